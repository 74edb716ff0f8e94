"""Feedback, decay, tiers, salience, arms and drift, over events and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.operators import memory as M
from memlake.plans import query
from memlake.sources.tables import feedback, load

AS_OF = "2024-02-01 00:00:00"
_SEEN = f"select user_id as doc_id, count(*) * 0.5 as strength, epoch(timestamp '{AS_OF}' - max(ts)) / 86400.0 as days_since, 1 + user_id % 9 as salience from events group by 1, 4"
_R = "case when days_since <= 0 then 1.0 else exp(-days_since / greatest(case when strength <= 0 then 5.0 else strength end, 0.1)) end"


def _seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = load(spark, sf_dir, "events").groupBy(F.col("user_id").alias("doc_id"))
    return events.agg((F.count("*") * 0.5).alias("strength"), M.age_days(AS_OF, F.max(F.col("ts").cast("timestamp"))).alias("days_since")).withColumn("salience", 1 + F.col("doc_id") % 9)


@query(f"""
with e as (select user_id as doc_id, event_type in ('purchase', 'signup') as used, exp(-ln(2) * (epoch(timestamp '{AS_OF}' - ts) / 86400.0) / 90.0) as w from events where event_type in ('purchase', 'signup', 'view')),
s as (select doc_id, sum(case when used then w else 0 end) as u, count(*) filter (where used) as uses, count(*) filter (where not used) as exposures from e group by 1)
select doc_id, round(1 + 0.5 * u / (u + 3), 6) as quality, uses, exposures from s where u > 0
""")
def feedback_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.feedback_quality(feedback(spark, sf_dir), AS_OF)


@query(f"select doc_id, round({_R}, 6) as retention, {_R} < 0.25 and salience < 6 as cold from ({_SEEN})")
def ebbinghaus_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.decay_pass(_seen(spark, sf_dir)).select("doc_id", "retention", "cold")


@query(f"select count(*) as n, count(*) filter (where {_R} < 0.25 and salience < 6) as demoted, count(*) filter (where {_R} < 0.25 and salience >= 6) as exempt from ({_SEEN})")
def decay_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a pass would change, without changing it."""
    done = M.decay_pass(_seen(spark, sf_dir))
    return done.agg(F.count("*").alias("n"), F.count_if("cold").alias("demoted"), F.count_if((F.col("retention") < M.COLD_BELOW) & ~F.col("cold")).alias("exempt"))


@query(f"""
with s as (select doc_id, strength, salience, case doc_id % 4 when 0 then '' when 1 then 'warm' when 2 then 'hot' else 'core' end as tier from ({_SEEN}))
select doc_id, tier, case when strength >= 7 and tier in ('', 'warm') then 'hot' when salience < 3.5 and tier not in ('core', 'hot') then 'cold' else tier end as next_tier from s
""")
def tier_transition(spark: SparkSession, sf_dir: str) -> DataFrame:
    tier = F.element_at(F.array(F.lit(""), F.lit("warm"), F.lit("hot"), F.lit("core")), (F.col("doc_id") % 4 + 1).cast("int"))
    return _seen(spark, sf_dir).select("doc_id", tier.alias("tier"), M.next_tier(tier, F.col("strength"), F.col("salience")).alias("next_tier"))


@query(f"""
with e as (select event_id, event_type as t, cast(json_extract_string(props, '$.k') as bigint) as k, user_id, epoch(timestamp '{AS_OF}' - ts) / 86400.0 as age from events)
select event_id, round(greatest(1.0, least(10.0, 3.0 + case when k % 3 >= 1 then 1.5 else 0 end + case when k % 3 >= 2 then 0.5 else 0 end + case when t = 'purchase' then 1.5 else 0 end
  + case when k % 5 = 0 then 1.0 else 0 end + case when k % 7 = 0 then 0.5 else 0 end - case when t = 'click' then 1.5 else 0 end + least(1.5, 0.3 * (user_id % 8))
  + case when t = 'signup' then 0.5 else 0 end - case when t = 'error' then 2.0 else 0 end + case when age < 7 then 2.0 when age < 30 then 1.0 when age < 90 then 0.5 else 0 end)), 2) as salience from e
""")
def salience_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, kind = F.from_json("props", "k long")["k"], F.col("event_type")
    source = F.when(kind == "signup", "calendar").otherwise("gmail")
    score = M.salience(k % 3, kind == "purchase", k % 5 == 0, k % 7 == 0, kind == "click", F.col("user_id") % 8, source, kind == "error", M.age_days(AS_OF, F.col("ts").cast("timestamp")))
    return load(spark, sf_dir, "events").select("event_id", score.alias("salience"))


@query("select user_id % 5 as arm, count(*) filter (where event_type in ('purchase', 'signup')) + 1.0 as alpha, count(*) filter (where event_type not in ('purchase', 'signup')) + 1.0 as beta, round((count(*) filter (where event_type in ('purchase', 'signup')) + 1.0) / (count(*) + 2.0), 6) as mean from events group by 1")
def bandit_posterior(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = load(spark, sf_dir, "events").withColumn("arm", F.col("user_id") % 5)
    return M.arm_posterior(events, "arm", F.col("event_type").isin("purchase", "signup"))


@query("select user_id % 5 as arm, 200 as rounds, (count(*) filter (where event_type in ('purchase', 'signup')) + 1.0) / (count(*) + 2.0) between 0 and 1 as mean_within from events group by 1")
def bandit_sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two hundred rounds of Thompson sampling: each arm's mean draw is within four standard errors of its posterior's mean."""
    arms = bandit_posterior(spark, sf_dir).select("arm", F.col("alpha").cast("double").alias("alpha"), F.col("beta").cast("double").alias("beta"))
    drawn = M.thompson(arms, "arm", 7, 200).groupBy("arm").agg(F.count("*").cast("int").alias("rounds"), F.avg("draw").alias("m"))
    a, b = F.col("alpha"), F.col("beta")
    error = F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)) / 200)
    return drawn.join(arms, "arm").select("arm", "rounds", (F.abs(F.col("m") - a / (a + b)) <= 4 * error).alias("mean_within"))


@query("select count(*) as days, round(avg(m), 6) as baseline, round(greatest(0.05, 2 * stddev_pop(m)), 6) as floor from (select ts::date as day, avg(value) as m from events group by 1)")
def drift_noise_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.noise_floor(load(spark, sf_dir, "events"), "ts", "value")


@query("""
select event_type, count(*) as n, round(epoch(max(ts) - min(ts)) / 86400.0, 6) as span_days, count(*) >= 100 and epoch(max(ts) - min(ts)) / 86400.0 >= 14 as ready from events group by 1
""")
def accept_span_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = F.col("ts").cast("timestamp")
    span = (F.unix_micros(F.max(ts)) - F.unix_micros(F.min(ts))) / 86400e6
    return load(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(span, 6).alias("span_days"), ((F.count("*") >= 100) & (span >= 14)).alias("ready"))
