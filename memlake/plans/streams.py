"""Streams over the events table. Each equals the batch query over the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.operators import waiting as W
from memlake.plans import query
from memlake.shared import shared_folder
from memlake.sources.tables import load
from memlake.streaming import jobs


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.event_stream(spark, sf_dir, load(spark, sf_dir, "events").schema)


@query("select ts::date as day, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def stream_daily_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = jobs.run_available(jobs.daily_counts(_events(spark, sf_dir)), "complete")
    last = out.groupBy("window", "event_type").agg(F.max_by(F.struct("n", "total"), "__batch").alias("x"))
    return last.select(F.to_date("window.start").alias("day"), "event_type", F.col("x.n").alias("n"), F.round("x.total", 4).alias("total"))


@query("select event_id, event_type from events")
def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table, delivered twice, without repetitions."""
    twice = _events(spark, sf_dir).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    return jobs.run_available(jobs.deduplicated(twice, ["event_id"]), "append").select("event_id", "event_type")


@query("""
with g as (select user_id, ts, case when lag(ts) over w is null or ts - lag(ts) over w > interval 30 minutes then 1 else 0 end as fresh from events window w as (partition by user_id order by ts)),
s as (select user_id, ts, sum(fresh) over (partition by user_id order by ts, fresh desc rows unbounded preceding) as k from g)
select user_id, count(*) as sessions, max(n) as longest from (select user_id, k, count(*) as n from s group by 1, 2) group by 1
""")
def stream_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = jobs.run_available(jobs.sessions(_events(spark, sf_dir)), "complete")
    last = out.groupBy("session_window", "user_id").agg(F.max_by("n", "__batch").alias("n"))
    return last.groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("longest"))


@query("select a.event_id as asked_id, c.event_id as cleared_id, a.user_id from events a join events c on a.user_id = c.user_id and a.event_type = 'error' and c.event_type = 'signup' and c.ts > a.ts and c.ts <= a.ts + interval 1 day")
def stream_cleared_waits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.run_available(jobs.cleared_waits(_events(spark, sf_dir), "error", "signup"), "append")


_WAITS = r"""
n as (select client_id, trim(regexp_replace(regexp_replace(lower(coalesce(name, '')), '[^\p{L}\p{N}_\s]', '', 'g'), '\s+', ' ', 'g')) as name from clients),
w as (select sale_id as id, s.client_id, n.name, sold_at as ts from sales s left join n using (client_id) where status = 'open' and sold_at is not null),
m as (select distinct click_id as id, c.client_id, n.name, ts from clicks c left join n using (client_id) where kind <> 'view' and ts is not null),
hits as (select w.id, m.ts, m.id as who from w join m on w.client_id = m.client_id where m.ts > w.ts and m.ts <= w.ts + interval 30 days
  union select w.id, m.ts, m.id from w join m on w.name = m.name and w.name <> '' where m.ts > w.ts and m.ts <= w.ts + interval 30 days)
select id, arg_min(who, {'t': ts, 'b': who}) as cleared_by, min(ts) as cleared_at from hits group by 1
"""


def _waits(spark: SparkSession, sf_dir: str, read) -> tuple[DataFrame, DataFrame]:
    """Open sales wait for their client; whatever the client does but view is a message. Both by the client's id and name."""
    names = load(spark, sf_dir, "clients").select("client_id", "name")
    waits = read("sales").where("status = 'open'").join(names, "client_id", "left").select(F.col("sale_id").alias("id"), F.col("client_id").cast("string").alias("person"), "name", F.col("sold_at").cast("timestamp").alias("ts"))
    said = read("clicks").where("kind <> 'view'").join(names, "client_id", "left").select(F.col("click_id").alias("id"), F.col("client_id").cast("string").alias("person"), "name", F.col("ts").cast("timestamp").alias("ts"))
    return waits, said


@query(f"with {_WAITS}")
def waiting_cleared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Waits and the first message that ends each, over whole tables."""
    return W.replies(*_waits(spark, sf_dir, lambda name: load(spark, sf_dir, name)))


@query(f"with {_WAITS}")
def stream_waiting_cleared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as keyed state of a stream."""
    read = lambda name: jobs.table_stream(spark, sf_dir, name)
    return W.run_waiting(W.clear_waiting(*_waits(spark, sf_dir, read)), shared_folder(spark, "waiting"))
