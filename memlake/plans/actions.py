"""Action lists over orders and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.operators import actions as A
from memlake.plans import query
from memlake.sources.tables import actions, load, messages

AS_OF = "2001-07-30"
_BUCKETED = f"""select o_orderkey as id, o_custkey % 50 as owner, case when o_orderdate::date < date '{AS_OF}' then 'overdue' when o_orderdate::date = date '{AS_OF}' then 'due_today'
  when o_orderdate::date <= date '{AS_OF}' + 7 then 'upcoming' end as bucket, o_orderdate::date as deadline from orders where o_orderstatus = 'O'"""


def _bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    open_ones = actions(spark, sf_dir).where("status = 'O'")
    return open_ones.select("id", (F.col("owner") % 50).alias("owner"), A.bucket(F.col("deadline"), AS_OF).alias("bucket"), "deadline")


@query(f"select bucket, count(*) as n, min(deadline) as first, max(deadline) as last from ({_BUCKETED}) group by 1")
def action_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bucketed(spark, sf_dir).groupBy("bucket").agg(F.count("*").alias("n"), F.min("deadline").alias("first"), F.max("deadline").alias("last"))


@query(f"""
with b as (select * from ({_BUCKETED}) where bucket is not null),
r as (select *, row_number() over (partition by owner, bucket order by deadline desc, id) as rn from b),
q as (select *, greatest(0, rn - case bucket when 'upcoming' then 2 else 3 end) as t, case bucket when 'overdue' then 1 when 'due_today' then 2 else 3 end as p from r)
select owner, id, bucket, pick from (select *, row_number() over (partition by owner order by t, p, rn) as pick from q) where pick <= 8
""")
def action_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _bucketed(spark, sf_dir).where("bucket is not null")
    return A.round_robin(rows, "owner", "bucket", [F.desc("deadline"), F.asc("id")], 8).select("owner", "id", "bucket", "pick")


@query(f"""
with a as (select o_orderkey as id, case when o_orderpriority <> '1-URGENT' then o_orderdate::date end as deadline, o_orderdate::date as created from orders where o_orderstatus = 'O')
select id, marker from (select id, case when deadline is null and created < date '{AS_OF}' - 120 then 'ttl' when deadline < date '{AS_OF}' - 730 then 'ttl_overdue' end as marker from a) where marker is not null
""")
def action_ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = actions(spark, sf_dir).where("status = 'O'").select("id", F.when(F.col("priority") != "1-URGENT", F.col("deadline")).alias("deadline"), F.col("deadline").alias("created"))
    return rows.select("id", A.ttl(F.col("deadline"), F.col("created"), AS_OF).alias("marker")).where("marker is not null")


@query("""
with k as (select o_custkey, o_orderpriority, min(o_orderkey) as kept from orders where o_orderstatus = 'O' group by 1, 2)
select o_orderkey as id, kept from orders join k using (o_custkey, o_orderpriority) where o_orderstatus = 'O' and o_orderkey <> kept
""")
def action_dedup_min_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.first_of_each(actions(spark, sf_dir).where("status = 'O'"), ["owner", "priority"], "id")


@query("""
with a as (select o_orderkey as id, o_custkey % 200 as owner, o_orderdate::date as day, list_distinct(regexp_extract_all(lower(o_orderpriority || ' ' || o_orderstatus), '[\\p{L}\\p{N}]+')) as w from orders)
select x.id as a, y.id as b, round(len(list_intersect(x.w, y.w)) / len(list_distinct(x.w || y.w)), 6) as similarity from a x join a y on x.owner = y.owner and x.id < y.id and abs(date_diff('day', x.day, y.day)) <= 7
where round(len(list_intersect(x.w, y.w)) / len(list_distinct(x.w || y.w)), 6) >= 0.85
""".replace("\\\\", "\\"))
def action_near_dup_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = actions(spark, sf_dir).select("id", (F.col("owner") % 200).alias("owner"), F.col("deadline").alias("day"), F.concat_ws(" ", "priority", "status").alias("text"))
    return A.near_duplicates(rows, "owner", "id", "day", "text")


@query(r"""
with t as (select conv_id, turn, role, lower(text || case conv_id % 6 + turn % 3 when 1 then ' It is Sorted.' when 2 then ' abandoned' when 3 then ' all good' when 4 then ' all good, but not done' when 5 then ' received, thanks' else '' end) as t from conversations),
m as (select conv_id, turn from t where (regexp_matches(t, '\b(done|resolved|completed|sorted|handled)\b') or regexp_matches(t, 'taken care of|sent through|no longer needed|all good|received, thanks|received with thanks'))
  and not regexp_matches(t, 'not done|get it done|get this done|well done|yet to be|to be done|isn''t done|still need'))
select c.conv_id as thread_id, c.turn as position, exists (select 1 from m where m.conv_id = c.conv_id and m.turn > c.turn) as stale from conversations c where role = 'user'
""")
def stale_actions_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A later message of the thread says that it is settled: by the thread's last such message, one aggregate instead of a theta join."""
    kind = F.col("thread_id") % 6 + F.col("position") % 3
    said = F.when(kind == 1, " It is Sorted.").when(kind == 2, " abandoned").when(kind == 3, " all good").when(kind == 4, " all good, but not done").when(kind == 5, " received, thanks").otherwise("")
    m = messages(spark, sf_dir).withColumn("text", F.concat("text", said))
    last = m.where(A.signals_resolution(F.col("text"))).groupBy("thread_id").agg(F.max("position").alias("last"))
    asked = m.where("role = 'user'").join(last, "thread_id", "left")
    return asked.select("thread_id", "position", F.coalesce(F.col("last") > F.col("position"), F.lit(False)).alias("stale"))


@query("""
with w as (select o_orderkey as id, o_custkey as who from orders where o_orderstatus = 'P'), e as (select user_id, min(event_id) as cleared_by from events where event_type = 'signup' group by 1)
select id, cleared_by from w join e on w.who = e.user_id
""")
def waiting_on_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Waiting actions, cleared by the first signal of the one waited for."""
    waiting = actions(spark, sf_dir).where("status = 'P'").select("id", "owner")
    first = load(spark, sf_dir, "events").where("event_type = 'signup'").groupBy(F.col("user_id").alias("owner")).agg(F.min("event_id").alias("cleared_by"))
    return waiting.join(first, "owner").select("id", "cleared_by")
