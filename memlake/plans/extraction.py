"""Orders as extractions of threads, applied to the graph in batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.operators import extraction as X
from memlake.plans import query
from memlake.shared import exists, fingerprint, shared_folder, stored
from memlake.sources.store import TableSet
from memlake.sources.tables import load

AS_OF = "2000-01-01"
_applied: dict[tuple, TableSet] = {}

_LINES = """
lines as (
  select l_orderkey, 's' || l_suppkey as s, l_quantity as q, l_shipdate::date as due, l_returnflag as flag, p_brand,
    case l_returnflag when 'R' then 'return ' when 'A' then 'accept ' else 'deliver ' end || p_name as what,
    row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity, l_returnflag) as rn
  from lineitem join part on p_partkey = l_partkey
), o as (
  select o_orderkey, 'o' || o_orderkey as thread_id, 'm' || o_orderkey as message_id, o_orderdate::date as day, c_name, n_name, o_orderstatus as status, o_orderpriority as priority
  from orders join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey
  where o_orderkey in (select l_orderkey from lines)
)"""


def extractions(spark: SparkSession, sf_dir: str, pending: bool = False) -> DataFrame:
    """One extraction an order, or a pending order: its customer and suppliers, who buys from whom, brands as topics, an action a line; open and pending orders are in the inbox."""
    verb = F.when(F.col("l_returnflag") == "R", "return ").when(F.col("l_returnflag") == "A", "accept ").otherwise("deliver ")
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_returnflag", F.concat(verb, "p_name").alias("what"), "p_brand")
    orders = load(spark, sf_dir, "orders")
    items = load(spark, sf_dir, "lineitem")
    if pending:
        orders = orders.where("o_orderstatus = 'P'")
        items = items.join(X.few(orders.select(F.col("o_orderkey").alias("l_orderkey"))), "l_orderkey", "left_semi")
    lines = items.join(load(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).groupBy("l_orderkey").agg(F.sort_array(F.collect_list(line)).alias("lines"))
    orders = orders.join(load(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(load(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    rows = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    supplier = lambda x: F.concat(F.lit("s"), x["l_suppkey"].cast("string"))
    account = F.struct(F.col("c_name").alias("name"), F.lit("account").alias("kind"), F.col("n_name").alias("org"), F.lit(None).cast("string").alias("email"))
    makers = F.transform("lines", lambda x: F.struct(F.concat(F.lit("Supplier "), supplier(x)).alias("name"), F.lit("org").alias("kind"), F.lit(None).cast("string").alias("org"), F.lit(" ").alias("email")))
    return rows.select(
        F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("thread_id"),
        F.lit("mail").alias("org"),
        F.when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "notification").otherwise("mail").alias("content_type"),
        (F.col("o_orderstatus") != "F").alias("in_inbox"),
        F.col("o_orderpriority").alias("summary"),
        F.transform("lines", lambda x: x["p_brand"]).alias("topics"),
        F.array(F.struct(F.concat(F.lit("m"), F.col("o_orderkey").cast("string")).alias("message_id"), F.col("o_orderdate").cast("date").alias("day"), F.col("c_name").alias("sender"))).alias("messages"),
        F.concat(F.array(account), makers).alias("entities"),
        F.transform("lines", lambda x: F.struct(F.col("c_name").alias("a"), F.lit("buys from").alias("relation"), F.concat(F.lit("Supplier "), supplier(x)).alias("b"), x["l_quantity"].cast("double").alias("strength"))).alias("relations"),
        F.transform("lines", lambda x: F.struct(x["what"].alias("description"), F.col("c_name").alias("owner"), x["l_shipdate"].cast("date").alias("due"))).alias("actions"),
        F.when(F.col("o_orderstatus") == "P", F.transform(F.filter("lines", lambda x: x["l_returnflag"] == "R"), lambda x: x["what"])).alias("resolved"),
    )


def applied(spark: SparkSession, sf_dir: str) -> TableSet:
    """All orders applied in one batch, then pending ones once more, with what they resolve, twice."""
    key = spark.sparkContext.applicationId, fingerprint(spark, f"{sf_dir}/lineitem.parquet"), fingerprint(spark, f"{sf_dir}/orders.parquet")
    if key not in _applied or not exists(spark, _applied[key].root):
        rows = extractions(spark, sf_dir)
        tables = TableSet(spark, shared_folder(spark, "applied"))
        X.apply(tables, rows.withColumn("resolved", F.lit(None).cast("array<string>")), AS_OF)
        pending = stored(extractions(spark, sf_dir, pending=True).where("resolved is not null"), "pending")
        for _ in range(2):
            X.apply(tables, pending, AS_OF)
        _applied[key] = tables
    return _applied[key]


_SLUG = "trim(regexp_replace(lower({}), '[^a-z0-9]+', '-', 'g'), '-')"


@query(f"""
with {_LINES}, n as (
  select 'account:' || {_SLUG.format('c_name')} as entity, c_name as name, 'account' as kind, n_name as org, message_id, day from o
  union select 'org:' || {_SLUG.format("'Supplier ' || s")}, 'Supplier ' || s, 'org', null, message_id, day from lines join o on o_orderkey = l_orderkey
)
select entity, min(name) as name, min(kind) as kind, min(org) as org, null as email, min(day) as first_seen, max(day) as last_seen, count(distinct message_id)::bigint as n_messages from n group by 1
""")
def applied_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities after batches of extractions: counted by their links, so that a batch applied twice counts once."""
    return applied(spark, sf_dir).read("entities")


@query(f"""
with {_LINES}
select thread_id, 'account:' || {_SLUG.format('c_name')} as a, 'buys from' as relation, 'org:' || {_SLUG.format("'Supplier ' || s")} as b, sum(q)::double as strength, min(day) as valid_from
from lines join o on o_orderkey = l_orderkey group by all
""")
def applied_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return applied(spark, sf_dir).read("relations")


@query(f"""
with {_LINES}, t as (select l_orderkey, array_to_string(list(b order by first), ', ') as topics from (select l_orderkey, lower(p_brand) as b, min(rn) as first from lines group by 1, 2) group by 1)
select thread_id, message_id, day, 'mail' as org, case priority when '4-NOT SPECIFIED' then 'notification' else 'mail' end as content_type, priority as summary, topics from o join t on o_orderkey = l_orderkey
""")
def applied_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return applied(spark, sf_dir).read("digests")


@query(f"""
with recursive {_LINES}, gated as (
  select * from o where priority <> '4-NOT SPECIFIED' and (status <> 'F' or date_diff('day', day, date '{AS_OF}') <= 60)
), own as (
  -- within a thread: each against those kept before it
  select thread_id, list_reduce(list({{'what': what, 'due': due, 'kept': [what]}} order by rn), lambda acc, x: case when len(list_filter(acc.kept,
      lambda k: k = x.what or contains(k, x.what) or contains(x.what, k) or len(list_intersect(string_split(k, ' '), string_split(x.what, ' '))) >= 0.75 * len(list_distinct(string_split(k, ' ') || string_split(x.what, ' '))))) > 0
    then acc else {{'what': acc.what, 'due': acc.due, 'kept': acc.kept || x.kept}} end).kept as kept
  from gated join lines on l_orderkey = o_orderkey group by 1
), proposed as (
  select thread_id, c_name as owner, day, what, sha256(thread_id || chr(10) || what) as action, (select min_by(due, rn) from lines where l_orderkey = o_orderkey and lines.what = k.what) as due
  from (select thread_id, unnest(kept) as what from own) k join gated using (thread_id)
), ordered as (select *, row_number() over (partition by owner order by day, action) as rn from proposed
), greedy as (
  -- across an owner's threads: each against those kept before it
  select owner, rn, action, true as keep, [{{'what': what, 'day': day}}] as kept from ordered where rn = 1
  union all
  select owner, rn, action, keep, case when keep then list_filter(kept, lambda k: date_diff('day', k.day, day) <= 7) || [{{'what': what, 'day': day}}] else kept end
  from (select o.*, g.kept, len(list_filter(g.kept, lambda k: date_diff('day', k.day, o.day) <= 7 and (k.what = o.what or (
      least(length(k.what), length(o.what)) >= 0.6 * greatest(length(k.what), length(o.what)) and (list_has_all(string_split(k.what, ' '), string_split(o.what, ' ')) or list_has_all(string_split(o.what, ' '), string_split(k.what, ' '))
        or len(list_intersect(string_split(k.what, ' '), string_split(o.what, ' '))) >= 0.85 * len(list_distinct(string_split(k.what, ' ') || string_split(o.what, ' ')))))))) = 0 as keep
    from greedy g join ordered o on o.owner = g.owner and o.rn = g.rn + 1)
)
select p.action, p.thread_id, p.owner, 'account:' || {_SLUG.format('p.owner')} as owner_entity, p.what as text, p.what as norm, p.due, p.day,
  case when r.what is null then 'open' else 'done' end as status, case when r.what is not null then 'm' || substr(p.thread_id, 2) end as resolved_by
from proposed p join greedy g using (action) left join (select distinct thread_id, what from lines join o on o_orderkey = l_orderkey where status = 'P' and flag = 'R') r on r.thread_id = p.thread_id and r.what = p.what
where g.keep
""")
def applied_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Actions past the gates, without those much the same as one kept before, in the thread and across the owner's threads; resolved ones are done."""
    return applied(spark, sf_dir).read("actions")
