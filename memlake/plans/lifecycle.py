"""State changes and queues over the stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memlake.operators import lifecycle as L
from memlake.plans import query
from memlake.sources.tables import actions, load, messages

AS_OF = "2024-02-01 00:00:00"


@query("select event_id, event_type as kind, case when cast(json_extract_string(props, '$.k') as bigint) % 2 = 0 then 'even' end as parity, user_id % 3 = 0 as kept from events")
def metadata_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON object patched: one key set, one taken away."""
    k = F.from_json("props", "k long")["k"]
    base = F.create_map(F.lit("kind"), F.col("event_type"), F.lit("parity"), F.lit("?"), F.lit("old"), F.lit("x"))
    patch = F.create_map(F.lit("parity"), F.when(k % 2 == 0, "even"), F.lit("old"), F.when(F.col("user_id") % 3 == 0, "y"))
    done = load(spark, sf_dir, "events").select("event_id", L.patched(base, patch).alias("m"))
    return done.select("event_id", F.col("m")["kind"].alias("kind"), F.col("m")["parity"].alias("parity"), F.map_contains_key("m", "old").alias("kept"))


@query("""
with o as (select s_suppkey as id, s_name as name, '' as note from supplier where s_suppkey % 4 <> 0), n as (select s_suppkey as id, case when s_suppkey % 2 = 0 then '' else upper(s_name) end as name, 'n' || s_suppkey as note from supplier where s_suppkey % 3 <> 0)
select coalesce(o.id, n.id) as id, coalesce(nullif(n.name, ''), o.name) as name, coalesce(nullif(n.note, ''), o.note) as note from o full join n on o.id = n.id
""")
def thread_context_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = load(spark, sf_dir, "supplier")
    old = s.where("s_suppkey % 4 <> 0").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.lit("").alias("note"))
    new = s.where("s_suppkey % 3 <> 0").select(F.col("s_suppkey").alias("id"), F.when(F.col("s_suppkey") % 2 == 0, "").otherwise(F.upper("s_name")).alias("name"), F.concat(F.lit("n"), "s_suppkey").alias("note"))
    return L.filled(old, new, "id", ["name", "note"])


@query("""
with a as (select o_orderkey as id, o_orderstatus as status, case when o_orderkey % 3 = 0 then 'F' when o_orderkey % 5 = 0 then 'P' end as wanted from orders)
select id, case when (status = 'O' and wanted in ('F', 'P')) or (status = 'P' and wanted = 'F') then wanted else status end as status, coalesce((status = 'O' and wanted in ('F', 'P')) or (status = 'P' and wanted = 'F'), false) as applied from a
""")
def guarded_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = actions(spark, sf_dir).select("id", "status")
    asked = a.select("id", F.when(F.col("id") % 3 == 0, "F").when(F.col("id") % 5 == 0, "P").alias("wanted")).where("wanted is not null")
    return L.transition(a, asked, "id", {"O": ["F", "P"], "P": ["F"]})


@query("""
select 'documents' as name, count(*) as n from documents where doc_id not in (select doc_id from labels where quality = 0) union all
select 'embeddings', count(*) from embeddings where vec_id not in (select doc_id from labels where quality = 0) union all select 'labels', count(*) from labels where doc_id not in (select doc_id from labels where quality = 0)
""")
def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = load(spark, sf_dir, "labels")
    tables = {"documents": load(spark, sf_dir, "documents").select("doc_id"), "embeddings": load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id")), "labels": labels.select("doc_id")}
    left = L.cascade(labels.where("quality = 0"), "doc_id", tables)
    counts = [d.agg(F.lit(name).alias("name"), F.count("*").alias("n")) for name, d in left.items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query("""
with f as (select source, min(doc_id) as first from documents group by 1 order by first, source limit 5) select doc_id, source from documents where source in (select source from f)
""")
def group_unenriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.first_groups(load(spark, sf_dir, "documents").select("doc_id", "source"), "source", "doc_id", 5)


@query("""
select conv_id, string_agg(text, '|' order by turn) as joined, count(*) as parts from conversations group by 1
""")
def regroup_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = messages(spark, sf_dir).select(F.col("thread_id").alias("conv_id"), "position", F.array("text").alias("texts"))
    return L.regrouped(parts, "conv_id", "position", "texts").select("conv_id", F.array_join("texts", "|").alias("joined"), "parts")


@query("""
with recursive r as (select source, doc_id, n_chars, row_number() over (partition by source order by doc_id) as rn from documents), g(source, rn, used, doc_id, kept) as (
  select source, rn, case when n_chars <= 4000 then n_chars else 0 end, doc_id, n_chars <= 4000 from r where rn = 1
  union all select r.source, r.rn, case when g.used + r.n_chars <= 4000 then g.used + r.n_chars else g.used end, r.doc_id, g.used + r.n_chars <= 4000 from g join r on r.source = g.source and r.rn = g.rn + 1 where r.rn <= 5)
select source, doc_id from g where kept
""")
def expand_budget_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.greedy_skip(load(spark, sf_dir, "documents").select("source", "doc_id", "n_chars"), ["source"], "doc_id", "n_chars", 4000, 5)


@query("select s_suppkey as id, case when s_suppkey % 7 = 0 then s_suppkey % 4 + 1 else 0 end as misses, s_suppkey % 7 = 0 and s_suppkey % 4 + 1 >= 3 as revoked from supplier")
def absence_counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") % 4).alias("misses"))
    return L.absent(s.where("id % 7 <> 0"), s, "id", "misses", 3)


@query("""
with n as (select lower(p_name || ' ' || p_type || ' ' || p_brand || ' ' || p_size) as k, p_partkey as id from part), l as (select * from n where id % 3 <> 0), r as (select * from n where id % 3 <> 1),
lo as (select k, min(id) as left_id from l group by 1 having count(*) = 1), ro as (select k, min(id) as right_id from r group by 1 having count(*) = 1) select left_id, right_id from lo join ro using (k)
""")
def slug_drift_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts on two sides that overlap, matched where a key is one part's alone on either side."""
    key = F.lower(F.concat_ws(" ", "p_name", "p_type", "p_brand", F.col("p_size").cast("string")))
    p = load(spark, sf_dir, "part").select(key.alias("k"), F.col("p_partkey").alias("id"))
    return L.unique_matches(p.where("id % 3 <> 0"), p.where("id % 3 <> 1"), "k")


@query("""
with t as (select o_orderkey as task, case when o_orderkey % 4 = 0 then o_orderkey end as ext, o_custkey as fp from orders where o_orderkey % 2 = 0), a as (select o_orderkey as id, o_orderkey as ext, o_custkey as fp from orders where o_orderkey % 3 = 0),
s as (select task, id, 'id' as how from t join a using (ext)), rt as (select *, row_number() over (partition by fp order by task) as n from t where task not in (select task from s)), ra as (select *, row_number() over (partition by fp order by id) as n from a where id not in (select id from s))
select * from s union all select task, id, case when task is null then 'gone' when id is null then 'new' else 'fingerprint' end from rt full join ra on rt.fp = ra.fp and rt.n = ra.n
""")
def task_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "orders")
    tasks = o.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("task"), F.when(F.col("o_orderkey") % 4 == 0, F.col("o_orderkey")).alias("ext"), F.col("o_custkey").alias("fp"))
    own = o.where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("ext"), F.col("o_custkey").alias("fp"))
    return L.reconcile(tasks, own, "ext", "fp")


@query("""
select min(p_partkey) as id, p_name as name from part where lower(p_name) in ('small', 'ring', 'small ring', 'the', 'the small', 'the small ring') group by p_name order by length(p_name) desc, p_name limit 1
""")
def query_intent(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = L.intent("the small ring", load(spark, sf_dir, "part").groupBy("p_name").agg(F.min("p_partkey").alias("p_partkey")), "p_name")
    return found.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))


@query(r"""
with u as (select conv_id, turn, list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) as w from conversations where role = 'user'), a as (select conv_id, turn - 1 as turn, list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) as w from conversations where role = 'assistant')
select u.conv_id, u.turn, round(case when len(u.w) < 5 then 0 else len(list_intersect(u.w, a.w)) / len(u.w) end, 6) as reuse from u join a using (conv_id, turn) where len(u.w) >= 5 and round(len(list_intersect(u.w, a.w)) / len(u.w), 6) >= 0.2
""")
def quoteback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions of which a fifth of the words comes back in the answer."""
    m = load(spark, sf_dir, "conversations").withColumn("turn", F.col("turn").cast("long"))
    asked = m.where("role = 'user'").withColumn("key", F.struct("conv_id", "turn"))
    said = m.where("role = 'assistant'").withColumn("key", F.struct("conv_id", (F.col("turn") - 1).alias("turn")))
    return L.quoted_back(asked, said, "key", 0.2).select("conv_id", "turn", "reuse")


@query("""
with c as (select 'orders' as t, 'o_totalprice' as col, o_totalprice::varchar as v from orders union all select 'orders', 'o_orderpriority', o_orderpriority from orders union all select 'part', 'p_size', p_size::varchar from part)
select t, col, count(*) filter (where v <> '') as n, round(sum(try_cast(v as double)), 2) as total from c group by 1, 2 having count(try_cast(v as double)) * 2 >= count(*)
""")
def table_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    cell = lambda t, c: load(spark, sf_dir, t).select(F.lit(t).alias("t"), F.lit(c).alias("col"), F.col(c).cast("string").alias("v"))
    cells = cell("orders", "o_totalprice").union(cell("orders", "o_orderpriority")).union(cell("part", "p_size"))
    return L.column_totals(cells, "t", "col", "v").withColumn("total", F.round("total", 2))


@query("""
with p as (select distinct l_suppkey as s, l_orderkey as o from lineitem) select x.s as a, y.s as b, count(*) as together from p x join p y on x.o = y.o and x.s < y.s group by 1, 2 having count(*) >= 30
""")
def co_occurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers met in one order. A group is an order, of few lines by its schema; tasks grow in number with the lines, not in size."""
    lines = load(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("s"), F.col("l_orderkey").alias("o"))
    return L.met_together(lines, 30)


@query("""
select c_custkey as id, o_orderkey, o_totalprice from (select c_custkey, o_orderkey, o_totalprice, row_number() over (partition by c_custkey order by o_orderdate desc, o_orderkey desc) as rn from customer join orders on c_custkey = o_custkey where c_acctbal < 0) where rn <= 3
""")
def draft_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest three of each."""
    c = load(spark, sf_dir, "customer").where("c_acctbal < 0").select("c_custkey")
    met = load(spark, sf_dir, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"))
    rn = F.row_number().over(Window.partitionBy("c_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")))
    return met.withColumn("rn", rn).where("rn <= 3").select(F.col("c_custkey").alias("id"), "o_orderkey", "o_totalprice")


@query("select event_id, event_type from (select *, row_number() over (partition by event_type order by value desc, event_id) as rn from events) where rn <= 20")
def capped_per_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    rn = F.row_number().over(Window.partitionBy("event_type").orderBy(F.desc("value"), "event_id"))
    return load(spark, sf_dir, "events").withColumn("rn", rn).where("rn <= 20").select("event_id", "event_type")


@query(f"select event_id, user_id from events where event_type in ('signup', 'purchase') and ts >= timestamp '{AS_OF}' - interval 7 days and ts < timestamp '{AS_OF}' order by ts desc, event_id desc limit 20")
def inbox_today(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events")
    end = F.lit(AS_OF).cast("timestamp_ntz")
    recent = e.where(F.col("event_type").isin("signup", "purchase") & (F.col("ts") >= end - F.expr("interval 7 days")) & (F.col("ts") < end))
    return recent.orderBy(F.desc("ts"), F.desc("event_id")).limit(20).select("event_id", "user_id")


@query("""
with w as (select date_diff('day', o_orderdate::date, date '2001-08-01') // 90 as k, count(*) as n from orders where o_orderpriority = '1-URGENT' and o_totalprice > 300000 group by 1)
select k as window_no, n from w where k < coalesce((select min(k) from (select range as k from range(0, 100)) g where not exists (select 1 from w where w.k between g.k and g.k + 3)), 1000)
""")
def progressive_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 90 days backwards until four in a row are empty: gaps between windows that have rows."""
    day = F.datediff(F.lit("2001-08-01").cast("date"), F.col("o_orderdate").cast("date"))
    w = load(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT' and o_totalprice > 300000").groupBy(F.floor(day / 90).alias("window_no")).agg(F.count("*").alias("n"))
    order = Window.orderBy("window_no")
    gap = w.withColumn("empty", F.col("window_no") - F.coalesce(F.lag("window_no").over(order), F.lit(-1)) - 1)
    stopped = F.max((F.col("empty") >= 4).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return gap.withColumn("stopped", stopped).where("stopped = 0").select("window_no", "n")


@query("""
with r as (select * from lineitem where l_orderkey > (select max(o_orderkey) * 9 // 10 from orders)) select 'relation' as kind, count(*) as n from r union all select 'entity', count(*) from supplier where s_suppkey in (select l_suppkey from r)
""")
def delta_since_watermark(spark: SparkSession, sf_dir: str) -> DataFrame:
    mark = load(spark, sf_dir, "orders").agg(F.floor(F.max("o_orderkey") * 9 / 10).alias("mark"))
    r = load(spark, sf_dir, "lineitem").join(F.broadcast(mark), F.col("l_orderkey") > F.col("mark"))
    ends = load(spark, sf_dir, "supplier").join(r.select(F.col("l_suppkey").alias("s_suppkey")), "s_suppkey", "left_semi")
    return r.agg(F.lit("relation").alias("kind"), F.count("*").alias("n")).union(ends.agg(F.lit("entity"), F.count("*")))


@query("""
with s as (select doc_id, 1.0 / (1 + doc_id % 17) as score from documents), q as (select user_id as doc_id, 1 + 0.5 * count(*) / (count(*) + 3.0) as quality from events where event_type in ('purchase', 'signup') group by 1)
select doc_id, round(score * (1 + 0.3 * (coalesce(quality, 1) - 1)), 6) as score from s left join q using (doc_id)
""")
def quality_multiplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = load(spark, sf_dir, "events").where("event_type in ('purchase', 'signup')").groupBy(F.col("user_id").alias("doc_id")).agg((1 + 0.5 * F.count("*") / (F.count("*") + 3.0)).alias("quality"))
    hits = load(spark, sf_dir, "documents").select("doc_id", (1.0 / (1 + F.col("doc_id") % 17)).alias("score")).join(used, "doc_id", "left")
    return hits.select("doc_id", F.round(F.col("score") * (1 + 0.3 * (F.coalesce("quality", F.lit(1.0)) - 1)), 6).alias("score"))


@query("""
select doc_id, max(score) as score from (select doc_id, 1 + doc_id % 5 as score from documents where doc_id % 2 = 0 union all select doc_id, doc_id % 9 from documents where doc_id % 3 = 0) group by 1
""")
def merge_hit_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = load(spark, sf_dir, "documents").select("doc_id")
    both = d.where("doc_id % 2 = 0").withColumn("score", 1 + F.col("doc_id") % 5).union(d.where("doc_id % 3 = 0").withColumn("score", F.col("doc_id") % 9))
    return both.groupBy("doc_id").agg(F.max("score").alias("score"))
