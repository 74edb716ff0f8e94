"""Lookups, reports and upkeep over the stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memlake.operators import upkeep as U
from memlake.plans import query
from memlake.sources.tables import load, messages

AS_OF = "2024-02-01 00:00:00"


@query("select s_suppkey as id, s_name as name, 1 as how from supplier where lower(regexp_replace(s_name, '[^A-Za-z0-9]+', '-', 'g')) = 'supplier-000000007' order by 1 limit 1")
def entity_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.find_entity(load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")), "Supplier 000000007")


@query("select doc_id, row_number() over (order by n_chars, doc_id) - 1 as position from documents where doc_id not in (select doc_id from labels where toxic = 1)")
def drop_cold_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", F.struct("n_chars", "doc_id").alias("position"))
    return U.in_order(docs, load(spark, sf_dir, "labels").where("toxic = 1"), "doc_id", "position")


@query("select o_orderkey as id, l_linenumber as line from orders left join lineitem on l_orderkey = o_orderkey where o_orderpriority = '1-URGENT' and o_orderstatus = 'O' order by o_orderdate desc, o_orderkey, l_linenumber, l_partkey limit 30")
def ownerless_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A left join that fans out, the newest thirty rows."""
    o = load(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT' and o_orderstatus = 'O'")
    met = o.join(load(spark, sf_dir, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return met.orderBy(F.desc("o_orderdate"), "o_orderkey", F.asc_nulls_last("l_linenumber"), F.asc_nulls_last("l_partkey")).limit(30).select(F.col("o_orderkey").alias("id"), F.col("l_linenumber").alias("line"))


@query("""
with c as (select source, lang as label, count(*) as n from documents group by 1, 2) select source, sum(n)::bigint as n, string_agg(label || ': ' || n, ', ' order by n desc, label) as detail from c group by 1
""")
def skip_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.detail(load(spark, sf_dir, "documents"), ["source"], F.col("lang"))


@query("select source, count(*) as n, count(*) filter (where n_chars >= 200) as kept, count(*) filter (where n_chars < 200) as gated, round(100.0 * count(*) filter (where n_chars >= 200) / count(*), 2) as pct from documents group by 1")
def gate_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = F.count_if(F.col("n_chars") >= 200)
    return load(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"), kept.alias("kept"), F.count_if(F.col("n_chars") < 200).alias("gated"), F.round(100.0 * kept / F.count("*"), 2).alias("pct"))


@query(f"""
with a as (select user_id, epoch(timestamp '{AS_OF}' - max(ts)) / 86400.0 as d from events group by 1)
select user_id, case when d < 1 then 'today' when d < 2 then 'yesterday' when d < 14 then floor(d)::bigint || ' days' else floor(d / 7)::bigint || ' weeks' end as seen, d > 3 as stale from a
""")
def beacon_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = (F.unix_micros(F.lit(AS_OF).cast("timestamp")) - F.unix_micros(F.max(F.col("ts").cast("timestamp")))) / 86400e6
    rows = load(spark, sf_dir, "events").groupBy("user_id").agg(days.alias("d"))
    return rows.select("user_id", U.age_label(F.col("d")).alias("seen"), (F.col("d") > 3).alias("stale"))


@query("select doc_id, doc_id % 5 as version from documents where doc_id % 5 < 3 order by doc_id % 5, doc_id limit 100")
def reflow_outdated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.reflow(load(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 5).alias("version")), "version", 3, ["version", "doc_id"], 100)


@query("select user_id, count(*) as attempts from events where event_type = 'error' group by 1 having count(*) >= 15")
def attempts_given_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.given_up(load(spark, sf_dir, "events").where("event_type = 'error'"), "user_id", 15)[1]


@query("select o_custkey as id, string_agg('- ' || o_orderdate::date || ' ' || o_orderkey, chr(10) order by o_orderkey) filter (where o_orderdate::date >= date '1999-01-01') as text from orders group by 1 having count(*) filter (where o_orderdate::date >= date '1999-01-01') > 0")
def prune_dated_bullets(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat(F.lit("- "), F.col("o_orderdate").cast("date").cast("string"), F.lit(" "), "o_orderkey")
    lists = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("o_orderkey", line.alias("t")))), lambda x: x["t"]), "\n")
    notes = load(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(lists.alias("text"))
    return notes.select("id", U.pruned_bullets(F.col("text"), "1999-01-01").alias("text")).where("text <> ''")


@query(r"""
with t as (select p_partkey as id, lower(p_name) as w from part), q as (select id, regexp_replace(w, '^(?:(?:red|small) )+', '') as w from t),
s as (select id, case when regexp_matches(w, '(ss|us|is)$') then w when regexp_matches(w, '[^aeiou]ies$') then regexp_replace(w, 'ies$', 'y') when regexp_matches(w, '(ch|sh|x|z|s)es$') then regexp_replace(w, 'es$', '') else regexp_replace(w, 's$', '') end as w from q)
select id, case w when 'widget' then 'gadget' else w end as topic from s
""")
def topic_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), U.topic(F.col("p_name"), {"widget": "gadget"}, ["red", "small"]).alias("topic"))


@query("""
with recursive n as (select s_suppkey as id, case when s_suppkey // 2 <> s_suppkey then s_suppkey // 2 end as up, s_name as name from supplier), r(id, top, path, k) as (select id, up, name, 1 from n union all select r.id, n.up, n.name || '/' || r.path, k + 1 from r join n on r.top = n.id where r.k < 8)
select id, arg_max(r.path, r.k) as path from r group by 1
""")
def folder_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.floor(F.col("s_suppkey") / 2).alias("up"), F.col("s_name").alias("name"))
    return U.paths(n, "id", "up", "name")


@query("select bool_or(contains(lower(text), 'reation') or contains(lower(text), 'token')) as mentioned, count(*) filter (where contains(lower(text), 'reation') or contains(lower(text), 'token')) as texts from conversations")
def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.first_mention(messages(spark, sf_dir), ["Reation", "token", "abc"])


@query("""
select doc_id, used from (select doc_id, sum(least(length(text), 200)) over (order by n_chars desc, doc_id rows unbounded preceding) as used from documents where lang = 'en') where used <= 2000
""")
def core_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The block is a running budget over all candidates."""
    core = load(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id", "n_chars", F.least(F.char_length("text"), F.lit(200)).alias("size"))
    return U.running(core, [], [F.desc("n_chars"), F.asc("doc_id")], F.col("size"), "used").where("used <= 2000").select("doc_id", "used")
