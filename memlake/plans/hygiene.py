"""Checks, findings, contracts and federation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.operators import hygiene as H
from memlake.plans import query
from memlake.sources.tables import load


@query("select c_mktsegment as type, n_name as org, count(*) as n, count(*) filter (where c_acctbal < 0) as in_debt from customer join nation on c_nationkey = n_nationkey group by grouping sets ((c_mktsegment), (n_name), ())")
def lint_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir, "customer").join(F.broadcast(load(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_mktsegment").alias("type"), F.col("n_name").alias("org"), "c_acctbal")
    return c.groupingSets([["type"], ["org"], []], "type", "org").agg(F.count("*").alias("n"), F.count_if(F.col("c_acctbal") < 0).alias("in_debt"))


@query("select c_custkey as id, c_acctbal as balance from customer where c_nationkey % 5 = 0 order by c_acctbal desc, c_custkey limit 50")
def lint_missing_org(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "customer").where("c_nationkey % 5 = 0").orderBy(F.desc("c_acctbal"), "c_custkey").limit(50).select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"))


@query("""
select count(*) as relations, count(distinct l_suppkey) as senders, round(100.0 * count(*) filter (where l_returnflag = 'R') / count(*), 4) as returned_pct,
  round(100.0 * count(*) filter (where l_linestatus = 'O') / count(*), 4) as open_pct from lineitem
""")
def graph_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    share = lambda c: F.round(100.0 * F.count_if(c) / F.count("*"), 4)
    return load(spark, sf_dir, "lineitem").agg(F.count("*").alias("relations"), F.countDistinct("l_suppkey").alias("senders"), share(F.col("l_returnflag") == "R").alias("returned_pct"), share(F.col("l_linestatus") == "O").alias("open_pct"))


@query()
def dup_org_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spellings of market segments against the canonical ones: of each that is none, the most like it, if it is like enough."""
    spelt = F.when(F.col("c_custkey") % 4 == 0, F.concat(F.lit("The "), F.initcap("c_mktsegment"), F.lit(" Group"))).when(F.col("c_custkey") % 4 == 1, F.substring("c_mktsegment", 1, 6)).when(F.col("c_custkey") % 4 == 2, F.concat(F.lit("zz"), F.col("c_nationkey").cast("string"))).otherwise(F.col("c_mktsegment"))
    return H.org_variants(load(spark, sf_dir, "customer").select(spelt.alias("org")), ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"])


@query("select o_orderkey as id from orders where o_orderpriority = '1-URGENT' union select l_orderkey from lineitem where l_quantity >= 49 union select o_orderkey from orders where o_totalprice > 400000")
def union_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, line = load(spark, sf_dir, "orders"), load(spark, sf_dir, "lineitem")
    keys = o.where("o_orderpriority = '1-URGENT' or o_totalprice > 400000").select(F.col("o_orderkey").alias("id"))
    return keys.union(line.where("l_quantity >= 49").select("l_orderkey")).distinct()


_CLAIMS = """select l_partkey as part, l_returnflag as relation, count(distinct l_suppkey) as contributors, count(*) as sources, round(max(1 - l_discount), 6) as confidence, min(l_shipdate)::date as valid_from,
  max(case when l_linestatus = 'F' then l_shipdate::date end) as valid_to, arg_max(l_linestatus, lpad((l_orderkey * 10 + l_linenumber)::varchar, 16, '0') || l_linestatus) filter (where l_linenumber % 3 <> 0) as value from lineitem group by 1, 2"""


def _claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.col("l_shipdate").cast("date")
    rows = load(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("part"), F.col("l_returnflag").alias("relation"), F.col("l_suppkey").alias("contributor"), (1 - F.col("l_discount")).alias("confidence"), day.alias("valid_from"),
        F.when(F.col("l_linestatus") == "F", day).alias("valid_to"), F.when(F.col("l_linenumber") % 3 == 0, "").otherwise(F.col("l_linestatus")).alias("value"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
    )
    return H.claims(rows, ["part", "relation"])


@query(_CLAIMS)
def claims_materialise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _claims(spark, sf_dir)


@query(f"select part, relation, contributors, sources from ({_CLAIMS}) where sources >= 2 and (relation <> 'R' or contributors >= 2)")
def corroborated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.corroborated(_claims(spark, sf_dir), weak="R").select("part", "relation", "contributors", "sources")


@query("""
with l as (select s_suppkey as id, s_name as name, case when s_suppkey % 2 = 0 then s_acctbal end as balance from supplier where s_suppkey % 3 <> 0), s as (select s_suppkey as id, upper(s_name) as name, s_acctbal + 1 as balance from supplier where s_suppkey % 5 <> 0)
select coalesce(l.id, s.id) as id, coalesce(l.name, s.name) as name, round(coalesce(l.balance, s.balance), 2) as balance, case when l.id is null then 'shared' else 'local' end as origin from l full join s on l.id = s.id
""")
def snapshot_import_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = load(spark, sf_dir, "supplier")
    local = s.where("s_suppkey % 3 <> 0").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.when(F.col("s_suppkey") % 2 == 0, F.col("s_acctbal")).alias("balance"))
    shared = s.where("s_suppkey % 5 <> 0").select(F.col("s_suppkey").alias("id"), F.upper("s_name").alias("name"), (F.col("s_acctbal") + 1).alias("balance"))
    return H.layered(local, shared, "id", ["name", "balance"]).withColumn("balance", F.round("balance", 2))


@query("""
with o as (select c_custkey as ref_id, case when c_custkey % 7 = 0 then 'dismissed' end as verdict from customer where c_acctbal < 500), d as (select c_custkey as ref_id from customer where c_acctbal < 0 or c_acctbal > 9000)
select coalesce(o.ref_id, d.ref_id) as ref_id, case when verdict is not null then 'closed' when o.ref_id is null then 'new' when d.ref_id is null then 'resolved' else 'open' end as state, verdict from o full join d on o.ref_id = d.ref_id
""")
def findings_upsert_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir, "customer")
    open_ones = c.where("c_acctbal < 500").select(F.col("c_custkey").alias("ref_id"), F.when(F.col("c_custkey") % 7 == 0, "dismissed").alias("verdict"))
    return H.record_findings(open_ones, c.where("c_acctbal < 0 or c_acctbal > 9000").select(F.col("c_custkey").alias("ref_id")))


@query("""
with o as (select p_partkey as id, md5(p_name) as version, p_name as name from part where p_partkey % 4 <> 0), n as (select p_partkey as id, md5(case when p_partkey % 10 = 0 then p_name || ' new' else p_name end) as version, case when p_partkey % 10 = 0 then p_name || ' new' else p_name end as name from part where p_partkey % 3 <> 0)
select coalesce(o.id, n.id) as id, case when n.id is null or o.version = n.version then o.version else n.version end as version, case when n.id is null or o.version = n.version then o.name else n.name end as name, not (n.id is null or coalesce(o.version = n.version, false)) as changed from o full join n on o.id = n.id
""")
def upsert_by_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Idempotent upsert: an unchanged hash writes nothing."""
    p = load(spark, sf_dir, "part")
    renamed = F.when(F.col("p_partkey") % 10 == 0, F.concat("p_name", F.lit(" new"))).otherwise(F.col("p_name"))
    row = lambda df, name: df.select(F.col("p_partkey").alias("id"), F.md5(name).alias("version"), name.alias("name"))
    return H.upsert(row(p.where("p_partkey % 4 <> 0"), F.col("p_name")), row(p.where("p_partkey % 3 <> 0"), renamed), "id", "version", ["name"])


@query("""
select doc_id, array_to_string(list_filter([case when length(text) < 100 then 'short' end, case when lang not in ('en', 'fr') then 'lang' end, case when n_chars <> length(text) then 'length' end, case when source is null or source = '' then 'source' end], lambda x: x is not null), ',') as problems from documents
""")
def extraction_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows against a contract: the names of the rules they break."""
    rules = {"short": F.char_length("text") < 100, "lang": ~F.col("lang").isin("en", "fr"), "length": F.col("n_chars") != F.char_length("text"), "source": F.coalesce("source", F.lit("")) == ""}
    return load(spark, sf_dir, "documents").select("doc_id", F.array_join(H.problems(rules), ",").alias("problems"))


@query("""
select conv_id, turn, array_to_string(list_filter(['reation', 'La Mention', 'The End'], lambda n: contains(lower(text), lower(n)) or len(list_filter(string_split(lower(n), ' '), lambda w: length(w) >= 4 and contains(lower(text), w))) > 0), ',') as names from conversations
""")
def grounding_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(F.lit("reation"), F.lit("La Mention"), F.lit("The End"))
    return load(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(H.grounded(names, F.col("text")), ",").alias("names"))


@query("select event_id, rn from (select event_id, row_number() over (partition by user_id order by ts desc, event_id desc) as rn from events) where rn <= 10")
def prune_log_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest ten entries of each log."""
    from pyspark.sql import Window

    events = load(spark, sf_dir, "events").withColumn("rn", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))))
    return events.where("rn <= 10").select("event_id", "rn")
