"""Graph queries: suppliers, parts, customers and orders as entities and relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memlake.functions import text as X
from memlake.operators import communities as M
from memlake.operators import graph as G
from memlake.plans import query
from memlake.sources.tables import load, relations

DAY = "1998-06-01"
_EDGES = "select least('s' || l_suppkey, 'p' || l_partkey) as a, greatest('s' || l_suppkey, 'p' || l_partkey) as b, sum(l_quantity) as weight, count(*) as n from lineitem group by 1, 2"


@query(_EDGES)
def graph_edges_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.edge_weights(relations(spark, sf_dir))


@query(f"""
with recursive e as (select a, b from ({_EDGES})), u as (select a as x, b as y from e union select b, a from e),
h(node, depth) as (select 's1', 0 union select y, depth + 1 from h join u on h.node = u.x where depth < 3)
select node, min(depth) as depth from h group by 1
""")
def graph_khop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.hops(G.edge_weights(relations(spark, sf_dir)), spark.createDataFrame([("s1",)], "node string"), 3)


@query(f"""
with h as (select 's' || l_suppkey as entity_a, 'p' || l_partkey as entity_b, l_shipdate::date as valid_from, case when l_returnflag = 'R' then l_shipdate::date + 90 end as valid_to from lineitem)
select entity_a, count(*) as live from h where valid_from <= date '{DAY}' and (valid_to is null or valid_to > date '{DAY}') group by 1
""")
def graph_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = relations(spark, sf_dir).withColumn("valid_to", F.when(F.col("flag") == "R", F.date_add("valid_from", 90)))
    return G.as_of(rows, DAY).groupBy("entity_a").agg(F.count("*").alias("live"))


@query(f"""
with recursive e as ({_EDGES}), u as (select a as x, b as y from e union select b, a from e),
h(node, depth) as (select 's2', 0 union select y, depth + 1 from h join u on h.node = u.x where depth < 2), n as (select distinct node from h)
select a, b, weight from e where a in (from n) and b in (from n)
""")
def ego_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The links among the nodes within two hops."""
    edges = G.edge_weights(relations(spark, sf_dir))
    near = G.hops(edges, spark.createDataFrame([("s2",)], "node string"), 2)
    return edges.join(near.select(F.col("node").alias("a")), "a", "left_semi").join(near.select(F.col("node").alias("b")), "b", "left_semi").select("a", "b", "weight")


@query(f"""
with e as ({_EDGES}), d as (select node, count(*) as degree from (select a as node from e union all select b from e) group by 1),
s as (select 's' || s_suppkey as node, s_name as name, r_name as community from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey where s_acctbal >= 0)
select node, name, community, degree from s join d using (node) where degree >= 5
""")
def graph_canvas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes with their community and degree; suppliers in the red count as suppressed."""
    e = G.edge_weights(relations(spark, sf_dir))
    degree = e.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))
    s = load(spark, sf_dir, "supplier")
    suppressed = s.where("s_acctbal < 0").select("s_suppkey")
    place = load(spark, sf_dir, "nation").join(F.broadcast(load(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    nodes = s.join(suppressed, "s_suppkey", "left_anti").join(F.broadcast(place), F.col("s_nationkey") == F.col("n_nationkey"))
    nodes = nodes.select(F.concat(F.lit("s"), "s_suppkey").alias("node"), F.col("s_name").alias("name"), F.col("r_name").alias("community"))
    return nodes.join(degree.where("degree >= 5"), "node")


@query("select o_orderkey as id from orders where not exists (select 1 from lineitem where l_orderkey = o_orderkey)")
def orphan_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"))
    return load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")).join(linked, "id", "left_anti")


@query("""
select c_custkey as id, n_name as org, count(o_orderkey) as n, round(coalesce(sum(o_totalprice), 0), 2) as amount, max(o_orderdate)::date as last_seen, count(*) filter (where o_orderstatus = 'O') as open
from customer join nation on c_nationkey = n_nationkey left join orders on o_custkey = c_custkey group by 1, 2
""")
def entity_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders are summed per customer before the join."""
    o = load(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("amount"), F.max("o_orderdate").cast("date").alias("last_seen"), F.count_if(F.col("o_orderstatus") == "O").alias("open"))
    c = load(spark, sf_dir, "customer").join(F.broadcast(load(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("id"), F.col("n_name").alias("org"))
    zero = F.lit(0).cast("long")
    return c.join(o, "id", "left").select("id", "org", F.coalesce("n", zero).alias("n"), F.round(F.coalesce("amount", F.lit(0.0)), 2).alias("amount"), "last_seen", F.coalesce("open", zero).alias("open"))


@query("""
select p_partkey as id, p_name as name, case when lower(p_name) = 'red' then 0 when starts_with(lower(p_name), 'red') then 1 when contains(lower(p_name), 'red') then 2 when contains(lower(p_brand), 'red') then 3 end as class
from part where class is not null order by class, p_size desc, length(p_name), p_partkey limit 25
""")
def entity_search_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.lower("p_name")
    kind = F.when(name == "red", 0).when(name.startswith("red"), 1).when(F.contains(name, F.lit("red")), 2).when(F.contains(F.lower("p_brand"), F.lit("red")), 3)
    found = load(spark, sf_dir, "part").withColumn("class", kind).where("class is not null")
    return found.orderBy("class", F.desc("p_size"), F.char_length("p_name"), "p_partkey").limit(25).select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), "class")


@query(f"""
with recursive e as ({_EDGES}), u as (select a as x, b as y from e union select b, a from e),
r(node, component) using key (node) as (select x, x from u group by 1 union (select u.y, min(r.component) from r join u on r.node = u.x join recurring.r as own on own.node = u.y where r.component < own.component group by 1))
select node, component from r
""")
def connected_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.components(relations(spark, sf_dir).select(F.col("entity_a").alias("a"), F.col("entity_b").alias("b")))


@query(f"""
with e as ({_EDGES}), m as (select sum(weight) as m from e), k as (select 's' || s_suppkey as node, 'n' || s_nationkey as community from supplier union all select 'p' || p_partkey, 'n' || (p_size % 25) from part),
ends as (select a as node, weight from e union all select b, weight from e), d as (select community, count(distinct node) as n_nodes, sum(weight) as degree from ends join k using (node) group by 1),
i as (select x.community, sum(weight) as inside from e join k x on x.node = a join k y on y.node = b where x.community = y.community group by 1)
select community, n_nodes, round(coalesce(inside, 0), 2) as inside, round(degree, 2) as degree, round(coalesce(inside, 0) / m - (degree / (2 * m)) ** 2, 9) as share from d left join i using (community), m
""")
def partition_modularity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The modularity of a given partition of the graph: suppliers by nation, parts by size."""
    own = load(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("node"), F.concat(F.lit("n"), "s_nationkey").alias("community"))
    parts = load(spark, sf_dir, "part").select(F.concat(F.lit("p"), "p_partkey").alias("node"), F.concat(F.lit("n"), F.col("p_size") % 25).alias("community"))
    found = M.modularity(G.edge_weights(relations(spark, sf_dir)), own.unionByName(parts))
    return found.select("community", "n_nodes", F.round("inside", 2).alias("inside"), F.round("degree", 2).alias("degree"), F.round("share", 9).alias("share"))


@query()
def communities_by_modularity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Communities of the largest component; tests hold their modularity against SQL and against a plain version's."""
    return M.communities(M.largest_component(G.edge_weights(relations(spark, sf_dir))), resolution=1.0)


@query()
def community_label_prop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.label_propagation(G.edge_weights(relations(spark, sf_dir)))


@query(f"""
with e as ({_EDGES}), k as (select 's' || s_suppkey as node, s_nationkey as community from supplier), f as (select b.node, k.community, b.weight from (select a as node, b as y, weight from e union all select b, a, weight from e) b join k on k.node = b.y
  where b.node not in (select node from k))
select node, community from (select *, row_number() over (partition by node order by weight desc, community) as rn from f) where rn = 1
""")
def community_extend(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = load(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("node"), F.col("s_nationkey").alias("community"))
    return G.extend_communities(G.edge_weights(relations(spark, sf_dir)), known)


@query(r"""
with t as (select p_partkey as id, p_type as kind, list_sort(list_distinct(list_filter(regexp_extract_all(lower(p_name), '[\p{L}\p{N}]+'), lambda w: length(w) > 1))) as w from part),
s as (select kind, w, min(id) as id from t where len(w) > 0 group by 1, 2)
select x.id as a, y.id as b, round(len(list_intersect(x.w, y.w)) / len(list_distinct(x.w || y.w)), 6) as similarity from s x join s y on x.kind = y.kind and x.id < y.id
where len(list_intersect(x.w, y.w)) > 0 and round(len(list_intersect(x.w, y.w)) / len(list_distinct(x.w || y.w)), 6) >= 0.3
""")
def candidate_pairs_blocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.candidate_pairs(load(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("kind"), F.col("p_name").alias("name")))


_MERGE = "with k as (select p_type, lower(p_name) as n, arg_max(p_partkey, p_size::bigint * 1000000000 + p_partkey) as winner, count(*) as c from part group by 1, 2) select p_partkey as loser, winner from part join k on part.p_type = k.p_type and lower(p_name) = n where c > 1 and p_partkey <> winner"


def _merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = load(spark, sf_dir, "part").withColumn("id", F.col("p_partkey"))
    return G.survivors(parts, [F.col("p_type"), X.slug(F.col("p_name"))], F.struct("p_size", "id"))


@query(_MERGE)
def deterministic_merge_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merges(spark, sf_dir)


@query("""
with c as (select c_custkey as id, 'u' || (c_custkey % 400) || '@example.com' as email, c_acctbal from customer where c_custkey % 400 <> 0),
k as (select email, arg_max(id, c_acctbal * 100000 + id / 1000000.0) as winner, count(*) as n from c group by 1) select id as loser, winner from c join k using (email) where n > 1 and id <> winner
""")
def email_merge_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """People of one address are one, unless the mailbox is a role's."""
    local = F.when(F.col("c_custkey") % 400 == 0, F.lit("office")).otherwise(F.concat(F.lit("u"), F.col("c_custkey") % 400))
    people = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.concat(local, F.lit("@example.com")).alias("email"), "c_acctbal").where(~X.is_role_mailbox(F.col("email")))
    return G.survivors(people, [F.col("email")], F.struct("c_acctbal", "id"))


@query(f"""
with m as ({_MERGE}), e as (select l_orderkey * 10 + l_linenumber as id, 's' || l_suppkey as a, l_returnflag as relation, 'p' || coalesce(winner, l_partkey) as b from lineitem left join m on l_partkey = loser)
select a, relation, b, min(id) as id from e where a <> b group by 1, 2, 3
""")
def merge_repoint_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = load(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.concat(F.lit("s"), "l_suppkey").alias("a"), F.col("l_returnflag").alias("relation"), F.concat(F.lit("p"), "l_partkey").alias("b"))
    merges = _merges(spark, sf_dir).select(F.concat(F.lit("p"), "loser").alias("loser"), F.concat(F.lit("p"), "winner").alias("winner"))
    return G.repoint(edges, merges)


@query("""
with f as (select o_custkey, o_orderpriority, o_orderdate::date as d, o_orderkey, lag(o_orderpriority) over (partition by o_custkey order by o_orderdate::date, o_orderkey) as p from orders), s as (select * from f where p is null or p <> o_orderpriority)
select o_custkey as entity, o_orderpriority as value, d as valid_from, lead(d) over w as valid_to, lead(d) over w is null as is_current, lead(o_orderkey) over w as superseded_by from s window w as (partition by o_custkey order by d, o_orderkey)
""")
def scd2_singleton(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("entity"), F.col("o_orderpriority").alias("value"), F.col("o_orderdate").cast("date").alias("d"), F.col("o_orderkey").alias("id"))
    return G.scd2(facts, "entity", "value", "d", "id")


@query("select o_custkey as entity, o_orderpriority as value, count(*) as observed, min(o_orderdate)::date as first_seen, max(o_orderdate)::date as last_seen, round(least(1.0, 0.5 + 0.05 * (count(*) - 1)), 6) as confidence from orders group by 1, 2")
def observation_confirm(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("entity"), F.col("o_orderpriority").alias("value"))
    return o.agg(F.count("*").alias("observed"), F.min("o_orderdate").cast("date").alias("first_seen"), F.max("o_orderdate").cast("date").alias("last_seen"), F.round(F.least(F.lit(1.0), 0.5 + 0.05 * (F.count("*") - 1)), 6).alias("confidence"))


@query(f"""
with e as (select 's' || l_suppkey as a, 'p' || l_partkey as b, sum(l_quantity) / 20 as strength, max(l_shipdate)::date as last_seen from lineitem group by 1, 2), s as (select *, strength > 0 and strength <= 1 and last_seen < date '{DAY}' - 365 as stale from e)
select a, b, case when stale then 0.0 else strength end as strength, case when stale then date '{DAY}' end as valid_to, case when stale then 'decayed' end as reason from s
""")
def edge_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = relations(spark, sf_dir).groupBy(F.col("entity_a").alias("a"), F.col("entity_b").alias("b")).agg((F.sum("strength") / 20).alias("strength"), F.max("valid_from").alias("last_seen")).withColumn("valid_to", F.lit(None).cast("date"))
    return G.decayed(rows, DAY).select("a", "b", "strength", "valid_to", "reason")


@query("select o_custkey as entity, arg_max(o_orderpriority, o_orderdate::date::varchar || lpad(o_orderkey::varchar, 12, '0')) as role, max(o_orderdate)::date as since from orders group by 1")
def latest_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.col("o_orderdate").cast("date")
    return load(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("entity")).agg(F.max_by("o_orderpriority", F.struct(day, "o_orderkey")).alias("role"), F.max(day).alias("since"))


@query("select topic, count(distinct p_brand) as orgs, count(*) as n from (select p_brand, unnest(string_split(lower(p_type), ' ')) as topic from part) group by 1")
def topic_distinct_orgs(spark: SparkSession, sf_dir: str) -> DataFrame:
    topics = load(spark, sf_dir, "part").select("p_brand", F.explode(F.split(F.lower("p_type"), " ")).alias("topic"))
    return topics.groupBy("topic").agg(F.countDistinct("p_brand").alias("orgs"), F.count("*").alias("n"))


@query("""
with recursive t as (select s_suppkey as loser, s_suppkey // 2 as winner from supplier where s_suppkey >= 2), r(loser, winner) as (select * from t union all select r.loser, t.winner from r join t on r.winner = t.loser)
select loser, min(winner) as winner from r group by 1
""")
def tombstone_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains of merges (each supplier into the one of half its number) followed to their ends."""
    merges = load(spark, sf_dir, "supplier").where("s_suppkey >= 2").select(F.col("s_suppkey").alias("loser"), F.floor(F.col("s_suppkey") / 2).alias("winner"))
    return G.chain_ends(merges)


@query("""
with c as (select n_regionkey as community, s_name as name, s_acctbal, s_suppkey, count(*) over (partition by n_regionkey) as members, row_number() over (partition by n_regionkey order by s_acctbal desc, s_suppkey) as rn from supplier join nation on s_nationkey = n_nationkey)
select community, max(members) as members, string_agg(name, ', ' order by rn) as key_entities from c where rn <= 5 group by 1
""")
def community_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size and top five members of each community."""
    rows = load(spark, sf_dir, "supplier").join(F.broadcast(load(spark, sf_dir, "nation")), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_regionkey").alias("community"), "s_name", "s_acctbal", "s_suppkey")
    sizes = rows.groupBy("community").agg(F.count("*").alias("members"))
    top = rows.withColumn("rn", F.row_number().over(Window.partitionBy("community").orderBy(F.desc("s_acctbal"), "s_suppkey"))).where("rn <= 5")
    names = top.groupBy("community").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rn", "s_name"))), lambda x: x["s_name"]), ", ").alias("key_entities"))
    return sizes.join(names, "community")
