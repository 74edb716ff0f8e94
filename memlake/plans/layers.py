"""Clients as a shared layer (those of the web) over a local one: matches, merges and their undoing, snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.operators import contributions as C
from memlake.operators import layers as L
from memlake.plans import query
from memlake.sources.tables import load


def _clients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A client's aliases are its name the other way round, and its city."""
    turned = F.concat_ws(" ", F.element_at(F.split("name", " "), -1), F.element_at(F.split("name", " "), 1))
    return load(spark, sf_dir, "clients").select(F.col("client_id").cast("string").alias("id"), "name", F.col("segment").alias("kind"), "email", F.concat_ws("|", F.when(F.col("name") != "", turned), "city").alias("aliases"), "source", F.col("master_id").cast("string").alias("master"), "balance", "city", "nation_id")


_NAMED = r"""
c as (select client_id::varchar as id, segment as kind, nullif(lower(trim(email)), '') as mail, lower(trim(name)) as low, nullif(left(trim(regexp_replace(lower(strip_accents(name)), '[^a-z0-9]+', '-', 'g'), '-'), 80), '') as key,
  list_distinct(regexp_extract_all(lower(coalesce(name, '')), '[\p{L}\p{N}]+')) as w, [lower(trim(string_split(name, ' ')[-1] || ' ' || string_split(name, ' ')[1])), lower(trim(city))] as aliases, source from clients),
s as (select * from c where source = 'web'), l as (select * from c where source <> 'web' or source is null),
mail as (select s.id, min(l.id) as other from s join l on s.mail = l.mail group by 1 having count(*) = 1),
name as (select s.id, min(l.id) as other from s join l on s.kind = l.kind and (s.key = l.key or (l.low <> '' and list_contains(s.aliases, l.low)) or (len(s.w) > 0 and len(l.w) > 0 and len(list_intersect(s.w, l.w)) >= 0.8 * len(list_distinct(s.w || l.w))))
  where s.id not in (select id from mail) group by 1 having count(*) = 1),
found as (select id, other, 'mail' as how from mail union all select id, other, 'name' from name)"""


@query(f"with {_NAMED} select id as shared_id, other as local_id, how from found where other in (select other from found group by 1 having count(*) = 1)")
def shared_namesakes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Local entities that shared ones take over: by e-mail, else key, alias or words; ambiguous and contested ones are left alone."""
    rows = _clients(spark, sf_dir)
    web = F.coalesce(F.col("source") == "web", F.lit(False))
    return L.drifted(rows.where(web).drop("source"), rows.where(~web).drop("source"))


def _graph(spark: SparkSession, sf_dir: str) -> L.Layers:
    """Clients with what changed of them as observations, and sales as relations to a priority."""
    entities = _clients(spark, sf_dir).select("id", "name", "kind", "email", "aliases", F.lit("local").alias("origin"))
    sold = load(spark, sf_dir, "sales").where("sale_id is not null and client_id is not null").select(F.col("sale_id").alias("id"), F.col("client_id").cast("string").alias("a"), F.lit("bought at").alias("relation"), F.concat(F.lit("p"), F.col("priority").cast("string")).alias("b"), F.lit("local").alias("origin"))
    seen = load(spark, sf_dir, "client_changes").where("change_id is not null and client_id is not null").groupBy(F.col("change_id").alias("id")).agg(F.min(F.col("client_id")).cast("string").alias("entity"), F.min("segment").alias("text"))
    log = spark.createDataFrame([], "seq int, what string, row long, side string, from_id string, to_id string")
    return L.Layers(entities, sold.dropDuplicates(["id"]), seen, log)


_MERGES = """
one as (select client_id::varchar as loser, master_id::varchar as winner from clients where client_id <> master_id),
two as (select id as loser, min(id) over (partition by nation_id, city) as winner from (select client_id::varchar as id, nation_id, city from clients where client_id = master_id and nation_id is not null and city is not null)),
m2 as (select * from two where loser <> winner),
o as (select change_id as id, min(client_id)::varchar as entity from client_changes where change_id is not null and client_id is not null group by 1),
m as (select o.id, o.entity as was, coalesce(one.winner, o.entity) as mid, one.winner is not null as folded from o left join one on one.loser = o.entity)"""


@query(f"""
with {_MERGES}
select m.id, coalesce(m2.winner, m.mid) as merged, case when folded then m.was else coalesce(m2.winner, m.mid) end as restored from m left join m2 on m2.loser = m.mid
""")
def merges_undone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Duplicates merged into their masters, masters into one of their city; then the duplicates come back, through both merges."""
    clients = _clients(spark, sf_dir)
    first = clients.where("id <> master").select(F.col("id").alias("loser"), F.col("master").alias("winner"))
    town = clients.where("id = master and nation_id is not null and city is not null").groupBy("nation_id", "city").agg(F.min("id").alias("winner"))
    second = clients.where("id = master").join(town, ["nation_id", "city"]).where("id <> winner").select(F.col("id").alias("loser"), "winner")
    merged = L.merged(L.merged(_graph(spark, sf_dir), first, 1), second, 2)
    back = L.undone(merged, first.select("loser"))
    return merged.observations.select("id", F.col("entity").alias("merged")).join(back.observations.select("id", F.col("entity").alias("restored")), "id")


@query("""
with c as (select client_id::varchar as id, master_id::varchar as master, coalesce(source = 'web', false) as web, coalesce(balance, 0) >= 0 as told from clients),
o as (select min(client_id)::varchar as entity from client_changes where change_id is not null and client_id is not null group by change_id
  union all select client_id::varchar from sales where sale_id is not null and client_id is not null),
follow as (select c.id, m.id as winner from c join c m on m.id = c.master where c.web and not c.told and m.web and m.id <> c.id),
used as (select distinct coalesce(f2.winner, f.winner, entity) as id from o left join follow f on f.id = entity left join follow f2 on f2.id = f.winner)
select id, case when web and told then 'shared' else 'local' end as origin from c
where not web or told or (id not in (select id from follow) and id in (select id from used))
""")
def snapshot_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two snapshots of the shared layer, the second without clients in debt: those merged away hand over what is theirs, those still referred to become local, the rest go."""
    clients = _clients(spark, sf_dir).withColumn("web", F.coalesce(F.col("source") == "web", F.lit(False)))
    graph = _graph(spark, sf_dir)
    local = L.replace(graph, entities=graph.entities.join(clients.where("not web").select("id"), "id", "left_semi").withColumn("kind", F.lit("local")).withColumn("email", F.lit(None).cast("string")))
    shared = clients.where("web").select("id", "name", "kind", "email", "aliases", "master", (F.coalesce("balance", F.lit(0.0)) >= 0).alias("told"))
    none = spark.createDataFrame([], "id long, a string, relation string, b string")
    first = L.imported(local, shared.drop("master", "told"), none, spark.createDataFrame([], "id string, merged_into string"), 1)
    gone = shared.where("not told").select("id", F.when(F.col("master") != F.col("id"), F.col("master")).alias("merged_into"))
    return L.imported(first, shared.where("told").drop("master", "told"), none, gone, 2).entities.select("id", "origin")


_KEY = b"fleet secret".ljust(64, b"\0")


@query(rf"""
with e as (
  select 'c' || client_id as id, name, 'person' as kind, case when source = 'partner' then 'shared' else 'local' end as origin from clients
  union all select 'v' || vendor_id, name, 'org', 'local' from vendors
), fit as (
  select id, kind, trim(regexp_replace(name, '\s+', ' ', 'g')) as name from e
  where origin = 'local' and regexp_full_match(trim(regexp_replace(name, '\s+', ' ', 'g')), '[\p{{L}} .,''\-]{{1,40}}')
    and len(list_filter(regexp_extract_all(trim(name), '[^.,\s]+'), lambda w: not regexp_matches(w, '^\p{{Lu}}'))) = 0 and len(regexp_extract_all(trim(name), '[^.,\s]+')) > 0
), docs as (select sale_id, bool_and(coalesce(status, 'held') <> 'held') as warm from sales where sale_id is not null group by 1),
r as (
  select distinct 'c' || client_id as a, case l.flag when 'kept' then 'buys from' else 'returns to' end as relation, 'v' || vendor_id as b, s.sold_at::date as valid_from,
    sha256(unhex('{bytes(b ^ 0x5C for b in _KEY).hex()}') || unhex(sha256(unhex('{bytes(b ^ 0x36 for b in _KEY).hex()}') || encode('sale-' || s.sale_id)))) as source_ref
  from sale_lines l join sales s on s.sale_id = l.sale_id join docs d on d.sale_id = s.sale_id and d.warm where l.flag in ('kept', 'returned')
), t as (select r.*, x.name as xn, y.name as yn from r join fit x on x.id = r.a join fit y on y.id = r.b)
select distinct kind, subject, relation, object, name, entity_kind, '' as aliases, confidence, valid_from, source_ref from (
  select 'entity' as kind, a as subject, null as relation, null as object, xn as name, 'person' as entity_kind, 1.0 as confidence, valid_from, source_ref from t
  union all select 'entity', b, null, null, yn, 'org', 1.0, valid_from, source_ref from t)
union all select 'relation', a, relation, b, null, null, null, 0.8, valid_from, source_ref from t
""")
def contribution_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who buys from whom, as claims that may leave: by kind of relation, from sales that aren't on hold, of entities that aren't from partners."""
    lines, sales = load(spark, sf_dir, "sale_lines").select("sale_id", "vendor_id", "flag"), load(spark, sf_dir, "sales")
    verb = F.when(F.col("flag") == "kept", "buys from").when(F.col("flag") == "returned", "returns to").otherwise("swaps with")
    document = F.concat(F.lit("sale-"), F.col("sale_id").cast("string"))
    told = lines.join(sales.select("sale_id", "client_id", "sold_at"), "sale_id").select(F.concat(F.lit("c"), F.col("client_id").cast("string")).alias("a"), verb.alias("relation"), F.concat(F.lit("v"), F.col("vendor_id").cast("string")).alias("b"), document.alias("doc_id"), F.col("sold_at").cast("date").alias("valid_from"), F.lit(0.8).alias("confidence"), F.lit(None).cast("string").alias("origin"))
    clients = load(spark, sf_dir, "clients").select(F.concat(F.lit("c"), F.col("client_id").cast("string")).alias("id"), "name", F.lit("person").alias("kind"), "email", F.lit(None).cast("string").alias("aliases"), F.when(F.col("source") == "partner", "shared").otherwise("local").alias("origin"))
    vendors = load(spark, sf_dir, "vendors").select(F.concat(F.lit("v"), F.col("vendor_id").cast("string")).alias("id"), "name", F.lit("org").alias("kind"), F.lit(None).cast("string").alias("email"), F.lit(None).cast("string").alias("aliases"), F.lit("local").alias("origin"))
    cold = sales.select(document.alias("doc_id"), (F.coalesce("status", F.lit("held")) == "held").alias("cold"))
    return C.contributions(told, clients.unionByName(vendors), cold, ["buys from", "returns to"], "fleet secret")
