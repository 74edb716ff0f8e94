"""Writes to the entity tables. Customers and suppliers stand for entities, nations for organisations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.operators import entities as E
from memlake.plans import query
from memlake.sources.tables import load

DAY = "2024-03-01"


@query("""
with e as (select s_suppkey as id, case s_suppkey % 4 when 0 then 'J.K.' when 1 then 'Josh Kemp ' || s_suppkey when 2 then '' else 'Josh' || s_suppkey end as name, case s_suppkey % 3 when 0 then 'office@x.org' when 1 then 'p' || s_suppkey || '@x.org' else '' end as email, s_nationkey as degree from supplier),
p as (select a.*, b.id as id2, b.name as name2, b.email as email2, b.degree as degree2 from e a join e b on b.id = a.id + 1 + a.id % 3),
o as (select case when degree >= degree2 then id else id2 end as winner_id, case when degree >= degree2 then id2 else id end as loser_id, case when degree >= degree2 then name else name2 end as w, case when degree >= degree2 then name2 else name end as l, case when degree >= degree2 then email else email2 end as we, case when degree >= degree2 then email2 else email end as le from p)
select winner_id, loser_id, case when w = '' then l when l = '' then w when contains(w, ' ') <> contains(l, ' ') then case when contains(l, ' ') then l else w end when length(l) > length(w) then l else w end as name,
  case when we <> '' and we <> 'office@x.org' then we when le <> '' and le <> 'office@x.org' then le when we <> '' then we else le end as email from o
""")
def merge_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, text = F.col("s_suppkey"), F.col("s_suppkey").cast("string")
    name = F.when(k % 4 == 0, "J.K.").when(k % 4 == 1, F.concat(F.lit("Josh Kemp "), text)).when(k % 4 == 2, "").otherwise(F.concat(F.lit("Josh"), text))
    email = F.when(k % 3 == 0, "office@x.org").when(k % 3 == 1, F.concat(F.lit("p"), text, F.lit("@x.org"))).otherwise("")
    e = load(spark, sf_dir, "supplier").select(k.alias("id"), name.alias("name"), email.alias("email"), F.col("s_nationkey").alias("degree"))
    return E.merge_preview(e.select(F.col("id").alias("a"), (F.col("id") + 1 + F.col("id") % 3).alias("b")), e)


@query("""
with e as (select c_custkey as id, case when c_custkey % 3 = 0 then '' else 'org' || c_nationkey end as org, case when c_custkey % 4 = 0 then '1998-06-01' else '' end as org_since, case when c_custkey % 10 = 0 then 'org' else 'local' end as origin from customer),
s as (select o_custkey as id, arg_max('new' || o_orderpriority[1], o_orderdate::date::varchar || o_orderpriority[1]) filter (where o_orderstatus <> 'O') as dorg, (max(o_orderdate::date) filter (where o_orderstatus <> 'O'))::varchar as ddate, min('old' || o_orderpriority[1]) filter (where o_orderstatus = 'O') as plain from orders group by 1),
b as (select e.*, dorg, ddate, plain, coalesce(ddate is not null and origin <> 'org' and (org = '' or org_since = '' or org_since < ddate), false) as newer from e left join s using (id))
select id, case when newer then dorg when origin <> 'org' and org = '' and plain is not null then plain else org end as org, case when newer then ddate else org_since end as org_since from b
""")
def org_recency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finished orders are dated observations, open ones undated."""
    k = F.col("c_custkey")
    e = load(spark, sf_dir, "customer").select(
        k.alias("id"), F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("org"), F.col("c_nationkey").cast("string"))).alias("org"), F.when(k % 4 == 0, "1998-06-01").otherwise("").alias("org_since"), F.when(k % 10 == 0, "org").otherwise("local").alias("origin")
    )
    first, dated = F.substring("o_orderpriority", 1, 1), F.col("o_orderstatus") != "O"
    seen = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.concat(F.when(dated, "new").otherwise("old"), first).alias("org"), F.when(dated, F.col("o_orderdate").cast("date").cast("string")).otherwise("").alias("since"))
    return E.with_recent_org(e, seen).select("id", "org", "org_since")


@query("""
with m as (select s_suppkey as id, case s_nationkey % 6 when 0 then 'external' when 1 then '' else 'Org ' || s_nationkey end as org from supplier), g as (select *, lower(replace(org, ' ', '-')) as org_id from m where org not in ('external', ''))
select 'org' as what, org_id as a, min(org) as b from g where org_id not in ('org-2', 'org-3') group by 2 union all select 'edge', id::varchar, org_id from g where id % 5 <> 0
""")
def ensure_works_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("s_nationkey")
    members = load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.when(n % 6 == 0, "external").when(n % 6 == 1, "").otherwise(F.concat(F.lit("Org "), n.cast("string"))).alias("org"))
    known = spark.range(1).select(F.explode(F.array(F.lit("org-2"), F.lit("org-3"))).alias("id"))
    edges = members.where("id % 5 = 0").select(F.col("id").alias("entity_a"), F.lit("works_at").alias("relation"), F.lower(F.translate("org", " ", "-")).alias("entity_b"))
    orgs, new = E.works_at(members, known, edges)
    return orgs.select(F.lit("org").alias("what"), F.col("id").alias("a"), F.col("name").alias("b")).unionByName(new.select(F.lit("edge").alias("what"), F.col("entity_a").cast("string").alias("a"), F.col("entity_b").alias("b")))


@query("""
with e as (select lower(replace(s_name, '#', '-')) as id, s_name as name, 'Nick ' || s_suppkey % 40 as alias, case when s_suppkey % 2 = 0 then 'S' || s_suppkey || '@x.org' end as email from supplier),
c as (select distinct * from (select trim(case s_suppkey % 5 when 0 then 'Someone Else' when 1 then upper(s_name) when 2 then 'nick ' || s_suppkey % 40 when 3 then 'Person ' || s_suppkey % 60 else '' end) as name, case when s_suppkey % 3 = 0 then 's' || s_suppkey || '@X.org' else '' end as email from supplier)),
m as (select lower(email) as email, min(id) as id from e where email is not null group by 1), n as (select low, min(id) as id from (select distinct lower(name) as low, id from e union select distinct lower(alias), id from e) group by 1 having count(distinct id) = 1),
b as (select c.name, lower(c.email) as email, regexp_replace(lower(c.name), '[^a-z0-9]+', '-', 'g') as slug, m.id as by_mail, n.id as by_name from c left join m on m.email = lower(c.email) left join n on n.low = lower(c.name) where c.name <> '')
select name, email, case when by_mail is not null then by_mail when slug in (select id from e) then slug when by_name is not null then by_name else slug end as id, case when by_mail is not null then 'email' when slug in (select id from e) then 'id' when by_name is not null then 'name' else 'new' end as how from b
""")
def upsert_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates found by address, id, unique name or alias, or new."""
    k, text, s = F.col("s_suppkey"), F.col("s_suppkey").cast("string"), load(spark, sf_dir, "supplier")
    known = s.select(F.lower(F.translate("s_name", "#", "-")).alias("id"), F.col("s_name").alias("name"), F.array(F.concat(F.lit("Nick "), (k % 40).cast("string"))).alias("aliases"), F.when(k % 2 == 0, F.concat(F.lit("S"), text, F.lit("@x.org"))).alias("email"))
    name = F.when(k % 5 == 0, "Someone Else").when(k % 5 == 1, F.upper("s_name")).when(k % 5 == 2, F.concat(F.lit("nick "), (k % 40).cast("string"))).when(k % 5 == 3, F.concat(F.lit("Person "), (k % 60).cast("string"))).otherwise(" ")
    asked = s.select(name.alias("name"), F.lit("org").alias("kind"), F.when(k % 3 == 0, F.concat(F.lit("s"), text, F.lit("@X.org"))).otherwise("").alias("email"))
    return E.resolved(asked, known).drop("kind")


@query("""
with t as (select n_nationkey as community_id, count(*) as member_count from customer join nation on c_nationkey = n_nationkey where n_nationkey % 3 <> 0 group by 1 order by 2 desc, 1 limit 10),
m as (select c_nationkey as community_id, c_name as name, row_number() over (partition by c_nationkey order by c_name, c_custkey) as rn from customer)
select community_id, member_count, string_agg(name, ',' order by name) as members from t join m using (community_id) where rn <= 40 group by 1, 2
""")
def community_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("community_id"), F.col("c_name").alias("name"), F.col("c_custkey").alias("id"))
    sizes = c.groupBy("community_id").agg(F.count("*").alias("member_count")).withColumn("title", F.when(F.col("community_id") % 3 == 0, "known").otherwise(" "))
    return E.community_requests(sizes, c).withColumn("members", F.array_join("members", ","))


@query("""
with a as (select c_nationkey as id, max(case when c_custkey % 5 = 0 then 'title ' || c_custkey % 9 end) as title from customer where c_nationkey % 2 = 0 group by 1)
select n_nationkey as id, coalesce(a.title, n_name) as title from nation left join a on a.id = n_nationkey
""")
def drain_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers for communities that are there; blank ones count for nothing."""
    rows = load(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("title"))
    c = load(spark, sf_dir, "customer").where("c_nationkey % 2 = 0")
    said = c.select(F.col("c_nationkey").alias("id"), F.when(F.col("c_custkey") % 5 == 0, F.concat(F.lit("title "), (F.col("c_custkey") % 9).cast("string"))).otherwise(" ").alias("title"))
    return E.answered(rows, said.unionByName(said.withColumn("id", F.col("id") + 1000)), "id", ["title"])


@query(f"""
with v as (select doc_id, ['keep', 'expire', 'promote', 'what'][(quality + 2 * toxic + doc_id % 2) % 4 + 1] as v from labels where doc_id is not null)
select d.doc_id, coalesce(v = 'expire', false) as expired, case when v in ('keep', 'expire', 'promote') then date '{DAY}' end as distilled_at, case when v in ('keep', 'expire', 'promote') then v end as verdict, coalesce(v = 'promote', false) as reported from documents d left join v using (doc_id)
""")
def drain_distil(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None)
    notes = load(spark, sf_dir, "documents").select("doc_id", none.cast("boolean").alias("expired"), none.cast("date").alias("distilled_at"), none.cast("string").alias("verdict"))
    kinds = F.array(*map(F.lit, ("keep", "expire", "promote", "what")))
    said = load(spark, sf_dir, "labels").where("doc_id is not null").select("doc_id", kinds[((F.col("quality") + 2 * F.col("toxic") + F.col("doc_id") % 2) % 4).cast("int")].alias("verdict"))
    done, findings = E.distilled(notes, said, DAY)
    return done.join(findings, "doc_id", "left").select("doc_id", "expired", "distilled_at", "verdict", F.col("finding_type").isNotNull().alias("reported"))


@query("""
with e as (select s_suppkey as id, s_nationkey % 2 as kind, case when s_suppkey % 4 = 0 then 'org' else 'local' end as origin, s_nationkey as degree from supplier), v as (select id as a, id + 2 + id % 3 as b, id % 7 <> 0 as same, (id * 37 % 100)::double as sure from e),
j as (select v.*, x.degree as da, y.degree as db from v join e x on x.id = a join e y on y.id = b where same and x.kind = y.kind and not (x.origin = 'org' and y.origin = 'org')),
r as (select case when da >= db then b else a end as loser, case when da >= db then a else b end as winner, sure from j), g as (select loser, arg_max(winner, sure * 1000000 + winner) as winner, max(sure) as sure from r group by 1)
select loser, winner from g where winner not in (select loser from g) order by sure desc, loser limit 15
""")
def merge_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    e = load(spark, sf_dir, "supplier").select(k.alias("id"), (F.col("s_nationkey") % 2).alias("kind"), F.when(k % 4 == 0, "org").otherwise("local").alias("origin"), F.col("s_nationkey").alias("degree"))
    said = e.select(F.col("id").alias("a"), (F.col("id") + 2 + F.col("id") % 3).alias("b"), (F.col("id") % 7 != 0).alias("same"), (F.col("id") * 37 % 100).cast("double").alias("sure"))
    return E.capped_merges(said, e, 15)


@query("""
with e as (select c_custkey as id, case when c_custkey % 3 = 0 then 'kept' else '' end as org, case when c_custkey % 11 = 0 then '' else 'c@' || lower(c_mktsegment) || '.org' end as email from customer)
select 'org' as what, case when org = '' then case email when 'c@building.org' then 'Builders' when 'c@machinery.org' then 'Makers' else '' end else org end as name, count(*) as n from e group by 2
union all select 'unknown', split_part(email, '@', 2), count(*) from e where org = '' and email not in ('', 'c@building.org', 'c@machinery.org') group by 2
""")
def org_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blank organisations by the domain of the address; domains that are not known, counted."""
    k = F.col("c_custkey")
    e = load(spark, sf_dir, "customer").select(F.when(k % 3 == 0, "kept").otherwise("").alias("org"), F.when(k % 11 == 0, "").otherwise(F.concat(F.lit("c@"), F.lower("c_mktsegment"), F.lit(".org"))).alias("email"))
    table = spark.range(1).select(F.inline(F.array(F.struct(F.lit("building.org").alias("domain"), F.lit("Builders").alias("org")), F.struct(F.lit("machinery.org").alias("domain"), F.lit("Makers").alias("org")))))
    done, unknown = E.backfilled(e, table)
    return done.groupBy(F.lit("org").alias("what"), F.col("org").alias("name")).agg(F.count("*").alias("n")).unionByName(unknown.select(F.lit("unknown").alias("what"), F.col("domain").alias("name"), "n"))


@query("""
with s as (select o_orderkey as id, o_custkey as thread_id from orders where o_orderpriority = '1-URGENT' and o_orderstatus = 'O'), t as (select c_custkey as thread_id, c_custkey % 5 = 0 as busy, md5(c_custkey::varchar) as signature from customer)
select thread_id, signature from (select thread_id, min(id) as first from s group by 1) join t using (thread_id) where not busy and thread_id % 4 <> 0 order by first, thread_id limit 20
""")
def stale_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Threads of stale actions that are idle and have changed since they were tried."""
    o = load(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT' and o_orderstatus = 'O'").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("thread_id"))
    threads = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("thread_id"), (F.col("c_custkey") % 5 == 0).alias("has_unenriched"), F.md5(F.col("c_custkey").cast("string")).alias("signature"))
    tried = threads.where("thread_id % 4 = 0 or thread_id % 4 = 1").withColumn("signature", F.when(F.col("thread_id") % 4 == 0, F.col("signature")).otherwise("old"))
    return E.idle_threads(o, threads, tried)


@query("""
with e as (select *, ts::date::varchar as day from events where event_type <> 'error'), p as (select 'user-' || user_id as entity_b, day from e where user_id % 7 <> 0 union all select 'bob', day from e where event_id % 3 = 0)
select 'owner' as entity_a, 'attended' as relation, entity_b, min(day) as valid_from from p group by 3
""")
def attended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Those who came to events that took place: by name, or by what stands before the @; the owner and rooms left out."""
    user = F.col("user_id").cast("string")
    person = lambda name, email, room: F.struct(name.alias("name"), email.alias("email"), F.lit(room).alias("resource"))
    own = F.when(F.col("user_id") % 7 == 0, "Me@x.org").otherwise(F.concat(F.lit("u"), user, F.lit("@x.org")))
    people = F.array(person(F.concat(F.lit("User "), user), own, False), person(F.lit("Room 1"), F.lit("r@x.org"), True), person(F.lit(None).cast("string"), F.when(F.col("event_id") % 3 == 0, "bob@x.org").otherwise("me@X.org"), False))
    events = load(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("ts").cast("string").alias("start"), F.when(F.col("event_type") == "error", "cancelled").alias("status"), people.alias("attendees"))
    return E.attended(events, "me@x.org")


@query("""
with recursive r as (select user_id as session, event_type as doc_id, ts, row_number() over (partition by user_id, event_type order by ts) as rn from events),
f(session, doc_id, rn, ts, last, shown) as (select session, doc_id, rn, ts, ts, true from r where rn = 1 union all select r.session, r.doc_id, r.rn, r.ts, case when r.ts >= f.last + interval 24 hours then r.ts else f.last end, r.ts >= f.last + interval 24 hours from f join r on r.session = f.session and r.doc_id = f.doc_id and r.rn = f.rn + 1)
select session, doc_id, count(*) as asked, count(*) filter (where shown) as shown from f group by 1, 2
""")
def session_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a session has seen within a day isn't shown again."""
    recalls = load(spark, sf_dir, "events").select(F.col("user_id").alias("session"), F.col("event_type").alias("doc_id"), F.col("ts").cast("timestamp").alias("ts"))
    return E.first_shown(recalls).groupBy("session", "doc_id").agg(F.count("*").alias("asked"), F.count_if("shown").alias("shown"))


@query("select event_id as id, event_type as kind from events where event_id % 3 <> 0")
def outbox_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows appended twice, some stamped as sent."""
    rows = load(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("kind"))
    return E.to_publish(rows.unionByName(rows.where("id % 10 = 1")), rows.where("id % 3 = 0"))


@query("""
with recursive v as (select vec_id as id, embedding::double[] as v from embeddings), e as (select a.id as x, b.id as y from v a join v b on a.id <> b.id and list_dot_product(a.v, b.v) >= 0.45),
r(id, cluster) using key (id) as (select x, x from e group by 1 union (select e.y, min(r.cluster) from r join e on r.id = e.x join recurring.r as own on own.id = e.y where r.cluster < own.cluster group by 1))
select id as vec_id, cluster, ((row_number() over (partition by cluster order by id) - 1) // 10)::int as slice from r
""")
def vector_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a lower line than the usual one, which no two of these vectors reach; in several blocks."""
    return E.vector_clusters(load(spark, sf_dir, "embeddings"), least=0.45, block_bytes=1 << 17)


@query("""
select 'note-' || doc_id || ' ' || lang || ': ' || left(trim(string_split(text, chr(10))[1]), 120) as line from documents where doc_id % 5 = 1 and text is not null
""")
def memory_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line for every note: its id, what it is about, and the first line."""
    first = F.substring(F.trim(F.split("text", "\n", 2)[0]), 1, 120)
    rows = load(spark, sf_dir, "documents").where("doc_id % 5 = 1 and text is not null")
    return rows.select(F.concat(F.lit("note-"), F.col("doc_id").cast("string"), F.lit(" "), "lang", F.lit(": "), first).alias("line"))


@query("select doc_id, lang, round(list_sum(embedding::double[]), 4) as total from documents join embeddings on vec_id = doc_id where source is not null")
def chunks_with_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks and their vectors; those without one are left out."""
    v = load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double")), 4).alias("total"))
    return load(spark, sf_dir, "documents").where("source is not null").select("doc_id", "lang").join(v, "doc_id")


@query("""
with c as (select conv_id, turn, ['person', 'alien', '', 'topic'][turn % 4 + 1] as kind, case when turn % 3 = 0 then '  ' else 'B' end as target, ['works_at', 'likes'][turn % 2 + 1] as relation, case when turn % 5 <> 0 then left(text, 5) end as action from conversations)
select conv_id, turn, 1 + (kind <> 'alien')::int as entities, case when turn % 6 = 5 then null else (trim(target) <> '' and relation = 'works_at')::int end as relations, (trim(coalesce(action, '')) <> '')::int as actions,
  (kind = 'alien')::int + case when turn % 6 = 5 then 0 else (not (trim(target) <> '' and relation = 'works_at'))::int end + (trim(coalesce(action, '')) = '')::int as dropped from c
""")
def sanitized_extractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that are void by themselves go, the rest of an extraction stays."""
    turn = F.col("turn")
    nth = lambda n, *values: F.array(*map(F.lit, values))[(turn % n).cast("int")]
    entities = F.array(F.struct(F.lit("A").alias("name"), nth(4, "person", "alien", "", "topic").alias("type")), F.struct(F.lit("B").alias("name"), F.lit(None).cast("string").alias("type")))
    relations = F.array(F.struct(F.lit("A").alias("source_name"), nth(2, "works_at", "likes").alias("type"), F.when(turn % 3 == 0, "  ").otherwise("B").alias("target_name")))
    actions = F.array(F.struct(F.when(turn % 5 != 0, F.substring("text", 1, 5)).alias("description")))
    rows = load(spark, sf_dir, "conversations").select("conv_id", "turn", entities.alias("entities"), F.when(turn % 6 != 5, relations).alias("relations"), actions.alias("actions"))
    count = lambda c: F.when(F.col(c).isNotNull(), F.size(c)).alias(c)
    return E.sanitized(rows).select("conv_id", "turn", count("entities"), count("relations"), count("actions"), "dropped")


@query("""
with e as (select s_suppkey as id, 'role' || s_nationkey as role, case when s_suppkey % 2 = 0 then 'org' || s_nationkey end as org from supplier),
c as (select s_suppkey as position, s_suppkey + s_suppkey % 3 as id, ['role', 'org', 'name'][s_suppkey % 3 + 1] as field, case when s_suppkey % 5 <> 0 then 'new' || s_suppkey else '' end as new_value from supplier)
select position, id, field, new_value, field || ':' || coalesce(case when field = 'role' then role else org end, '') as revert_ref from c join e using (id) where field <> 'name' and new_value <> '' order by position limit 10
""")
def drain_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten corrections that may be made, and how to take them back."""
    k, n = F.col("s_suppkey"), F.col("s_nationkey").cast("string")
    s = load(spark, sf_dir, "supplier")
    known = s.select(k.alias("id"), F.concat(F.lit("role"), n).alias("role"), F.when(k % 2 == 0, F.concat(F.lit("org"), n)).alias("org"))
    said = s.select(k.alias("position"), (k + k % 3).alias("id"), F.array(F.lit("role"), F.lit("org"), F.lit("name"))[(k % 3).cast("int")].alias("field"), F.when(k % 5 != 0, F.concat(F.lit("new"), k.cast("string"))).otherwise("").alias("new_value"))
    return E.corrected(known, said)
