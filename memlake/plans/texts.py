"""Texts, names, pages: projections, filters, duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memlake.functions import text as X
from memlake.operators import chunking
from memlake.plans import query
from memlake.shared import stored
from memlake.sources.tables import load, messages


@query("select doc_id, sha256(text) as content_hash from documents")
def content_hash_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", X.content_hash(F.col("text")).alias("content_hash"))


@query("select sha256(text) as content_hash, count(*) as copies, min(doc_id) as first_doc from documents group by 1 having count(*) > 1")
def exact_duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").groupBy(X.content_hash(F.col("text")).alias("content_hash"))
    return docs.agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc")).where("copies > 1")


@query("""
select doc_id, content_hash from (
  select doc_id, sha256(text) as content_hash, row_number() over (partition by sha256(text) order by n_chars desc, doc_id) as rn from documents) where rn = 1
""")
def dedupe_keep_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best of each hash by an aggregate, which combines before the shuffle, not by a window."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "n_chars", X.content_hash(F.col("text")).alias("content_hash"))
    return docs.groupBy("content_hash").agg(F.min_by("doc_id", F.struct(-F.col("n_chars"), "doc_id")).alias("doc_id"))


_STOP = "', '".join(X.TITLE_STOPWORDS)
_TITLE = rf"array_to_string(list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^\p{{L}}\p{{N}}_\s]+', ' ', 'g'), '\s+'), lambda w: w <> '' and w not in ('{_STOP}')), ' ')"


@query(f"select item_id, {_TITLE} as title, case when {_TITLE} = '' then '' else sha1({_TITLE}) end as fingerprint from benchmark")
def normalise_title_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "benchmark").select("item_id", X.normalised_title(F.col("text")).alias("title"), X.fingerprint(F.col("text")).alias("fingerprint"))


@query(r"select doc_id from documents where regexp_matches(text, '[\p{L}\p{N}]')")
def has_content_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").where(X.has_content(F.col("text"))).select("doc_id")


@query(r"""
with n as (select c_custkey as id, c_name as name, 'person' as kind from customer union all select s_suppkey, s_name, 'org' from supplier)
select id, kind, kind in ('person', 'org') and (length(trim(name)) < 2 or length(trim(name)) > 60
  or regexp_matches(trim(name), '(?i)^(Re|Fwd|FW|RE|FWD)\s*:') or regexp_matches(trim(name), 'https?://') or regexp_matches(trim(name), '\w+@\w+\.\w+') or regexp_matches(trim(name), '[|{}\[\]<>]')
  or (kind = 'person' and (regexp_matches(trim(name), '\d{4}') or regexp_matches(trim(name), '\d{2,}/\d{2,}')))) as junk from n
""")
def junk_name_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.lit("person").alias("kind"))
    orgs = load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.lit("org").alias("kind"))
    return people.unionByName(orgs).select("id", "kind", X.is_junk_name(F.col("name"), F.col("kind")).alias("junk"))


@query("select p_partkey as id, left(trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-'), 80) as slug from part")
def slugify_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), X.slug(F.col("p_name")).alias("slug"))


@query("""
with n as (select c_custkey as id, 'Dr.  ' || c_name as name from customer)
select id, regexp_replace(regexp_replace(name, '\\s+', ' ', 'g'), '^(?i:dr)\\.* ', '') as name from n
""".replace("\\\\", "\\"))
def canonical_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), X.canonical_name(F.concat(F.lit("Dr.  "), "c_name")).alias("name"))


@query(r"""
with b as (select page_id, regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<(script|style|head)\b.*?</(script|style|head)>', '', 'g'),
  '(?i)</?(p|div|br|li|ul|ol|tr|table|h1|h2|h3|h4|h5|h6|blockquote|section|article|nav|body|html|header|footer)\b[^>]*>', chr(10), 'g'), '<[^>]*>', '', 'g') as t from pages)
select page_id, array_to_string(list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(x)), lambda x: x <> ''), chr(10)) as text from b
""")
def html_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "pages").select("page_id", X.strip_html(F.col("html")).alias("text"))


_DOMAINS = [("example.com", "com-org", 0), ("example.net", "net-org", 1), ("m.ththth.example.net", "mobile-org", 2), ("example.org", "org-org", 3)]
_DOMAIN_ROWS = ", ".join(f"('{d}', '{o}', {r})" for d, o, r in _DOMAINS)


@query(rf"""
with h as (select page_id, lower(regexp_extract(url, '^[a-zA-Z]+://([^/:?#]+)', 1)) as host from pages), d(domain, org, rank) as (values {_DOMAIN_ROWS})
select h.page_id, h.host, coalesce(arg_min(org, rank), 'external') as org from h left join d on h.host = d.domain or h.host like '%.' || d.domain group by 1, 2
""")
def url_domain_org(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts are tried by their own suffixes, an equality join, instead of by LIKE against every domain."""
    hosts = load(spark, sf_dir, "pages").select("page_id", X.url_host(F.col("url")).alias("host"))
    domains = spark.createDataFrame(_DOMAINS, "domain string, org string, rank int")
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    found = hosts.withColumn("domain", F.explode(suffixes)).join(F.broadcast(domains), "domain")
    best = found.groupBy("page_id").agg(F.min_by("org", "rank").alias("org"))
    return hosts.join(best, "page_id", "left").select("page_id", "host", F.coalesce("org", F.lit("external")).alias("org"))


@query()
def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk_documents(load(spark, sf_dir, "documents")).drop("text")


@query(r"""
select count(*) as n, count(*) filter (where length(text) > 2000) as long_texts, count(*) filter (where not regexp_matches(text, '[\p{L}\p{N}]')) as content_free,
  count(distinct sha256(text)) as distinct_texts, max(length(text)) as longest, count(*) filter (where lang = 'en') as english from documents
""")
def chunk_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return load(spark, sf_dir, "documents").agg(
        F.count("*").alias("n"),
        F.count_if(F.char_length(text) > 2000).alias("long_texts"),
        F.count_if(~X.has_content(text)).alias("content_free"),
        F.countDistinct(X.content_hash(text)).alias("distinct_texts"),
        F.max(F.char_length(text)).cast("long").alias("longest"),
        F.count_if(F.col("lang") == "en").alias("english"),
    )


@query(r"""
select term, count(distinct doc_id) as df, count(*) as tf from (select doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) as term from documents) group by term
""")
def term_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counted per document first, so that a term's documents are never compared as a set."""
    terms = load(spark, sf_dir, "documents").select("doc_id", F.explode(X.tokens(F.col("text"))).alias("term"))
    return terms.groupBy("term", "doc_id").agg(F.count("*").alias("tf")).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))


_CUES = " or ".join("contains(lower(text), '{}')".format(c.replace("'", "''")) for c in X.ACTION_CUES)
_BULK = " or ".join(f"contains(lower(text), '{c}')" for c in X.BULK_MARKERS)


@query(f"""
select l.quality, count(*) as n, count(*) filter (where {_BULK} or (contains(lower(text), 'unsubscribe') and contains(lower(text), 'http'))) as bulk, count(*) filter (where length(text) < 200) as short
from documents d join labels l using (doc_id) group by 1
""")
def noise_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", X.is_bulk_body(F.col("text")).alias("bulk"), (F.char_length("text") < 200).alias("short"))
    return docs.join(load(spark, sf_dir, "labels"), "doc_id").groupBy("quality").agg(F.count("*").alias("n"), F.count_if("bulk").alias("bulk"), F.count_if("short").alias("short"))


@query("""
select doc_id, case lang when 'en' then '[Context: Email from ' || source || ', on 2024-01-0' || (doc_id % 9 + 1) || ', (' || lang || ')] '
  when 'fr' then '[Context: Document: ' || source || ', last updated 2024-01-0' || (doc_id % 9 + 1) || ', (' || lang || ')] '
  when 'de' then '[Context: Event: ' || source || ', on 2024-01-0' || (doc_id % 9 + 1) || ', at ' || lang || '] ' else '' end as prefix from documents
""")
def contextual_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("lang") == "en", "gmail").when(F.col("lang") == "fr", "gdrive").when(F.col("lang") == "de", "calendar")
    when = F.concat(F.lit("2024-01-0"), F.col("doc_id") % 9 + 1, F.lit("T10:00:00Z"))
    return load(spark, sf_dir, "documents").select("doc_id", X.context_prefix(F.coalesce(kind, F.lit("")), F.col("source"), when, F.col("lang")).alias("prefix"))


_LOCALS = ["office", "Office", "jo", "info", "noreply", "prayer", "officer", "kids", "ann.lee", "do-not-reply", "STAFF", "hello", "billing2"]


@query(f"""
with e as (select c_custkey as id, {_LOCALS}[c_custkey % 13 + 1] || case when c_custkey % 4 = 0 then '+' || c_custkey else '' end || case when c_custkey % 17 <> 0 then '@x.org' else '' end as email from customer)
select id, contains(email, '@') and regexp_matches(lower(split_part(email, '@', 1)), '^(office|info|noreply|prayer|kids|do-not-reply|staff|hello)([+].*)?$') as role from e
""")
def role_mailboxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    local = F.array(*map(F.lit, _LOCALS))[(k % 13).cast("int")]
    email = F.concat(local, F.when(k % 4 == 0, F.concat(F.lit("+"), k.cast("string"))).otherwise(""), F.when(k % 17 != 0, "@x.org").otherwise(""))
    return load(spark, sf_dir, "customer").select(k.alias("id"), X.is_role_mailbox(email).alias("role"))


@query("select event_id, event_type, cast(json_extract_string(props, '$.k') as bigint) as k from events")
def props_json_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").select("event_id", "event_type", F.from_json("props", "k long")["k"].alias("k"))


@query(f"""
select conv_id as thread_id, not bool_or({_CUES}) and sum(length(text)) < 300 as trivial from conversations group by 1
""")
def thread_trivial(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = messages(spark, sf_dir)
    return m.groupBy("thread_id").agg((~F.bool_or(X.any_contained(F.col("text"), X.ACTION_CUES)) & (F.sum(F.char_length("text")) < 300)).alias("trivial"))


@query(f"""
select conv_id as thread_id, arg_min({_BULK.replace("text", "text")} or length(text) < 60, turn) as noise from conversations group by 1
""")
def thread_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By the thread's first message."""
    noisy = X.is_bulk_body(F.col("text")) | (F.char_length("text") < 60)
    return messages(spark, sf_dir).groupBy("thread_id").agg(F.min_by(noisy, "position").alias("noise"))


@query(r"""
with dt as (select doc_id, list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) as t from documents), bt as (select item_id, list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) as t from benchmark),
dx as (select doc_id, unnest(t) as w from dt), bx as (select item_id, len(t) as n, unnest(t) as w from bt)
select dx.doc_id, bx.item_id, count(*) as shared, round(count(*) / max(n), 6) as containment from dx join bx using (w) group by 1, 2 having count(*) >= 0.9 * max(n)
""")
def contamination_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of which a document holds nine tenths of the words: it holds one of the item's rarest tenth and one more, which decide the candidates."""
    words = lambda c: F.array_distinct(X.tokens(F.col(c)))
    docs = stored(load(spark, sf_dir, "documents").select("doc_id", words("text").alias("d")), "words")
    items = stored(load(spark, sf_dir, "benchmark").select("item_id", words("text").alias("t")).where(F.size("t") > 0), "items")
    held = items.select("item_id", F.size("t").alias("n"), F.explode("t").alias("w"))
    spread = docs.select(F.explode("d").alias("w"))
    counts = spread.join(held.select("w").distinct(), "w", "left_semi").groupBy("w").agg(F.count("*").alias("df"))
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy("df", "w"))
    rare = held.join(counts, "w", "left").withColumn("df", F.coalesce("df", F.lit(0))).withColumn("rank", rank).where(F.col("rank") <= F.col("n") - F.ceil(0.9 * F.col("n") - 1e-9) + 1)
    met = docs.select("doc_id", F.explode("d").alias("w")).join(rare.select("w", "item_id"), "w").select("doc_id", "item_id").distinct()
    both = met.join(docs, "doc_id").join(items, "item_id").select("doc_id", "item_id", F.size(F.array_intersect("d", "t")).cast("long").alias("shared"), F.size("t").alias("n"))
    return both.where("shared >= 0.9 * n").select("doc_id", "item_id", "shared", F.round(F.col("shared") / F.col("n"), 6).alias("containment"))


@query("""
with recursive m as (select conv_id as thread_id, turn as position, length(text) as size, row_number() over (partition by conv_id order by turn, length(text)) as rn from conversations),
p(thread_id, rn, position, size, used, unit) as (select thread_id, rn, position, size, size, 0 from m where rn = 1
  union all select m.thread_id, m.rn, m.position, m.size, case when p.used + m.size > 2000 then m.size else p.used + m.size end, case when p.used + m.size > 2000 then p.unit + 1 else p.unit end from p join m on m.thread_id = p.thread_id and m.rn = p.rn + 1)
select thread_id, position, size, unit from p
""")
def pack_by_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.pack_by_size(messages(spark, sf_dir).withColumn("size", F.char_length("text")), "thread_id", "position", "size", 2000)


@query("""
with c as (select 'gdrive-f' || (doc_id // 40) || '-' || doc_id % 40 as chunk_id, sha256(text) as content_hash from documents), r as (select * from (values ('gdrive-f1'), ('gdrive-f12'), ('gdrive-f2')) v(root))
select root, chunk_id, content_hash from c join r on chunk_id >= root || '-' and chunk_id < root || '.'
""")
def range_join_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks whose ids begin with a root: not a range of ids, but an equality on the root that an id has."""
    i = F.col("doc_id")
    name = F.concat(F.lit("gdrive-f"), F.expr("doc_id div 40").cast("string"), F.lit("-"), (i % 40).cast("string"))
    chunks = load(spark, sf_dir, "documents").select(name.alias("chunk_id"), X.content_hash(F.col("text")).alias("content_hash")).withColumn("root", X.doc_root(F.col("chunk_id")))
    roots = spark.range(1).select(F.explode(F.array(*map(F.lit, ("gdrive-f1", "gdrive-f12", "gdrive-f2")))).alias("root"))
    return chunks.join(F.broadcast(roots), "root").select("root", "chunk_id", "content_hash")
