"""Identifiers, names, dates and payloads, column by column."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.functions import keys as K
from memlake.plans import query
from memlake.sources.tables import load

ZONE = "Asia/Tokyo"  # nine hours ahead all year, which the counterpart reckons with


@query(r"""
with d as (select doc_id, case when doc_id % 4 = 0 then 'gdrive-' || source || '-9-' || doc_id % 13 when doc_id % 4 = 1 then 't' || doc_id % 100 end as thread_id, case when doc_id % 3 = 0 then 'f-' || source || '-a' end as file_id,
  case when doc_id % 2 = 0 then 'e' || doc_id || '_20240131T101500Z' end as event_id, case when doc_id % 5 < 3 then 'gdrive-' || source || '-7-' || doc_id when doc_id % 5 = 3 then 'gdrive-x' else 'cal-e' || doc_id || '_20240131T101500Z' end as name from documents)
select doc_id, regexp_replace(regexp_replace(coalesce(thread_id, file_id, 'cal-' || event_id), '^gdrive-', ''), '-\d+$', '') as cluster, nullif(regexp_extract(name, '^gdrive-(.+)-(\d+)$', 1), '') as file,
  regexp_replace(regexp_replace(name, '^cal-', ''), '_\d{8}T\d{6}Z$', '') as event from d
""")
def cluster_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a chunk belongs to; the file and the series of an id."""
    i, text = F.col("doc_id"), F.col("doc_id").cast("string")
    thread = F.when(i % 4 == 0, F.concat(F.lit("gdrive-"), "source", F.lit("-9-"), (i % 13).cast("string"))).when(i % 4 == 1, F.concat(F.lit("t"), (i % 100).cast("string"))).otherwise("")
    file = F.when(i % 3 == 0, F.concat(F.lit("f-"), "source", F.lit("-a")))
    event = F.when(i % 2 == 0, F.concat(F.lit("e"), text, F.lit("_20240131T101500Z")))
    name = F.when(i % 5 < 3, F.concat(F.lit("gdrive-"), "source", F.lit("-7-"), text)).when(i % 5 == 3, "gdrive-x").otherwise(F.concat(F.lit("cal-e"), text, F.lit("_20240131T101500Z")))
    return load(spark, sf_dir, "documents").select("doc_id", K.cluster_key(thread, file, event).alias("cluster"), K.file_key(name).alias("file"), K.base_event_id(name).alias("event"))


@query(r"""
with n as (select p_partkey as id, case p_partkey % 5 when 0 then 'Ann ' || p_name || ' from The ' || p_brand when 1 then '  Ben AT ' || p_name when 2 then 'from ' || p_name else p_name end as name,
  case p_partkey % 4 when 0 then 'Ann Lee|ann, Jo van Dyk (' || p_name || ')' when 1 then p_name || ',Bob - re: ' || p_name when 2 then 'Ann, Ann|Müller-Lüdenscheidt , O''Neil J.' end as aliases from part),
t as (select id, name, unnest(string_split_regex(coalesce(aliases, ''), '[|,]')) as a, generate_subscripts(string_split_regex(coalesce(aliases, ''), '[|,]'), 1) as i from n),
k as (select id, i, trim(regexp_replace(string_split_regex(string_split_regex(a, '[(\[]')[1], '\s[-–—/;:]\s')[1], '\s+', ' ', 'g')) as c from t where regexp_matches(trim(a), '^[\p{L} .,''\-]{1,40}$')
  and len(list_filter(list_filter(string_split_regex(trim(a), '[.,\s]+'), lambda w: w <> ''), lambda w: not (regexp_matches(w, '^\p{Lu}') or lower(w) in ('van', 'von', 'de', 'del', 'della', 'der', 'den', 'di', 'da', 'la', 'le', 'du', 'bin', 'al', 'mac', 'mc')))) = 0
  and len(list_filter(string_split_regex(trim(a), '[.,\s]+'), lambda w: w <> '')) > 0),
f as (select id, c, min(i) as i from k where c <> '' group by 1, 2), g as (select id, string_agg(c, ',' order by i) as aliases from f group by 1)
select n.id, case when regexp_matches(trim(name), '(?i)^(.+?)\s+(?:from|at)\s+\S.*$') then trim(regexp_extract(trim(name), '(?i)^(.+?)\s+(?:from|at)\s+\S.*$', 1)) else name end as name, coalesce(g.aliases, '') as aliases from n left join g using (id)
""")
def shareable_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names without affiliation, and the aliases that may be shared."""
    k, p = F.col("p_partkey"), F.col("p_name")
    name = F.when(k % 5 == 0, F.concat(F.lit("Ann "), p, F.lit(" from The "), "p_brand")).when(k % 5 == 1, F.concat(F.lit("  Ben AT "), p)).when(k % 5 == 2, F.concat(F.lit("from "), p)).otherwise(p)
    aliases = F.when(k % 4 == 0, F.concat(F.lit("Ann Lee|ann, Jo van Dyk ("), p, F.lit(")"))).when(k % 4 == 1, F.concat(p, F.lit(",Bob - re: "), p)).when(k % 4 == 2, "Ann, Ann|Müller-Lüdenscheidt , O'Neil J.")
    return load(spark, sf_dir, "part").select(k.alias("id"), K.without_affiliation(name).alias("name"), K.safe_aliases(aliases).alias("aliases"))


@query("""
with o as (select o_orderkey as id, o_orderdate::date as d from orders) select id, case when id % 7 <> 0 then epoch_ms(d::timestamp - interval 9 hours) end as due_ms,
  case when id % 7 <> 0 then ((d::timestamp - interval 9 hours + interval 1 hour * (id % 24) + interval 9 hours)::date)::varchar end as due_day, 'Asia/Tokyo (GMT+09:00)' as zone from o
""")
def due_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days as milliseconds in a zone, and back from some hours later."""
    k = F.col("o_orderkey")
    said = F.when(k % 7 != 0, F.col("o_orderdate").cast("date").cast("string")).otherwise("soon")
    rows = load(spark, sf_dir, "orders").select(k.alias("id"), K.due_millis(said, ZONE).alias("due_ms"), F.col("o_orderdate").cast("timestamp").alias("at"))
    return rows.select("id", "due_ms", K.due_day(F.col("due_ms") + (F.col("id") % 24) * 3_600_000, ZONE).alias("due_day"), K.offset_label(ZONE, F.col("at")).alias("zone"))


@query("""
with a as (select p_partkey as id, 'f.' || replace(p_name, ' ', '_') as file, left(md5(p_name), 12) as hash, left(md5(p_brand), 8) as fp, case p_partkey % 4 when 0 then 'v1' when 1 then 'v' || (p_partkey % 9) when 2 then 'latest' end as pin from part)
select id, case when id % 6 <> 0 then file end as file, case when id % 6 <> 0 then hash end as hash, case when id % 6 <> 0 then fp end as fingerprint, case when coalesce(try_cast(regexp_extract(pin, '\\d+') as bigint), 0) >= 2 then pin else '2' end as version from a
""")
def artifact_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    name = F.concat_ws(".", F.lit("f"), F.translate("p_name", " ", "_"), F.substring(F.md5("p_name"), 1, 12), F.substring(F.md5("p_brand"), 1, 8), F.when(k % 6 != 0, "mbc.gz").otherwise("json"))
    pin = F.when(k % 4 == 0, "v1").when(k % 4 == 1, F.concat(F.lit("v"), (k % 9).cast("string"))).when(k % 4 == 2, "latest")
    part = K.artifact_parts(name)
    return load(spark, sf_dir, "part").select(k.alias("id"), part["file"].alias("file"), part["hash"].alias("hash"), part["fingerprint"].alias("fingerprint"), K.chunker_version(pin).alias("version"))


@query(r"""
with c as (select conv_id, turn, text, case when turn % 3 = 0 then '```json' || chr(10) || text || chr(10) || '```' when turn % 3 = 1 then '  ' || text || ' ' else '```' || text end as raw,
  case turn % 4 when 0 then '★ - ' when 1 then 'Fwd' when 2 then '[x] ' else '' end || left(text, 20) as subject from conversations),
b as (select *, regexp_replace(raw, '^\s+|\s+$', '', 'g') as r, regexp_replace(subject, '^\s+|\s+$', '', 'g') as s, list_filter(list_transform(string_split_regex(text, '[.!?]'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') as parts,
  left(regexp_replace(regexp_replace(lower(left(string_split(text, chr(10))[1], 60)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 50) as slug from c)
select conv_id, turn, regexp_replace(case when starts_with(r, '```') then regexp_replace(regexp_replace(r, '^```[a-zA-Z0-9]*\s*', ''), '\s*```$', '') else r end, '^\s+|\s+$', '', 'g') as bare,
  case when slug = '' then 'consolidated-note' else slug end as slug, regexp_replace(subject, '^[^\p{L}\p{N}_\[]+', '') as subject,
  case when s <> '' and len(parts) > 0 then s || ': ' || parts[1] else s || coalesce(parts[1], '') end as summary, case turn % 6 when 0 then 1 when 1 then 2 when 2 then 3 when 3 then 4 end as priority from b
""")
def text_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without fences, as a file name, without decoration, in a sentence; and a priority's number."""
    t, turn = F.col("text"), F.col("turn")
    raw = F.when(turn % 3 == 0, F.concat(F.lit("```json\n"), t, F.lit("\n```"))).when(turn % 3 == 1, F.concat(F.lit("  "), t, F.lit(" "))).otherwise(F.concat(F.lit("```"), t))
    subject = F.concat(F.when(turn % 4 == 0, "★ - ").when(turn % 4 == 1, "Fwd").when(turn % 4 == 2, "[x] ").otherwise(""), F.substring(t, 1, 20))
    level = F.array(*map(F.lit, ("Urgent", " high ", "normal", "LOW", "later", "")))[(turn % 6).cast("int")]
    return load(spark, sf_dir, "conversations").select(
        "conv_id", "turn", K.without_fences(raw).alias("bare"), K.note_slug(t).alias("slug"), K.bare_subject(subject).alias("subject"), K.extractive_summary(subject, t).alias("summary"), K.priority(level).alias("priority")
    )


@query("""
with e as (select event_id as id, case event_id % 6 when 0 then 'We always ' || event_type when 1 then 'The ' || event_type || ' Pipeline' when 2 then event_type when 3 then 'House Style' else 'note' end as summary, case when event_id % 6 = 4 then ['x', 'Daemon'] when event_id % 6 = 5 then ['tone of voice'] end as tags from events)
select id, case when regexp_matches(t, 'preference|prefer |style guide|tone of voice|format default|convention|always |never |i like |house style') then 'preference' when regexp_matches(t, 'system|tool|automation|integration|workflow|pipeline|script|daemon|platform|software') then 'system' else 'project' end as kind
from (select id, lower(concat_ws(' ', summary, coalesce(array_to_string(tags, ' '), ''))) as t from e)
""")
def memory_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, e = F.col("event_id"), F.col("event_type")
    summary = F.when(i % 6 == 0, F.concat(F.lit("We always "), e)).when(i % 6 == 1, F.concat(F.lit("The "), e, F.lit(" Pipeline"))).when(i % 6 == 2, e).when(i % 6 == 3, "House Style").otherwise("note")
    tags = F.when(i % 6 == 4, F.array(F.lit("x"), F.lit("Daemon"))).when(i % 6 == 5, F.array(F.lit("tone of voice")))
    return load(spark, sf_dir, "events").select(i.alias("id"), K.memory_kind(summary, tags).alias("kind"))


@query(r"""
with m as (select event_id as id, case event_id % 5 when 0 then 'NoReply@x.org' when 1 then 'Ann <ann@x.org>' when 2 then 'updates@shop.com' else event_type || '@x.org' end as sender,
  case event_id % 11 when 0 then '★ Unsubscribe now' when 1 then 'Re: your order' when 2 then '50% off today' when 3 then 'it is 50% off' when 4 then '>> Out of Office' when 5 then 'workshop nowhere' when 6 then 'Shop now!' when 7 then 'View this email in browser' when 8 then '[Automated] x' when 9 then 'Not automated' else event_type end as subject from events)
select id, regexp_matches(lower(sender), 'noreply|no-reply|no_reply|donotreply|do-not-reply|mailer-daemon|postmaster|notifications@|newsletter|automated|autorespond|bounce@|support@mailchimp|msonlineservicesteam|microsoftonline[.]com|updates@|microsoftstore')
  or regexp_matches(subject, p) or regexp_matches(regexp_replace(subject, '^[^\p{L}\p{N}_\[]+', ''), p) as noise
from m, (select '(?i)^unsubscribe|your (order|receipt|invoice|statement|bill)|password reset|verify your email|confirm your (subscription|account|email)|^\[?automated\]?|delivery (failed|notification|status)|^ops-brain[:\s]|^(daily|morning) briefing|^out of office|^automatic reply|^now available\b|view (this email )?in (your )?browser|\bshop (?:now|today)\b|^\d+% off\b' as p)
""")
def noise_mail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By sender and by subject, with and without decoration."""
    i, e = F.col("event_id"), F.col("event_type")
    sender = F.when(i % 5 == 0, "NoReply@x.org").when(i % 5 == 1, "Ann <ann@x.org>").when(i % 5 == 2, "updates@shop.com").otherwise(F.concat(e, F.lit("@x.org")))
    said = ("★ Unsubscribe now", "Re: your order", "50% off today", "it is 50% off", ">> Out of Office", "workshop nowhere", "Shop now!", "View this email in browser", "[Automated] x", "Not automated")
    subject = F.when(i % 11 == 10, e).otherwise(F.get(F.array(*map(F.lit, said)), (i % 11).cast("int")))
    return load(spark, sf_dir, "events").select(i.alias("id"), K.is_noise(sender, subject).alias("noise"))


@query("""
select o_orderkey as id, round(greatest(0.10, least(1.0, 0.7 * (o_totalprice / 500000.0) + 0.3 * (case when o_orderkey % 3 = 0 then 0.5 else (o_custkey % 10) / 10.0 + 0.05 end) - (0.10 * (o_orderkey % 3) + 0.03 * (o_orderkey % 4) + 0.05 * (o_orderkey % 2) + 0.02 * (o_orderkey % 5)))), 4) as confidence from orders
""")
def composite_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    critic = F.when(k % 6 == 0, 0.0).when(k % 3 != 0, (F.col("o_custkey") % 10) / 10.0 + 0.05)
    return load(spark, sf_dir, "orders").select(k.alias("id"), K.confidence(F.col("o_totalprice") / 500000.0, critic, k % 3, k % 4, k % 2, k % 5).alias("confidence"))


@query(r"""
with c as (select conv_id, turn, text, case turn % 3 when 0 then replace(substr(text, 10, 25), ' ', '  ') when 1 then 'zz' || left(text, 9) else '  ' end as q from conversations)
select conv_id, turn, nq <> '' and contains(trim(regexp_replace(lower(text), '\s+', ' ', 'g')), nq) as stands from (select *, trim(regexp_replace(lower(q), '\s+', ' ', 'g')) as nq from c)
""")
def attribution_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, turn = F.col("text"), F.col("turn")
    quote = F.when(turn % 3 == 0, F.replace(F.substring(t, 10, 25), F.lit(" "), F.lit("  "))).when(turn % 3 == 1, F.concat(F.lit("zz"), F.substring(t, 1, 9))).otherwise("  ")
    return load(spark, sf_dir, "conversations").select("conv_id", "turn", K.quote_stands(quote, t).alias("stands"))


_KEY = b"fleet secret".ljust(64, b"\0")


@query(f"""
select doc_id, sha256(unhex('{bytes(b ^ 0x5C for b in _KEY).hex()}') || unhex(sha256(unhex('{bytes(b ^ 0x36 for b in _KEY).hex()}') || encode('gmail-' || doc_id)))) as ref from documents
""")
def source_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", K.source_ref("fleet secret", F.concat(F.lit("gmail-"), F.col("doc_id").cast("string"))).alias("ref"))


@query(r"""
with c as (select conv_id, turn, case when conv_id % 2 = 0 then 'cal-' || conv_id else 't' || conv_id end as thread, case when turn % 2 = 0 then 'gmail_enriched_v2' end as st, case turn % 3 when 0 then '2024-01-0' || (1 + turn % 9) when 1 then 'Tue, 02 Jan 2024' end as said, case when turn % 4 = 3 then '2023-01-01' else '' end as d from conversations)
select conv_id, turn, case when st is distinct from w then w end as source_type, case when d = '' then said end as date, case when d = '' and regexp_matches(said, '^\d{4}-') then said end as date_iso from (select *, case when starts_with(thread, 'cal-') then 'calendar_enriched_v2' else 'gmail_enriched_v2' end as w from c)
""")
def digest_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An empty Date line has no date, and doesn't take the next line for one."""
    turn, conv = F.col("turn"), F.col("conv_id").cast("string")
    thread = F.concat(F.when(F.col("conv_id") % 2 == 0, "cal-").otherwise("t"), conv)
    said = F.when(turn % 3 == 0, F.concat(F.lit("2024-01-0"), (1 + turn % 9).cast("string"))).when(turn % 3 == 1, "Tue, 02 Jan 2024").otherwise("")
    text = F.concat(F.lit("Subject: x\nDate:  "), said, F.lit("\nType: notification\n"), "text")
    patch = K.digest_patch(thread, text, F.when(turn % 2 == 0, "gmail_enriched_v2"), F.when(turn % 4 == 3, "2023-01-01").otherwise(""), F.lit(""))
    return load(spark, sf_dir, "conversations").select("conv_id", "turn", patch["source_type"].alias("source_type"), patch["date"].alias("date"), patch["date_iso"].alias("date_iso"))


@query("select event_id, cast(json_extract_string(props, '$.k') as bigint) as k from events")
def json_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first object of a noisy answer."""
    from memlake.functions.packed import first_json_object

    raw = F.concat(F.lit("Sure {not json}:\n```json\n"), "props", F.lit("\n``` and {\"k\": -1}"))
    return load(spark, sf_dir, "events").select("event_id", F.from_json(first_json_object(raw), "k long")["k"].alias("k"))


@query("select vec_id, len(embedding)::int as dim, round(list_sum(embedding::double[]), 4) as total from embeddings")
def packed_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors to base64 and back."""
    from memlake.functions.packed import decode_vector, encode_vector

    v = load(spark, sf_dir, "embeddings").select("vec_id", decode_vector(encode_vector("embedding")).alias("v"))
    return v.select("vec_id", F.size("v").alias("dim"), F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double")), 4).alias("total"))
