"""Reads of the chunk, action and thread tables, and guarded changes. The documents stand for chunks, the orders for actions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.operators import selectors as S
from memlake.plans import query
from memlake.sources.tables import load

AS_OF, OWNER = "2024-03-01", "me@example.org"
_CHUNKS = """
with chunks as (select doc_id as position, case doc_id % 5 when 0 then 'gdrive-f' || (doc_id // 40) || '-' || (doc_id // 5) % 12 when 1 then 'note-' || doc_id when 2 then 'enriched-' || doc_id else 'gmail-' || doc_id || '-body-0' end as doc_id,
  case when doc_id % 5 = 0 then 'gdrive' else 'gmail' end as source_type, case when doc_id % 5 = 0 then 'f' || (doc_id // 40) end as file_id, case when doc_id % 10 = 0 then 'd' || doc_id % 3 end as drive_id,
  doc_id // 10 as thread_id, ((doc_id // 5) % 12)::varchar as chunk_index, doc_id % 3 as chunker_version, doc_id % 7 <> 0 as embedded, doc_id % 4 = 0 as enriched, case when doc_id % 6 = 0 then 'cold' end as enrich_state,
  case when doc_id % 8 = 0 then 0 else doc_id % 11 end as salience, ['hot', 'warm', 'cold', 'core'][doc_id % 4 + 1] as tier, ['episodic', 'semantic', 'procedural'][doc_id % 3 + 1] as memory_type,
  case when doc_id % 9 = 0 then 'INBOX,SENT' when doc_id % 9 < 6 then 'INBOX' end as labels, case when doc_id % 3 <> 0 then (date '2024-01-01' + (doc_id % 60)::int)::varchar end as date,
  case when doc_id % 5 <> 0 then (date '2024-01-05' + (doc_id % 50)::int)::varchar end as date_iso, doc_id % 11 = 0 as expired, case when doc_id % 4 = 1 then date '2024-01-01' + (doc_id % 59)::int end as distilled_at,
  ['keep', 'expire', 'promote'][doc_id % 3 + 1] as verdict, ['fact', 'task'][doc_id % 2 + 1] as observation_type, lang, n_chars from documents where doc_id is not null)
"""


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("i")
    nth = lambda n, *values: F.array(*map(F.lit, values))[(i % n).cast("int")]
    part = (F.expr("i div 5") % 12).cast("string")
    file = F.concat(F.lit("f"), F.expr("i div 40").cast("string"))
    text = i.cast("string")
    day = lambda start, n: F.date_add(F.lit(start).cast("date"), (i % n).cast("int"))
    return load(spark, sf_dir, "documents").where("doc_id is not null").select(F.col("doc_id").alias("i"), "lang", "n_chars").select(
        i.alias("position"),
        F.when(i % 5 == 0, F.concat(F.lit("gdrive-"), file, F.lit("-"), part)).when(i % 5 == 1, F.concat(F.lit("note-"), text)).when(i % 5 == 2, F.concat(F.lit("enriched-"), text)).otherwise(F.concat(F.lit("gmail-"), text, F.lit("-body-0"))).alias("doc_id"),
        F.when(i % 5 == 0, "gdrive").otherwise("gmail").alias("source_type"),
        F.when(i % 5 == 0, file).alias("file_id"),
        F.when(i % 10 == 0, F.concat(F.lit("d"), (i % 3).cast("string"))).alias("drive_id"),
        F.expr("i div 10").alias("thread_id"),
        part.alias("chunk_index"),
        (i % 3).alias("chunker_version"),
        (i % 7 != 0).alias("embedded"),
        (i % 4 == 0).alias("enriched"),
        F.when(i % 6 == 0, "cold").alias("enrich_state"),
        F.when(i % 8 == 0, 0).otherwise(i % 11).alias("salience"),
        nth(4, "hot", "warm", "cold", "core").alias("tier"),
        nth(3, "episodic", "semantic", "procedural").alias("memory_type"),
        F.when(i % 9 == 0, "INBOX,SENT").when(i % 9 < 6, "INBOX").alias("labels"),
        F.when(i % 3 != 0, day("2024-01-01", 60).cast("string")).alias("date"),
        F.when(i % 5 != 0, day("2024-01-05", 50).cast("string")).alias("date_iso"),
        (i % 11 == 0).alias("expired"),
        F.when(i % 4 == 1, day("2024-01-01", 59)).alias("distilled_at"),
        nth(3, "keep", "expire", "promote").alias("verdict"),
        nth(2, "fact", "task").alias("observation_type"),
        "lang",
        "n_chars",
    )


_ACTIONS = """
with actions as (select o_orderkey as id, case when o_custkey % 3 = 0 then 'Owner' || o_custkey else 'owner' || o_custkey end as owner, case o_orderstatus when 'O' then 'open' when 'F' then 'done' else 'waiting' end as status, o_orderkey % 500 as thread_id,
  case when o_orderkey % 4 = 0 then 'someone' end as waiting_on, o_orderdate::date as waiting_since, 'ext' || o_orderkey as external_id, md5((o_custkey % 50)::varchar) as fingerprint, case when o_orderkey % 10 = 0 then '1998-0' || (1 + o_orderkey % 9) || '-01' end as snoozed_until from orders)
"""


def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    return load(spark, sf_dir, "orders").select(
        k.alias("id"),
        F.when(F.col("o_custkey") % 3 == 0, F.concat(F.lit("Owner"), c)).otherwise(F.concat(F.lit("owner"), c)).alias("owner"),
        F.when(F.col("o_orderstatus") == "O", "open").when(F.col("o_orderstatus") == "F", "done").otherwise("waiting").alias("status"),
        (k % 500).alias("thread_id"),
        F.when(k % 4 == 0, "someone").alias("waiting_on"),
        F.col("o_orderdate").cast("date").alias("waiting_since"),
        F.concat(F.lit("ext"), k.cast("string")).alias("external_id"),
        F.md5((F.col("o_custkey") % 50).cast("string")).alias("fingerprint"),
        F.when(k % 10 == 0, F.concat(F.lit("1998-0"), (1 + k % 9).cast("string"), F.lit("-01"))).alias("snoozed_until"),
    )


@query(_CHUNKS + "select position, doc_id, tier from chunks where doc_id = 'note-31'")
def chunk_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(spark, sf_dir).where(F.col("doc_id") == "note-31").select("position", "doc_id", "tier")


@query(_CHUNKS + "select position, doc_id from chunks where thread_id = 3")
def thread_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(spark, sf_dir).where("thread_id = 3").select("position", "doc_id")


@query(_CHUNKS + "select doc_id, chunk_index, row_number() over (order by chunk_index::int, doc_id) - 1 as place from chunks where file_id = 'f2'")
def chunks_for_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers as numbers: 9 stands before 10."""
    from memlake.operators.retrieval import over

    rows = S.of_file(chunks(spark, sf_dir), "f2")
    return rows.select("doc_id", "chunk_index", (F.row_number().over(over(F.col("chunk_index").cast("int"), F.col("doc_id"))) - 1).alias("place"))


@query(_CHUNKS + "select doc_id, drive_id, file_id from chunks where file_id = 'f1' or drive_id = 'd1'")
def doc_ids_for_file_or_drive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(spark, sf_dir).where("file_id = 'f1' or drive_id = 'd1'").select("doc_id", "drive_id", "file_id")


@query(_CHUNKS + "select position, doc_id from chunks where not enriched and coalesce(enrich_state, '') <> 'cold' and doc_id not like 'enriched-%' order by position desc limit 100")
def unenriched_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.unenriched(chunks(spark, sf_dir), 100).select("position", "doc_id")


@query(_CHUNKS + f"select position, doc_id, verdict from chunks where doc_id like 'note-%' and not expired and (distilled_at is null or (verdict = 'keep' and date '{AS_OF}' - distilled_at > 30)) and observation_type = 'fact' order by position desc limit 500")
def note_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.notes(chunks(spark, sf_dir), AS_OF, kind="fact", skip_distilled=True).select("position", "doc_id", "verdict")


@query(_CHUNKS + "select position, doc_id from chunks where coalesce(date, date_iso) > '2024-02-10' and not coalesce(list_contains(string_split(labels, ','), 'SENT'), false)")
def inbound_chunks_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.inbound_since(chunks(spark, sf_dir), S.parse_cursor("2024-02-10")).select("position", "doc_id")


@query("select c_custkey as id, 'c' || c_custkey || '@x.org' as email from customer where c_nationkey % 4 = 0 and c_custkey % 3 <> 0")
def entities_without_org(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir, "customer")
    org = F.when(F.col("c_nationkey") % 4 != 0, "org").otherwise("")
    email = F.when(F.col("c_custkey") % 3 != 0, F.concat(F.lit("c"), F.col("c_custkey").cast("string"), F.lit("@x.org"))).otherwise("")
    return c.select(F.col("c_custkey").alias("id"), org.alias("org"), email.alias("email")).where("org = '' and email <> ''").select("id", "email")


@query(_ACTIONS + "select id, owner, status from actions where lower(owner) = 'owner12' and status = 'open'")
def unified_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.actions(actions(spark, sf_dir), owner="OWNER12", status="open").select("id", "owner", "status")


@query(_ACTIONS + "select id, owner, status from actions where lower(owner) = 'owner12'")
def actions_for_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.actions(actions(spark, sf_dir), owner="Owner12").select("id", "owner", "status")


@query(_ACTIONS + "select id, status, waiting_since from actions where status = 'open' and waiting_on is not null and waiting_since > date '1998-06-01' - 30")
def open_waiting_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.waiting(actions(spark, sf_dir), "1998-06-01").select("id", "status", "waiting_since")


@query(_ACTIONS + "select id, external_id, fingerprint, 'ext' as how from actions where external_id = 'ext40' union all select min(id), arg_min(external_id, id), fingerprint, 'print' from actions where status = 'open' and fingerprint = md5('7') group by fingerprint")
def action_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By the other system's id; by fingerprint the first that is open."""
    rows = actions(spark, sf_dir).select("id", "external_id", "fingerprint", "status")
    by_print = rows.where((F.col("status") == "open") & (F.col("fingerprint") == F.md5(F.lit("7")))).orderBy("id").limit(1)
    return rows.where("external_id = 'ext40'").withColumn("how", F.lit("ext")).unionByName(by_print.withColumn("how", F.lit("print"))).drop("status")


@query("select c_custkey as id, case when c_custkey % 2 = 0 then 'orphan' else 'missing_org' end as finding_type from customer where c_acctbal < 0 and c_custkey % 3 <> 0 and c_custkey % 2 = 0")
def open_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir, "customer").where("c_acctbal < 0")
    rows = c.select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 2 == 0, "orphan").otherwise("missing_org").alias("finding_type"), F.when(F.col("c_custkey") % 3 == 0, "2024-01-01").alias("resolved_at"))
    return S.open_findings(rows, "orphan").select("id", "finding_type")


@query("select c_custkey as id, round(c_acctbal, 2) as balance from customer where c_custkey = 7")
def finding_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "customer").where("c_custkey = 7").select(F.col("c_custkey").alias("id"), F.round("c_acctbal", 2).alias("balance"))


_THREADS = "select conv_id as thread_id, count(*) as email_count, case when conv_id % 3 = 0 then 's' when conv_id % 3 = 1 then '' end as summary, max(turn) as last_updated, case when conv_id % 2 = 0 then 5 end as summary_at from conversations group by 1"


@query(f"select thread_id, email_count from ({_THREADS}) where email_count >= 5 and (coalesce(summary, '') = '' or (summary_at is not null and last_updated > summary_at))")
def threads_needing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("conv_id")
    threads = load(spark, sf_dir, "conversations").groupBy(c).agg(F.count("*").alias("email_count"), F.max("turn").alias("last_updated"))
    threads = threads.withColumns({"summary": F.when(c % 3 == 0, "s").when(c % 3 == 1, ""), "summary_at": F.when(c % 2 == 0, 5), "thread_id": c})
    return S.needing_summary(threads).select("thread_id", "email_count")


@query("select turn, role, text from conversations where conv_id = 11")
def thread_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "conversations").where("conv_id = 11").orderBy("turn").select("turn", "role", "text")


@query(_CHUNKS + "select position, doc_id from chunks where embedded and salience = 0 order by position desc limit 500")
def chunks_needing_salience(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.newest(chunks(spark, sf_dir).where("embedded and salience = 0"), 500).select("position", "doc_id")


@query(_CHUNKS + "select position, doc_id, tier from chunks where tier = 'warm' order by position desc limit 50")
def chunks_by_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.newest(chunks(spark, sf_dir).where("tier = 'warm'"), 50).select("position", "doc_id", "tier")


@query("select event_id from events where ts::date = date '2024-01-05' and event_type = 'signup'")
def events_of_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A range of the time column, which reaches the scan."""
    return load(spark, sf_dir, "events").where("ts >= timestamp_ntz '2024-01-05' and ts < timestamp_ntz '2024-01-06' and event_type = 'signup'").select("event_id")


@query("""
select c_custkey as id, c_mktsegment in ('SENT') or c_custkey % 4 = 0 or lower('C' || c_custkey || '@x.org') = 'c7@x.org' as outbound, case when c_custkey % 5 = 0 then c_custkey % 2 = 0 else c_custkey = 7 end as own, c_custkey % 6 < 3 and c_custkey % 2 = 1 as dead, c_custkey % 3 = 1 as recall from customer
""")
def message_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sent by the owner, sent to nobody else, an action long past, a prompt worth a recall."""
    k = F.col("c_custkey")
    sender = F.concat(F.lit("C"), k.cast("string"), F.lit("@x.org"))
    to = F.when(k % 3 == 0, F.array(F.lit("c7@x.org"), F.lit("c8@x.org"))).when(k % 3 == 1, F.array(F.lit("C7@X.org")))
    deadline = F.when(k % 6 < 3, F.when(k % 2 == 1, "2022-01-31").otherwise("2022-03-03")).when(k % 6 == 3, "soon")
    prompt = F.when(k % 3 == 0, "/compact the whole thing").when(k % 3 == 1, "  what did she say ").otherwise("  go on      ")
    return load(spark, sf_dir, "customer").select(
        k.alias("id"),
        S.is_outbound(F.col("c_mktsegment"), k % 4 != 0, sender, "C7@x.org").alias("outbound"),
        S.is_self_message(F.when(k % 5 == 0, k % 2 == 0), sender, to, "c7@x.org").alias("own"),
        S.is_long_past(deadline, AS_OF).alias("dead"),
        S.worth_recalling(prompt).alias("recall"),
    )


@query(_CHUNKS + "select file_id, min(position) as first from chunks where source_type = 'gdrive' and file_id is not null and coalesce(chunker_version, 0) < 2 group by 1 order by 2, 1 limit 20")
def stale_chunker_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.stale_files(chunks(spark, sf_dir), 2, 20)


@query(_CHUNKS + "select count(*) as present, count(*) filter (where enrich_state = 'cold') as cold, round(100.0 * count(*) filter (where enrich_state = 'cold') / count(*), 1) as pct from chunks where position in (select item_id from benchmark) and doc_id like 'note-%'")
def gold_docs_cold(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold = load(spark, sf_dir, "benchmark").select(F.concat(F.lit("note-"), F.col("item_id").cast("string")).alias("doc_id"))
    return S.gold_cold(chunks(spark, sf_dir), gold)


@query(_CHUNKS + "select coalesce(sum(salience), 0)::double as salience from chunks where memory_type = 'episodic' and coalesce(tier, '') not in ('hot', 'core') and embedded")
def unconsolidated_salience(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunks(spark, sf_dir).where((F.col("memory_type") == "episodic") & ~F.coalesce("tier", F.lit("")).isin("hot", "core") & F.col("embedded"))
    return rows.agg(F.coalesce(F.sum("salience"), F.lit(0)).cast("double").alias("salience"))


_SNOOZED = "s as (select id, status, case when id % 5 = 0 and status = 'open' then '1999-01-01' else snoozed_until end as snoozed_until, snoozed_until as old, id % 5 = 0 and status = 'open' as hit from actions)"


@query(f"{_ACTIONS}, {_SNOOZED} select id, snoozed_until, case when hit then 'snoozed_until:' || coalesce(old, '') end as revert_ref from s where snoozed_until is null or snoozed_until <= '1998-06-01' or hit")
def snooze_action(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snoozes, what they replaced, and what is still shown."""
    rows = actions(spark, sf_dir)
    done, log = S.snoozed(rows, rows.where("id % 5 = 0").select("id", F.lit("1999-01-01").alias("until")))
    both = done.join(log, "id", "left")
    return S.shown(both, "1998-06-01").unionByName(both.where("revert_ref is not null")).select("id", "snoozed_until", "revert_ref")


@query(_CHUNKS + "select tier, count(*) as n from chunks where position not in (select doc_id from labels where quality = 0) group by 1")
def purge_uncited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of badly rated documents go; those of toxic ones are cited, none of them among these."""
    rows = chunks(spark, sf_dir)
    bad = rows.join(load(spark, sf_dir, "labels").where("quality = 0").select(F.col("doc_id").alias("position")), "position", "left_semi").select("doc_id")
    cited = rows.join(bad, "doc_id", "left_anti").select("doc_id")
    return S.purged(rows, bad, cited).groupBy("tier").agg(F.count("*").alias("n"))


@query(_CHUNKS + "select doc_id, enriched and position % 8 <> 0 as enriched from chunks")
def reset_enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunks(spark, sf_dir)
    return S.reset_enriched(rows, rows.where("position % 8 = 0").select("doc_id")).select("doc_id", "enriched")


@query(f"""
with s as (select doc_id, 1.0 + doc_id % 3 as strength, date '2024-01-01' + (doc_id % 20)::int as last_used from documents), h as (select user_id as doc_id, count(*) as n from events where event_type = 'view' group by 1)
select doc_id, round(strength + coalesce(n, 0), 4)::double as strength, case when n is not null then date '{AS_OF}' else last_used end as last_used from s left join h using (doc_id)
""")
def update_on_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = load(spark, sf_dir, "documents").select("doc_id", (1.0 + F.col("doc_id") % 3).cast("double").alias("strength"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 20).cast("int")).alias("last_used"))
    hits = load(spark, sf_dir, "events").where("event_type = 'view'").select(F.col("user_id").alias("doc_id"))
    return S.recalled(d, hits, AS_OF)


@query(_CHUNKS + ", top as (select doc_id from chunks where memory_type in ('semantic', 'procedural') and salience > 0 order by salience desc, position desc limit 12) select doc_id, case when doc_id in (select doc_id from top) then 'core' when tier = 'core' then 'hot' else tier end as tier from chunks")
def recompute_core(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.core(chunks(spark, sf_dir)).select("doc_id", "tier")


@query(_CHUNKS + "select file_id, max(chunk_index::int) as last from chunks where file_id is not null group by 1")
def payload_keepers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.keepers(chunks(spark, sf_dir)).select("file_id", F.regexp_extract("doc_id", r"-(\d+)$", 1).cast("int").alias("last"))
