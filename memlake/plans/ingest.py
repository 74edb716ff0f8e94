"""Messages, events and files as chunks, and a feed of changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.operators import ingest as I
from memlake.plans import query
from memlake.shared import stored
from memlake.sources.tables import load


@query("""
with e as (select event_id::varchar as id, case when event_type = 'error' then 'cancelled' when event_type = 'view' then 'tentative' end as status, case when event_id % 4 <> 0 then event_type end as summary, ts::date::varchar as start,
  case when event_id % 2 = 0 then (ts::date + 1)::varchar else '' end as ending, case when event_id % 3 = 0 then 'Room ' || user_id end as location, props as description, case when event_id % 5 = 0 then [case when event_id % 10 = 0 then 'Ann' else 'u@x.org' end, 'b@x.org'] end as people from events),
t as (select *, concat_ws(chr(10), coalesce(summary, '(no title)'), 'When: ' || start || case when ending <> '' then ' to ' || ending else '' end, 'Location: ' || location, 'Attendees: ' || array_to_string(people, ', '), description) as text from e where coalesce(status, '') <> 'cancelled')
select 'cal-' || id as doc_id, text, sha256(text) as content_hash, 0 as chunk_index, 1 as chunk_total, coalesce(summary, '(no title)') as summary, coalesce(status, 'confirmed') as status, coalesce(array_to_string(people, ', '), '') as attendees from t
""")
def calendar_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    person = lambda name, email: F.struct(name.alias("name"), F.lit(email).alias("email"))
    people = F.array(person(F.when(i % 10 == 0, "Ann"), "u@x.org"), person(F.lit(""), "b@x.org"))
    day = F.col("ts").cast("date")
    events = load(spark, sf_dir, "events").select(
        i.cast("string").alias("id"),
        F.when(F.col("event_type") == "error", "cancelled").when(F.col("event_type") == "view", "tentative").alias("status"),
        F.when(i % 4 != 0, F.col("event_type")).alias("summary"),
        day.cast("string").alias("start"),
        F.when(i % 2 == 0, F.date_add(day, 1).cast("string")).otherwise("").alias("end"),
        F.when(i % 3 == 0, F.concat(F.lit("Room "), F.col("user_id").cast("string"))).alias("location"),
        F.col("props").alias("description"),
        F.when(i % 5 == 0, people).alias("attendees"),
        F.lit(None).cast("string").alias("recurring_id"),
    )
    return I.event_chunks(events).select("doc_id", "text", "content_hash", "chunk_index", "chunk_total", "summary", "status", "attendees")


@query(r"""
with m as (select conv_id || 'x' || turn as id, 't' || conv_id as thread_id, left(text, 30) as subject, role || '@x.org' as sender, 'word' || turn || ' one two.' as own, turn % 4 = 3 as listed, turn % 3 as k from conversations)
select 'gmail-' || id || '-body-0' as doc_id, own || case when k = 1 then chr(10) || 'two' else '' end as text, thread_id, sender, 2 as to_count, 0 as cc_count, 'INBOX,UNREAD' as labels, listed or regexp_matches(subject, '(?i)^(newsletter|digest|weekly|daily)\b') as bulk, case when k = 2 then '--' || chr(10) || 'Ann' else '' end as signature_block from m
""")
def message_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies with markup, a quoted reply or a signature."""
    turn = F.col("turn")
    own = F.concat(F.lit("word"), turn.cast("string"), F.lit(" one two."))
    body = F.when(turn % 3 == 0, F.concat(own, F.lit("\nOn Mon, 1 Jan 2024 Bob wrote:\n> quoted\n> words"))).when(turn % 3 == 1, F.concat(F.lit("<p>"), own, F.lit("</p><script>x</script><div>two</div>"))).otherwise(F.concat(own, F.lit("\n-- \nAnn")))
    header = F.struct(F.lit("List-Id").alias("name"), F.lit("<l>").alias("value"))
    none = F.array().cast("array<struct<name:string,value:string>>")
    mail = load(spark, sf_dir, "conversations").select(
        F.concat(F.col("conv_id").cast("string"), F.lit("x"), turn.cast("string")).alias("id"),
        F.concat(F.lit("t"), F.col("conv_id").cast("string")).alias("thread_id"),
        F.substring("text", 1, 30).alias("subject"),
        F.concat("role", F.lit("@x.org")).alias("sender"),
        F.lit("a@x.org, b@x.org").alias("to"),
        F.lit(None).cast("string").alias("cc"),
        F.lit("Mon, 1 Jan 2024 10:00:00 +0000").alias("date"),
        F.array(F.lit("INBOX"), F.lit("UNREAD")).alias("labels"),
        F.when(turn % 4 == 3, F.array(header)).otherwise(none).alias("headers"),
        body.alias("body"),
    )
    return I.message_chunks(mail).select("doc_id", "text", "thread_id", "sender", "to_count", "cc_count", "labels", "bulk", "signature_block")


@query(r"""
select 'gdrive-' || page_id || 'f-0' as doc_id, url as text, sha256(url) as content_hash, left(url, 200) as file_name, case when page_id % 2 = 0 then 'd1' end as drive_id from pages where page_id % 5 <> 0 and regexp_matches(url, '[\p{L}\p{N}]')
""")
def file_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as files whose text is their address; some are blank."""
    i = F.col("page_id")
    files = load(spark, sf_dir, "pages").select(
        F.concat(i.cast("string"), F.lit("f")).alias("id"),
        F.col("url").alias("name"),
        F.lit("text/plain").alias("mime_type"),
        F.lit("2024-01-01").alias("modified"),
        F.lit("Ann").alias("owner"),
        F.when(i % 2 == 0, "d1").otherwise("").alias("drive_id"),
        F.lit(None).cast("string").alias("folder"),
        F.when(i % 5 == 0, " \n ").otherwise(F.col("url")).alias("text"),
    )
    return I.file_chunks(files).select("doc_id", "text", "content_hash", "file_name", "drive_id")


@query("""
with l as (select user_id as key, max(event_id) as "offset", arg_max(event_type, event_id) as kind, arg_max(value, event_id) as value from events group by 1)
select key, "offset", kind, round(value, 4) as value from l where kind <> 'error'
""")
def change_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a log of changes, an error taking its user away: read from its beginning in rounds that are cut short twice and resumed."""
    log = load(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("offset"), (F.col("event_type") == "error").alias("gone"), F.col("event_type").alias("kind"), "value")
    first, last = log.agg(F.min("offset"), F.max("offset")).first()
    empty = log.drop("gone").limit(0)
    if first is None:
        return empty
    half = log.where(F.col("offset") <= (first + last) // 2)
    budget = max(1, (last - first) // 3)
    state, cursor = stored(empty, "feed"), I.Cursor(at=first - 1)
    new, cursor = I.step(state, half, cursor, budget)
    # the cursor is kept as text between runs
    state, cursor, _ = I.absorb(stored(new, "feed"), half, I.Cursor.of_json(cursor.to_json()), budget, lambda df: stored(df, "feed"))
    state, cursor, _ = I.absorb(state, log, cursor, budget, lambda df: stored(df, "feed"))
    return state.withColumn("value", F.round("value", 4))
