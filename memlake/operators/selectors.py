"""Reads of the chunk, action, thread and finding tables, as filters that reach the scan, and the guards on changes.

Flags of a chunk's metadata are columns of their own, so that they prune; the newest come first by `position`.
"""

from __future__ import annotations

import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def newest(rows: DataFrame, limit: int | None, position: str = "position") -> DataFrame:
    """The newest rows; all if there is no limit."""
    return rows if limit is None else rows.orderBy(F.desc(position)).limit(limit)


def of_file(chunks: DataFrame, file_id: str) -> DataFrame:
    """A file's chunks in the order of their numbers (9 before 89)."""
    return chunks.where(F.col("file_id") == file_id).orderBy(F.col("chunk_index").cast("int"), "doc_id")


def unenriched(chunks: DataFrame, limit: int | None = None) -> DataFrame:
    """Not yet extracted, not set aside as cold, and no digests, which are extraction's own output."""
    wanted = ~F.col("enriched") & (F.coalesce("enrich_state", F.lit("")) != "cold") & ~F.startswith("doc_id", F.lit("enriched-"))
    return newest(chunks.where(wanted), limit)


def notes(chunks: DataFrame, as_of: str, kind: str | None = None, expired: bool = False, skip_distilled: bool = False, review_days: int = 30, limit: int = 500) -> DataFrame:
    """The newest live notes. A note that was looked at and kept comes up again after review_days; one with any other verdict does not."""
    keep = F.startswith("doc_id", F.lit("note-"))
    if not expired:
        keep &= ~F.coalesce("expired", F.lit(False))
    if skip_distilled:
        again = (F.col("verdict") == "keep") & (F.datediff(F.lit(as_of).cast("date"), F.col("distilled_at")) > review_days)
        keep &= F.col("distilled_at").isNull() | F.coalesce(again, F.lit(False))
    if kind is not None:
        keep &= F.col("observation_type") == kind
    return newest(chunks.where(keep), limit)


def inbound_since(chunks: DataFrame, cursor: str | None) -> DataFrame:
    """Chunks dated after the cursor (undated ones only without a cursor) that were not sent by the owner."""
    sent = F.coalesce(F.array_contains(F.split("labels", ","), "SENT"), F.lit(False))
    rows = chunks.where(~sent)
    return rows if cursor is None else rows.where(F.coalesce("date", "date_iso") > cursor)


def is_outbound(labels: Column, is_inbound: Column, sender: Column, identity: str) -> Column:
    """By the SENT label, the flag, or the owner's address."""
    own = F.lower(F.coalesce(sender, F.lit("")))
    known = F.contains(F.lit(identity.lower()), own) & (own != "") if identity else F.lit(False)
    return F.coalesce(F.array_contains(F.split(labels, ","), "SENT"), F.lit(False)) | F.coalesce(~is_inbound, F.lit(False)) | known


def is_self_message(is_self: Column, sender: Column, recipients: Column, identity: str) -> Column:
    """The flag if there is one; else the owner wrote to nobody but the owner (recipients: array of addresses)."""
    to = F.filter(F.transform(recipients, lambda a: F.lower(a)), lambda a: a != "")
    return F.coalesce(is_self, (F.lower(sender) == identity.lower()) & F.forall(F.coalesce(to, F.array().cast("array<string>")), lambda a: a == identity.lower()))


def is_long_past(deadline: Column, as_of: str, days: int = 730) -> Column:
    """A deadline so far back that the action is dead; never where it is missing or no date."""
    return F.coalesce(F.datediff(F.lit(as_of).cast("date"), F.try_to_date(F.substring(deadline, 1, 10), "yyyy-MM-dd")) > days, F.lit(False))


def worth_recalling(prompt: Column, least: int = 12) -> Column:
    p = F.trim(F.coalesce(prompt, F.lit("")))
    return (F.char_length(p) >= least) & ~F.startswith(p, F.lit("/"))


def actions(rows: DataFrame, owner: str | None = None, status: str | None = None, thread: object = None) -> DataFrame:
    """Of an owner in any case of letters, a status, a thread; what isn't given doesn't matter."""
    asked = [F.lower("owner") == owner.lower() if owner is not None else None, F.col("status") == status if status is not None else None, F.col("thread_id") == thread if thread is not None else None]
    return reduce(lambda df, c: df.where(c), [c for c in asked if c is not None], rows)


def waiting(rows: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """Open actions that wait for someone since no more than `days`."""
    return rows.where((F.col("status") == "open") & F.col("waiting_on").isNotNull() & (F.col("waiting_since") > F.date_sub(F.lit(as_of).cast("date"), days)))


def open_findings(findings: DataFrame, kind: str | None = None) -> DataFrame:
    rows = findings.where(F.col("resolved_at").isNull())
    return rows if kind is None else rows.where(F.col("finding_type") == kind)


def needing_summary(threads: DataFrame, least: int = 5) -> DataFrame:
    """Long threads without a summary, or with messages since it was written."""
    stale = (F.coalesce(F.col("summary_at").cast("string"), F.lit("")) != "") & (F.col("last_updated") > F.col("summary_at"))
    return threads.where((F.col("email_count") >= least) & ((F.coalesce("summary", F.lit("")) == "") | F.coalesce(stale, F.lit(False))))


def stale_files(chunks: DataFrame, version: int, limit: int) -> DataFrame:
    """Files with a chunk of an older chunker, the longest untouched first."""
    old = chunks.where((F.col("source_type") == "gdrive") & F.col("file_id").isNotNull() & (F.coalesce("chunker_version", F.lit(0)) < version))
    return old.groupBy("file_id").agg(F.min("position").alias("first")).orderBy("first", "file_id").limit(limit)


def gold_cold(chunks: DataFrame, gold: DataFrame) -> DataFrame:
    """One row: expected documents that are there, how many of them are cold, and their share."""
    there = chunks.join(gold.select("doc_id").distinct(), "doc_id", "left_semi")
    cold = F.count_if(F.coalesce("enrich_state", F.lit("")) == "cold")
    return there.agg(F.count("*").alias("present"), cold.alias("cold")).withColumn("pct", F.when(F.col("present") > 0, F.round(100.0 * F.col("cold") / F.col("present"), 1)).otherwise(0.0))


def snoozed(rows: DataFrame, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Actions with the snoozes asked for (id, until), open ones only, and the log of what each replaced. A date that is none is an error."""
    for r in asked.where(F.try_to_date("until", "yyyy-MM-dd").isNull()).limit(1).collect():
        raise ValueError(f"not a date: {r.until}")
    latest = asked.groupBy("id").agg(F.max("until").alias("__until"))
    both = rows.join(latest, "id", "left").withColumn("__hit", F.col("__until").isNotNull() & (F.col("status") == "open"))
    log = both.where("__hit").select("id", F.concat(F.lit("snoozed_until:"), F.coalesce(F.col("snoozed_until").cast("string"), F.lit(""))).alias("revert_ref"))
    return both.withColumn("snoozed_until", F.when(F.col("__hit"), F.col("__until")).otherwise(F.col("snoozed_until"))).drop("__until", "__hit"), log


def shown(rows: DataFrame, today: str) -> DataFrame:
    """Actions that are not asleep on a day."""
    return rows.where(F.col("snoozed_until").isNull() | (F.col("snoozed_until") == "") | (F.col("snoozed_until") <= today))


def purged(chunks: DataFrame, doc_ids: DataFrame, cited: DataFrame) -> DataFrame:
    """chunks without doc_ids; an error, with nothing deleted, if any of them is cited."""
    held = doc_ids.join(cited, "doc_id", "left_semi").limit(3).collect()
    if held:
        raise ValueError(f"cited as provenance: {[r.doc_id for r in held]}")
    return chunks.join(doc_ids.select("doc_id").distinct(), "doc_id", "left_anti")


def reset_enriched(chunks: DataFrame, doc_ids: DataFrame) -> DataFrame:
    """The chunks asked for are to be extracted again."""
    asked = doc_ids.select("doc_id").distinct().withColumn("__again", F.lit(True))
    return chunks.join(asked, "doc_id", "left").withColumn("enriched", F.col("enriched") & F.col("__again").isNull()).drop("__again")


def recalled(strengths: DataFrame, hits: DataFrame, now: str) -> DataFrame:
    """One stronger for every recall, and last used now; hits may name a document several times."""
    times = hits.groupBy("doc_id").agg(F.count("*").alias("__n"))
    both = strengths.join(times, "doc_id", "left")
    used = F.col("__n").isNotNull()
    return both.withColumns({"strength": F.col("strength") + F.coalesce("__n", F.lit(0)), "last_used": F.when(used, F.lit(now).cast("date")).otherwise(F.col("last_used"))}).drop("__n")


def core(chunks: DataFrame, most: int = 12) -> DataFrame:
    """chunks with tier anew: the most salient durable notes are core, what was core besides is hot."""
    top = chunks.where(F.col("memory_type").isin("semantic", "procedural") & (F.col("salience") > 0)).orderBy(F.desc("salience"), F.desc("position")).limit(most).select("doc_id", F.lit(True).alias("__core"))
    both = chunks.join(F.broadcast(top), "doc_id", "left")
    return both.withColumn("tier", F.when(F.col("__core"), "core").when(F.col("tier") == "core", "hot").otherwise(F.col("tier"))).drop("__core")


def keepers(chunks: DataFrame) -> DataFrame:
    """Of each file the chunk with the largest number, as a number."""
    return chunks.where("file_id is not null").groupBy("file_id").agg(F.max_by("doc_id", F.struct(F.col("chunk_index").cast("int"), "doc_id")).alias("doc_id"))


def parse_cursor(cursor: str | None) -> str | None:
    """An ISO date, checked."""
    return None if cursor is None else datetime.date.fromisoformat(cursor[:10]).isoformat()
