"""Messages, events and files as chunk rows, and feeds of changes that resume."""

from __future__ import annotations

import json
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlake.functions import mail as M
from memlake.functions.text import strip_html
from memlake.operators.chunking import chunk_documents

VERSION = 2


def _text(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def _cut(c: str, most: int) -> Column:
    return F.substring(_text(c), 1, most)


def _chunks(rows: DataFrame, doc_id, meta: list[str]) -> DataFrame:
    """rows (__key, __text, ..) as chunks; doc_id makes an id of the key, the chunk's number and their count.

    Only keys and texts pass through Python; the rest is joined by the key.
    """
    parts = chunk_documents(rows.select("__key", "__text"), "__key", "__text")
    base = rows.select("__key", *meta).withColumnRenamed("__key", "__base")
    both = parts.join(base, F.col("__key") == F.col("__base"))
    return both.select(doc_id(F.col("__key"), F.col("chunk_index"), F.col("chunk_total")).alias("doc_id"), "text", "content_hash", "chunk_index", "chunk_total", F.lit(VERSION).alias("chunker_version"), *meta)


def message_chunks(messages: DataFrame) -> DataFrame:
    """Chunks gmail-<id>-body-<i> of (id, thread_id, subject, sender, to, cc, date, labels, headers, body).

    Markup, quoted replies and the signature leave the body; bulk mail is marked, not dropped; a message
    without a body gives no row.
    """
    own = M.own_text(strip_html(F.col("body")))
    sign = M.signature(own)
    rows = messages.withColumn("__sign", sign).withColumn("__own", own)
    rows = rows.select(
        F.col("id").alias("__key"),
        F.expr("left(__own, length(__own) - length(__sign))").alias("__text"),
        F.lit("gmail").alias("source_type"),
        F.col("id").alias("message_id"),
        _text("thread_id").alias("thread_id"),
        _cut("subject", 200).alias("subject"),
        _cut("sender", 200).alias("sender"),
        _cut("to", 2000).alias("to"),
        _cut("cc", 2000).alias("cc"),
        F.regexp_count(_text("to"), F.lit("@")).alias("to_count"),
        F.regexp_count(_text("cc"), F.lit("@")).alias("cc_count"),
        _cut("date", 80).alias("date"),
        F.substring(F.array_join(F.coalesce("labels", F.array().cast("array<string>")), ","), 1, 200).alias("labels"),
        F.substring("__sign", 1, 500).alias("signature_block"),
        M.is_bulk(F.col("headers"), F.col("subject")).alias("bulk"),
    )
    meta = [c for c in rows.columns if not c.startswith("__")]
    return _chunks(rows, lambda k, i, n: F.concat(F.lit("gmail-"), k, F.lit("-body-"), i.cast("string")), meta)


def event_chunks(events: DataFrame) -> DataFrame:
    """Chunks cal-<id> (cal-<id>-<i> if there are several) of (id, status, summary, start, end, location, description, attendees: array<struct<name,email>>, recurring_id); cancelled events give none."""
    named = F.transform(F.coalesce("attendees", F.array().cast("array<struct<name:string,email:string>>")), lambda a: F.when(F.coalesce(a["name"], F.lit("")) != "", a["name"]).otherwise(F.coalesce(a["email"], F.lit(""))))
    line = lambda label, c: F.when(c != "", F.concat(F.lit(label), c))
    live = events.where(F.coalesce("status", F.lit("")) != "cancelled").withColumns({"__people": F.array_join(named, ", "), "__title": F.coalesce("summary", F.lit("(no title)"))})
    when = F.when(_text("start") != "", F.concat(F.lit("When: "), "start", F.when(_text("end") != "", F.concat(F.lit(" to "), "end")).otherwise("")))
    text = F.concat_ws("\n", "__title", when, line("Location: ", _text("location")), line("Attendees: ", F.col("__people")), line("", _text("description")))
    rows = live.select(
        F.col("id").alias("__key"),
        text.alias("__text"),
        F.lit("calendar").alias("source_type"),
        F.col("id").alias("event_id"),
        F.substring("__title", 1, 200).alias("summary"),
        _cut("start", 40).alias("start"),
        _cut("end", 40).alias("end"),
        _cut("location", 200).alias("location"),
        F.substring("__people", 1, 300).alias("attendees"),
        F.coalesce("status", F.lit("confirmed")).alias("status"),
        _text("recurring_id").alias("recurring_event_id"),
    )
    meta = [c for c in rows.columns if not c.startswith("__")]
    return _chunks(rows, lambda k, i, n: F.concat(F.lit("cal-"), k, F.when(n > 1, F.concat(F.lit("-"), i.cast("string"))).otherwise("")), meta)


def file_chunks(files: DataFrame) -> DataFrame:
    """Chunks gdrive-<id>-<i> of (id, name, mime_type, modified, owner, drive_id, folder, text); blank files give none."""
    rows = files.where(F.trim(F.regexp_replace(_text("text"), r"\s+", " ")) != "").select(
        F.col("id").alias("__key"),
        F.col("text").alias("__text"),
        F.lit("gdrive").alias("source_type"),
        F.col("id").alias("file_id"),
        _cut("name", 200).alias("file_name"),
        _cut("mime_type", 100).alias("mime_type"),
        _text("modified").alias("modified"),
        _cut("owner", 100).alias("owner"),
        F.when(_text("drive_id") != "", F.col("drive_id")).alias("drive_id"),
        F.when(_text("folder") != "", F.substring("folder", 1, 300)).alias("folder_path"),
    )
    meta = [c for c in rows.columns if not c.startswith("__")]
    return _chunks(rows, lambda k, i, n: F.concat(F.lit("gdrive-"), k, F.lit("-"), i.cast("string")), meta)


# -- feeds -------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Cursor:
    """How far a feed has come: `at` (changes up to it are done; None: never run) and, of the round after it, its end
    and how far it is done. A round that was cut short goes on where it stopped; `at` moves at its end only."""

    at: int | None = None
    goal: int | None = None
    done: int | None = None

    def to_json(self) -> str:
        return json.dumps(self.__dict__)

    @staticmethod
    def of_json(text: str | None) -> Cursor:
        return Cursor(**json.loads(text)) if text else Cursor()


def step(state: DataFrame, changes: DataFrame, cursor: Cursor, budget: int, key: str = "key", offset: str = "offset", snapshot: DataFrame | None = None) -> tuple[DataFrame, Cursor]:
    """One bounded step of a feed: (state after it, cursor after it).

    changes: (key, offset, gone, payload columns..), a log whose oldest part may have been dropped. state:
    (key, offset, payload..): of each key the last change, the rows of keys that are gone left out. A first
    run takes the log's end as its cursor, its state being the snapshot if there is one. A cursor older than
    the log is reset the same way. The changes of one step are those of the next `budget` offsets: the last
    of each key wins, an offset that the state has already is not taken again.
    """
    first, last = changes.agg(F.min(offset), F.max(offset)).first()
    if cursor.at is None or first is not None and cursor.at < first - 1:
        return (state if snapshot is None else snapshot), Cursor(at=last if last is not None else cursor.at)
    if cursor.goal is None:
        if last is None or last <= cursor.at:
            return state, cursor
        cursor = replace(cursor, goal=last, done=cursor.at)
    end = min(cursor.goal, cursor.done + budget)
    taken = changes.where((F.col(offset) > cursor.done) & (F.col(offset) <= end))
    columns = state.columns
    newest = taken.groupBy(key).agg(F.max_by(F.struct(F.col("gone"), *columns), offset).alias("__new"), F.max(offset).alias("__at"))
    both = state.select(F.col(key).alias("__key"), F.struct(*columns).alias("__old")).join(newest, F.col("__key") == F.col(key), "full_outer")
    fresh = F.col("__at").isNotNull() & (F.col("__old").isNull() | (F.col(f"__old.{offset}") < F.col("__at")))
    kept = both.where(~(fresh & F.col("__new.gone")))
    row = [F.when(fresh, F.col(f"__new.{c}")).otherwise(F.col(f"__old.{c}")).alias(c) for c in columns]
    after = Cursor(at=cursor.goal) if end == cursor.goal else replace(cursor, done=end)
    return kept.where(fresh | F.col("__old").isNotNull()).select(*row), after


def absorb(state: DataFrame, changes: DataFrame, cursor: Cursor, budget: int, store, **names) -> tuple[DataFrame, Cursor, int]:
    """Steps until the log is absorbed: (state, cursor, steps). store writes a state to the shared folder after each."""
    n = 0
    while True:
        new, after = step(state, changes, cursor, budget, **names)
        if after == cursor:
            return state, cursor, n
        state, cursor, n = store(new), after, n + 1
