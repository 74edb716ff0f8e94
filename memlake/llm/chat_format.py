r"""Chat formatting from an event log: conversations are reconstructed, then rendered.

An event is (conv_id, turn, tie, message, part, kind, role, text). The log is partitioned by ranges of
conversations and, within a long one, of its messages, sorted by the first five, and folded, message by
message:

    open        begins a message, with its role and its first text
    delta       appends text
    edit        replaces the text
    regenerate  discards the text; deltas begin anew
    delete      takes the message away

A turn is rendered as `### role: text</turn>\n`. In role and text a backslash goes before each backslash,
each `###` and each `</turn>`, in the role also before a colon and a line feed, so that texts read back
exactly. The loss mask covers the texts of assistant turns, without marks.

The fold holds one message at a time and gives a conversation out in segments of whole turns, of about
SEGMENT_CHARS at most (a longer turn is a segment); so a task's memory depends on the longest message, not
on the conversation, and a long conversation is folded by several tasks. Only digests(), whose hashes run
over a conversation's turns in order, read its segments in one task, one after another.

Defined results: null texts and roles are empty; null turns and conversations sort first, null
conversations are one. An event for a message that was not opened opens it. Rows equal in every column
are separate messages. Ties of turn are put in the order of `tie`. An empty log gives no rows. Extra
columns are not carried.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from memlake.llm import common as C

SEGMENT_CHARS = 1 << 20
#: Code points of one delta when plain rows are turned into events.
DELTA_CHARS = 1024
_CONTROL = re.compile(r"\\|###|</turn>")
_IN_ROLE = re.compile(r"\\|###|</turn>|:|\n")
_ROLE_END = re.compile(r"\\.|: ", re.S)
_TEXT_END = re.compile(r"\\.|</turn>\n", re.S)
_ESCAPED = re.compile(r"\\(.)", re.S)

FORMATTED = "conv_id {id}, segment long, n_turns long, formatted string, loss array<struct<start:bigint,end:bigint>>"
_LOSS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def escape(text: str, pattern: re.Pattern = _CONTROL) -> str:
    return pattern.sub(lambda m: "\\" + m.group(), text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def render(role: str, text: str) -> tuple[str, tuple[int, int]]:
    """One turn, and where its text stands in it."""
    head, body = f"### {escape(role, _IN_ROLE)}: ", escape(text)
    return f"{head}{body}</turn>\n", (len(head), len(head) + len(body))


def parse(formatted: str) -> Iterator[tuple[str, str]]:
    """(role, text) of each turn, one at a time: the text is read once, from mark to mark."""
    at = 0
    while at < len(formatted):
        if not formatted.startswith("### ", at):
            raise ValueError(f"no turn at {at}")
        role = _marked(_ROLE_END, formatted, at + 4)
        said = _marked(_TEXT_END, formatted, role.end())
        yield unescape(formatted[at + 4 : role.start()]), unescape(formatted[role.end() : said.start()])
        at = said.end()


def _marked(mark: re.Pattern, formatted: str, at: int) -> re.Match:
    """The first mark from here on that isn't escaped."""
    for m in mark.finditer(formatted, at):
        if m[0][0] != "\\":
            return m
    raise ValueError(f"no mark after {at}")


def events_of_rows(rows: DataFrame, revised: bool = False) -> DataFrame:
    """The log of plain rows (conv_id, turn, role, text): each opens a message and streams its text in deltas, cut in one pass.

    revised: the log also tells how messages came about, and folds to the same rows. By the hash of role and
    text a third of them has a draft that is regenerated, and beside it a message that is deleted; a third opens with a draft
    that is edited. Drafts are the first delta.
    """
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    base = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("__role"), text.alias("__text"), F.monotonically_increasing_id().alias("message"))
    cut = F.regexp_extract_all("__text", F.lit(f"(?s).{{1,{DELTA_CHARS}}}"), F.lit(0))
    base = base.withColumns({"tie": F.xxhash64("__role", "__text"), "parts": cut})

    def event(kind: str, said: Column | str = "", withdrawn: bool = False) -> Column:
        words = said if isinstance(said, Column) else F.lit(said)
        return F.struct(F.lit(kind).alias("kind"), F.when(F.lit(kind == "open"), F.col("__role")).alias("role"), words.alias("text"), F.lit(withdrawn).alias("withdrawn"))

    deltas = lambda parts: F.transform(parts, lambda p: event("delta", p))
    draft = F.coalesce(F.get("parts", F.lit(0)), F.lit(""))
    plain = F.concat(F.array(event("open")), deltas("parts"))
    events = plain
    if revised:
        again = F.concat(F.array(event("open", draft, True), event("delete", "", True), event("open"), event("delta", draft), event("regenerate")), deltas("parts"))
        mended = F.concat(F.array(event("open", F.concat(draft, F.lit("?"))), event("edit", draft)), deltas(F.slice("parts", F.lit(2), F.greatest(F.size("parts"), F.lit(1)))))
        third = F.pmod("tie", F.lit(3))
        events = F.when(third == 0, again).when(third == 1, mended).otherwise(plain)
    each = base.select("conv_id", "turn", "tie", "message", F.posexplode(events).alias("part", "event"))
    message = F.when(F.col("event.withdrawn"), -1 - F.col("message")).otherwise(F.col("message"))
    return each.select("conv_id", "turn", "tie", message.alias("message"), "part", "event.kind", "event.role", "event.text")


_ORDER = ["conv_id", "turn", "tie", "message", "part"]


def _messages(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, str, str]]:
    """(conv_id, role, text) of each final message, in order."""
    at, role, parts, alive = None, "", [], False
    for batch in batches:
        for conv, turn, tie, message, _, kind, r, text in zip(*(batch.column(k).to_pylist() for k in range(8)), strict=True):
            if at != (conv, turn, tie, message):
                if alive:
                    yield at[0], role, "".join(parts)
                at, role, parts, alive = (conv, turn, tie, message), r or "", [], True
            if kind == "delta":
                parts.append(text or "")
            elif kind in ("open", "edit"):
                parts, role = [text or ""], r or role
            elif kind == "regenerate":
                parts = []
            elif kind == "delete":
                alive = False
    if alive:
        yield at[0], role, "".join(parts)


def format_chats(events: DataFrame, segment_chars: int = SEGMENT_CHARS, loss_role: str = "assistant") -> DataFrame:
    """Formatted segments (conv_id, segment, n_turns, formatted, loss spans in code points of the segment).

    A conversation's segments follow one another in the order of `segment`; most conversations have one.
    """
    C.small_batches(events.sparkSession)
    id_type, id_arrow = _types(events)
    log = events.select(*_ORDER, "kind", "role", "text").repartitionByRange(*_ORDER[:4]).sortWithinPartitions(*_ORDER)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        # ranges are numbered in their order
        conv, segment, turns, texts, loss, size = None, TaskContext.get().partitionId() << 32, 0, [], [], 0

        def flush():
            nonlocal turns, texts, loss, size, segment
            if turns:
                rows.append((conv, segment, turns, "".join(texts), loss))
                segment += 1
            turns, texts, loss, size = 0, [], [], 0

        def batch() -> pa.RecordBatch:
            kinds = [None, pa.int64(), pa.int64(), pa.string(), _LOSS]
            out = pa.RecordBatch.from_arrays([pa.array(c, k or id_arrow) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["conv_id", "segment", "n_turns", "formatted", "loss"])
            rows.clear()
            return out

        started, held = False, 0
        for c, role, text in _messages(batches):
            if not started or c != conv:
                flush()
                conv, started = c, True
            turn, (a, b) = render(role, text)
            if size and size + len(turn) > segment_chars:
                flush()
            if role == loss_role:
                loss.append({"start": size + a, "end": size + b})
            texts.append(turn)
            turns, size, held = turns + 1, size + len(turn), held + len(turn)
            if held > 4 * segment_chars and rows:
                held = size
                yield batch()
        flush()
        if rows:
            yield batch()

    return log.mapInArrow(run, FORMATTED.format(id=id_type))


def _types(df: DataFrame) -> tuple[str, pa.DataType]:
    """The type of conv_id, as Spark and as Arrow name it."""
    kind = df.schema["conv_id"].dataType
    return kind.simpleString(), to_arrow_type(kind)


def digests(formatted: DataFrame) -> DataFrame:
    """Of each conversation, read back from its segments as they follow one another: its turns, loss text and length."""
    C.small_batches(formatted.sparkSession)
    id_type, id_arrow = _types(formatted)
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for batch in batches:
            done = []
            for conv, text, loss in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "formatted", "loss")), strict=True):
                if state is None or conv != state[0]:
                    if state:
                        done.append(_closed(state))
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, said in parse(text):
                    state[1] += 1
                    state[2].update(f"{role}\n{said}\n".encode())
                for s in loss:
                    under = unescape(text[s["start"] : s["end"]])
                    state[3] += len(under)
                    state[4].update(under.encode())
                state[5] += len(text)
            if done:
                yield _rows(done)
        if state:
            yield _rows([_closed(state)])

    def _closed(s: list) -> tuple:
        return (s[0], s[1], s[2].hexdigest(), s[3], s[4].hexdigest(), s[5])

    def _rows(done: list[tuple]) -> pa.RecordBatch:
        kinds = [id_arrow, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], names=names)

    ordered = formatted.select("conv_id", "segment", "formatted", "loss").repartition("conv_id").sortWithinPartitions("conv_id", "segment")
    return ordered.mapInArrow(run, f"conv_id {id_type}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def joined(formatted: DataFrame, conv: Column | str = "conv_id") -> DataFrame:
    """One text per conversation, for conversations that fit a row."""
    parts = F.sort_array(F.collect_list(F.struct("segment", "formatted")))
    return formatted.groupBy(conv).agg(F.concat_ws("", F.transform(parts, lambda p: p["formatted"])).alias("formatted"))
