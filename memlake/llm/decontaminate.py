"""Benchmark decontamination: one Aho-Corasick automaton over the windows of all test items.

Texts are normalised to words: A-Z lower-cased, words being runs of letters a-z, digits and all
characters from U+0080 on. The automaton runs over word numbers, so a document is scanned once, whatever
the number of windows, and hits are spans of words, mapped back to code-point offsets of the original.

Defined results: a null or empty text has no words and no hits; an item without words has no window; a
null item id is reported as 'null'. Items with equal windows are all reported, equal ids once. Repeated
documents are scanned each for itself. Empty tables give an empty result or no hits. Input columns named
like a result are replaced.

The items are broadcast in blocks of at most BLOCK_BYTES of text, whose automaton a worker builds once and
keeps (some 90 bytes of memory and 2 microseconds for a byte of items); a benchmark beyond one block is
scanned block after block, and the spans are united.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memlake.llm import common as C

WINDOW = 10
BLOCK_BYTES = 2 << 20
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_WORD = re.compile("[0-9A-Za-z\u0080-\U0010ffff]+")


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(_TABLE).split() if text else []


class Windows:
    """The automaton: every run of `window` words of an item, or a shorter item's whole text."""

    def __init__(self, items: Iterable[tuple[str, str | None]], window: int = WINDOW):
        self.numbers: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            ids = tuple(self.numbers.setdefault(w, len(self.numbers) + 1) for w in words_of(text))
            for k in range(max(1, len(ids) - window + 1) if ids else 0):
                found.setdefault(ids[k : k + window], set()).add(item)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for key, names in found.items():
            self.automaton.add_word(key, (len(key), tuple(sorted(names))))
        self.empty = not found
        if found:
            self.automaton.make_automaton()

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Spans of hit words, united (end exclusive), and the items whose windows occur."""
        if self.empty or not words:
            return [], set()
        spans, items = [], set()
        for end, (n, names) in self.automaton.iter(tuple(map(self.numbers.get, words, [0] * len(words)))):
            spans.append((end + 1 - n, end + 1))
            items.update(names)
        return united(spans), items


def united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


_SPAN = T.ArrayType(T.StructType([C.field("start", T.LongType()), C.field("end", T.LongType())]))
_PA_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int) -> Iterable[list[tuple[str, str]]]:
    """The items in blocks: a hash of the item deals them out, so that a block is about block_bytes at most."""
    size = benchmark.agg(F.sum(F.octet_length(text_col) + 16)).first()[0] or 0
    n = -(-2 * size // block_bytes) if size > block_bytes else 1
    named = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("item"), F.col(text_col).alias("text"))
    block = F.pmod(F.xxhash64("item", "text"), F.lit(n))
    for k in range(n):
        yield [tuple(r) for r in named.where(block == k).distinct().collect()]


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, carry: list[str] | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Add n_words, hit_words and hit_chars (spans in words and in code points, of the original), items."""
    fields = [C.field("n_words", T.LongType()), C.field("hit_words", _SPAN), C.field("hit_chars", _SPAN), C.field("items", T.ArrayType(T.StringType()))]
    spark, out = docs.sparkSession, docs
    needed = None if carry is None else [*carry, *([] if text_col in carry else [text_col])]
    earlier = {n: f"__earlier_{n}" for n in ("hit_words", "hit_chars", "items")}
    for k, items in enumerate(_blocks(benchmark, item_id_col, item_text_col, block_bytes)):
        if k:
            out = C.stored(out, "decontaminate").withColumnsRenamed(earlier)
        out = C.map_rows(out, text_col, _scanner(spark.sparkContext.broadcast(items), window), fields, needed if k == 0 or needed is None else [*needed, *earlier.values()])
        if k:
            both = {n: F.concat(old, n) for n, old in earlier.items()}
            out = out.withColumns({**both, "items": F.array_sort(F.array_distinct(both["items"]))}).drop(*earlier.values())
            out = out.withColumns({n: _united_column(n) for n in ("hit_words", "hit_chars")})
    return out if carry is None or text_col in carry else out.drop(text_col)


def _united_column(name: str):
    """Overlapping or touching spans of words as one; spans of characters are united where they overlap."""
    touch = "x.start <= y.end"
    return F.expr(
        f"""aggregate(array_sort({name}), cast(array() as array<struct<start:bigint,end:bigint>>), (acc, x) ->
        case when size(acc) = 0 then array(x) else transform(array(element_at(acc, -1)), y -> case when {touch} then
        concat(slice(acc, 1, size(acc) - 1), array(named_struct('start', y.start, 'end', greatest(x.end, y.end)))) else concat(acc, array(x)) end)[0] end)"""
    )


#: The automaton that this worker has built last, by the name of its block.
_built: dict[str, Windows] = {}


def _windows(name: str, items, window: int) -> Windows:
    if name not in _built:
        _built.clear()
        _built[name] = Windows(items.value, window)
    return _built[name]


def _scanner(items, window: int):
    name = uuid.uuid4().hex

    def make():
        windows = _windows(name, items, window)

        def work(texts: list) -> list[pa.Array]:
            n, spans, chars, names = [], [], [], []
            for text in texts:
                words = words_of(text)
                hit, found = windows.scan(words)
                n.append(len(words))
                spans.append([{"start": a, "end": b} for a, b in hit])
                chars.append(_offsets(text, hit))
                names.append(sorted(found))
            return [pa.array(n, pa.int64()), pa.array(spans, _PA_SPAN), pa.array(chars, _PA_SPAN), pa.array(names, pa.list_(pa.string()))]

        return work

    return make


def _offsets(text: str, hit: list[tuple[int, int]]) -> list[dict[str, int]]:
    if not hit:
        return []
    at = [m.span() for m in _WORD.finditer(text)]
    return [{"start": at[a][0], "end": at[b - 1][1]} for a, b in hit]
