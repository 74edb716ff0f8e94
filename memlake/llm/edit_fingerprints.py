"""Document fingerprints: a randomised edit embedding, its sampled digits, bands of them, and verification.

The embedding is a walk: at step j it stands on one character and goes on to the next if a coin says so that all
texts share, thrown by (j modulo COINS, class of the character). Walks of two texts that differ by an edit
meet again after some steps and then read the same, so that edit distance becomes Hamming distance of
what the walks read; on average a character is read twice.

What is read is sampled: every step below SAMPLES, then one step from each of SAMPLES equal parts of each
power of two. A sample is a hexadecimal digit, a hash of the character read and the three after it. The
fingerprint of a text has as many digits as its walk reaches, so it grows with the logarithm of the length, and
fingerprints of any two texts compare. Their likeness is the share of equal digits, each weighted by the
steps that it stands for and corrected by the sixteenth that is equal by chance; 0 to 1.

Walks run in pieces of PIECE characters: memory depends on the text itself only.

near_classes() finds similar texts: digits of a fingerprint's last full powers of two, in several orders, are its
bands; rows are sorted by band and each is verified against the WINDOW before it, by the likeness of the whole
fingerprints. Links make classes. Work and rows are linear in the number of different fingerprints, however large
the groups of copies are; a pair is missed if it is never within a window in any band (tests measure it).

Defined results: a null text is empty; an empty text has the empty fingerprint, which is like the empty one only.
Equal texts have equal fingerprints. Documents are ordered by id, nulls first, equal ids by a hash of the text; the one
after the last is the first, after the only one itself. An empty table gives an empty result. Result columns
replace columns of the same names.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import accumulate
from operator import getitem, itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memlake.llm import common as C
from memlake.operators.graph import components

#: Coins before they repeat (a power of two), classes of characters, samples of each power of two, powers of two.
COINS, CLASSES, SAMPLES, POWERS = 2048, 64, 32, 40
PIECE = 1 << 18
#: Of near_classes: orders of a fingerprint's digits, rows before it that each row is verified against, least likeness.
BANDS, WINDOW, LEAST = 8, 8, 0.75

_DIGITS = np.frombuffer(b"0123456789abcdef", dtype=np.uint8)
_MIX = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F], dtype=np.uint32)


@lru_cache(1)
def coins() -> np.ndarray:
    """Whether the walk goes on, by step and class of the character: the same for all texts. No class stays for all steps."""
    thrown = np.random.RandomState(13).randint(0, 2, (COINS, CLASSES)).astype(bool)
    thrown[0] |= ~thrown.any(axis=0)
    return thrown


@lru_cache(1)
def _states() -> list[list]:
    """The walk as a graph: state (step modulo COINS) -> class of the next character -> state that leaves it; the state's number comes last."""
    goes, states = coins(), [[] for _ in range(COINS)]
    stay = np.zeros((COINS, CLASSES), dtype=np.int64)
    ahead = np.full(CLASSES, COINS)
    for s in range(2 * COINS - 1, -1, -1):
        ahead = np.where(goes[s % COINS], 1, ahead + 1)
        stay[s % COINS] = ahead
    for s, state in enumerate(states):
        state.extend(states[(s + t) % COINS] for t in stay[s].tolist())
        state.append(s)
    return states


@lru_cache(1)
def sampled() -> tuple[np.ndarray, np.ndarray]:
    """The steps that are sampled, ascending, and the steps that each stands for."""
    bits = SAMPLES.bit_length() - 1
    random, steps, weights = np.random.RandomState(14), [np.arange(SAMPLES)], [np.ones(SAMPLES)]
    for k in range(bits, POWERS):
        width = 1 << (k - bits)
        steps.append((1 << k) + np.arange(SAMPLES) * width + (random.random_sample(SAMPLES) * width).astype(np.int64))
        weights.append(np.full(SAMPLES, float(width)))
    return np.concatenate(steps).astype(np.int64), np.concatenate(weights)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


class Walk:
    """The character at which each sampled step stands, as far as the text has been read."""

    def __init__(self, state: int = 0, step: int = 0, n: int = 0, places: Sequence[np.ndarray] = ()):
        self.state, self.step, self.n, self.places = state, step, n, list(places)

    def fork(self) -> Walk:
        return Walk(self.state, self.step, self.n, self.places)

    def read(self, points: np.ndarray) -> Walk:
        states, steps = _states(), sampled()[0]
        classes = ((points * _MIX[0]) >> np.uint32(26)).astype(np.uint8)
        done = sum(map(len, self.places))
        for a in range(0, len(classes), PIECE):
            part = classes[a : a + PIECE].tobytes()
            seen = np.fromiter(map(itemgetter(CLASSES), accumulate(part, getitem, initial=states[self.state])), np.int32, len(part) + 1)
            left = self.step + np.cumsum(((seen[1:] - seen[:-1] - 1) & (COINS - 1)) + 1, dtype=np.int64)
            self.state, self.step = int(seen[-1]), int(left[-1])
            upto = int(np.searchsorted(steps, self.step))
            self.places.append(self.n + np.searchsorted(left, steps[done:upto], side="right"))
            self.n += len(part)
            done = upto
        return self

    def digits(self, points: np.ndarray) -> np.ndarray:
        """The samples as numbers from 0 to 15; points: all that was read."""
        if not self.n:
            return np.zeros(0, dtype=np.uint8)
        at = np.concatenate(self.places)
        padded = np.concatenate([points, np.zeros(3, dtype=np.uint32)])
        return (sum(padded[at + k] * _MIX[k] for k in range(4)) >> np.uint32(28)).astype(np.uint8)


def written(digits: np.ndarray) -> str:
    return _DIGITS[digits].tobytes().decode()


def digits_of(fingerprint: str) -> np.ndarray:
    raw = np.frombuffer(fingerprint.encode(), dtype=np.uint8)
    return np.where(raw > 57, raw - 87, raw - 48).astype(np.uint8)


def fingerprint(text: str | None) -> str:
    points = code_points(text or "")
    return written(Walk().read(points).digits(points))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of steps at which two walks read the same, of the longer one's; estimated by the samples."""
    both, most = min(len(a), len(b)), max(len(a), len(b))
    if not most:
        return 1.0
    weights = sampled()[1][:most]
    equal = weights[:both][a[:both] == b[:both]].sum()
    unequal = weights[:both].sum() - equal
    return max(0.0, round(float((equal - unequal / 15) / weights.sum()), 9))


def fingerprints(docs: DataFrame, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Add n_chars and fingerprint to docs."""

    def make():
        def work(texts: list) -> list[pa.Array]:
            return [pa.array([len(t or "") for t in texts], pa.int64()), pa.array([fingerprint(t) for t in texts], pa.string())]

        return work

    return C.map_rows(docs, text_col, make, [C.field("n_chars", T.LongType()), C.field("fingerprint", T.StringType())], carry)


class _Read:
    """A document's text, its walk, and the walk up to the part that an edit replaces."""

    def __init__(self, doc: object, text: str | None):
        self.doc, self.text = doc, text or ""
        self.points = code_points(self.text)
        self.tail = len(self.points) // 2
        self.start = Walk().read(self.points[: len(self.points) - self.tail])
        self.digits = self.start.fork().read(self.points[len(self.points) - self.tail :]).digits(self.points)

    def beside(self, next_one: _Read) -> tuple:
        """n_chars, digest and fingerprint of the edited text, own fingerprint, and the likenesses."""
        n = len(self.points)
        text = self.text[: n - self.tail] + next_one.text[: self.tail]
        points = np.concatenate([self.points[: n - self.tail], next_one.points[: self.tail]])
        edited = self.start.fork().read(next_one.points[: self.tail]).digits(points)
        digest = hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()
        return self.doc, n, digest, written(self.digits), written(edited), likeness(self.digits, edited), likeness(self.digits, next_one.digits)


_NAMES = ["n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def beside_next(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of each document.

    The edited text is the document's with its last half replaced by the beginning of the next document.
    Texts are shuffled once, into ranges of the order, and each range is read in order with one document held. The
    last of a range goes with the first of the next in a second step, which has two rows for each range.
    """
    C.small_batches(docs.sparkSession)
    id_field = docs.schema[id_col]
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    order = ["id", "tie"]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("range", F.spark_partition_id()).select("id", "text", "range")
    kind = id_field.dataType.simpleString()
    # edge: 1 for the first of a range, 2 for the last, with their texts; 0 for a result
    schema = f"range int, edge int, id {kind}, text string, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    kinds = [pa.int32(), pa.int32(), None, pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, place, id_type = None, None, None
        for batch in batches:
            id_type, out = batch.column(0).type, []
            for k in range(batch.num_rows):
                doc, text = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
                now = _Read(doc, text)
                if held is None:
                    place = batch.column(2)[k].as_py()
                    out.append((place, 1, doc, text, *[None] * 6))
                else:
                    doc, *found = held.beside(now)
                    out.append((place, 0, doc, None, *found))
                held = now
            yield _rows(out, id_type)
        if held is not None:
            yield _rows([(place, 2, held.doc, held.text, *[None] * 6)], id_type)

    def _rows(out: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
        cols = zip(*out, strict=True) if out else [[]] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, k or id_type) for c, k in zip(cols, kinds, strict=True)], names=["range", "edge", "id", "text", *_NAMES])

    found = C.stored(ranged.mapInArrow(run, schema), "beside")
    # the ranges that have rows, in order: as many as tasks at most
    places = sorted(r["range"] for r in found.where("edge = 1").select("range").collect())
    follows = F.create_map(*[F.lit(x) for pair in zip(places, places[1:] + places[:1], strict=True) for x in pair]) if places else F.lit(None).cast("map<int,int>")
    last = found.where("edge = 2").select("id", "text", follows[F.col("range")].alias("range"))
    first = found.where("edge = 1").select("range", F.col("text").alias("next"))

    def make():
        def work(texts: list, others: list) -> list[pa.Array]:
            done = [_Read(None, a).beside(_Read(None, b))[1:] for a, b in zip(texts, others, strict=True)]
            return [pa.array(c, k) for c, k in zip(zip(*done, strict=True) if done else [[]] * 6, kinds[4:], strict=True)]

        return work

    types = [T.LongType(), T.StringType(), T.StringType(), T.StringType(), T.DoubleType(), T.DoubleType()]
    edges = C.map_rows(last.join(first, "range"), "text", make, [C.field(n, t) for n, t in zip(_NAMES, types, strict=True)], ["id"], also=["next"])
    return found.where("edge = 0").select("id", *_NAMES).unionByName(edges.select("id", *_NAMES)).withColumnRenamed("id", id_col)


@lru_cache(1)
def _orders() -> np.ndarray:
    """Orders of the digits of two powers of two, one for each band."""
    random = np.random.RandomState(15)
    return np.stack([random.permutation(2 * SAMPLES) for _ in range(BANDS)])


def bands(fingerprint: str) -> list[tuple[int, str]]:
    """(power and number of the band, its digits) of the last two full powers of two, and of the two before, as texts of somewhat different lengths end in different ones."""
    digits, full = digits_of(fingerprint), max(2, len(fingerprint) // SAMPLES)
    out = []
    for q in {full, max(2, full - 1)}:
        part = digits[(q - 2) * SAMPLES : q * SAMPLES]
        part = np.concatenate([part, np.zeros(2 * SAMPLES - len(part), dtype=np.uint8)])
        out.extend((q * BANDS + b, written(part[o])) for b, o in enumerate(_orders()))
    return out


def near_classes(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", least: float = LEAST) -> DataFrame:
    """(id, fingerprint, class_id, n_links): the smallest id of the documents linked by a likeness of at least `least`, and how many different fingerprints are linked to the document's."""
    C.small_batches(docs.sparkSession)
    own = C.stored(fingerprints(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "text", ["id"]), "fingerprints")
    # a node for each fingerprint: copies are one
    nodes = own.groupBy("fingerprint").agg(F.min("id").alias("least")).where("fingerprint <> ''").withColumn("node", F.xxhash64("fingerprint"))

    def make():
        def work(prints: list, _: list) -> list[pa.Array]:
            kind = pa.list_(pa.struct([("band", pa.int32()), ("digits", pa.string())]))
            return [pa.array([[{"band": b, "digits": d} for b, d in bands(p)] for p in prints], kind)]

        return work

    field = C.field("bands", T.ArrayType(T.StructType([T.StructField("band", T.IntegerType()), T.StructField("digits", T.StringType())])))
    dealt = C.map_rows(nodes, "fingerprint", make, [field], ["node", "fingerprint"], also=["node"]).select("node", "fingerprint", F.inline("bands"))
    ordered = dealt.repartitionByRange("band", "digits", "node").sortWithinPartitions("band", "digits", "node").select("band", "node", "fingerprint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        window: deque = deque(maxlen=WINDOW)
        at = None
        for batch in batches:
            links = []
            for band, node, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if band != at:
                    window.clear()
                    at = band
                digits = digits_of(text)
                links.extend((min(node, other), max(node, other)) for other, seen in window if other != node and likeness(digits, seen) >= least)
                window.append((node, digits))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*links, strict=True) if links else ((), ()))], names=["a", "b"])

    links = C.stored(ordered.mapInArrow(run, "a long, b long").distinct(), "links")
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    degrees = both.groupBy(F.col("a").alias("node")).agg(F.count("*").alias("n_links"))
    found = components(links).toDF("node", "label")
    named = nodes.join(found, "node", "left").join(degrees, "node", "left").withColumn("label", F.coalesce("label", "node"))
    named = C.stored(named.select("fingerprint", "least", "label", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links")), "named")
    classes = named.groupBy("label").agg(F.min("least").alias("class_id"))
    by_print = named.join(classes, "label").select("fingerprint", "class_id", "n_links")
    linked = own.join(by_print.hint("merge"), "fingerprint", "left")
    return linked.select(F.col("id").alias(id_col), "fingerprint", F.coalesce("class_id", "id").alias("class_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))
