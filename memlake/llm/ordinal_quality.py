"""Quality classifier: ordinal cumulative-link regression on graded ratings.

P(grade <= k) = sigmoid(threshold_k - w.x) with one weight vector over hashed text features and ordered
thresholds. A document gets its expected grade and the tail probability P(grade >= cut), by which it is
selected. Features: words (letters and digits, A-Z lower-cased), what is left of words without letters
(digits as 9), and the length's order of magnitude; each bucket has log(1 + count) / log(2 + words).

The fit takes rated documents in the order of their id hashes, at most `max_rows` of them and no more than have
`max_cells` features together (the first one always); each of them with all its features. So the sample is the
same on every run, and its features (not texts) fit the driver: some 40 bytes each while the fit runs, 0.5 GB in
all. All documents are scored, by all their features.

Defined results: a null or empty text has the length feature only. Ratings whose document is missing and
null ratings are passed over; an id rated more than once counts with its lowest grade, and an id of
several documents with the text of the smallest hash. Where no feature tells the grades apart, all
documents have the tail probability of the ratings and are kept or rejected by it. Without any ratings
there is no model: every grade is equally likely and nothing is rejected. An empty table gives an empty result. Input
columns named like a result are replaced.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memlake.llm import common as C

BUCKETS = 1 << 16
#: Rated documents of the fit, and features of them all: the bounds of the sample.
MAX_ROWS, MAX_CELLS = 12_000, 12_000_000
STEPS, RATE, SHRINK = 250, 0.08, 1e-4
#: Buckets take part in the fit if their score statistic at zero weights is this large for some grade, and they occur in this many rated documents.
LEAST_Z, LEAST_ROWS = 5.0, 5
#: Documents are kept at this tail probability or above.
KEEP = 0.5

_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_NINES = bytes(57 if 48 <= b <= 57 else b for b in range(256))
_LETTERS = bytes(b for b in range(256) if b >= 128 or chr(b).isalpha())


def counts(text: str | None) -> tuple[np.ndarray, np.ndarray, int]:
    """Distinct buckets, how often each occurs, and the number of words."""
    raw = (text or "").encode()
    words = raw.translate(_WORDS).split()
    marks = raw.translate(_NINES, _LETTERS).split()
    found = [*map(zlib.crc32, words), *(zlib.crc32(m, 1) for m in marks), zlib.crc32(b"%d" % len(words).bit_length(), 2)]
    h = np.array(found, dtype=np.uint32) * np.uint32(0x9E3779B1) >> np.uint32(32 - BUCKETS.bit_length() + 1)
    at, n = np.unique(h, return_counts=True)
    return at.astype(np.int32), n.astype(np.int32), len(words)


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets and their values."""
    at, n, words = counts(text)
    return at, np.log1p(n) / np.log(2 + words)


@dataclass
class OrdinalModel:
    weights: np.ndarray
    thresholds: np.ndarray  # ascending; one less than there are grades
    rated: int = 0

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) for each k, one row per score."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - np.asarray(score)[:, None], -40, 40)))

    def score(self, text: str | None) -> float:
        at, x = features(text)
        return float(self.weights[at] @ x)


def fit(row: np.ndarray, col: np.ndarray, val: np.ndarray, grades: np.ndarray, n_grades: int) -> OrdinalModel:
    """row, col, val: the features of the rated documents, by document, bucket and value. Gradient steps (Adam, over all rows at once) on the cumulative-link likelihood; thresholds are ordered by their positive gaps."""
    if not len(grades):
        return OrdinalModel(np.zeros(BUCKETS), np.log(np.arange(1, n_grades) / (n_grades - np.arange(1, n_grades))))
    y = np.asarray(grades)
    telling = _telling(row, col, val, y, n_grades)[col]
    row, col, val = row[telling], col[telling], val[telling]
    below = np.clip([(y <= k).mean() for k in range(n_grades - 1)], 0.01, 0.99)
    start = np.log(below / (1 - below))
    p = np.concatenate([np.zeros(BUCKETS), [start[0]], np.log(np.maximum(np.diff(start), 1e-2))])
    m, v = np.zeros_like(p), np.zeros_like(p)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    for step in range(1, STEPS + 1):
        w, gaps = p[:BUCKETS], np.exp(p[BUCKETS + 1 :])
        theta = np.concatenate([[p[BUCKETS]], p[BUCKETS] + np.cumsum(gaps)])
        s = np.bincount(row, val * w[col], minlength=len(y))
        edges = np.concatenate([np.full((len(y), 1), 0.0), sigmoid(theta[None, :] - s[:, None]), np.full((len(y), 1), 1.0)], axis=1)
        high, low = edges[np.arange(len(y)), y + 1], edges[np.arange(len(y)), y]
        chance = np.maximum(high - low, 1e-9)
        d_high, d_low = high * (1 - high) / chance, low * (1 - low) / chance  # d log p / d of the upper and lower edge
        g_s = (d_high - d_low) / len(y)
        g_theta = np.zeros(n_grades + 1)
        np.add.at(g_theta, y + 1, -d_high / len(y))
        np.add.at(g_theta, y, d_low / len(y))
        g_theta = g_theta[1:-1]
        g = np.concatenate([np.bincount(col, val * g_s[row], minlength=BUCKETS) + SHRINK * w, [g_theta.sum()], np.cumsum(g_theta[::-1])[::-1][1:] * gaps])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p = p - RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    theta = np.concatenate([[p[BUCKETS]], p[BUCKETS] + np.cumsum(np.exp(p[BUCKETS + 1 :]))])
    return OrdinalModel(p[:BUCKETS], theta, len(y))


def _telling(row: np.ndarray, col: np.ndarray, val: np.ndarray, y: np.ndarray, n_grades: int) -> np.ndarray:
    """Buckets whose score statistic against some tail of the grades is large."""
    norm = np.sqrt(np.bincount(col, val * val, minlength=BUCKETS)) + 1e-12
    largest = np.zeros(BUCKETS)
    for k in range(n_grades - 1):
        r = (y > k) - (y > k).mean()
        if spread := r.std():
            largest = np.maximum(largest, np.abs(np.bincount(col, val * (r / spread)[row], minlength=BUCKETS)) / norm)
    return (largest >= LEAST_Z) & (np.bincount(col, minlength=BUCKETS) >= LEAST_ROWS)


def fit_ratings(docs: DataFrame, ratings: DataFrame, n_grades: int, text_col: str = "text", id_col: str = "doc_id", max_rows: int = MAX_ROWS, max_cells: int = MAX_CELLS) -> OrdinalModel:
    """ratings: (id, grade from 0 to n_grades - 1)."""
    rated = ratings.toDF("__id", "__grade").where("__id is not null and __grade is not null").groupBy("__id").agg(F.min("__grade").alias("__grade"))
    sample = rated.orderBy(F.xxhash64("__id"), "__id").limit(max_rows)
    rated_docs = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "__id")
    # one text for an id; a task adds up its own rows first
    texts = rated_docs.groupBy("__id", "__grade").agg(F.min_by("text", F.coalesce(F.xxhash64("text"), F.lit(0))).alias("text"))

    def make():
        def work(batch: list) -> list[pa.Array]:
            got = [counts(t) for t in batch]
            return [pa.array([a for a, _, _ in got], pa.list_(pa.int32())), pa.array([n for _, n, _ in got], pa.list_(pa.int32())), pa.array([w for _, _, w in got], pa.int32())]

        return work

    fields = [C.field("at", T.ArrayType(T.IntegerType())), C.field("n", T.ArrayType(T.IntegerType())), C.field("words", T.IntegerType())]
    counted = C.stored(C.map_rows(texts, "text", make, fields, ["__id", "__grade"]).drop("text").withColumn("place", F.xxhash64("__id")), "rated")
    # at most max_rows sizes: up to which place all features fit
    sizes = sorted(map(tuple, counted.select("place", "__id", F.size("at")).collect()))
    fits = 1 + int(np.searchsorted(np.cumsum([n for *_, n in sizes][1:]) + (sizes[0][2] if sizes else 0), max_cells, side="right"))
    if fits < len(sizes):
        place, last, _ = sizes[fits - 1]
        counted = counted.where((F.col("place") < place) | ((F.col("place") == place) & (F.col("__id") <= last)))
    # held once, as Arrow has it; in the order of the ids, so that sums are the same on every run
    rated = counted.drop("place").toArrow()
    rated = rated.take(pc.sort_indices(rated, sort_keys=[("__id", "ascending")])).combine_chunks()
    at, n = rated.column("at").combine_chunks(), rated.column("n").combine_chunks()
    row = np.repeat(np.arange(len(at), dtype=np.int32), pc.list_value_length(at).to_numpy(zero_copy_only=False))
    val = np.log1p(n.flatten().to_numpy()) / np.log(2 + rated.column("words").to_numpy())[row]
    return fit(row, at.flatten().to_numpy(), val, rated.column("__grade").to_numpy().astype(np.int64), n_grades)


def classify(docs: DataFrame, model: OrdinalModel, cut: int, text_col: str = "text", keep: float = KEEP, carry: list[str] | None = None) -> DataFrame:
    """Add expected_grade, tail_probability (of a grade of cut at least) and kept."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        own = shared.value

        def work(texts: list) -> list[pa.Array]:
            tails = own.tails(np.array([own.score(t) for t in texts]))
            tail = np.round(tails[:, cut - 1], 9)
            return [pa.array(np.round(tails.sum(axis=1), 9)), pa.array(tail), pa.array(tail >= keep)]

        return work

    fields = [C.field("expected_grade", T.DoubleType()), C.field("tail_probability", T.DoubleType()), C.field("kept", T.BooleanType())]
    return C.map_rows(docs, text_col, make, fields, carry)


def ordinal_quality(docs: DataFrame, ratings: DataFrame, n_grades: int, cut: int, text_col: str = "text", id_col: str = "doc_id", carry: list[str] | None = None) -> DataFrame:
    """Fit on the ratings, classify every document."""
    model = fit_ratings(docs, ratings, n_grades, text_col, id_col)
    return classify(docs, model, cut, text_col, KEEP if model.rated else 0.0, carry)
