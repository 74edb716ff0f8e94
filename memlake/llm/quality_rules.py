"""Quality rules: plain counts of each document, and a log-likelihood ratio of hashed n-grams.

Two multinomials over BUCKETS hash buckets are counted over *all* documents: one of the raw corpus, one
of the trusted target (documents that carry a flag). Every document's score, mean_log_ratio, is the mean,
over its hashed unigrams and bigrams, of log p_target - log p_raw, with PRIOR pseudo-counts.

The verdict must not depend on how large the corpus is, so it is taken on a mean of its own: each distinct
text counts once, as a target if one of its rows is; the text's own n-grams are left out of both
multinomials; and the pseudo-counts are SHARE of what is left of the target. A document is kept if that
mean is at or above a fixed threshold. Repeating every row leaves each verdict as it was.

Defined results: a null or empty text has no words, hence zero counts, no score (null) and base_failed
true. Without target documents every score is 0. Repeated rows are scored as often as they stand there,
and count as often in mean_log_ratio. A bucket that no other text has says nothing in the verdict. An empty
table gives an empty result. Input columns named like a result are replaced.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memlake.llm import common as C

BUCKETS = 1 << 16
#: Pseudo-counts drawn from the raw multinomial: a bucket without evidence has a ratio near 1.
PRIOR = 4.0 * BUCKETS
#: Pseudo-counts of the verdict, drawn from the raw multinomial too, as a share of the target's n-grams.
SHARE = 0.25
#: Mean log ratio of the verdict (nats per n-gram) below which a document is rejected.
THRESHOLD = -0.12
#: Fewest words of a document, and the largest percentage of its words in repeated 5-word windows.
MIN_WORDS, MAX_REPEATED_PERCENT = 10, 20
#: N-grams that a task holds before it adds them up.
HELD = 500_000
#: Trusted ids and digests of repeated texts are broadcast up to this number (some 30 and 120 bytes each); beyond it they are joined by a shuffle.
MAX_BROADCAST_IDS = 1_000_000

_MIX, _PAIR = np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B)
_GRAM = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], dtype=np.uint64)


def hashed_words(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, words), dtype=np.uint32, count=len(words))


def buckets_of(u: np.ndarray) -> np.ndarray:
    """Buckets of all unigrams and bigrams, by multiplicative hashing of the words' CRCs."""
    pairs = (u[:-1] * _PAIR) ^ (u[1:] + _MIX)
    return (np.concatenate([u, pairs]) * _MIX) >> np.uint32(32 - BUCKETS.bit_length() + 1)


def repeated_words(words: list[bytes], u: np.ndarray) -> int:
    """Words inside 5-word windows that stand twice or more in the text.

    Equal windows have equal hashes, so only windows whose hash repeats are compared word by word.
    """
    n = len(words) - 4
    if n < 2:
        return 0
    wide = u.astype(np.uint64)
    h = sum(wide[j : j + n] * _GRAM[j] for j in range(5))
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    if not same.any():
        return 0
    again = np.zeros(n, dtype=bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    first: dict[tuple, int] = {}
    hit = np.zeros(len(words), dtype=bool)
    for i in np.flatnonzero(again).tolist():
        window = tuple(words[i : i + 5])
        if (at := first.setdefault(window, i)) != i:
            hit[at : at + 5] = True
            hit[i : i + 5] = True
    return int(hit.sum())


def base_counts(text: str | None) -> tuple[int, int, int, int, int, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the words' hashes."""
    text = text or ""
    raw = text.encode()
    words = raw.split()  # bytes.split: runs of other than 0x20 and 0x09-0x0D
    spaces = len(raw) - sum(map(len, words))
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    u = hashed_words(words)
    return len(words), len(text) - spaces, len(raw) - len(raw.translate(None, b"#*$%&|<>")), len(lines) - len(set(lines)), repeated_words(words, u), u


def ngram_counts(docs: DataFrame, text_col: str = "text", target_col: str = "is_target") -> DataFrame:
    """(bucket, raw, target): how often each bucket occurs in all documents and in the flagged ones.

    Each task adds up its own documents, so the shuffle has one row per bucket and task.
    """
    C.small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        held: list[list[np.ndarray]] = [[], []]  # n-grams of texts that are no targets, and of those that are

        def added() -> None:
            for flag, grams in enumerate(held):
                if grams:
                    got = np.bincount(np.concatenate(grams), minlength=BUCKETS)
                    raw[:] += got
                    target[:] += got * flag
                    grams.clear()

        size = 0
        for batch in batches:
            for text, flag in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                words = (text.as_py() or "").encode().split()
                if words:
                    grams = buckets_of(hashed_words(words))
                    held[bool(flag)].append(grams)
                    size += len(grams)
                    if size > HELD:
                        added()
                        size = 0
        added()
        at = np.flatnonzero(raw)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(raw[at]), pa.array(target[at])], names=["bucket", "raw", "target"])

    part = docs.select(text_col, target_col).mapInArrow(C.released(run), "bucket int, raw long, target long")
    return part.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def bucket_counts(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(raw, target) by bucket. The table has BUCKETS rows at most, whatever the corpus."""
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for bucket, a, b in counts.toLocalIterator():
        raw[bucket], target[bucket] = a, b
    return raw, target


def log_ratios(counts: DataFrame) -> np.ndarray:
    """log p_target - log p_raw of each bucket."""
    raw, target = bucket_counts(counts)
    p_raw = (raw + 1) / (raw.sum() + BUCKETS)
    return np.log((target + PRIOR * p_raw) / (target.sum() + PRIOR)) - np.log(p_raw)


def others_ratio(grams: np.ndarray, is_target: bool, raw: np.ndarray, target: np.ndarray, n_raw: float, n_target: float) -> float:
    """The verdict's mean: raw and target hold the text itself once (target only if is_target), which is taken out."""
    at, own = np.unique(grams, return_counts=True)
    n = len(grams)
    r, t = raw[at] - own, target[at] - own * is_target
    n_raw, n_target = n_raw - n, n_target - n * is_target
    known = r > 0
    if n_target <= 0 or not known.any():
        return 0.0
    r, t, own = r[known], t[known], own[known]
    ratio = np.log((t * n_raw / (r * n_target) + SHARE) / (1 + SHARE))
    return float((ratio * own).sum() / n)


def flag_targets(docs: DataFrame, target_ids: DataFrame, id_col: str = "doc_id", name: str = "is_target") -> DataFrame:
    """docs with is_target: whether id_col is among target_ids (one column; nulls match nothing)."""
    ids = target_ids.toDF("__id").where("__id is not null").distinct().withColumn(name, F.lit(True))
    if ids.count() <= MAX_BROADCAST_IDS:
        ids = F.broadcast(ids)
    docs = C.without(docs, [name])
    return docs.join(ids, docs[id_col] == ids["__id"], "left").drop("__id").withColumn(name, F.coalesce(name, F.lit(False)))


def by_text(flagged: DataFrame, text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """flagged (with __flag) where __flag says whether any row of the same text is a target; and (text, is_target) of each distinct text.

    Only texts that repeat are shuffled, and of them one a task.
    """
    keyed = flagged.withColumn("__key", F.sha2(F.col(text_col), 256))
    seen = keyed.where("__key is not null").groupBy("__key").agg(F.count("*").alias("n"), F.max("__flag").alias("__any"))
    repeated = C.stored(seen.where("n > 1").select(F.col("__key").alias("__again"), "__any"), "repeated")
    joined = F.broadcast(repeated) if repeated.count() <= MAX_BROADCAST_IDS else repeated
    marked = keyed.join(joined, F.col("__key") == F.col("__again"), "left")
    texts = marked.select(F.col(text_col).alias("text"), F.coalesce("__any", "__flag").alias("is_target"), "__again")
    one = texts.where("__again is not null").groupBy("__again").agg(F.first("text").alias("text"), F.first("is_target").alias("is_target"))
    once = texts.where("__again is null").drop("__again").unionByName(one.drop("__again"))
    return marked.withColumn("__flag", F.coalesce("__any", "__flag")).drop("__key", "__again", "__any"), once


def score(docs: DataFrame, ratios: np.ndarray, once: tuple[np.ndarray, np.ndarray], text_col: str = "text", threshold: float = THRESHOLD, carry: list[str] | None = None) -> DataFrame:
    """Add the counts, mean_log_ratio, base_failed and kept to each document of by_text; once: the (raw, target) counts of its distinct texts."""
    shared = docs.sparkSession.sparkContext.broadcast((ratios, *once))
    carry = [c for c in docs.columns if c != "__flag"] if carry is None else carry
    def make():
        table, raw, target = shared.value
        n_raw, n_target = raw.sum(), target.sum()

        def work(texts: list, flags: list) -> list[pa.Array]:
            rows = []
            for text, flag in zip(texts, flags, strict=True):
                *counts, u = base_counts(text)
                grams = buckets_of(u)
                mean = round(float(table[grams].mean()), 9) if len(u) else None
                failed = counts[0] < MIN_WORDS or 100 * counts[4] > MAX_REPEATED_PERCENT * counts[0]
                kept = not failed and others_ratio(grams, flag, raw, target, n_raw, n_target) >= threshold
                rows.append((*counts, mean, failed, kept))
            kinds = [pa.int64()] * 5 + [pa.float64(), pa.bool_(), pa.bool_()]
            return [pa.array(col, kind) for col, kind in zip(zip(*rows, strict=True) if rows else [[]] * 8, kinds, strict=True)]

        return work

    long, names = T.LongType(), ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    fields = [C.field(n, long) for n in names] + [C.field("mean_log_ratio", T.DoubleType()), C.field("base_failed", T.BooleanType()), C.field("kept", T.BooleanType())]
    return C.map_rows(docs, text_col, make, fields, carry, also=["__flag"])


def quality_rules(docs: DataFrame, target_ids: DataFrame, text_col: str = "text", id_col: str = "doc_id", threshold: float = THRESHOLD, carry: list[str] | None = None) -> DataFrame:
    """Count the multinomials over all documents and over all distinct texts, then score every document."""
    flagged = flag_targets(docs, target_ids, id_col, "__flag")
    marked, once = by_text(flagged, text_col)
    ratios = log_ratios(ngram_counts(flagged, text_col, "__flag"))
    return score(marked, ratios, bucket_counts(ngram_counts(once)), text_col, threshold, carry)
