"""Retrieval: exact nearest neighbours, BM25, rank fusion, re-ranking, grouping and windows of hits.

bm25 here scans the corpus, for tables that are searched once: term counts come of each row's own tokens,
without a shuffle, and only top-k candidates leave a task. operators.search has a stored index.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlake.functions.text import tokens
from memlake.operators.upkeep import running

# The usual constants of BM25 and of reciprocal rank fusion, and the default weights.
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
RRF_K = 60
RECENCY, IMPORTANCE, DECAY, ALPHA = 0.15, 0.10, 0.10, 0.01
NEAREST_GATE = 0.80
# End of fixed values.


def _vector(v: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in v])


def l2(a: Column, b: Column) -> Column:
    squares = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def knn(vectors: DataFrame, query: Sequence[float], k: int, id_col: str = "vec_id", vec_col: str = "embedding", metric: str = "l2") -> DataFrame:
    """The k nearest rows (id, distance), ties by id."""
    v = F.col(vec_col).cast("array<double>")
    distance = l2(v, _vector(query)) if metric == "l2" else 1 - cosine(v, _vector(query))
    return vectors.select(id_col, F.round(distance, 6).alias("distance")).orderBy("distance", id_col).limit(k)


#: Bytes of query vectors that are sent to the tasks at once.
QUERY_BYTES = 16 << 20
#: Distances that a task holds at once.
TILE = 1 << 21


def knn_batch(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, id, distance, rank) of the k nearest rows of each query.

    The queries are sent out in blocks of QUERY_BYTES at most, dealt by a hash of their ids; a task compares
    its vectors with a block by one matrix product and passes on no more than k rows for each query.
    """
    q = queries.select(F.col(id_col).alias("query_id"), F.col(vec_col).cast("array<double>").alias("__q"))
    size = q.agg(F.sum(8 * F.size("__q"))).first()[0] or 0
    n = -(-2 * size // QUERY_BYTES) if size > QUERY_BYTES else 1
    kind = vectors.schema[id_col].dataType.simpleString()
    parts = []
    for block in range(n):
        rows = q.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == block).orderBy("query_id").collect()
        if rows:
            sent = vectors.sparkSession.sparkContext.broadcast(([r[0] for r in rows], np.array([r[1] for r in rows])))
            parts.append(vectors.select(id_col, vec_col).mapInArrow(_nearest(sent, k, id_col), f"query_id {kind}, {id_col} {kind}, distance double"))
    if not parts:
        return vectors.select(F.col(id_col).alias("query_id"), id_col, F.lit(0.0).alias("distance"), F.lit(0).alias("rank")).limit(0)
    near = reduce(DataFrame.unionByName, parts)
    return near.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", id_col))).where(F.col("rank") <= k)


def _nearest(sent, k: int, id_col: str):
    def run(batches):
        ids, q = sent.value
        squares, best = (q * q).sum(axis=1), [[] for _ in ids]
        for batch in batches:
            rows = [(i, v) for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if v is not None]
            if not rows:
                continue
            names, v = [i for i, _ in rows], np.array([x for _, x in rows], dtype=np.float64)
            lengths, step = (v * v).sum(axis=1), max(1, TILE // len(v))
            for first in range(0, len(ids), step):
                part = slice(first, first + step)
                away = np.sqrt(np.maximum(squares[part, None] + lengths[None, :] - 2 * q[part] @ v.T, 0)).round(6)
                for held, row in zip(best[part], away, strict=True):
                    at = np.flatnonzero(row <= np.partition(row, k - 1)[k - 1]) if len(row) > k else range(len(row))
                    held += [(float(row[j]), names[j]) for j in at]
                    held.sort()
                    del held[k:]
        found = [(query, name, d) for query, held in zip(ids, best, strict=True) for d, name in held]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found, strict=True)], names=["query_id", id_col, "distance"])

    return run


def phrases(query: str) -> list[list[str]]:
    """White-space tokens as phrases of words: VERIFY-CAP-001 is three words in a row."""
    import re

    found = [re.findall(r"[^\W_]+", part.lower()) for part in query.split()]
    return [p for p in found if p]


def _phrase_count(words: Column, phrase: list[str]) -> Column:
    if len(phrase) == 1:
        return F.size(F.filter(words, lambda w: w == phrase[0]))
    rest = " ".join(phrase[1:])  # letters and digits only: nothing to quote in a regex
    joined = F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
    return F.regexp_count(joined, F.lit(f"(?<= ){phrase[0]}(?= {rest} )"))


def bm25(docs: DataFrame, query: str, k: int, id_col: str = "doc_id", text_col: str = "text", fallback: bool = True) -> DataFrame:
    """The k best rows (id, score), the lower score the better: all phrases, or any of them if no row has all."""
    wanted = phrases(query)
    if not wanted:
        return docs.select(id_col, F.lit(0.0).alias("score")).limit(0)
    counted = docs.select(id_col, tokens(F.col(text_col)).alias("w")).select(id_col, F.size("w").alias("dl"), *[_phrase_count(F.col("w"), p).alias(f"tf{i}") for i, p in enumerate(wanted)])
    return best(counted, counted.agg(F.count("*").alias("N"), F.avg("dl").alias("avgdl")), len(wanted), k, id_col, fallback)


def best(counted: DataFrame, stats: DataFrame, n_phrases: int, k: int, id_col: str, fallback: bool = True) -> DataFrame:
    """The k best (id, score) of rows (id, dl, tf0, tf1, ..) that hold all phrases, or any of them if no row has all; stats: one row (N, avgdl) of the corpus."""
    return best_of(counted.join(F.broadcast(stats), F.lit(True)), F.col("N"), F.col("avgdl"), n_phrases, k, id_col, fallback)


def best_of(counted: DataFrame, n_docs: Column, mean: Column, n_phrases: int, k: int, id_col: str, fallback: bool = True, known: dict[int, int] | None = None) -> DataFrame:
    """As best, the corpus' size and mean length given; known: of some phrases how many documents have them, others are counted.

    Rows with all phrases come first in one list of k, so that whether there are any needs no pass of its own.
    """
    known = known or {}
    tf = [F.col(f"tf{i}") for i in range(n_phrases)]
    every = reduce(lambda a, b: a & b, [t > 0 for t in tf])
    some = reduce(lambda a, b: a | b, [t > 0 for t in tf])
    unknown = [i for i in range(n_phrases) if i not in known]
    scored = counted.join(F.broadcast(counted.agg(*[F.count_if(tf[i] > 0).alias(f"n{i}") for i in unknown])), F.lit(True)) if unknown else counted
    df = lambda i: F.lit(known[i]) if i in known else F.col(f"n{i}")
    idf = lambda i: F.greatest(F.lit(LEAST_IDF), F.log((n_docs - df(i) + 0.5) / (df(i) + 0.5)))
    norm = K1 * (1 - B + B * F.col("dl") / mean)
    score = -reduce(lambda a, b: a + b, [idf(i) * t * (K1 + 1) / (t + norm) for i, t in enumerate(tf)])
    wanted = some if fallback and n_phrases > 1 else every
    top = scored.where(wanted).select(id_col, F.round(score, 6).alias("score"), every.alias("all")).orderBy(F.desc("all"), "score", id_col).limit(k)
    whole = F.max("all").over(Window.partitionBy(F.lit(1)))  # of a top-k list
    return top.withColumn("whole", whole).where(F.col("all") == F.col("whole")).orderBy("score", id_col).select(id_col, "score")


def over(*order: Column) -> Window:
    """A window over a top-k list."""
    return Window.orderBy(*order)


def ranked(hits: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """Add list and rank, from 0; hits are a top-k list."""
    return hits.withColumns({"list": F.lit(name), "rank": F.row_number().over(over(*order)) - 1})


def rrf(lists: Sequence[DataFrame], id_col: str, weights: Sequence[float], k: int = RRF_K) -> DataFrame:
    """Fused score of (id, list, rank) lists; ties as in the first list, then the second."""
    names = [f"r{i}" for i in range(len(lists))]
    every = reduce(DataFrame.unionByName, [d.select(id_col, F.lit(i).alias("i"), "rank", F.lit(w).alias("w")) for i, (d, w) in enumerate(zip(lists, weights, strict=True))])
    fused = every.groupBy(id_col).agg(F.sum(F.col("w") / (k + F.col("rank") + 1)).alias("fused"), *[F.min(F.when(F.col("i") == i, F.col("rank"))).alias(n) for i, n in enumerate(names)])
    return fused.withColumn("fused", F.round("fused", 8))


def hybrid_search(docs: DataFrame, vectors: DataFrame, text: str, vector: Sequence[float], limit: int, id_col: str = "doc_id", weights: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
    """Semantic and keyword candidates (twice the limit of each), fused, scores relative to the best."""
    return fused_hits(vectors, bm25(docs, text, 2 * limit, id_col), vector, limit, id_col, weights)


def fused_hits(vectors: DataFrame, keyword: DataFrame, vector: Sequence[float], limit: int, id_col: str = "doc_id", weights: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
    """The nearest vectors and keyword hits (id, score) fused."""
    near = ranked(knn(vectors.withColumnRenamed("vec_id", id_col), vector, 2 * limit, id_col), [F.col("distance"), F.col(id_col)], "vector")
    words = ranked(keyword, [F.col("score"), F.col(id_col)], "keyword")
    fused = rrf([near, words], id_col, weights)
    best = fused.agg(F.max("fused").alias("best"))
    hits = fused.join(F.broadcast(best), F.lit(True)).withColumn("score", F.round(F.col("fused") / F.col("best"), 6))
    return hits.orderBy(F.desc("fused"), F.asc_nulls_last("r0"), F.asc_nulls_last("r1"), id_col).limit(limit).select(id_col, "score", "r0", "r1")


def three_axis(score: Column, age_days: Column, salience: Column, retention: Column | None = None) -> Column:
    """Additive recency, retention (recency where unknown) and importance."""
    recency = F.coalesce(F.exp(-ALPHA * age_days), F.lit(0.5))
    return score + RECENCY * recency + DECAY * (recency if retention is None else F.coalesce(retention, recency)) + IMPORTANCE * salience / 10


def overlap_rerank(score: Column, text: Column, query: str) -> Column:
    """0.7 of the score and 0.3 of the share of the query's words (three letters at least) in the text."""
    words = sorted({w for p in phrases(query) for w in p if len(w) >= 3})
    if not words:
        return score
    shared = F.size(F.array_intersect(F.array_distinct(tokens(text)), F.array(*map(F.lit, words))))
    return 0.7 * score + 0.3 * shared / len(words)


def without_digests(hits: DataFrame, cluster: str, is_digest: str) -> DataFrame:
    """Digests go where a raw hit of their cluster is in the pool."""
    raw = hits.where(~F.col(is_digest)).select(cluster).distinct()
    digests = hits.where(is_digest).join(raw, cluster, "left_anti")
    return hits.where(~F.col(is_digest)).unionByName(digests.select(*hits.columns))


def windows(hits: DataFrame, chunks: DataFrame, parent: str, index: str, around: int) -> DataFrame:
    """Chunks within `around` of a hit, as (parent, text with gap marks), in order."""
    wanted = hits.select(parent, F.explode(F.sequence(F.col(index) - around, F.col(index) + around)).alias(index)).distinct()
    found = chunks.join(wanted, [parent, index])
    gap = F.col(index) - F.lag(index).over(Window.partitionBy(parent).orderBy(index)) > 1
    marked = found.withColumn("piece", F.when(gap, F.concat(F.lit("[...]\n"), "text")).otherwise(F.col("text")))
    parts = F.sort_array(F.collect_list(F.struct(index, "piece")))
    return marked.groupBy(parent).agg(F.array_join(F.transform(parts, lambda p: p["piece"]), "\n").alias("text"), F.count("*").alias("n_chunks"))


def stop_at_budget(rows: DataFrame, group: Sequence[str], order: Sequence[Column], size: Column, budget: int) -> DataFrame:
    """Rows of each group, in order, up to the first whose running size exceeds the budget."""
    return running(rows, group, order, size, "used").where(F.col("used") <= budget)


def ranking_quality(hits: DataFrame, k: int) -> DataFrame:
    """Of (query_id, rank from 1, relevant 0/1, n_relevant): recall@k, reciprocal rank and nDCG@k of each query."""
    gain = F.sum(F.when((F.col("rank") <= k) & (F.col("relevant") == 1), 1 / F.log2(F.col("rank") + 1)).otherwise(0.0))
    found = F.sum(F.when(F.col("rank") <= k, F.col("relevant")).otherwise(0))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.lit(k), F.max("n_relevant")).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    return hits.groupBy("query_id").agg(
        F.round(found / F.max("n_relevant"), 6).alias("recall"),
        F.round(F.coalesce(1 / F.min(F.when(F.col("relevant") == 1, F.col("rank"))), F.lit(0.0)), 6).alias("reciprocal_rank"),
        F.round(gain / ideal, 6).alias("ndcg"),
    )
