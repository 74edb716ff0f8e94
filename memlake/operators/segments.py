"""A search index that is kept up without being rebuilt: segments, lists of what is gone, and merges.

Each batch of changes is a segment: postings of its documents (by a hash of the term), a forward table (id,
words, terms and their places; by a hash of the id), the ids whose older rows are gone, and the change of each term's number of
documents. Nothing written before is touched. A row counts if no later segment has its id among the gone.
The corpus' size, mean length and each term's document count are sums over segments, so a search reads the
buckets of its terms and what is gone, and never counts documents.

A manifest names the live segments; its versions are written whole, and one that was prepared on an older
version is refused. Merges take the newest segments as long as each is not much larger than those after it, so
that a corpus has some log(batches) of them and a row is rewritten as often.

Defined results: of rows with equal ids in one batch that with the smallest text hash is taken; null ids are passed over; a null text is a document without words. Deleting an unknown id changes
nothing; an id both deleted and written in a batch is written.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.operators import retrieval as R
from memlake.operators import search as S
from memlake.shared import delete_folder
from memlake.sources.store import VersionedTable

#: Folders of the forward table.
SLOTS = 64
#: Ids that are gone are broadcast up to this number (some 30 bytes each); beyond it they are joined by a shuffle.
MAX_BROADCAST_IDS = 1_000_000
#: A segment is merged with those after it if it has at most this many times their rows.
TIER = 2

MANIFEST = "segment int, folder string, n_docs long, n_words long, n_rows long, n_gone long"


@dataclass(frozen=True)
class Segment:
    segment: int
    folder: str
    n_docs: int
    n_words: int
    n_rows: int
    n_gone: int


def _slot(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(SLOTS)).cast("int")


class SegmentedIndex:
    """The index below uri; ids are of id_type."""

    def __init__(self, spark: SparkSession, uri: str, id_type: str = "bigint"):
        self.spark, self.uri, self.id_type = spark, uri.rstrip("/"), id_type
        self.manifest = VersionedTable(spark, self.uri, "manifest")

    def segments(self, version: int | None = None) -> list[Segment]:
        """The live segments, oldest first."""
        known = self.manifest.versions()
        if not known:
            return []
        return sorted((Segment(**r.asDict()) for r in self.manifest.read(version).collect()), key=lambda s: s.segment)

    def _commit(self, segments: Sequence[Segment], after: int | None) -> None:
        rows = [(s.segment, s.folder, s.n_docs, s.n_words, s.n_rows, s.n_gone) for s in segments]
        self.manifest.write(self.spark.createDataFrame(rows, MANIFEST).coalesce(1), after=after or 0)

    def _read(self, segments: Sequence[Segment], what: str, schema: str) -> DataFrame:
        """A table of some segments, with the segment of each row."""
        parts = [self.spark.read.schema(schema).parquet(f"{s.folder}/{what}").withColumn("segment", F.lit(s.segment)) for s in segments]
        return reduce(DataFrame.unionByName, parts)

    def postings(self, segments: Sequence[Segment]) -> DataFrame:
        return self._read(segments, "postings", f"term string, id {self.id_type}, dl int, at array<int>, bucket int")

    def forward(self, segments: Sequence[Segment]) -> DataFrame:
        return self._read(segments, "forward", f"id {self.id_type}, dl int, terms array<string>, slot int")

    def gone(self, segments: Sequence[Segment]) -> DataFrame:
        """(id, until): rows of the id in segments before `until` don't count."""
        return self._read(segments, "gone", f"id {self.id_type}").groupBy("id").agg(F.max("segment").alias("until"))

    def live(self, rows: DataFrame, segments: Sequence[Segment]) -> DataFrame:
        """rows (id, segment, ..) that count."""
        n = sum(s.n_gone for s in segments)
        if not n:
            return rows
        gone = self.gone([s for s in segments if s.n_gone])
        marked = rows.join(F.broadcast(gone) if n <= MAX_BROADCAST_IDS else gone, "id", "left")
        return marked.where(F.col("until").isNull() | (F.col("segment") >= F.col("until"))).drop("until")

    # -- writing ---------------------------------------------------------------------------------

    def apply(self, docs: DataFrame, deleted: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> Segment:
        """Write documents (new or changed) and take deleted ids out: one segment, seen by searches at once or not at all."""
        version, known = (self.manifest.versions() or [None])[-1], self.segments()
        number = known[-1].segment + 1 if known else 1
        folder = f"{self.uri}/segment-{number}-{uuid.uuid4().hex[:12]}"
        docs = docs.select(F.col(id_col).cast(self.id_type).alias("id"), F.col(text_col).alias("text")).where("id is not null")
        # texts are dealt out once, by slot; what else there is of them is made from the forward table
        one = docs.withColumn("slot", _slot(F.col("id"))).repartition("slot").groupBy("slot", "id").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
        held = S.with_terms(one.select("id", "text")).withColumn("slot", _slot(F.col("id")))
        held.select("id", "dl", F.col("terms.term").alias("terms"), F.col("terms.at").alias("at"), "slot").write.partitionBy("slot").parquet(f"{folder}/forward")
        placed = self.spark.read.schema(f"id {self.id_type}, dl int, terms array<string>, at array<array<int>>, slot int").parquet(f"{folder}/forward")
        S.write_sorted(placed.select("id", "dl", F.inline(F.arrays_zip(F.col("terms").alias("term"), F.col("at").alias("at")))), f"{folder}/postings", placed.count())
        new = self.spark.read.schema(f"id {self.id_type}, dl int, terms array<string>, slot int").parquet(f"{folder}/forward")
        ids = new.select("id")
        if deleted is not None:
            ids = ids.unionByName(deleted.select(F.col(deleted.columns[0]).cast(self.id_type).alias("id")).where("id is not null")).distinct()
        self._dead(known, ids).write.parquet(f"{folder}/gone")
        dead = self.spark.read.schema(f"id {self.id_type}, dl int, terms array<string>").parquet(f"{folder}/gone")
        change = new.select("dl", "terms", F.lit(1).alias("sign")).unionByName(dead.select("dl", "terms", F.lit(-1).alias("sign")))
        self._write_terms(change.select(F.explode("terms").alias("term"), "sign").groupBy("term").agg(F.sum("sign").alias("df")), folder)
        sums = change.agg(F.coalesce(F.sum("sign"), F.lit(0)), F.coalesce(F.sum(F.col("sign") * F.col("dl")), F.lit(0)), F.count_if(F.col("sign") > 0), F.count_if(F.col("sign") < 0)).first()
        segment = Segment(number, folder, *map(int, sums))
        self._commit([*known, segment], version)
        return segment

    def _dead(self, known: Sequence[Segment], ids: DataFrame) -> DataFrame:
        """(id, dl, terms) of rows that count now and whose id is among ids."""
        if not known:
            return self.spark.createDataFrame([], f"id {self.id_type}, dl int, terms array<string>")
        slots = [r[0] for r in ids.select(_slot(F.col("id"))).distinct().collect()]
        old = self.forward(known).where(F.col("slot").isin(*slots)) if slots else self.forward(known).limit(0)
        return self.live(old.join(ids.hint("merge"), "id", "left_semi"), known).select("id", "dl", "terms")

    def _write_terms(self, df: DataFrame, folder: str) -> None:
        terms = df.where("df <> 0").withColumn("bucket", S.bucket(F.col("term")))
        terms.repartition("bucket").sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{folder}/terms")

    def merge(self, all_of_them: bool = False) -> Segment | None:
        """Merge the newest segments into one, as far as the tiers say; None if there is nothing to merge."""
        version, known = (self.manifest.versions() or [None])[-1], self.segments()
        first, rows = len(known) - 1, known[-1].n_rows if known else 0
        while first > 0 and (all_of_them or known[first - 1].n_rows <= TIER * max(1, rows)):
            first -= 1
            rows += known[first].n_rows
        some = known[max(0, first):]
        if len(some) < 2:
            return None
        number, folder = some[-1].segment, f"{self.uri}/segment-{some[-1].segment}-{uuid.uuid4().hex[:12]}"
        S.write_sorted(self.live(self.postings(some), some).drop("segment", "bucket"), f"{folder}/postings", sum(s.n_rows for s in some))
        self.live(self.forward(some), some).drop("segment").repartition("slot").write.partitionBy("slot").parquet(f"{folder}/forward")
        # nothing stands before the oldest segment that could be gone
        gone = self.gone(some).select("id")
        (gone if first > 0 else gone.limit(0)).write.parquet(f"{folder}/gone")
        self._write_terms(self._read(some, "terms", "term string, df long, bucket int").groupBy("term").agg(F.sum("df").alias("df")), folder)
        n_rows = self.spark.read.parquet(f"{folder}/forward").count() if any(s.n_gone for s in some) else sum(s.n_rows for s in some)
        n_gone = self.spark.read.schema(f"id {self.id_type}").parquet(f"{folder}/gone").count() if first > 0 else 0
        merged = Segment(number, folder, sum(s.n_docs for s in some), sum(s.n_words for s in some), n_rows, n_gone)
        self._commit([*known[:first], merged], version)
        return merged

    def vacuum(self, keep: int = 2) -> int:
        """Delete the folders that none of the last manifests names; gives their number."""
        versions = self.manifest.versions()
        named = {s.folder for v in versions[-keep:] for s in self.segments(v)}
        old = {s.folder for v in versions[:-keep] for s in self.segments(v)} - named
        for folder in old:
            delete_folder(self.spark, folder)
        self.manifest.drop_old(keep)
        return len(old)

    # -- reading ---------------------------------------------------------------------------------

    def stats(self) -> tuple[int, float]:
        """Documents, and their mean number of words: from the manifest alone."""
        known = self.segments()
        n = sum(s.n_docs for s in known)
        return n, sum(s.n_words for s in known) / n if n else 0.0

    def terms(self, words: Sequence[str] | None = None) -> DataFrame:
        """(term, df) of all terms, or of some."""
        rows = self._read(self.segments(), "terms", "term string, df long, bucket int")
        if words is not None:
            rows = rows.where(F.col("bucket").isin(*[S.bucket(F.lit(w)) for w in words]) & F.col("term").isin(*words))
        return rows.groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")

    def found(self, words: Sequence[str] | None = None) -> DataFrame:
        """(term, id, dl, at) of the documents that count."""
        known = self.segments()
        rows = self.postings(known)
        if words is not None:
            rows = rows.where(F.col("bucket").isin(*[S.bucket(F.lit(w)) for w in words]) & F.col("term").isin(*words))
        return self.live(rows, known).drop("segment", "bucket")

    def bm25(self, query: str, k: int, fallback: bool = True) -> DataFrame:
        """The k best (id, score), as search.bm25; phrases of one word take their counts from the index."""
        phrases = R.phrases(query)
        words = sorted({w for p in phrases for w in p})
        if not words or not self.segments():
            return self.spark.createDataFrame([], f"id {self.id_type}, score double")
        n, mean = self.stats()
        counted = S.counted(self.found(words), phrases, "id")
        df = {r.term: r.df for r in self.terms(words).collect()}
        known = {i: df.get(p[0], 0) for i, p in enumerate(phrases) if len(p) == 1}
        return R.best_of(counted, F.lit(n), F.lit(float(mean)), len(phrases), k, "id", fallback, known)
