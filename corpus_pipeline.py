"""The corpus pipeline: five stages over documents, each written as Parquet and read again by the next.

Stages take (spark, docs, sf_dir). All but the last return the columns of documents.

quality          documents that the rules reject go
near_duplicates  of each class of linked documents one row stays: that with the smallest id (nulls last), of
                 equal ids that with the smallest hash of its text
decontaminate    documents that hold a benchmark window go
secrets          every span found is masked in the text; n_chars follows
sentencepiece    ids of the text, with the end id, and their number

Defined results: null and empty texts go in the first stage, as texts of fewer than 10 words do. Rows are
told apart by id and text, null ids too, so that different texts under one id are different documents; of
rows equal in both, one stays. Other columns may be null and go along as they are; columns that documents
don't have by contract are left out. Empty tables give empty tables; without labels the first stage's
ratios reject nothing, without benchmark items the third lets all pass. Texts of any length are taken whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.llm import common as C
from memlake.llm import decontaminate as windows
from memlake.llm import entry, ngram_join, quality_rules, secret_scan, sentencepiece_codec

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Rows (id, text hash) that go are broadcast up to this number (some 40 bytes each); beyond it they are joined by a shuffle.
MAX_BROADCAST_IDS = 1_000_000


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    scored = quality_rules.quality_rules(docs, entry.targets(spark, sf_dir), carry=COLUMNS)
    return scored.where("kept").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class one row stays, of null ids too: that with the smallest id (nulls last), then by its text's hash. Rows without words all stay."""
    found = C.stored(ngram_join.row_classes(docs).where("label is not null").select("doc", "key", "label"), "classes")
    first = F.min(F.struct(F.col("doc").isNull().alias("none"), "doc", "key")).alias("first")
    stays = C.stored(found.groupBy("label").agg(first).select("first.doc", "first.key"), "stays")
    rows = found.groupBy("doc", "key").agg(F.count("*").alias("n"))
    gone = C.stored(rows.join(stays.toDF("d", "k"), F.col("doc").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k")), "left_anti").select("doc", "key"), "gone")
    # of rows that stay but are repeated, in id and text, one is left
    repeated = C.stored(rows.where("n > 1").select("doc", "key"), "repeated")
    left = _by_row(docs, gone, "left_anti")
    if not repeated.head(1):
        return left.select(*COLUMNS)
    one = _by_row(left, repeated, "left_semi").withColumn("__key", ngram_join.text_key("text")).dropDuplicates(["doc_id", "__key"])
    return _by_row(left, repeated, "left_anti").select(*COLUMNS).unionByName(one.select(*COLUMNS))


def _by_row(docs: DataFrame, rows: DataFrame, how: str) -> DataFrame:
    """docs joined to rows (doc, key) by id, null or not, and text."""
    if rows.count() <= MAX_BROADCAST_IDS:
        rows = F.broadcast(rows)
    return docs.join(rows, F.col("doc_id").eqNullSafe(F.col("doc")) & (ngram_join.text_key("text") == F.col("key")), how)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = windows.decontaminate(docs.select(*COLUMNS), entry.table(spark, sf_dir, "benchmark"), carry=COLUMNS)
    return found.where(F.size("hit_words") == 0).select(*COLUMNS)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = secret_scan.masked(docs.select(*COLUMNS))
    return clean.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    done = sentencepiece_codec.encode(docs, entry.tokenizer_path("piece_bpe_32k.model"), carry=["doc_id", "lang", "source", "n_chars"])
    return done.select("doc_id", "lang", "source", "n_chars", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("secrets", secrets),
    ("sentencepiece", sentencepiece),
]

#: The hashed n-gram ratios of the first stage and the ids of the last are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = entry.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = C.stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
