"""The queries of this subpackage: each applies one operator, with production parameters, to whole tables."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.llm import chat_format as op5
from memlake.llm import common as C
from memlake.llm import conversation_trie as op11
from memlake.llm import decontaminate as op7
from memlake.llm import edit_fingerprints as op13
from memlake.llm import frequent_baskets as op12
from memlake.llm import kd_shards as op4
from memlake.llm import ngram_join as op1
from memlake.llm import ordinal_quality as op3
from memlake.llm import quality_rules as op8
from memlake.llm import secret_scan as op2
from memlake.llm import sentencepiece_codec as op9
from memlake.llm import token_counts as op10
from memlake.llm import warc as op6


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """A public vocabulary file; MEMLAKE_TOKENIZERS names another folder than that of public_tokenizers."""
    if folder := os.environ.get("MEMLAKE_TOKENIZERS"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of the documents that were rated good."""
    return table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op1.similar_classes(table(spark, sf_dir, "documents"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = op2.scan_secrets(table(spark, sf_dir, "documents"), carry=["doc_id"])
    of = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("secrets", lambda s: s["kind"].isin([r.kind for r in op2.RULES if r.base]))
    return found.select("doc_id", of("assign"), of("access"), of("hex"), F.sha2(op2.span_list(base), 256).alias("base_sha256"), op2.span_list(F.col("secrets")).alias("spans"))


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades: 0 rated bad, 1 rated good but toxic, 2 rated good."""
    grade = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).when(F.col("quality") == 1, 2)
    return table(spark, sf_dir, "labels").select("doc_id", grade.alias("grade"))


def op3_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op3.ordinal_quality(table(spark, sf_dir, "documents"), ratings(spark, sf_dir), n_grades=3, cut=2, carry=["doc_id"])


def op4_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = op4.kd_shards(table(spark, sf_dir, "documents"), leaves=8, text_dims=("lang", "source"))
    return shards.withColumn("grown_shard", F.lit(None).cast("int"))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = rows.unionByName(spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string"))
    return op5.digests(op5.format_chats(op5.events_of_rows(rows, revised=True)))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = op6.write_warc(table(spark, sf_dir, "pages"), C.shared_folder(spark, "warc"))
    read = op6.read_warc(written.select("path", "length"), payload=False)
    return read.select(F.col("page_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = op7.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), carry=["doc_id"])
    n_hit = F.aggregate("hit_words", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op8.quality_rules(table(spark, sf_dir, "documents"), targets(spark, sf_dir), carry=["doc_id"]).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "mean_log_ratio")


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = op9.encode(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"), carry=["doc_id"])
    return done.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), op9.ids_digest().alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10.token_counts(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), carry=["doc_id"])


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations, turns = op11.regenerated(table(spark, sf_dir, "conversations"))
    return op11.prefix_trie(conversations, turns).drop("prefix")


def op12_frequent_baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    mined, n_baskets = op12.itemsets(table(spark, sf_dir, "sale_lines").select("sale_id", "item_id"))
    sets = C.stored(op12.closed(mined), "closed")
    found = op12.rules(sets, mined, n_baskets)
    line = F.concat_ws(":", F.col("item").cast("string"), F.col("without").cast("string"), F.col("own").cast("string"))
    held = found.groupBy("items").agg(F.count("*").alias("n"), F.min(F.struct("without", "item"))["item"].alias("best_item"), F.sort_array(F.collect_list(F.struct("item", line.alias("line")))).alias("rules"))
    listed = F.concat_ws(";", F.transform("rules", lambda r: r["line"]))
    return sets.join(held.hint("merge"), "items", "left").select(
        F.concat_ws(",", F.transform(F.sort_array("items"), lambda i: i.cast("string"))).alias("items"),
        "n_items",
        "support",
        F.coalesce("n", F.lit(0).cast("long")).alias("n_rules"),
        "best_item",
        F.sha2(F.coalesce(listed, F.lit("")), 256).alias("rules_sha256"),
    )


def op13_edit_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op13.beside_next(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = {name: f for name, f in globals().items() if name.startswith("op") and "_" in name and callable(f)}
    return own | {"pipeline": pipeline}


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def oracle_sql() -> dict[str, str]:
    from memlake.llm import sql

    return dict(sql.ORACLES)
