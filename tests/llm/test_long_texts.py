"""Texts of many megabytes through Spark: time in proportion to their length and to what is found in them."""

import hashlib
import time

import pytest
from pyspark.sql import functions as F

from memlake.llm import chat_format, edit_fingerprints, kd_shards, secret_scan, warc

KEY = "0123456789abcdef01234567\n"
N_KEYS = 200_000
LONG = "abcdéfghi " * 2_000_000  # 20 M characters
SECONDS = 120


@pytest.fixture(autouse=True)
def limited():
    began = time.monotonic()
    yield
    assert time.monotonic() - began < SECONDS


def docs(spark):
    keys = spark.range(1).select(F.lit(1).cast("long").alias("doc_id"), F.repeat(F.lit(KEY), N_KEYS).alias("text"))
    plain = spark.range(1).select(F.lit(2).cast("long").alias("doc_id"), F.repeat(F.lit("abcdéfghi "), 2_000_000).alias("text"))
    return keys.unionByName(plain)


def test_secrets_of_long_texts(spark):
    found = secret_scan.scan_secrets(docs(spark), carry=["doc_id"])
    got = {r[0]: r[1:] for r in found.select("doc_id", F.size("secrets"), F.get("secrets", F.lit(N_KEYS - 8))["start"]).collect()}
    assert got == {1: (N_KEYS, (N_KEYS - 8) * len(KEY)), 2: (0, None)}


def test_masking_long_texts(spark):
    got = {r[0]: r[1] for r in secret_scan.masked(docs(spark)).select("doc_id", F.sha2("text", 256)).collect()}
    assert got == {1: hashlib.sha256(("[SECRET]\n" * N_KEYS).encode()).hexdigest(), 2: hashlib.sha256(LONG.encode()).hexdigest()}


@pytest.mark.parametrize("revised", [False, True])
def test_chats_of_long_turns(spark, revised):
    rows = docs(spark).select(F.lit(3).cast("long").alias("conv_id"), F.col("doc_id").alias("turn"), F.lit("assistant").alias("role"), "text")
    row = chat_format.digests(chat_format.format_chats(chat_format.events_of_rows(rows, revised))).first()
    said = KEY * N_KEYS + LONG
    assert (row.n_turns, row.loss_chars, row.loss_sha256) == (2, len(said), hashlib.sha256(said.encode()).hexdigest())


def test_shards_archives_and_fingerprints_of_long_texts(spark, tmp_path):
    df = docs(spark)
    sizes = {r.doc_id: r["size"] for r in kd_shards.kd_shards(df, leaves=2).collect()}
    assert sizes == {1: N_KEYS * len(KEY) + 1, 2: len(LONG.encode()) + 1}
    pages = df.select(F.col("doc_id").alias("page_id"), F.lit("http://x/").alias("url"), F.col("text").alias("html"))
    read = warc.read_warc(warc.write_warc(pages, f"file://{tmp_path}/warc").select("path", "length"), payload=False)
    assert {int(r.page_id): r.payload_bytes for r in read.collect()} == {1: N_KEYS * len(KEY), 2: len(LONG.encode())}
    near = {r.doc_id: r for r in edit_fingerprints.beside_next(df).collect()}
    assert near[2].n_chars == len(LONG) and near[1].near_edited > 0.2
