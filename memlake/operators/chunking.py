"""Splitting texts into chunks, and packing ordered items into budgets."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memlake.session import ship

MAX_CHARS, OVERLAP_WORDS = 1800, 50


def split_text(text: str | None, max_chars: int = MAX_CHARS, overlap: int = OVERLAP_WORDS) -> list[str]:
    """Paragraphs packed up to max_chars; longer ones go by words, each piece beginning with the last `overlap` words
    of the one before as far as they fit; words longer than max_chars are cut. Pieces without a letter or digit go."""
    out: list[str] = []
    open_part = ""

    def close() -> None:
        nonlocal open_part
        if any(c.isalnum() for c in open_part):
            out.append(open_part)
        open_part = ""

    for para in (p.strip() for p in (text or "").split("\n\n")):
        if not para:
            continue
        if len(open_part) + 2 + len(para) <= max_chars and open_part:
            open_part = f"{open_part}\n\n{para}"
        elif len(para) <= max_chars:
            close()
            open_part = para
        else:
            close()
            words = [w[i : i + max_chars] for w in para.split() for i in range(0, len(w), max_chars)]
            start = 0
            while start < len(words):
                end, size = start, -1
                while end < len(words) and size + 1 + len(words[end]) <= max_chars:
                    size += 1 + len(words[end])
                    end += 1
                open_part = " ".join(words[start:end])
                close()
                if end == len(words):
                    break
                start = max(end - overlap, start + 1)
    close()
    return out


def chunk_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, chunk_index, chunk_total, text, content_hash): chunks of every document, batch by batch."""
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, kind), T.StructField("chunk_index", T.IntegerType()), T.StructField("chunk_total", T.IntegerType()), T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [split_text(t) for t in batch.column(1).to_pylist()]
            at = [k for k, p in enumerate(parts) for _ in p]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int64())), pa.array([i for p in parts for i in range(len(p))], pa.int32()), pa.array([len(p) for p in parts for _ in p], pa.int32()), pa.array([x for p in parts for x in p], pa.string())],
                names=schema.names,
            )

    return docs.select(id_col, text_col).mapInArrow(run, schema).withColumn("content_hash", F.sha2("text", 256))


def pack_by_size(items: DataFrame, group: str, order: str, size: str, budget: int) -> DataFrame:
    """Add `unit`: items of a group go, in order, into units of at most `budget`; a larger item is a unit by itself.

    The fold runs over the sizes of one group at a time, sorted; its state is one struct.
    """
    acc = F.struct(F.lit(0).cast("long").alias("used"), F.lit(-1).alias("unit"), F.array().cast("array<int>").alias("units"))

    def step(a, x):
        fresh = (a["unit"] < 0) | (a["used"] + x["s"] > budget)
        unit = F.when(fresh, a["unit"] + 1).otherwise(a["unit"])
        return F.struct(F.when(fresh, x["s"]).otherwise(a["used"] + x["s"]).alias("used"), unit.alias("unit"), F.concat(a["units"], F.array(unit)).alias("units"))

    lists = items.groupBy(group).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(size).cast("long").alias("s")))).alias("x"))
    units = lists.select(group, "x", F.aggregate("x", acc, step, lambda a: a["units"]).alias("u"))
    return units.select(group, F.inline(F.arrays_zip("x", "u"))).select(group, F.col("x.o").alias(order), F.col("x.s").alias(size), F.col("u").alias("unit"))
