"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memlake.session import ship
from memlake.shared import delete_folder, remove_stored, shared_folder, shared_root, stored  # noqa: F401

#: Rows of one Arrow batch. Texts of 100 kB then need 50 MB a batch, whatever the table's size.
ARROW_ROWS = 512

def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small, so that a task's memory does not depend on how long the texts are; send the package along."""
    ship(spark)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def release() -> None:
    """Give free memory back: workers are used again, and what one task held would count beside all later ones."""
    pa.default_memory_pool().release_unused()
    if trim := _trim():
        trim(0)


@lru_cache(1)
def _trim():
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):  # another C library
        return None


def released(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, with memory given back when a task ends."""

    def to_the_end(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            release()

    return to_the_end


def without(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """df without the columns of these names, in any case of letters: an operator's results replace them."""
    gone = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in gone])


def map_rows(
    df: DataFrame,
    text_col: str,
    make: Callable[[], Callable[..., Sequence[pa.Array]]],
    fields: Sequence[T.StructField],
    carry: Sequence[str] | None = None,
    also: Sequence[str] = (),
) -> DataFrame:
    """Add columns that a Python function makes of text_col and of the columns in also, batch by batch.

    make() runs once per task and returns a function from lists of values (None for null), one list per
    column, to one Arrow array per field; its attribute close, if it has one, is called at the task's end. carry names the columns that go along (None: all); a text that
    goes along is sent once. Columns named like a field are replaced.
    """
    small_batches(df.sparkSession)
    names = [f.name for f in fields]
    base = without(df if carry is None else df.select(*carry), names)
    kept = base.columns
    fed = [c for c in (text_col, *also) if c not in kept]
    at = [kept.index(c) if c in kept else len(kept) + fed.index(c) for c in (text_col, *also)]
    rows = df.select(*[F.col(f"`{c}`") for c in kept], *[F.col(f"`{c}`").alias(f"__fed{k}") for k, c in enumerate(fed)])
    schema = T.StructType([*base.schema.fields, *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            made = work(*[batch.column(k).to_pylist() for k in at])
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *made], names=[*kept, *names])
        if close := getattr(work, "close", None):
            close()

    return rows.mapInArrow(released(run), schema)


def field(name: str, kind: T.DataType) -> T.StructField:
    return T.StructField(name, kind, True)
