"""File sources: spools of JSON, gzip snapshots, transcripts, delimited tables, mail; bad rows go to quarantine, not away."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memlake.session import ship

BAD = "_corrupt_record"


def spool(spark: SparkSession, path: str, schema: str, required: list[str], multiline: bool = True) -> tuple[DataFrame, DataFrame]:
    """(good, bad) rows of JSON files, with their file's name; bad: not JSON, or without a required field."""
    fields = T.StructType([*T._parse_datatype_string(schema).fields, T.StructField(BAD, T.StringType())])
    rows = spark.read.schema(fields).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BAD).option("multiLine", multiline).json(path).withColumn("file", F.input_file_name())
    broken = F.col(BAD).isNotNull()
    for name in required:
        broken = broken | F.col(name).isNull()
    return rows.where(~broken).drop(BAD), rows.where(broken)


def snapshot(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The parts of a gzip JSONL snapshot, by their kind: entity, relation, taxonomy."""
    rows = spark.read.schema("kind string, id string, name string, payload string").json(path)
    return {kind: rows.where(F.col("kind") == kind).drop("kind") for kind in ("entity", "relation", "taxonomy")}


def transcript(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, role, text) of JSONL transcripts; contents are a string or a list of blocks with texts."""
    lines = spark.read.text(path).select(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("line"), "value")
    plain = F.get_json_object("value", "$.content")
    blocks = F.from_json(plain, "array<struct<text:string>>")
    text = F.when(F.startswith(plain, F.lit("[")), F.array_join(F.transform(blocks, lambda b: b["text"]), " ")).otherwise(plain)
    return lines.select("file", "line", F.get_json_object("value", "$.role").alias("role"), text.alias("text")).where("role is not null and text is not null")


def delimited(spark: SparkSession, path: str, separator: str = ",", char_budget: int | None = None) -> DataFrame:
    """(file, row, cells): rows with something in them, the first one the header, within the budget of characters per file. Quoted cells may hold separators and line feeds; rows are counted without blank lines."""
    quoted, apart = r'"(?:[^"]++|"")*+"?', re.escape(separator)
    whole = spark.read.text(path, wholetext=True)
    lines = F.regexp_extract_all("value", F.lit(rf'(?:[^"\r\n]++|{quoted})++'), F.lit(0))
    lines = whole.select(F.input_file_name().alias("file"), F.posexplode(lines).alias("row", "line"))
    parts = F.regexp_extract_all(F.concat("line", F.lit(separator)), F.lit(rf'((?:[^"{apart}]++|{quoted})*+){apart}'), F.lit(1))
    cells = F.transform(parts, lambda c: F.regexp_replace(F.regexp_replace(F.trim(c), '^"|"$', ""), '""', '"'))
    rows = lines.select("file", "row", cells.alias("cells")).where(F.exists("cells", lambda c: c != ""))
    if char_budget is None:
        return rows
    used = F.sum(F.aggregate("cells", F.lit(0), lambda n, c: n + F.char_length(c))).over(Window.partitionBy("file").orderBy("row").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("__used", used).where(F.col("__used") <= char_budget).drop("__used")


_MAIL = T.StructType([T.StructField(n, T.StringType()) for n in ("path", "message_id", "subject", "sender", "recipients", "date", "text")] + [T.StructField("attachments", T.ArrayType(T.StringType()))])


def mail_files(spark: SparkSession, path: str) -> DataFrame:
    """RFC 822 files: headers, the plain text (or the HTML where there is no plain part), names of attachments."""
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import email
        from email import policy

        for batch in batches:
            rows = []
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                message = email.message_from_bytes(data, policy=policy.default)
                body = message.get_body(preferencelist=("plain", "html"))
                try:
                    text = body.get_content() if body else ""
                except (LookupError, ValueError):
                    text = body.get_payload(decode=True).decode("utf-8", "replace")
                names = [p.get_filename() or "" for p in message.iter_attachments()]
                rows.append((name, *(str(message[h]) if message[h] else None for h in ("message-id", "subject", "from", "to", "date")), text, names))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.list_(pa.string()) if i == 7 else pa.string()) for i, c in enumerate(zip(*rows, strict=True))], names=_MAIL.names)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, _MAIL)
