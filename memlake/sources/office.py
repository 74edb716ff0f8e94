"""Text and tables of office files, read with the standard library: .docx, .pptx, .xlsx, delimited and plain text.

A file is one row of the binary file source; what cannot be read comes back with a reason, not silently.
"""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.operators.chunking import split_text
from memlake.session import ship

# Budgets, cell widths and header words that results depend on.
SHEET_CHARS, CHUNK_CHARS, CELL_CHARS, LEAST_CELL = 200_000, 1800, 300, 5
QUANTITY_WORDS = set(
    "amount amt total totals subtotal budget budgeted actual actuals cost costs price value qty quantity count hours fee fees income expense expenses "
    "balance variance paid spend revenue salary wages rate gst tax $ sum ytd forecast".split()
)
CODE_WORDS = set("code codes id ids ref reference account acct number no num year invoice phone mobile postcode zip abn acn gl index row line abr".split())
# End of fixed values.

_TABLE = pa.struct([("sheet", pa.string()), ("header", pa.list_(pa.string())), ("rows", pa.list_(pa.list_(pa.string()))), ("rows_total", pa.int64())])
_SQL_TABLE = "struct<sheet:string,header:array<string>,rows:array<array<string>>,rows_total:bigint>"


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _parts(node: ElementTree.Element, name: str) -> Iterator[ElementTree.Element]:
    return (e for e in node.iter() if _local(e.tag) == name)


def _said(node: ElementTree.Element) -> str:
    """The runs of a paragraph; tabs and breaks as such."""
    marks = {"tab": "\t", "br": "\n", "cr": "\n"}
    return "".join(e.text or "" if _local(e.tag) == "t" else marks.get(_local(e.tag), "") for e in node.iter())


def _row_line(row: ElementTree.Element) -> str:
    cells = ("\n".join(_said(p) for p in _parts(c, "p")).strip() for c in row if _local(c.tag) == "tc")
    return " | ".join(c for c in cells if c)


def docx_text(data: bytes) -> str:
    """Paragraphs, then the rows of tables with bars between their cells."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = next(_parts(ElementTree.fromstring(z.read("word/document.xml")), "body"))
    lines = [_said(p) for p in body if _local(p.tag) == "p"]
    rows = [_row_line(r) for t in body if _local(t.tag) == "tbl" for r in t if _local(r.tag) == "tr"]
    return "\n".join([x for x in lines if x.strip()] + [x for x in rows if x])


def pptx_text(data: bytes) -> str:
    """Each slide that says something under its number."""
    out = []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        slides = sorted((int(m[1]), n) for n in z.namelist() if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n)))
        for place, (_, name) in enumerate(slides, 1):
            lines = []
            for shape in ElementTree.fromstring(z.read(name)).iter():
                if _local(shape.tag) == "txBody":
                    lines += [_said(p).strip() for p in _parts(shape, "p")]
                elif _local(shape.tag) == "tr":
                    lines.append(_row_line(shape))
                    for body in _parts(shape, "txBody"):
                        body.clear()
            if lines := [x for x in lines if x]:
                out.append("\n".join([f"Slide {place}", *lines]))
    return "\n\n".join(out)


def _column(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]*", ref)[0]:
        n = 26 * n + ord(c) - 64
    return n - 1


def xlsx_tables(data: bytes, budget: int = SHEET_CHARS) -> list[dict]:
    """One table for each sheet that has cells, as the file shows them."""
    out = []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        strings = ["".join(t.text or "" for t in _parts(s, "t")) for s in _parts(ElementTree.fromstring(z.read("xl/sharedStrings.xml")), "si")] if "xl/sharedStrings.xml" in names else []
        links = {r.get("Id"): r.get("Target", "") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels")).iter() if r.get("Id")}
        for sheet in _parts(ElementTree.fromstring(z.read("xl/workbook.xml")), "sheet"):
            target = links[next(v for k, v in sheet.attrib.items() if _local(k) == "id")].lstrip("/")
            grid = []
            for row in _parts(ElementTree.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}")), "row"):
                cells: list[str] = []
                for c in _parts(row, "c"):
                    value = "".join(t.text or "" for t in c.iter() if _local(t.tag) in ("v", "t"))
                    value = strings[int(value)] if c.get("t") == "s" and value else {"1": "True", "0": "False"}.get(value, value) if c.get("t") == "b" else value
                    at = _column(c.get("r", "")) if c.get("r") else len(cells)
                    cells += [""] * (at + 1 - len(cells))
                    cells[at] = value
                grid.append(cells)
            out += table_of(sheet.get("name", ""), grid, budget)
    return out


def table_of(sheet: str, grid: list[list[str]], budget: int = SHEET_CHARS) -> list[dict]:
    """Empty rows and empty columns at the end go; the first row is the header; rows up to the budget of characters, one at least."""
    rows = [r for r in grid if any(c.strip() for c in r)]
    if not rows:
        return []
    width = max(i + 1 for r in rows for i, c in enumerate(r) if c.strip())
    header, *data = [r[:width] for r in rows]
    kept, used = [], 0
    for r in data:
        used += sum(len(c) + 1 for c in r)
        if used > budget and kept:
            break
        kept.append(r)
    return [{"sheet": sheet, "header": header, "rows": kept, "rows_total": len(data)}]


def csv_tables(data: bytes, separator: str, sheet: str = "Sheet1", budget: int = SHEET_CHARS) -> list[dict]:
    return table_of(sheet, list(csv.reader(io.StringIO(data.decode("utf-8", "replace"), newline=""), delimiter=separator)), budget)


def is_code_column(name: str, values: list[float]) -> bool:
    """Numbers that name things: by the header's words, or three or more whole numbers of one width of three digits at least."""
    words = set(re.findall(r"[a-z$]+", (name or "").lower()))
    if words & QUANTITY_WORDS or words & CODE_WORDS:
        return not words & QUANTITY_WORDS
    widths = {len(str(abs(int(v)))) for v in values}
    return len(values) >= 3 and all(v.is_integer() for v in values) and len(widths) == 1 and min(widths) >= 3


def _number(cell: str) -> float | None:
    try:
        return float(cell.replace(",", "").replace("$", "").strip())
    except ValueError:
        return None


def summary_of(table: dict, file_name: str) -> str:
    header, rows, total = table["header"], table["rows"], table["rows_total"]
    sums = []
    for i, name in enumerate(header):
        values = [v for r in rows if (v := _number(r[i] if i < len(r) else "")) is not None]
        if values and len(values) >= max(1, len(rows) // 2) and not is_code_column(name, values):
            sums.append(f"{name or f'col{i}'} {sum(values):.2f}")
    lines = [f"### Sheet summary: {table['sheet']} ({file_name})", f"Rows: {total} · Columns: {len(header)}", f"Columns: {', '.join(h for h in header if h.strip())}"]
    return "\n".join(lines + ([f"Totals: {', '.join(sums)}"] if sums else []) + ([f"NOTE: only {len(rows)} of {total} rows captured."] if len(rows) < total else []))


def _line(row: list[str], width: int, most: int = CELL_CHARS) -> str:
    cells = [c.replace("|", "\\|").replace("\n", " ").strip() for c in [*row, *[""] * width][:width]]
    return "| " + " | ".join(c[:most] + "…" if len(c) > most else c for c in cells) + " |"


def table_chunks(table: dict, file_name: str, max_chars: int = CHUNK_CHARS) -> list[str]:
    """A summary, then groups of rows of at most max_chars, each under the sheet's name, its rows' numbers and the header.

    The cells of a row that is too long by itself are cut to half their width until it fits.
    """
    rows, total = table["rows"], table["rows_total"]
    width = max(map(len, [table["header"], *rows]))
    head = [_line(table["header"], width), "| " + " | ".join(["---"] * width) + " |"]
    title = lambda a, b: f"### Sheet: {table['sheet']} — rows {a}–{b} of {total}"
    size = lambda a, b, lines: len("\n".join([title(a, b), *head, *lines]))

    def fitted(row: list[str], first: int, n: int) -> str:
        most = CELL_CHARS
        while size(first, n, [line := _line(row, width, most)]) > max_chars and most > LEAST_CELL:
            most = max(LEAST_CELL, most // 2)
        return line

    out, group, first = [summary_of(table, file_name)], [], 1
    for n, row in enumerate(rows, 1):
        line = fitted(row, first, n)
        if group and size(first, n, [*group, line]) > max_chars:
            out.append("\n".join([title(first, n - 1), *head, *group]))
            group, first = [], n
            line = fitted(row, first, n)
        group.append(line)
    if group:
        out.append("\n".join([title(first, len(rows)), *head, *group]))
    return [x for x in out if any(c.isalnum() for c in x)]


_KINDS = {"docx": docx_text, "pptx": pptx_text, "xlsx": xlsx_tables, "csv": lambda d: csv_tables(d, ","), "tsv": lambda d: csv_tables(d, "\t"), "txt": lambda d: d.decode("utf-8", "replace"), "md": lambda d: d.decode("utf-8", "replace")}


def content(kind: str, data: bytes) -> tuple[str | None, list[dict], str | None]:
    """(text, tables, why neither) of a file's bytes, by the kind that its name says."""
    if kind not in _KINDS:
        return None, [], f"unsupported: {kind}"
    try:
        got = _KINDS[kind](data)
    except Exception as e:  # noqa: BLE001  a broken file is reported, and others go on
        return None, [], f"unreadable: {type(e).__name__}"
    return (got, [], None if got.strip() else "empty") if isinstance(got, str) else (None, got, None if got else "empty")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, kind, text, tables, skipped) of the files below path."""
    ship(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)).alias("kind"), "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):  # one file at a time
                text, tables, skipped = content(batch.column(1)[k].as_py(), batch.column(2)[k].as_py())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), batch.column(1).slice(k, 1), pa.array([text], pa.string()), pa.array([tables], pa.list_(_TABLE)), pa.array([skipped], pa.string())], names=["path", "kind", "text", "tables", "skipped"])

    return files.mapInArrow(run, f"path string, kind string, text string, tables array<{_SQL_TABLE}>, skipped string")


def chunked(files: DataFrame, prefix: str = "gdrive-") -> DataFrame:
    """(doc_id, path, text, content_hash, chunk_index, chunk_total) of files (id, path, text, tables): prose in pieces, tables in groups of rows."""
    ship(files.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, path, text, tables in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                parts = [c for t in tables or () for c in table_chunks(t, path.rpartition("/")[2])] or split_text(text)
                n = len(parts)
                columns = [pa.array([f"{prefix}{name}-{i}" for i in range(n)], pa.string()), pa.array([path] * n, pa.string()), pa.array(parts, pa.string()), pa.array(range(n), pa.int32()), pa.array([n] * n, pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "path", "text", "chunk_index", "chunk_total"])

    return files.select(F.col("id").cast("string"), "path", "text", "tables").mapInArrow(run, "doc_id string, path string, text string, chunk_index int, chunk_total int").withColumn("content_hash", F.sha2("text", 256))
