"""Office files made by hand, read back as text, tables and chunks."""

import zipfile

from pyspark.sql import functions as F

from memlake.sources import office

W = 'xmlns:w="http://x/w"'
A = 'xmlns:a="http://x/a" xmlns:p="http://x/p"'


def packed(path, parts):
    with zipfile.ZipFile(path, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)


def files(root):
    para = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    row = "".join(f"<w:tc>{para(c)}</w:tc>" for c in ("x", " ", "y"))
    packed(root / "a.docx", {"word/document.xml": f"<w:document {W}><w:body>{para('One &amp; two')}{para(' ')}<w:tbl><w:tr>{row}</w:tr></w:tbl><w:p><w:r><w:t>A</w:t><w:tab/><w:t>B</w:t></w:r></w:p></w:body></w:document>"})
    text = lambda *t: "<p:sp><p:txBody>" + "".join(f"<a:p><a:r><a:t>{x}</a:t></a:r></a:p>" for x in t) + "</p:txBody></p:sp>"
    table = "<a:tbl><a:tr>" + "".join(f"<a:tc><a:txBody><a:p><a:r><a:t>{c}</a:t></a:r></a:p></a:txBody></a:tc>" for c in "mn") + "</a:tr></a:tbl>"
    packed(root / "b.pptx", {f"ppt/slides/slide{i}.xml": f"<p:sld {A}>{body}</p:sld>" for i, body in ((10, text("Last")), (2, text("", " ")), (1, text("Title", "Body") + table))})
    cell = lambda ref, v, t="": f'<c r="{ref}"{t}><v>{v}</v></c>'
    shared = ' t="s"'
    sheet = f"<worksheet><sheetData><row>{cell('A1', 0, shared)}{cell('C1', 1, shared)}</row><row/><row>{cell('A3', 4521)}{cell('C3', 10.5)}</row><row>{cell('A4', 6100)}{cell('C4', 2)}{cell('D4', '')}</row></sheetData></worksheet>"
    packed(root / "c.xlsx", {
        "xl/workbook.xml": '<workbook xmlns:r="http://x/r"><sheets><sheet name="Plan" r:id="r1"/><sheet name="None" r:id="r2"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Target="/xl/worksheets/sheet2.xml"/></Relationships>',
        "xl/sharedStrings.xml": "<sst><si><t>GL Code</t></si><si><r><t>Am</t></r><r><t>ount</t></r></si></sst>", "xl/worksheets/sheet1.xml": sheet, "xl/worksheets/sheet2.xml": "<worksheet/>",
    })
    (root / "d.tsv").write_text('h\tk\n"x\ny"\t1,000\n')
    (root / "e.pdf").write_bytes(b"%PDF")
    (root / "f.docx").write_bytes(b"no zip")
    (root / "g.txt").write_text("plain text")


def test_read_and_chunk(spark, tmp_path):
    files(tmp_path)
    got = {r.path.rpartition("/")[2]: r for r in office.read_files(spark, f"file://{tmp_path}").collect()}
    assert got["a.docx"].text == "One & two\nA\tB\nx | y" and got["b.pptx"].text == "Slide 1\nTitle\nBody\nm | n\n\nSlide 3\nLast"
    table = got["c.xlsx"].tables[0]
    assert len(got["c.xlsx"].tables) == 1 and (table.sheet, table.header, table.rows, table.rows_total) == ("Plan", ["GL Code", "", "Amount"], [["4521", "", "10.5"], ["6100", "", "2"]], 2)
    assert got["d.tsv"].tables[0].rows == [["x\ny", "1,000"]]
    assert {n: r.skipped for n, r in got.items() if r.skipped} == {"e.pdf": "unsupported: pdf", "f.docx": "unreadable: BadZipFile"}
    chunks = office.chunked(office.read_files(spark, f"file://{tmp_path}").withColumn("id", F.regexp_extract("path", r"(\w)\.\w+$", 1))).collect()
    by = {r.doc_id: r.text for r in chunks}
    assert by["gdrive-g-0"] == "plain text" and "gdrive-e-0" not in by
    assert by["gdrive-c-0"] == "### Sheet summary: Plan (c.xlsx)\nRows: 2 · Columns: 3\nColumns: GL Code, Amount\nTotals: Amount 12.50"
    assert by["gdrive-c-1"] == "### Sheet: Plan — rows 1–2 of 2\n| GL Code |  | Amount |\n| --- | --- | --- |\n| 4521 |  | 10.5 |\n| 6100 |  | 2 |"


def test_groups_of_rows_fit():
    table = {"sheet": "S", "header": ["a", "b"], "rows": [[f"row {i}", "x" * (i * 37 % 400)] for i in range(60)] + [["y" * 900, "z" * 900]], "rows_total": 70}
    chunks = office.table_chunks(table, "f", 500)
    assert "NOTE: only 61 of 70 rows captured." in chunks[0] and all(len(c) <= 500 for c in chunks[1:])
    lines = [x for c in chunks[1:] for x in c.split("\n")[3:]]
    assert len(lines) == 61 and [x.split(" | ")[0] for x in lines[:60]] == [f"| row {i}" for i in range(60)]
    assert all(c.split("\n")[1] == "| a | b |" for c in chunks[1:]) and chunks[1].startswith("### Sheet: S — rows 1–")
    assert office.table_of("s", [["", " "], []]) == [] and len(office.table_of("s", [["h"], ["x" * 9], ["y"]], 3)[0]["rows"]) == 1
    assert office.is_code_column("Account", [1.0]) and not office.is_code_column("Account Balance", [100.0, 200.0, 300.0]) and office.is_code_column("", [100.0, 200.0, 300.0]) and not office.is_code_column("", [100.5, 200.0, 300.0])
