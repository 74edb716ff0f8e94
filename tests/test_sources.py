"""Sources, sinks and mail functions on small files."""

import datetime
import gzip
import json

from pyspark.sql import functions as F

from memlake.functions import mail
from memlake.sources import files, store


def test_spool_and_quarantine(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"kind": "note", "text": "x"}))
    (tmp_path / "b.json").write_text("{broken")
    (tmp_path / "c.json").write_text(json.dumps({"kind": None, "text": "y"}))
    good, bad = files.spool(spark, f"file://{tmp_path}/*.json", "kind string, text string", ["kind"])
    assert [r.text for r in good.collect()] == ["x"] and bad.count() == 2


def test_snapshot_and_transcript(spark, tmp_path):
    with gzip.open(tmp_path / "s.jsonl.gz", "wt") as f:
        f.write('{"kind":"entity","id":"e1","name":"A"}\n{"kind":"relation","id":"r1"}\n')
    parts = files.snapshot(spark, f"file://{tmp_path}/s.jsonl.gz")
    assert parts["entity"].first().name == "A" and parts["relation"].count() == 1 and parts["taxonomy"].count() == 0
    (tmp_path / "t.jsonl").write_text('{"role":"user","content":"hi"}\n{"role":"assistant","content":[{"text":"a"},{"text":"b"}]}\nnot json\n')
    assert [(r.role, r.text) for r in files.transcript(spark, f"file://{tmp_path}/t.jsonl").orderBy("line").collect()] == [("user", "hi"), ("assistant", "a b")]


def test_delimited(spark, tmp_path):
    (tmp_path / "t.csv").write_text('a,b\n,\n"x, y",2\n3,4\n\n"p\nq ""r""",5\r\n')
    rows = files.delimited(spark, f"file://{tmp_path}/t.csv").orderBy("row").collect()
    assert [r.cells for r in rows] == [["a", "b"], ["x, y", "2"], ["3", "4"], ['p\nq "r"', "5"]]
    assert files.delimited(spark, f"file://{tmp_path}/t.csv", char_budget=7).count() == 2


def test_mail_files(spark, tmp_path):
    (tmp_path / "m.eml").write_bytes(b"Message-ID: <1@x>\r\nFrom: Ann <ann@x.org>\r\nTo: b@x.org\r\nSubject: Hi\r\nDate: Tue, 02 Jun 2026 16:30:01 +0800\r\nContent-Type: text/plain; charset=utf-8\r\n\r\nh\xc3\xa9llo\r\n")
    row = files.mail_files(spark, f"file://{tmp_path}/*.eml").first()
    assert row.subject == "Hi" and row.text.strip() == "héllo" and row.attachments == []


def test_mail_functions(spark):
    body = "See below.\n> old\nThanks,\nAnn\n\nOn Tue, 2 Jun 2026 Bob wrote:\n> quoted"
    day = F.lit("2026-06-02").cast("date")
    got = spark.range(1).select(
        mail.address(F.lit('"Ann" <Ann@X.org>')).alias("a"), mail.display_name(F.lit('"Ann L" <a@x>')).alias("n"), mail.address(F.lit("no address")).alias("none"),
        mail.sent_at(F.lit("Tue, 02 Jun 2026 16:30:01 +0800")).alias("t"), mail.sent_at(F.lit("2026-06-02T01:02:03Z")).alias("i"), mail.sent_at(F.lit("junk")).alias("j"),
        mail.own_text(F.lit(body)).alias("own"), mail.signature(F.lit("Hello there\nmore\nThanks,\nAnn")).alias("sig"),
        mail.deadline(F.lit("please send by Friday"), day).alias("fri"), mail.deadline(F.lit("due 2026-07-01"), day).alias("iso"), mail.deadline(F.lit("in 3 days"), day).alias("in3"), mail.deadline(F.lit("whenever"), day).alias("never"),
        mail.questions(F.lit("Can you come? It is fine. Send it. Can you come?")).alias("q"), mail.owner_confidence(F.lit(False), F.lit("Send it")).alias("o"),
        mail.reuse(F.lit("one two three four five six"), F.lit("one two three")).alias("u"),
    ).first()
    assert (got.a, got.n, got.none) == ("ann@x.org", "Ann L", "") and got.t == datetime.datetime(2026, 6, 2, 8, 30, 1) and got.i == datetime.datetime(2026, 6, 2, 1, 2, 3) and got.j is None
    assert got.own == "See below.\nThanks,\nAnn" and got.sig == "Thanks,\nAnn"
    assert (str(got.fri), str(got.iso), str(got.in3), got.never) == ("2026-06-05", "2026-07-01", "2026-06-05", None)
    assert got.q == ["Can you come?", "Send it."] and got.o == 0.6 and got.u == 0.5


def test_versioned_table(spark, tmp_path):
    table = store.VersionedTable(spark, f"file://{tmp_path}", "chunks")
    rows = lambda *r: spark.createDataFrame(list(r), "id long, hash string, text string")
    table.upsert(rows((1, "a", "x"), (2, "b", "y")), "id", "hash")
    table.upsert(rows((2, "b", "ignored"), (3, "c", "z"), (1, "a2", "x2")), "id", "hash")
    assert {(r.id, r.text) for r in table.read().collect()} == {(1, "x2"), (2, "y"), (3, "z")}
    table.delete(spark.createDataFrame([(1,)], "id long"), "id")
    assert table.versions() == [1, 2, 3] and table.read().count() == 2 and table.read(1).count() == 2
    table.drop_old(1)
    assert table.versions() == [3]
    one, other = store.manifest(rows((1, "a", "x"), (2, "b", "y")), "id").first(), store.manifest(rows((2, "b", "y"), (1, "a", "x")).repartition(2), "id").first()
    assert one == other and one.rows == 2
    assert {r.text for r in store.newest_per_key(rows((1, "a", "x"), (1, "b", "y")), "id", "hash").collect()} == {"y"}
