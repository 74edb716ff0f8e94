"""Extractions applied to the graph: whole versions, replays, de-duplication in order."""

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from memlake.operators import extraction as X
from memlake.sources.store import StaleVersion, TableSet

NONE = {"org": None, "content_type": "mail", "in_inbox": True, "summary": "s", "topics": None, "messages": [], "entities": None, "relations": None, "actions": None, "resolved": None}


def batch(spark, *rows):
    return spark.createDataFrame([NONE | r for r in rows], X.EXTRACTION.replace("\n", " "))


def said(thread, day, *texts, owner="Ada Byron", **more):
    people = [{"name": "Mrs. Ada Byron", "kind": "person", "org": "Analytical", "email": "ada@x.org"}, {"name": "Engines", "kind": "org", "org": None, "email": None}, {"name": "?!", "kind": "person", "org": None, "email": None}]
    return {"thread_id": thread, "messages": [{"message_id": f"m-{thread}", "day": day, "sender": "x"}, {"message_id": "later", "day": day + timedelta(1), "sender": "y"}], "entities": people,
            "relations": [{"a": "ada byron", "relation": "works at", "b": "Engines", "strength": 2.0}, {"a": "nobody", "relation": "works at", "b": "Engines", "strength": 2.0}],
            "topics": ["Looms", "looms ", ""], "actions": [{"description": t, "owner": owner, "due": None} for t in texts]} | more


DAY = date(2024, 3, 1)


def state(tables):
    return {n: sorted(map(tuple, tables.read(n).collect()), key=str) for n in X.TABLES}


def test_applying_twice_is_applying_once(spark, tmp_path):
    tables = TableSet(spark, f"file://{tmp_path}/t")
    assert tables.version() == 0 and tables.read("entities") is None
    first = batch(spark, said("t1", DAY, "Send the first report", "send first report!", "Call"), said("t2", DAY + timedelta(3), "send first report", "Mend loom", owner="unclear"), said("t3", DAY + timedelta(2), "Send first report"), {"thread_id": "empty"})
    X.apply(tables, first, "2024-03-05")
    once = state(tables)
    assert [(e[0], e[3], e[4], e[7]) for e in once["entities"]] == [("org:engines", None, None, 3), ("person:ada-byron", "Analytical", "ada@x.org", 3)]
    assert {(r[1], r[3]) for r in once["relations"]} == {("person:ada-byron", "org:engines")} and len(once["relations"]) == 3
    assert {t for t in once["topics"]} == {(f"m-t{k}", "looms") for k in (1, 2, 3)}
    # t3's report is that of t1 two days before; t2 has another owner
    assert {(a[1], a[2], a[4]) for a in once["actions"]} == {("t1", "Ada Byron", "Send the first report"), ("t1", "Ada Byron", "Call"), ("t2", "unclear", "send first report"), ("t2", "unclear", "Mend loom")}
    X.apply(tables, first, "2024-03-05")
    assert state(tables) == once and tables.version() == 2
    X.apply(tables, batch(spark, said("t1", DAY, resolved=["send first report", "unknown"])), "2024-03-05")
    done = {(a[1], a[5]): (a[8], a[9]) for a in state(tables)["actions"]}
    assert done["t1", "send first report"] == ("done", "m-t1") and done["t2", "send first report"] == ("open", None)
    assert sorted(map(tuple, tables.read("actions", 1).collect()), key=str) == once["actions"]  # an older version is still whole


def test_a_replay_after_the_first_is_done_changes_nothing(spark, tmp_path):
    """What was dropped for the sake of an open action stays dropped when that one is done."""
    tables = TableSet(spark, f"file://{tmp_path}/t")
    both = batch(spark, said("t1", DAY, "mend old loom", resolved=["mend old loom"]), said("t2", DAY + timedelta(1), "mend old loom"))
    for _ in range(2):
        X.apply(tables, both, "2024-03-05")
        assert [(a[1], a[8]) for a in state(tables)["actions"]] == [("t1", "done")] and len(state(tables)["dropped"]) == 1


def test_gates(spark, tmp_path):
    tables = TableSet(spark, f"file://{tmp_path}/t")
    old = DAY - timedelta(200)
    X.apply(tables, batch(spark, said("auto", DAY, "one thing", content_type="notification"), said("old", old, "two things", in_inbox=False), said("kept", old, "three things"), said("edge", DAY - timedelta(60), "four things", in_inbox=None)), str(DAY))
    assert {a[1] for a in state(tables)["actions"]} == {"kept", "edge"} and len(state(tables)["digests"]) == 4


def test_a_failed_commit_leaves_the_old_version(spark, tmp_path):
    tables = TableSet(spark, f"file://{tmp_path}/t")
    X.apply(tables, batch(spark, said("t1", DAY, "one thing")), str(DAY))
    before, version = state(tables), tables.version()
    broken = spark.range(1).select(F.raise_error(F.lit("lost")).alias("entity"))
    with pytest.raises(Exception, match="lost"):
        tables.commit({"links": spark.range(3), "entities": broken})
    assert tables.version() == version and state(tables) == before
    X.apply(tables, batch(spark, said("t2", DAY, "another matter")), str(DAY))
    with pytest.raises(StaleVersion):
        tables.commit({"links": spark.range(3)}, after=version)
    assert tables.version() == version + 1 and len(state(tables)["digests"]) == 2


def plain_kept(rows):
    """rows (action, owner, norm, day): each held against those of its owner kept before it."""
    kept = []
    for action, owner, norm, day in sorted(rows, key=lambda r: (r[3], r[0])):
        w = set(norm.split())
        for _, o, n, d in kept:
            v, sizes = set(n.split()), sorted((len(n), len(norm)))
            if o == owner and (day - d).days <= 7 and (n == norm or sizes[0] >= 0.6 * sizes[1] and (v <= w or w <= v or len(v & w) >= 0.85 * len(v | w))):
                break
        else:
            kept.append((action, owner, norm, day))
    return {k[0] for k in kept}


@pytest.mark.parametrize("seed", [1, 2])
def test_actions_are_held_against_those_kept_before(spark, seed):
    """One owner has a third of the rows, and one text every day: chains, each link of which hangs on the one before."""
    rng = random.Random(seed)
    words = ["send", "mend", "report", "loom", "first", "large", "invoice", "old"]
    rows = []
    for k in range(240):
        owner = "hot" if k % 3 else f"o{rng.randrange(6)}"
        norm = "send daily report" if k % 4 == 0 else " ".join(rng.sample(words, rng.randrange(1, 7)))
        rows.append((f"a{k:03d}", f"t{k}", owner, None, norm, norm, None, DAY + timedelta(rng.randrange(50)), "open", None))
    df = spark.createDataFrame(rows, X.TABLES["actions"]).repartition(3)
    got = {r.action for r in X.merged_actions(df.limit(0), df, df.limit(0).select('action'))[0].collect()}
    assert got == plain_kept([(r[0], r[2], r[5], r[7]) for r in rows])


def test_pairs_leave_their_join_decided(spark):
    """Titles go along with the words: what meets but isn't much the same is never written or joined again."""
    rows = [(k, "o", f"send {w} report", DAY + timedelta(k % 3)) for k, w in enumerate(["large", "old", "large", "first"])]
    pairs = X.much_the_same(spark.createDataFrame(rows, "n long, owner string, norm string, day date"))
    assert [tuple(r) for r in pairs.collect()] == [(0, 2)]
    assert pairs._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 2


def test_owners_by_any_honorific_and_twice_named(spark, tmp_path):
    """The owner is the first of the extraction's people with the owner's name; relations take the smallest entity of a name."""
    tables = TableSet(spark, f"file://{tmp_path}/t")
    twice = [{"name": n, "kind": k, "org": None, "email": None} for n, k in (("Dr. Ada  Byron", "person"), ("ada byron", "org"), ("Ada Byron", "org"), ("Loom", None))]
    tie = [{"a": "Mr ADA BYRON", "relation": "owns", "b": "loom", "strength": 1.0}]
    X.apply(tables, batch(spark, said("t1", DAY, "one thing", owner="Prof. X", entities=twice, relations=tie), said("t2", DAY, "another", owner=" Sister Ada Byron", entities=twice, relations=tie), said("t3", DAY, "third", entities=None, relations=None)), str(DAY))
    made = state(tables)
    assert {a[1]: a[3] for a in made["actions"]} == {"t1": None, "t2": "person:ada-byron", "t3": None}
    assert {r[:4] for r in made["relations"]} == {(t, "org:ada-byron", "owns", "person:loom") for t in ("t1", "t2")}


def test_within_an_extraction(spark):
    lists = [["send report", "Send the report", "send report today", "call", "", None, "recall it"], [], ["a b c d", "a b c e", "f g h n j k l", "f g h n j k m"]]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(lists)], "id int, texts array<string>")
    got = {r.id: [x["at"] for x in r.kept] for r in df.select("id", X.distinct_in_order(F.transform("texts", lambda t: F.coalesce(t, F.lit("")))).alias("kept")).collect()}
    assert got == {0: [0, 3], 1: [], 2: [0, 1, 2]}


@pytest.mark.parametrize("most", [64, 3])
def test_pairs_in_place_are_those_by_words(spark, monkeypatch, most):
    """Two rows for each go to the tasks that compare them, and cells with more than IN_PLACE meet by words; the pairs are the same."""
    rng = random.Random(most)
    words = ["send", "mend", "report", "loom", "first", "large"]
    rows = {(rng.choice(["hot", "hot", "a", "b"]), " ".join(rng.sample(words, rng.randrange(1, 6))), DAY + timedelta(rng.randrange(60))) for _ in range(150)}
    first = spark.createDataFrame([(n, *r, (1, r[2], f"a{n:03d}")) for n, r in enumerate(sorted(rows))], "n long, owner string, norm string, day date, place struct<turn:int,day:date,action:string>").repartition(3)
    want = {frozenset(map(int, p)) for p in X.much_the_same(first.drop("place")).collect()}
    monkeypatch.setattr(X, "IN_PLACE", most)
    near = X.near_in_place(first).collect()
    assert any(r.b is None for r in near) == (most == 3)
    if most == 64:
        assert {frozenset((r.a, r.b)) for r in near} == want and len(near) == len(want)
    order = [n for n, r in sorted(enumerate(sorted(rows)), key=lambda x: (x[1][2], f"a{x[0]:03d}"))]
    got = X.paired(first).collect()
    assert len(got) == len(want) > 20 and all(r.early < r.late for r in got)
    late = {n: max(order.index(x) for x in p) for n, p in enumerate(want)}
    assert sorted(r.action for r in got) == sorted(f"a{order[k]:03d}" for k in late.values())
    plan = X.near_in_place(first)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join " not in plan and plan.count("RepartitionByExpression") == 1


def test_one_a_thread_moves_only_threads_with_several(spark, tmp_path):
    """Of several extractions of a thread that with the latest lead counts; without such nothing is shuffled but ids, and nothing is left in the shared folder."""
    from memlake import shared

    tables = TableSet(spark, f"file://{tmp_path}/t")
    before = list(shared._folders)
    X.apply(tables, batch(spark, said("t1", DAY, "one thing", summary="old"), said("t1", DAY + timedelta(4), "two things", summary="new"), said("t2", DAY, "three things")), str(DAY))
    assert {(d[0], d[1], d[5]) for d in state(tables)["digests"]} == {("t1", "m-t1", "new"), ("t2", "m-t2", "s")}
    assert shared._folders == before
    alone = shared.stored(X.led(batch(spark, said("t1", DAY), said("t2", DAY))).withColumn("people", X.people(F.col("entities"))), "alone")
    assert X.one_a_thread(alone, "people") is alone


def test_costly_arrays_are_made_once(spark):
    """A filter on what explode gives made the texts' list a second time; an entity's name was cut for each use."""
    found = X.led(batch(spark, said("t1", DAY, "one thing"))).withColumn("people", X.people(F.col("entities")))
    plan = X.proposed(found.drop("entities"), str(DAY))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("aggregate(") == 1
    assert [(p["id"], p["entity"]) for p in found.first()["people"]] == [("person:ada-byron", "person:ada-byron"), ("org:engines", "org:engines"), (None, None)]
    twice = batch(spark, said("t1", DAY, entities=[{"name": "Pastor Dr. Č. Ann", "kind": None, "org": None, "email": None}, {"name": "a@b.cd", "kind": "org", "org": None, "email": None}]))
    got = twice.select(X.people(F.col("entities")).alias("p")).first().p
    assert [(p["name"], p["id"], p["entity"]) for p in got] == [("Dr. Č. Ann", "person:dr-c-ann", "person:c-ann"), ("a@b.cd", "org:a-b-cd", None)]
