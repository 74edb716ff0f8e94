"""Matching, merges and their undoing, and snapshots of a shared layer, against plain versions."""

import random
import re
from collections import defaultdict

import pytest

from memlake.operators import layers as L

ENTITY = "id string, name string, kind string, email string, aliases string"
RELATION = "id long, a string, relation string, b string, origin string"
LOG = "seq int, what string, row long, side string, from_id string, to_id string"


def plain_drifted(shared, local):
    role = lambda e: bool(e) and e.split("@")[0].strip().lower() in ("info", "office")
    mail = lambda e: (e or "").strip().lower()
    words = lambda n: set(re.findall(r"[^\W_]+", (n or "").lower()))
    key = lambda n: re.sub(r"[^a-z0-9]+", "-", (n or "").lower()).strip("-")
    found = {}
    for i, name, kind, email, aliases in shared:
        hits = [r for r in local if r[0] != i and mail(email) and not role(email) and mail(r[3]) == mail(email)]
        if len(hits) == 1:
            found[i] = hits[0][0], "mail"
            continue
        if role(email):
            continue
        called = {a.strip().lower() for a in re.split("[|,]", aliases or "") if a.strip()}
        hits = []
        for r in local:
            if r[0] == i or r[2] != kind or role(r[3]):
                continue
            a, b = words(name), words(r[1])
            if (key(name) and key(name) == key(r[1])) or (r[1] or "").strip().lower() in called or (a and b and len(a & b) >= 0.8 * len(a | b)):
                hits.append(r)
        if len(hits) == 1:
            found[i] = hits[0][0], "name"
    claims = defaultdict(list)
    for i, (other, _) in found.items():
        claims[other].append(i)
    return {(i, other, how) for i, (other, how) in found.items() if len(claims[other]) == 1}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_drifted_is_unambiguous(spark, seed):
    """All four ways; contested, ambiguous and own ones; one name that a third of the locals have."""
    rng = random.Random(seed)
    first, last = ["ann", "bo", "cyd", "dee", "eve"], ["lee", "may", "o-neil", "poe", "quin", "ray"]
    name = lambda: None if rng.random() < 0.05 else " ".join(rng.sample(first, rng.randrange(1, 3)) + rng.sample(last, rng.randrange(1, 4)))
    mail = lambda: rng.choice([None, "", " ", f"u{rng.randrange(25)}@x.org", f"U{rng.randrange(25)}@x.org ", "info@x.org"])
    local = [(str(k), "Ann Lee" if k % 3 == 0 else name(), rng.choice("ab"), mail(), None) for k in range(60)]
    shared = [(str(k), rng.choice([name(), (local[rng.randrange(60)][1] or "x").upper(), "Ann, Lee!"]), rng.choice("ab"), mail(), rng.choice([None, "", f"{name()}|{name()},{name()}"])) for k in range(40, 100)]
    got = L.drifted(spark.createDataFrame(shared, ENTITY).repartition(2), spark.createDataFrame(local, ENTITY).repartition(3)).collect()
    assert {tuple(r) for r in got} == plain_drifted(shared, local) and len(got) > 2


def layers(spark, entities, relations, observations):
    return L.Layers(spark.createDataFrame(entities, ENTITY + ", origin string"), spark.createDataFrame(relations, RELATION), spark.createDataFrame(observations, "id long, entity string, text string"), spark.createDataFrame([], LOG))


def shown(graph):
    return {(r.a, r.relation, r.b, r.id) for r in L.edges(graph).collect()}, {(r.id, r.entity) for r in graph.observations.collect()}


def test_merge_then_undo_gives_the_first_graph(spark):
    """Chains within a merge and across merges, loops and equal edges in between, revived one after another."""
    people = [(c, c, "person", None, None, "local") for c in "abcdef"]
    edges = [(1, "a", "knows", "b", "local"), (2, "b", "knows", "c", "local"), (3, "a", "knows", "d", "local"), (4, "b", "knows", "d", "local"), (5, "e", "knows", "f", "local")]
    graph = layers(spark, people, edges, [(k, c, "x") for k, c in enumerate("aabbcdef")])
    before = shown(graph)
    one = L.merged(graph, spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "x")], "loser string, winner string"), 1)
    assert shown(one)[0] == {("c", "knows", "d", 3), ("e", "knows", "f", 5)}
    two = L.merged(one, spark.createDataFrame([("c", "e"), ("d", "e")], "loser string, winner string"), 2)
    assert shown(two)[0] == {("e", "knows", "f", 5)} and {r.id for r in two.entities.collect()} == {"e", "f"}
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    part = L.undone(two, ids("a"))  # a's references only, from e
    assert shown(part)[1] == {(0, "a"), (1, "a"), (2, "e"), (3, "e"), (4, "e"), (5, "e"), (6, "e"), (7, "f")}
    part = L.undone(part, ids("c"))
    assert shown(part)[1] == {(0, "a"), (1, "a"), (2, "c"), (3, "c"), (4, "c"), (5, "e"), (6, "e"), (7, "f")}
    assert shown(L.undone(part, ids("b", "d"))) == before
    every = L.undone(two, ids("a", "b", "c", "d"))
    assert shown(every) == before and every.log.count() == 0
    circle = L.merged(graph, spark.createDataFrame([("a", "b"), ("b", "a")], "loser string, winner string"), 3)
    assert shown(circle) == before


def test_snapshots_replace_the_shared_layer(spark):
    local = [("l1", "Ann Lee", "person", "ann@x.org", None, "local"), ("l2", "Bo Poe", "person", None, None, "local"), ("s3", "Mine", "person", None, "own", "local")]
    graph = layers(spark, local, [(1, "l1", "knows", "l2", "local")], [(1, "l1", "x"), (2, "l2", "y")])
    shared = [("s1", "Ann L.", "person", "ann@x.org", "A"), ("s2", "Engines", "org", None, None), ("s3", "Theirs", "person", None, "new"), ("s4", "Looms", "org", None, None)]
    rel = spark.createDataFrame([(100, "s1", "works at", "s2"), (101, "s2", "buys from", "s4")], "id long, a string, relation string, b string")
    none = spark.createDataFrame([], "id string, merged_into string")
    one = L.imported(graph, spark.createDataFrame(shared, ENTITY), rel, none, 1)
    origins = lambda g: {r.id: r.origin for r in g.entities.collect()}
    assert origins(one) == {"l2": "local", "s3": "local", "s1": "shared", "s2": "shared", "s4": "shared"}  # l1 went into s1; s3 stays the local one
    assert {r.id: r.name for r in one.entities.collect()}["s3"] == "Mine"
    assert shown(one)[0] == {("s1", "knows", "l2", 1), ("s1", "works at", "s2", 100), ("s2", "buys from", "s4", 101)} and shown(one)[1] == {(1, "s1"), (2, "l2")}
    # s1 is folded into s2; s4 goes without a trace; the relations are those of the second snapshot
    two = L.imported(one, spark.createDataFrame([shared[1]], ENTITY), rel.limit(0), spark.createDataFrame([("s1", "s2"), ("s9", "s2")], "id string, merged_into string"), 2)
    assert origins(two) == {"l2": "local", "s3": "local", "s2": "shared"} and shown(two) == ({("s2", "knows", "l2", 1)}, {(1, "s2"), (2, "l2")})
    # s1 is back and takes what it had; s2 is gone from the snapshot and nothing local is left of it
    three = L.imported(two, spark.createDataFrame([shared[0]], ENTITY), rel.limit(0), none, 3)
    assert origins(three) == {"l2": "local", "s3": "local", "s1": "shared"} and shown(three) == ({("s1", "knows", "l2", 1)}, {(1, "s1"), (2, "l2")})
    # gone without a successor, but referred to: it becomes local
    four = L.imported(three, spark.createDataFrame([], ENTITY), rel.limit(0), spark.createDataFrame([("s1", None)], "id string, merged_into string"), 4)
    assert origins(four) == {"l2": "local", "s3": "local", "s1": "local"}


def test_nothing_is_rewritten_where_nothing_moves(spark, monkeypatch):
    kept = []
    graph = layers(spark, [("x", "Ann", "k", None, "", "local")], [(1, "x", "knows", "y", "local")], [(5, "x", "o")])
    fresh = spark.createDataFrame([("s", "Bo", "k", None, "")], "id string, name string, kind string, email string, aliases string")
    none, gone = spark.createDataFrame([], "id long, a string, relation string, b string"), spark.createDataFrame([], "id string, merged_into string")
    monkeypatch.setattr(L, "stored", lambda df, name, write=L.stored: kept.append(name) or write(df, name))
    after = L.imported(graph, fresh, none, gone, 1)
    assert {(r.id, r.origin) for r in after.entities.collect()} == {("x", "local"), ("s", "shared")}
    assert [(r.id, r.a, r.b) for r in after.relations.collect()] == [(1, "x", "y")] and after.observations.count() == 1 and after.log.count() == 0
    assert not {"relations", "observations", "moves", "log"} & set(kept)
