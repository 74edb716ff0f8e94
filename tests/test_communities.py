"""Communities by modularity: against a plain version, against SQL, never below label propagation."""

import random
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from memlake.operators import communities as M
from memlake.operators import graph as G


def plain_modularity(edges, label, resolution=1.0):
    m = sum(w for _, _, w in edges)
    degree, inside = defaultdict(float), 0.0
    for a, b, w in edges:
        degree[label[a]] += w
        degree[label[b]] += w
        inside += w * (label[a] == label[b])
    return inside / m - resolution * sum((d / (2 * m)) ** 2 for d in degree.values())


def plain_communities(edges, resolution=1.0):
    """Merge the pair of communities that gains most, until none gains."""
    label = {n: n for e in edges for n in e[:2]}
    best = plain_modularity(edges, label, resolution)
    while True:
        found = None
        for x, y in {tuple(sorted((label[a], label[b]))) for a, b, _ in edges if label[a] != label[b]}:
            q = plain_modularity(edges, {n: x if c == y else c for n, c in label.items()}, resolution)
            if q > best + 1e-12 and (found is None or q > found[0]):
                found = q, x, y
        if not found:
            return label
        best, x, y = found
        label = {n: x if c == y else c for n, c in label.items()}


def planted(seed, groups, size, p_in, p_out):
    rng = random.Random(seed)
    names = [f"n{g:02d}{k:02d}" for g in range(groups) for k in range(size)]
    return [(a, b, float(rng.randrange(1, 4))) for i, a in enumerate(names) for b in names[:i] if rng.random() < (p_in if a[:3] == b[:3] else p_out)]


SCHEMA = "a string, b string, weight double"


@pytest.mark.parametrize(("seed", "groups", "size", "p_in", "p_out"), [(1, 5, 8, 0.8, 0.02), (2, 4, 10, 0.4, 0.1)])
def test_communities_are_as_good_as_a_plain_version(spark, seed, groups, size, p_in, p_out):
    edges = planted(seed, groups, size, p_in, p_out)
    df = spark.createDataFrame(edges, SCHEMA).repartition(3)
    found = {r.node: r.community for r in M.communities(df).collect()}
    assert set(found) == {n for e in edges for n in e[:2]} and all(c == min(n for n in found if found[n] == c) for c in found.values())
    got, plain = plain_modularity(edges, found), plain_modularity(edges, plain_communities(edges))
    spread = {r.node: r.community for r in G.label_propagation(df).collect()}
    assert got >= 0.95 * plain and got >= plain_modularity(edges, spread) - 1e-9
    if p_out < 0.05:
        assert len({(n[:3], c) for n, c in found.items()}) == groups == len(set(found.values()))
    labels = spark.createDataFrame(list(found.items()), "node string, community string")
    shares = M.modularity(df, labels).toPandas()
    assert abs(shares.share.sum() - got) < 1e-9 and shares.n_nodes.sum() == len(found)
    e, k = df.toPandas(), labels.toPandas()  # noqa: F841  read by SQL
    [(by_sql,)] = duckdb.sql("""
        with m as (select sum(weight) as m from e), i as (select sum(weight) as w from e join k x on x.node = a join k y on y.node = b where x.community = y.community),
        d as (select sum(weight) as d from (select a as node, weight from e union all select b, weight from e) join k using (node) group by community)
        select i.w / m - (select sum((d / (2 * m)) ** 2) from d, m) from i, m""").fetchall()
    assert abs(by_sql - got) < 1e-9


def test_resolution_loops_and_nothing(spark):
    edges = [("a", "b", 5.0), ("b", "c", 5.0), ("a", "c", 5.0), ("c", "d", 1.0), ("d", "e", 5.0), ("e", "f", 5.0), ("d", "f", 5.0), ("a", "a", 2.0)]
    df = spark.createDataFrame([*edges, (None, "x", 1.0), ("y", "z", 0.0)], SCHEMA)
    label = {r.node: r.community for r in M.communities(df).collect()}
    assert label == dict.fromkeys("abc", "a") | dict.fromkeys("def", "d")
    assert len({r.community for r in M.communities(df, resolution=30.0).collect()}) == 6
    got = M.modularity(spark.createDataFrame(edges, SCHEMA), spark.createDataFrame(list(label.items()), "node string, community string")).agg(F.sum("share")).first()[0]
    assert abs(got - plain_modularity(edges, label)) < 1e-9
    assert M.communities(df.limit(0)).count() == 0
    far = spark.createDataFrame([("a", "b", 1.0), ("c", "d", 1.0), ("d", "e", 1.0)], SCHEMA)
    assert {r.a for r in M.largest_component(far).collect()} == {"c", "d"}


def test_no_round_is_made_twice(spark, monkeypatch):
    """The better start's round is the first of its moves."""
    seen, made = [], M._round
    monkeypatch.setattr(M, "_round", lambda links, now, *a: seen.append(now) or made(links, now, *a))
    df = spark.createDataFrame([("a", "b", 5.0), ("b", "c", 5.0), ("a", "c", 5.0), ("c", "d", 1.0), ("d", "e", 5.0), ("e", "f", 5.0), ("d", "f", 5.0)], SCHEMA)
    assert {r.node: r.community for r in M.communities(df).collect()} == dict.fromkeys("abc", "a") | dict.fromkeys("def", "d")
    assert len({id(now) for now in seen}) == len(seen)
