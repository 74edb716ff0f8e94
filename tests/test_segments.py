"""An index kept up by segments holds and finds what one of the final documents does."""

import os
import random

import pytest
from pyspark.sql import functions as F

from memlake.operators import retrieval as R
from memlake.operators import segments as G
from memlake.sources.store import StaleVersion

WORDS = ["alpha", "beta", "gamma", "delta", "VERIFY-CAP-001", "red", "ring", "été"]
SCHEMA = "doc_id long, text string"


def text(rng):
    return " ".join(rng.choices(WORDS, k=rng.randrange(0, 30))) or None


def same(spark, index, state):
    docs = spark.createDataFrame(sorted(state.items()), SCHEMA).repartition(3)
    n, mean = index.stats()
    words = [len(R.phrases((t or "").replace("-", " "))) for t in state.values()]
    assert n == len(state) and abs(mean - (sum(words) / n if n else 0)) < 1e-9
    for query in ("alpha", "alpha beta", "verify-cap-001", "alpha-beta gamma", "zzz ring", "red red", "Été", "zzz", ""):
        assert [tuple(r) for r in index.bm25(query, 9).collect()] == [tuple(r) for r in R.bm25(docs, query, 9).collect()], query


def files(folder):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(folder) for f in names}


def test_segments_follow_changes(spark, tmp_path, monkeypatch):
    rng = random.Random(7)
    index, state = G.SegmentedIndex(spark, f"file://{tmp_path}/i"), {}
    assert index.segments() == [] and index.bm25("alpha", 3).count() == 0 and index.merge() is None
    batches = [([(i, text(rng)) for i in range(60)], []), ([(i, text(rng)) for i in range(50, 75)], [3, 4, 50, 999, None]), ([(3, "alpha beta"), (None, "lost"), (80, None)], [80, 74]), ([], [3, 61])]
    for new, gone in batches:
        before = files(tmp_path)
        segment = index.apply(spark.createDataFrame(new, SCHEMA), spark.createDataFrame([(g,) for g in gone], "id long"))
        after = files(tmp_path)
        assert {f: after[f] for f in before} == before  # nothing that was written is written again
        for g in gone:
            state.pop(g, None)
        state |= {i: t for i, t in new if i is not None}
        assert index.segments()[-1] == segment
        same(spark, index, state)
        monkeypatch.setattr(G, "MAX_BROADCAST_IDS", 2)
    assert len(index.segments()) == 4
    merged = index.merge()
    assert merged is not None and 1 < len(index.segments()) < 4
    same(spark, index, state)
    index.apply(spark.createDataFrame([(61, "red ring")], SCHEMA))
    state[61] = "red ring"
    assert index.merge(all_of_them=True).n_gone == 0 and len(index.segments()) == 1
    same(spark, index, state)
    assert index.vacuum(1) > 0 and len(index.segments()) == 1
    same(spark, index, state)
    assert {r.term: r.df for r in index.terms().collect()} == {r.term: r.n for r in index.found().groupBy("term").agg(F.count("*").alias("n")).collect()}


def test_a_search_reads_the_buckets_of_its_terms(spark, tmp_path):
    index = G.SegmentedIndex(spark, f"file://{tmp_path}/i")
    index.apply(spark.createDataFrame([(i, "alpha beta gamma") for i in range(9)], SCHEMA))
    plan = index.found(["alpha"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1][:200] and "Window" not in plan


def test_a_commit_on_an_older_version_is_refused(spark, tmp_path, monkeypatch):
    index = G.SegmentedIndex(spark, f"file://{tmp_path}/i")
    index.apply(spark.createDataFrame([(1, "alpha")], SCHEMA))
    known = index.segments()
    index.apply(spark.createDataFrame([(2, "alpha")], SCHEMA))
    with pytest.raises(StaleVersion):
        index._commit(known, 1)
    assert index.stats()[0] == 2
    whole = index._commit
    monkeypatch.setattr(index, "_commit", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError, match="lost"):
        index.apply(spark.createDataFrame([(3, "alpha")], SCHEMA))
    monkeypatch.setattr(index, "_commit", whole)
    same(spark, index, {1: "alpha", 2: "alpha"})


def test_postings_are_made_of_the_forward_table(spark, tmp_path):
    """Texts are dealt out and cut once."""
    index = G.SegmentedIndex(spark, f"file://{tmp_path}/i")
    folder = index.apply(spark.createDataFrame([(1, "beta alpha beta"), (1, None), (2, None)], SCHEMA).where("doc_id = 2 or text is not null")).folder
    held = spark.read.schema("id long, dl int, terms array<string>, at array<array<int>>").parquet(f"{folder}/forward").select("id", "dl", "terms", "at").orderBy("id").collect()
    assert [tuple(r) for r in held] == [(1, 3, ["alpha", "beta"], [[1], [0, 2]]), (2, 0, [], [])]
    assert [tuple(r) for r in index.found().select("term", "id", "dl", "at").orderBy("term").collect()] == [("alpha", 1, 3, [1]), ("beta", 1, 3, [0, 2])]
