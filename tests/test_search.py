"""The stored index, the route, nearest neighbours in blocks, running sums."""

import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from memlake.operators import entities as E
from memlake.operators import retrieval as R
from memlake.operators import search as S
from memlake.operators import upkeep as U

WORDS = ["alpha", "beta", "gamma", "delta", "VERIFY-CAP-001", "red", "ring", "été"]


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choices(WORDS, k=rng.randrange(1, 30)))) for i in range(60)] + [(90, None), (91, ""), (92, "alpha beta alpha beta")]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


@pytest.fixture(scope="module")
def index(spark, docs, tmp_path_factory):
    return S.build(docs, f"file://{tmp_path_factory.mktemp('index')}/i")


@pytest.mark.parametrize("query", ["alpha", "alpha beta", "verify-cap-001", "alpha-beta gamma", "zzz", "zzz ring", "red red", "Été", "", "?!", "a-a"])
def test_index_finds_what_a_scan_finds(spark, docs, index, query):
    got, want = S.bm25(spark, index, query, 12).collect(), R.bm25(docs, query, 12).collect()
    assert [(r.doc_id, r.score) for r in got] == [(r.doc_id, r.score) for r in want]
    if words := [w for p in R.phrases(query) for w in p]:
        plan = index.postings(spark, words)._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [bucket" in plan or "PartitionFilters: [isnotnull(bucket" in plan


def test_index_of_no_documents(spark, docs, tmp_path):
    none = S.build(docs.limit(0), f"file://{tmp_path}/i")
    assert none.stats(spark).first().N == 0 and S.bm25(spark, none, "alpha", 5).count() == 0


def test_route(spark, docs, index):
    rng = np.random.default_rng(0)
    vectors = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(30)], "vec_id long, embedding array<double>")
    names = spark.createDataFrame([(1, "red ring"), (2, "gamma"), (3, "delta"), (4, None)], "id long, name string")
    near = spark.createDataFrame([(1, 3, 5), (2, 1, 4), (1, 1, 0), (4, 1, 1), (1, 2, 9)], "entity_a long, entity_b long, position long")
    themes = spark.createDataFrame([(7, "Gamma rays"), (8, "  "), (9, "none of it")], "community_id long, summary string")
    assert S.classify("the red ring?", names, "id", "name") == ("entity", 1) and S.classify("List red ring", names, "id", "name") == ("thematic", None) and S.classify("zzz", names, "id", "name") == ("general", None)
    assert S.graph_seed("red ring", 1, near, names, "id", "name") == "red ring gamma delta"
    asked = []

    def go(query, **more):
        return S.route(spark, index, vectors, docs, query, [0.0] * 4, 5, names, near, themes, **more).collect()

    assert {r.provenance for r in go("red ring")} == {"graph_seeded"} and len(go("red ring")) == 5
    assert {r.provenance for r in go("alpha", rewrite=lambda q: asked.append(q) or "beta")} == {None} and not asked
    assert len(go("what gamma")) == 5
    nearest = {str(r.vec_id) for r in R.knn(vectors, [0.0] * 4, 5).collect()}
    for lonely in ("gamma zzz", "zzz"):  # an entity without neighbours, no entity
        rows = S.route(spark, index, vectors, docs, lonely, [0.0] * 4, 5, names, near.limit(0), themes, only_seeded=True).collect()
        assert {r.doc_id for r in rows} == nearest and {r.provenance for r in rows} == {"graph_seeded"}
    hits = spark.createDataFrame([("1", 0.5, None, 0), ("2", 0.4, None, 1)], "doc_id string, score double, provenance string, place int")
    rows = S.community_augment(hits, themes, "what gamma of it", 9).collect()
    assert [(r.doc_id, r.provenance) for r in rows] == [("1", None), ("2", None), ("community:7", "community_summary")]
    assert S.community_augment(hits, themes, "none gamma", 3).count() == 3


def test_scores_between_two_places_are_rounded_as_in_sql(spark):
    scores = [0.7625, 0.9685] + [round(61 / (61 + r), 6) for r in range(20)]
    got = spark.createDataFrame([(s, k) for s in scores for k in range(4)], "s double, k int").select("s", "k", S.mixed(F.col("s"), F.col("k"), 3).alias("x")).collect()
    duck = duckdb.connect()
    assert all(r.x == duck.execute("select round(0.7 * ?::double + 0.3 * len(range(?)) / 3, 4)", [r.s, r.k]).fetchone()[0] for r in got)


def test_nearest_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(200, 8)).round(2)
    v[50:60] = v[10]
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(999, None)], "vec_id long, embedding array<float>").repartition(4)
    want = {}
    for q in range(0, 200, 20):
        away = np.sqrt(((v.astype(np.float32).astype(float) - v[q].astype(np.float32).astype(float)) ** 2).sum(axis=1)).round(6)
        want[q] = sorted(zip(away.tolist(), range(200), strict=True))[:7]
    for size in (16 << 20, 200):
        monkeypatch.setattr(R, "QUERY_BYTES", size)
        got = R.knn_batch(rows, rows.where("vec_id % 20 = 0 and vec_id < 200"), 7).collect()
        for q, best in want.items():
            mine = sorted((r.rank, r.distance, r.vec_id) for r in got if r.query_id == q)
            assert [i for _, _, i in mine] == [i for _, i in best] and np.allclose([d for _, d, _ in mine], [d for d, _ in best], atol=2e-6)
    assert R.knn_batch(rows, rows.limit(0), 3).count() == 0


def test_distances_are_held_in_tiles(spark, monkeypatch):
    """What a task holds doesn't grow with the number of queries: at most TILE distances, whatever the batch."""
    v = np.random.default_rng(4).normal(size=(60, 4))
    ids = pa.array(range(60), pa.int64())
    batch = pa.RecordBatch.from_arrays([ids, pa.array(v.tolist())], names=["vec_id", "embedding"])
    sizes, root = [], np.sqrt
    monkeypatch.setattr(R.np, "sqrt", lambda x: sizes.append(x.size) or root(x))
    monkeypatch.setattr(R, "TILE", 300)
    sent = type("Sent", (), {"value": (list(range(60)), v)})
    out = pa.Table.from_batches(list(R._nearest(sent, 3, "vec_id")([batch]))).to_pylist()
    assert max(sizes) <= 300 and len(out) == 180 and all(r["query_id"] == r["vec_id"] for r in out if r["distance"] < 1e-6)


def test_vector_clusters_by_pairs_of_blocks(spark, monkeypatch):
    """However small the blocks that are asked for, there are no more than MOST_BLOCKS of them; one group of copies, and a chain."""
    rng = np.random.default_rng(6)
    v = rng.normal(size=(300, 6))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    v[100:160] = v[7]
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(999, None)], "vec_id long, embedding array<double>").repartition(5)
    near, name = v @ v.T >= 0.9, list(range(300))
    for _ in range(300):
        name = [min(name[j] for j in np.flatnonzero(near[i])) for i in range(300)]
    want = {i: c for i, c in enumerate(name) if near[i].sum() > 1}
    monkeypatch.setattr(E, "MOST_BLOCKS", 4)
    asked = []
    monkeypatch.setattr(E, "_alike", lambda least, f=E._alike: asked.append(least) or f(least))
    got = E.vector_clusters(rows, 0.9, 10, block_bytes=64).collect()
    assert {r.vec_id: r.cluster for r in got} == want and asked == [0.9]
    for c in set(want.values()):
        assert [r.slice for r in sorted(r for r in got if r.cluster == c)] == [k // 10 for k in range(sum(x == c for x in want.values()))]
    assert E.vector_clusters(rows.limit(0)).count() == 0


def test_running_sums(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["a", "b", None]) if i % 3 else "hot", rng.randrange(1000), i, rng.randrange(9)) for i in range(500)]
    got = U.running(spark.createDataFrame(rows, "g string, o long, i long, s long").repartition(5), ["g"], [F.desc("o"), F.asc("i")], F.col("s"), "used").collect()
    sums = {}
    want = {}
    for g, o, i, s in sorted(rows, key=lambda r: (-r[1], r[2])):
        sums[g] = want[i] = sums.get(g, 0) + s
    assert {r.i: r.used for r in got} == want and len(got) == 500


def test_a_long_document_takes_time_by_its_length(spark, tmp_path):
    """Copying all words for each term took the square: 60,000 different words some minutes."""
    import time

    words = [f"w{i:x}" for i in range(60_000)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, "w1 x w1"), (3, None)], "doc_id long, text string")
    began = time.monotonic()
    index = S.build(docs, f"file://{tmp_path}/i")
    assert time.monotonic() - began < 30
    held = index.postings(spark, ["w1", "wea5f"]).orderBy("term", "doc_id").collect()
    assert [(r.term, r.doc_id, r.dl, r["at"]) for r in held] == [("w1", 1, 60_000, [1]), ("w1", 2, 3, [0, 2]), ("wea5f", 1, 60_000, [59_999])]
    assert tuple(index.stats(spark).first()) == (3, 60_003 / 3)


def test_words_are_cut_once_for_the_postings(spark, monkeypatch):
    """A filter on what inline unfolds was pushed below the sorting of the words, which it repeated for each word."""
    seen = []
    monkeypatch.setattr(S, "write_sorted", lambda posted, *a: seen.append(posted))
    S.write_postings(spark.createDataFrame([(1, "b a b"), (2, ""), (3, None), (4, "c")], "id long, text string"), "unused")
    assert seen[0]._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1
    assert sorted(map(tuple, seen[0].collect())) == [(1, 3, "a", [1]), (1, 3, "b", [0, 2]), (4, 1, "c", [0])]
