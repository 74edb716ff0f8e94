"""Edge cases of the operators: nulls, empty tables, ties."""

import random
from collections import Counter
from datetime import date

import pytest
from pyspark.sql import functions as F

from memlake.functions import text as X
from memlake.operators import actions, chunking, graph, hygiene, memory, retrieval
from memlake.plans import graph as graph_queries


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first().asDict()


def test_texts(spark):
    got = one(
        spark,
        a=X.has_content(F.lit("漢")), b=X.has_content(F.lit(" .!")), c=X.has_content(F.lit(None).cast("string")),
        d=X.slug(F.lit("Chané & Co. (ACC)")), e=X.canonical_name(F.lit("Dr.  Ann Lee")), f=X.canonical_name(F.lit("Pastor")),
        g=X.fingerprint(F.lit("the of")), h=X.normalised_title(F.lit("To send: the Report, you!")), i=X.is_role_mailbox(F.lit("Office+a@x.org")), j=X.is_role_mailbox(F.lit("jo@x.org")),
        k=X.doc_root(F.lit("gdrive-a-b-12")), l=X.is_junk_name(F.lit("Re: x"), F.lit("org")), m=X.is_junk_name(F.lit("Ann 2020"), F.lit("person")), n=X.is_junk_name(F.lit(""), F.lit("topic")),
        o=X.jaccard(X.tokens(F.lit("a b")), X.tokens(F.lit("B c"))), p=X.strip_html(F.lit("<p>a<b>b</b></p><script>x</script><br>c")),
        q=X.context_prefix(F.lit("gmail"), F.lit("Ann"), F.lit("2024-01-02T03"), F.lit("")), r=X.context_prefix(F.lit("?"), F.lit("Ann"), F.lit(""), F.lit("")),
    )
    assert (got["a"], got["b"], got["c"]) == (True, False, False)
    assert (got["d"], got["e"], got["f"], got["g"], got["h"]) == ("chane-co-acc", "Ann Lee", "Pastor", "", "send report")
    assert (got["i"], got["j"], got["k"], got["l"], got["m"], got["n"]) == (True, False, "gdrive-a-b", True, True, False)
    assert abs(got["o"] - 1 / 3) < 1e-9 and got["p"] == "ab\nc" and got["q"] == "[Context: Email from Ann, on 2024-01-02] " and got["r"] == ""


def test_chunks_hold_every_word_and_fit():
    rng = random.Random(2)
    for _ in range(50):
        text = "\n\n".join(" ".join("w" * rng.randrange(1, 30) + str(rng.randrange(99)) for _ in range(rng.randrange(0, 200))) for _ in range(rng.randrange(0, 8)))
        parts = chunking.split_text(text, 300, 5)
        assert all(0 < len(p) <= 300 for p in parts) and set(" ".join(parts).split()) == set(text.split())
    assert chunking.split_text(None) == [] and chunking.split_text(" .. \n\n !") == []
    assert [len(p) for p in chunking.split_text("x" * 4000)] == [1800, 1800, 400]


def test_chunk_table(spark):
    docs = spark.createDataFrame([(1, "a\n\nb"), (2, None), (3, "x" * 2000)], "doc_id long, text string")
    got = chunking.chunk_documents(docs).orderBy("doc_id", "chunk_index").collect()
    assert [(r.doc_id, r.chunk_index, r.chunk_total, len(r.text)) for r in got] == [(1, 0, 1, 4), (3, 0, 2, 1800), (3, 1, 2, 200)]


def test_packing(spark):
    items = spark.createDataFrame([("a", i, s) for i, s in enumerate([5, 5, 1, 20, 3, 7])], "g string, o long, s long")
    got = {r.o: r.unit for r in chunking.pack_by_size(items, "g", "o", "s", 10).collect()}
    assert [got[i] for i in range(6)] == [0, 0, 1, 2, 3, 3]


def test_search_on_odd_input(spark):
    docs = spark.createDataFrame([(1, "VERIFY CAP 001 done"), (2, "cap verify 001"), (3, None), (4, "")], "doc_id long, text string")
    assert [r.doc_id for r in retrieval.bm25(docs, "VERIFY-CAP-001", 5).collect()] == [1]
    assert retrieval.bm25(docs, "?!", 5).count() == 0 and retrieval.bm25(docs.limit(0), "cap", 5).count() == 0
    assert {r.doc_id for r in retrieval.bm25(docs, "done cap", 5).collect()} == {1}
    assert {r.doc_id for r in retrieval.bm25(docs, "nothing cap", 5).collect()} == {1, 2}
    vectors = spark.createDataFrame([(1, [0.0, 1.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0])], "vec_id long, embedding array<float>")
    assert [r.vec_id for r in retrieval.knn(vectors, [0.0, 1.0], 2).collect()] == [1, 3]


def test_memory_bounds(spark):
    got = one(spark, a=memory.retention(F.lit(0.0), F.lit(5.0)), b=memory.retention(F.lit(3.0), F.lit(-1.0)), c=memory.next_tier(F.lit("core"), F.lit(9.0), F.lit(1.0)), d=memory.half_life_weight(F.lit(90.0)))
    assert abs(got["a"] - 0.36787944) < 1e-6 and got["b"] == 1.0 and got["c"] == "core" and abs(got["d"] - 0.5) < 1e-9


def test_graph_iterations(spark):
    chain = spark.createDataFrame([(f"n{i:03d}", f"n{i + 1:03d}") for i in range(40)] + [("x", "y")], "a string, b string")
    assert {r.component for r in graph.components(chain).collect()} == {"n000", "x"}
    depth = {r.node: r.depth for r in graph.hops(chain, spark.createDataFrame([("n005",)], "n string"), 2).collect()}
    assert depth == {"n003": 2, "n004": 1, "n005": 0, "n006": 1, "n007": 2}
    merges = spark.createDataFrame([(i, i - 1) for i in range(2, 30)], "loser long, winner long")
    assert {r.winner for r in graph.chain_ends(merges).collect()} == {1}
    assert graph.components(chain.limit(0)).count() == 0


@pytest.mark.parametrize("sent", [0, 500_000])
def test_components_of_repeated_edges_in_few_rounds(spark, monkeypatch, sent):
    rng = random.Random(sent)
    pairs = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] * 2 + [(7, 7), (200, 200), (None, 3), (3, None)]
    label = {v: v for a, b in pairs for v in (a, b) if None not in (a, b)}
    for _ in label:
        for a, b in pairs:
            if a in label and b in label:
                label[a] = label[b] = min(label[a], label[b])
    kept = []
    monkeypatch.setattr(graph, "SENT_NODES", sent)
    monkeypatch.setattr(graph, "written", lambda df, name, write=graph.written: (kept.append((name, out := write(df, name))), out)[1])
    assert {r.node: r.component for r in graph.components(spark.createDataFrame(pairs, "a long, b long")).collect()} == label
    sizes = [df.count() for name, df in kept if name == "edges"]
    assert sizes[0] == 122 and sizes[1] < 60 and sizes[-1] == 0


def test_interval_join_meets_over_cells(spark):
    rows = spark.createDataFrame([(1, i, f"2024-01-{d:02d}", "same words here") for i, d in enumerate([1, 8, 9, 16, 30])], "o long, i long, d string, t string").withColumn("d", F.to_date("d"))
    got = {(r.a, r.b) for r in actions.near_duplicates(rows, "o", "i", "d", "t").collect()}
    assert got == {(0, 1), (1, 2), (2, 3)}


def test_findings(spark):
    old = spark.createDataFrame([(1, None), (2, None), (3, "kept")], "ref_id long, verdict string")
    got = {r.ref_id: r.state for r in hygiene.record_findings(old, spark.createDataFrame([(1,), (4,), (4,)], "ref_id long")).collect()}
    assert got == {1: "open", 2: "resolved", 3: "closed", 4: "new"}


def test_communities_are_of_all_edges(spark, tmp_path):
    """Light edges count too: every node of the relations has a community."""
    rows = [(k, k, date(1998, 1, 1), 1.0, "N") for k in range(1, 6)] + [(1, 9, date(1998, 1, 1), 200.0, "N"), (2, 1, date(1998, 1, 1), 2.0, "N")]
    spark.createDataFrame(rows, "l_suppkey long, l_partkey long, l_shipdate date, l_quantity double, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {r.node: r.community for r in graph_queries.community_label_prop(spark, str(tmp_path)).collect()}
    assert set(got) == {f"s{r[0]}" for r in rows} | {f"p{r[1]}" for r in rows}
    assert all(got[f"s{k}"] in {f"s{k}", f"p{k}"} for k in (3, 4, 5))


def test_text_clusters_against_brute_force(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(f"{'abcdefghijkl'[i % 12]}{rng.choice(['word', 'term', 'note', 'line'])}{rng.choice('xyz')}" for _ in range(rng.randrange(2, 9))) + " the of éwordé") for i in range(150)]
    rows += [(200, None), (201, "a b"), (202, "Solo text"), (203, "solo, text!"), (204, "lone pair"), (205, "lone pair"), (206, "lone pair")]
    sets = {i: {w for w in "".join(c if c.isalpha() else " " for c in (t or "").lower()).split() if len(w) > 3 and w.isascii()} for i, t in rows}
    label = {i: i for i, _ in rows}
    for i in label:
        for j in label:
            if j < i and sets[i] and sets[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.3 and label[i] != label[j]:
                new, old = sorted((label[i], label[j]))
                label = {k: new if v == old else v for k, v in label.items()}
    want = {(i, v) for i, v in label.items() if sets[i] and sum(x == v for x in label.values()) > 2}
    got = graph.text_clusters(spark.createDataFrame(rows, "id long, text string"), least=0.3).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want) and {(204, 204), (206, 204)} <= want and len({v for _, v in want}) > 2


def test_near_duplicates_are_paired_once(spark):
    """Equal words within an owner are one set first; pairs are made by the last of two joins, and neither told apart nor joined again."""
    rows = [(k, k % 2, date(2024, 1, 1 + k % 20), ["send the report", "Report the send!", "call"][k % 3]) for k in range(60)]
    near = actions.near_duplicates(spark.createDataFrame(rows, "i long, o long, d date, t string"), "o", "i", "d", "t")
    plan = near._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 2 and "Aggregate" not in plan
    kind = lambda k: k % 3 == 2
    want = [(a[0], b[0], 1.0) for a in rows for b in rows if a[0] < b[0] and a[1] == b[1] and kind(a[0]) == kind(b[0]) and abs((a[2] - b[2]).days) <= 7]
    assert sorted(map(tuple, near.collect())) == sorted(want)


def test_tasks_of_pairs_grow_in_number_with_the_rows(spark, monkeypatch):
    from memlake.operators import lifecycle

    rng = random.Random(3)
    rows = [(rng.randrange(12), rng.randrange(60)) for _ in range(400)]
    rows += rows[:50] + [(None, 1), (1, None)]
    groups = {}
    for s, o in rows:
        if s is not None and o is not None:
            groups.setdefault(o, set()).add(s)
    want = Counter((a, b) for g in groups.values() for a in g for b in g if a < b)
    monkeypatch.setattr(lifecycle, "TASK_ROWS", 50)
    found = lifecycle.met_together(spark.createDataFrame(rows, "s long, o long"), 8)
    assert {(r.a, r.b): r.together for r in found.collect()} == {k: n for k, n in want.items() if n >= 8}
    assert found.rdd.getNumPartitions() == 4 * 10
