"""Reproducible draws, and claims that leave a store only past every guard."""

import pytest
from pyspark.sql import functions as F

from memlake.operators import contributions as C
from memlake.operators import entities as E
from memlake.operators import memory as M


def test_thompson_draws_are_reproducible_and_beta(spark):
    arms = spark.createDataFrame([("a", 1.0, 1.0), ("b", 30.0, 10.0), ("c", 2.0, 200.0), ("d", None, 3.0)], "arm string, alpha double, beta double")
    once = {tuple(r) for r in M.thompson(arms, "arm", 5, 400).collect()}
    assert once == {tuple(r) for r in M.thompson(arms.repartition(7), "arm", 5, 400).collect()} and len(once) == 1600
    assert once != {tuple(r) for r in M.thompson(arms, "arm", 6, 400).collect()}
    for arm, a, b in (("a", 1, 1), ("b", 30, 10), ("c", 2, 200)):
        draws = [d for _, x, d, _ in once if x == arm]
        mean, var = sum(draws) / 400, a * b / ((a + b) ** 2 * (a + b + 1))
        assert abs(mean - a / (a + b)) < 4 * (var / 400) ** 0.5
        assert 0.7 * var < sum((d - mean) ** 2 for d in draws) / 400 < 1.4 * var and all(0 < d < 1 for d in draws)
    assert sum(chosen for *_, chosen in once) == 400 and M.thompson(arms, "arm", 5, 0).count() == 0


RELATION = "a string, relation string, b string, doc_id string, valid_from date, confidence double, origin string"
ENTITY = "id string, name string, kind string, email string, aliases string, origin string"
GOOD = ("p", "works at", "o", "d1", None, 0.7, None)


def claims(spark, relations, entities=None, documents=None, allowed=("works at",), secret="s"):
    people = [("p", "Ann Lee from Looms", "person", "ann@x.org", "A. Lee|ann@x.org", None), ("o", "Engines (UK)", "org", None, None, "local")]
    docs = [("d1", False), ("d2", True), ("d3", None), ("d4", False), ("d4", True)]
    return C.contributions(spark.createDataFrame(relations, RELATION), spark.createDataFrame(people if entities is None else entities, ENTITY), spark.createDataFrame(docs if documents is None else documents, "doc_id string, cold boolean"), allowed, secret).collect()


def test_claims_are_redacted(spark):
    got = claims(spark, [GOOD, GOOD])
    assert {(r.kind, r.subject, r.relation, r.object, r.name, r.aliases, r.confidence) for r in got} == {("entity", "p", None, None, "Ann Lee", "A. Lee", 1.0), ("entity", "o", None, None, "Engines", "", 1.0), ("relation", "p", "works at", "o", None, None, 0.7)}
    assert len(got) == 3 and all("d1" not in str(r) and "ann@" not in str(r) for r in got) and len({r.source_ref for r in got}) == 1


@pytest.mark.parametrize("row", [
    ("p", "works at", "o", "d1", None, 0.7, "shared"), ("p", "knows", "o", "d1", None, 0.7, None), ("p", None, "o", "d1", None, 0.7, None), ("p", "works at", "o", "", None, 0.7, None),
    ("p", "works at", "o", None, None, 0.7, None), ("p", "works at", "o", "d2", None, 0.7, None), ("p", "works at", "o", "d3", None, 0.7, None), ("p", "works at", "o", "d4", None, 0.7, None), ("p", "works at", "o", "d9", None, 0.7, None), ("p", "works at", "x", "d1", None, 0.7, None),
])
def test_a_relation_that_fails_a_guard_never_leaves(spark, row):
    assert claims(spark, [row]) == []


@pytest.mark.parametrize("entity", [
    ("p", "Ann Lee", "person", "ann@x.org", None, "shared"), ("p", "Ann Lee", "topic", None, None, None), ("p", "Ann Lee", None, None, None, None), ("p", "Ann Lee", "person", "info@x.org", None, None),
    ("p", "ann 77", "person", None, None, None), ("p", None, "person", None, None, None),
])
def test_an_entity_that_fails_a_guard_takes_its_relations_along(spark, entity):
    assert claims(spark, [GOOD], [entity, ("o", "Engines", "org", None, None, None)]) == []


def test_nothing_leaves_without_secret_list_or_a_single_entity(spark):
    assert claims(spark, [GOOD], secret="") == [] and claims(spark, [GOOD], allowed=()) == []
    assert claims(spark, [GOOD], [("p", "Ann Lee", "person", None, None, None)] * 2 + [("o", "Engines", "org", None, None, None)]) == []


def test_claims_are_not_moved_any_more(spark):
    """Relations are dealt by document, a row each; what is made of them, three rows each, stays there and is told once."""
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        people = [("p", "Ann Lee", "person", None, None, None), ("o", "Engines", "org", None, None, None)]
        relations = [GOOD, GOOD, ("o", "works at", "p", "d1", None, 0.7, None), ("p", "works at", "o", "d5", None, 0.7, None)]
        documents = spark.createDataFrame([("d1", False), ("d5", False)], "doc_id string, cold boolean")
        got = C.contributions(spark.createDataFrame(relations, RELATION), spark.createDataFrame(people, ENTITY), documents, ["works at"], "s")
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" in plan and "Exchange" not in plan[: plan.index("Generate")]
        assert sorted((r.kind, r.subject) for r in got.collect()) == [("entity", "o")] * 2 + [("entity", "p")] * 2 + [("relation", "o")] + [("relation", "p")] * 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


def test_first_shown_streams_by(spark):
    rows = [("s", "d", 0), ("s", "d", 23), ("s", "d", 24), ("s", "d", 47), ("s", "d", 49), ("s", "e", 1), ("t", "d", 1), (None, "d", 5), (None, "d", 6)]
    df = spark.createDataFrame(rows, "session string, doc_id string, h int").select("session", "doc_id", F.timestamp_seconds(F.col("h") * 3600).alias("ts"))
    got = {(r.session, r.doc_id, int(r.ts.timestamp()) // 3600): r.shown for r in E.first_shown(df.union(df.limit(0))).collect()}
    assert {k for k, shown in got.items() if shown} == {("s", "d", 0), ("s", "d", 24), ("s", "d", 49), ("s", "e", 1), ("t", "d", 1), (None, "d", 5)} and len(got) == 9
    outbox = spark.createDataFrame([(1, "b"), (1, "a"), (2, "c")], "id int, kind string")
    assert {tuple(r) for r in E.to_publish(outbox, outbox.where("id = 2")).collect()} == {(1, "a")}
