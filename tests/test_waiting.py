"""Waits and what ends them: whole tables, and a stream with a restart in between, against brute force."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from memlake.operators import waiting as W

SCHEMA = "id long, person string, name string, ts timestamp"
DAY0 = datetime(2024, 1, 1)


def rows(seed):
    rng = random.Random(seed)
    people = [("p1", "Ann  Lee"), ("p2", "ann lee!"), ("p3", "Bo"), (None, "Bo"), ("p4", None), (None, "  "), ("hot", "Hot One")]
    pick = lambda: people[6] if rng.random() < 0.34 else rng.choice(people)
    waits = [(i, *pick(), DAY0 + timedelta(minutes=rng.randrange(0, 60 * 24 * 60, 30))) for i in range(60)]
    messages = [(1000 + i, *pick(), DAY0 + timedelta(minutes=rng.randrange(0, 60 * 24 * 90, 30))) for i in range(90)]
    return waits + [(None, "p1", "x", DAY0), (900, "p1", "x", None)], messages + messages[:5] + [(None, "p1", "x", DAY0)]


def plain(waits, messages, days):
    norm = lambda n: " ".join("".join(c for c in (n or "").lower() if c.isalnum() or c in "_ ").split())
    out = {}
    for i, person, name, since in waits:
        if i is None or since is None:
            continue
        hits = [(ts, m) for m, p, n, ts in messages if m is not None and ((p and p == person) or (norm(n) and norm(n) == norm(name))) and since < ts <= since + timedelta(days=days)]
        if hits:
            out[i] = min(hits)[::-1]
    return out


@pytest.mark.parametrize(("seed", "days"), [(1, 30), (2, 1)])
def test_replies(spark, seed, days):
    waits, messages = rows(seed)
    got = W.replies(spark.createDataFrame(waits, SCHEMA).repartition(3), spark.createDataFrame(messages, SCHEMA).repartition(3), days).collect()
    assert {r.id: (r.cleared_by, r.cleared_at) for r in got} == plain(waits, messages, days) and len(got) == len({r.id for r in got})


def test_stream_equals_batch_across_a_restart(spark, tmp_path):
    """Files come in the order of time but for some days; the second run goes on from the first one's state."""
    waits, messages = rows(3)
    whole = plain(waits, messages, 30)
    late = random.Random(4)
    told = [("waits", *r) for r in waits] + [("messages", *r) for r in messages]
    told.sort(key=lambda r: (r[4] or DAY0) + timedelta(days=late.random() * 2))
    for name in ("waits", "messages"):
        (tmp_path / name).mkdir()
    streams = [spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{n}") for n in ("waits", "messages")]
    found, parts = {}, 4
    for k in range(parts):
        for name in ("waits", "messages"):
            some = [r[1:] for r in told[k * len(told) // parts : (k + 1) * len(told) // parts] if r[0] == name]
            spark.createDataFrame(some, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}")
        if k % 2:  # two stops of the stream, each after two files a table
            got = W.run_waiting(W.clear_waiting(*streams, late="4 days"), f"file://{tmp_path}/run").collect()
            found = {r.id: (r.cleared_by, r.cleared_at) for r in got}
            assert k == parts - 1 or 0 < len(found) < len(whole)
    assert found == whole


def test_state_is_a_row_for_a_bucket_and_a_wait_may_have_two_times(spark, tmp_path):
    rng = random.Random(5)
    pick = lambda: rng.choice([("p%d" % rng.randrange(40), None), (None, "name %s" % rng.choice("abcdefgh"))])
    waits = [(i % 50, *pick(), DAY0 + timedelta(minutes=rng.randrange(60 * 24 * 20))) for i in range(100)]
    waits += [(60, "p1", None, DAY0 + timedelta(days=2)), (60, "p1", None, DAY0), (61, "p9x", None, DAY0)]
    messages = [(1000 + i, *pick(), DAY0 + timedelta(minutes=rng.randrange(60 * 24 * 40))) for i in range(200)] + [(999, "p1", None, DAY0 + timedelta(minutes=1)), (998, "p9x", None, DAY0), (997, "p9x", None, DAY0 + timedelta(days=30))]
    for name, rows in (("waits", waits), ("messages", messages)):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/{name}")
    streams = [spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/{n}") for n in ("waits", "messages")]
    cleared = W.clear_waiting(*streams, buckets=3)
    found = {r.id: (r.cleared_by, r.cleared_at) for r in W.run_waiting(cleared, f"file://{tmp_path}/run").collect()}
    assert found == {r.id: (r.cleared_by, r.cleared_at) for r in W.replies(*[spark.createDataFrame(r, SCHEMA) for r in (waits, messages)]).collect()}
    assert found[60][0] == 999 and found[61][0] == 997
    state = spark.read.format("statestore").load(f"file://{tmp_path}/run/checkpoint")
    assert 0 < state.count() <= 3
