"""Who is waited for, and the first message that ends the wait: by person or by name, within a window.

A wait and a message meet by either of two keys, the person's id and the normalised name; each row stands once
under each key that it has, so that "or" is an equality join, and a wait is ended by the smaller of what its keys
find. replies() answers over whole tables; clear_waiting() keeps waits as keyed state of a stream, and gives the
same result over the same rows, restarted or not, as long as no row is later than the watermark allows.

Defined results: a message counts if it comes after the wait began and at most window_days later; of those of one
time the smallest id. Rows without id or time are passed over, rows without person and name match nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

WINDOW_DAYS = 30
_DAY = 86_400_000_000


def normal_name(name: Column) -> Column:
    """Lower case, without marks, single spaces."""
    bare = F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), r"[^\p{L}\p{N}_\s]", "")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def keyed(rows: DataFrame, kind: str) -> DataFrame:
    """(key, kind, id, ts): rows (id, person, name, ts) under each of their keys."""
    person = F.when(F.col("person").isNotNull(), F.concat(F.lit("p:"), F.col("person").cast("string")))
    name = F.when(normal_name(F.col("name")) != "", F.concat(F.lit("n:"), normal_name(F.col("name"))))
    known = rows.where("id is not null and ts is not null")
    return known.select(F.explode(F.array_compact(F.array(person, name))).alias("key"), F.lit(kind).alias("kind"), F.col("id").cast("long").alias("id"), F.col("ts").cast("timestamp").alias("ts"))


def replies(waits: DataFrame, messages: DataFrame, window_days: int = WINDOW_DAYS) -> DataFrame:
    """(id, cleared_by, cleared_at) of the waits that a message ends.

    Messages of a key are their first one an hour before they are ordered, so that a person's rows are one an
    hour, however many they write; within the hour of the wait itself an equality join of key and hour looks closer.
    """
    hour = F.date_trunc("hour", "ts")
    first = F.min(F.struct("ts", "id")).alias("first")
    asked = keyed(waits, "wait").withColumn("hour", hour)
    said = keyed(messages, "message").withColumn("hour", hour)
    hours = said.groupBy("key", "hour").agg(first)
    both = hours.unionByName(asked.groupBy("key", "hour").agg(F.lit(None).cast("struct<ts:timestamp,id:long>").alias("first")))
    slots = both.groupBy("key", "hour").agg(F.min("first").alias("first"))
    later = Window.partitionBy("key").orderBy("hour").rowsBetween(1, Window.unboundedFollowing)
    after = slots.select("key", "hour", F.first("first", ignorenulls=True).over(later).alias("found"))
    next_hours = asked.join(after, ["key", "hour"]).select("id", F.col("ts").alias("since"), "found")
    # of one hour and key the waits are few different times: each looks for the first message after it
    times = asked.select("key", "hour", F.col("ts").alias("since")).distinct()
    near = times.join(said.select("key", "hour", "ts", "id").distinct(), ["key", "hour"]).where(F.col("ts") > F.col("since")).groupBy("key", "hour", "since").agg(first)
    same_hour = asked.withColumnRenamed("ts", "since").join(near, ["key", "hour", "since"]).select("id", "since", F.col("first").alias("found"))
    best = next_hours.unionByName(same_hour).where("found is not null").groupBy("id").agg(F.min(F.struct("found.ts", "found.id", "since")).alias("best"))
    within = F.unix_micros("best.ts") - F.unix_micros("best.since") <= window_days * _DAY
    return best.where(within).select("id", F.col("best.id").alias("cleared_by"), F.col("best.ts").alias("cleared_at"))


_STATE = "keys array<string>, waits binary, said binary"
#: Groups of keys that have one state each: a key of its own would cost a call of Python and a row of state.
BUCKETS = 1024


def clear_waiting(waits: DataFrame, messages: DataFrame, window_days: int = WINDOW_DAYS, late: str = "3 days", buckets: int = BUCKETS) -> DataFrame:
    """A stream of (id, cleared_by, cleared_at_us): the best message for a wait so far; the smallest time of an id counts.

    Of each key the state holds the waits whose window the watermark has not passed, with what ended them, and messages that are newer
    than the watermark, for waits that arrive after them; a timer lets go of waits that nobody answered. Keys are dealt to
    buckets by their hash, and a bucket's keys are looked at together; a stream that goes on keeps its number of buckets.
    """
    span = window_days * _DAY

    def first_after(waits: np.ndarray, said: np.ndarray) -> np.ndarray:
        """For each wait (key, id, since, ..) the place in said (key, at, id), sorted, of the first message of its key after it; len(said): none."""
        n = len(said)
        key, at = np.concatenate([said[:, 0], waits[:, 0]]), np.concatenate([said[:, 1], waits[:, 2]])
        # messages of the wait's own time come before it
        order = np.lexsort((np.arange(len(key)), at, key))
        following = np.minimum.accumulate(np.where(order < n, order, n)[::-1])[::-1]
        place = np.empty(len(key), "int64")
        place[order] = following
        found = place[n:]
        same = np.zeros(len(found), bool)
        same[found < n] = said[found[found < n], 0] == waits[found < n, 0]
        return np.where(same, found, n)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        keys, held = [], [b"", b""]
        if state.exists:
            keys, *held = state.get
        wait, said = (np.frombuffer(bytes(x), "int64").reshape(-1, width) for x, width in zip(held, (5, 3), strict=True))
        better = np.zeros(0, bool)
        if not state.hasTimedOut:
            rows = pd.concat(list(frames))
            codes, keys = pd.factorize(np.concatenate([np.array(keys, object), rows["key"].to_numpy(object)]))
            n_held = len(codes) - len(rows)
            wait, said = wait.copy(), said.copy()
            for x in (wait, said):
                x[:, 0] = codes[:n_held][x[:, 0]]
            asked, ids = rows["asked"].to_numpy(bool), rows["id"].to_numpy("int64")
            new = np.stack([codes[n_held:], ids, rows["ts"].to_numpy().astype("datetime64[us]").astype("int64")], 1)
            none = np.full((int(asked.sum()), 2), -1)
            wait = pd.DataFrame(np.concatenate([wait, np.concatenate([new[asked], none], 1)])).drop_duplicates([0, 1, 2]).to_numpy()
            said = pd.DataFrame(np.concatenate([said, new[~asked][:, [0, 2, 1]]])).drop_duplicates().sort_values([0, 1, 2]).to_numpy()
            found = first_after(wait, said)
            at, by = np.append(said[:, 1], 0)[found], np.append(said[:, 2], 0)[found]
            in_time = (found < len(said)) & (at - wait[:, 2] <= span)
            better = in_time & ((wait[:, 3] < 0) | (at < wait[:, 3]) | ((at == wait[:, 3]) & (by < wait[:, 4])))
            wait[better, 3], wait[better, 4] = at[better], by[better]
            out = wait[better]
        passed = state.getCurrentWatermarkMs() * 1000
        wait, said = wait[wait[:, 2] + span >= passed], said[said[:, 1] >= passed]
        if len(wait) or len(said):
            used, back = np.unique(np.concatenate([wait[:, 0], said[:, 0]]), return_inverse=True)
            wait, said = wait.copy(), said.copy()
            wait[:, 0], said[:, 0] = back[: len(wait)], back[len(wait) :]
            state.update(([keys[i] for i in used.tolist()], wait.tobytes(), said.tobytes()))
            ends = min(x.min() for x in (wait[:, 2] + span, said[:, 1]) if len(x))
            state.setTimeoutTimestamp(int(max(ends, passed)) // 1000 + 1)
        elif state.exists:
            state.remove()
        if better.any():
            yield pd.DataFrame({"id": out[:, 1], "cleared_by": out[:, 4], "cleared_at_us": out[:, 3]})

    rows = keyed(waits, "wait").unionByName(keyed(messages, "message")).withWatermark("ts", late)
    dealt = rows.select(F.pmod(F.xxhash64("key"), F.lit(buckets)).alias("bucket"), "key", (F.col("kind") == "wait").alias("asked"), "id", "ts")
    return dealt.groupBy("bucket").applyInPandasWithState(step, "id long, cleared_by long, cleared_at_us long", _STATE, "append", GroupStateTimeout.EventTimeTimeout)


def run_waiting(stream: DataFrame, folder: str) -> DataFrame:
    """Run over what is available, on from where the checkpoint in the folder stands; all waits ended so far, as replies() gives them."""
    done = stream.writeStream.outputMode("append").format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    done.awaitTermination()
    if done.exception():
        raise done.exception()
    out = stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")
    best = out.groupBy("id").agg(F.min(F.struct("cleared_at_us", "cleared_by")).alias("best"))
    return best.select("id", F.col("best.cleared_by").alias("cleared_by"), F.timestamp_micros("best.cleared_at_us").alias("cleared_at"))
