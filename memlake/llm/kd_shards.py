"""Sharding by a k-d tree over metadata, in DataFrame operations only.

A node of the tree that is to give k leaves is cut along its widest dimension (its range over the whole
table's range), where the bytes to the left are floor(k / 2) / k of its own. The cut is an exact
weighted quantile of (value, tie hash): bytes are added up in a bounded number of equal ranges, then
within the range where the sum crosses, until one row is left in it. So a hot value is split by the tie
hash, and shards differ by about one document. The number of leaves follows from the target bytes.

Law `bytes`: the shards' sizes are nearly equal. Equal texts are not kept together: a group of copies may
hold more bytes than a shard.

Defined results: a null text has no bytes (size 1) and CRC 0; null metadata sort first. Texts are ranked
by the seven bytes after what all values of the dimension begin with. Rows equal in id and text are told
apart by where they stand in the input. With fewer rows than leaves, shards stay empty. An empty
table gives an empty result. Columns other than id, text and the dimensions are not carried.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.llm import common as C

#: Sums that one pass sends to the driver, over all nodes.
MAX_SUMS = 1 << 15
#: Rows of one bucket in which slots are numbered.
SLOT_ROWS = 20_000
_TIES = 1 << 62


def text_rank(column: Column, skip: int = 0) -> Column:
    """Seven bytes, after the first `skip`, as a number in the order of the strings; null: -1."""
    seven = F.substring(F.encode(column, "UTF-8"), skip + 1, 7)
    return F.coalesce(F.conv(F.rpad(F.hex(seven), 14, "0"), 16, 10).cast("long"), F.lit(-1).cast("long"))


def _common_bytes(docs: DataFrame, names: tuple[str, ...]) -> list[int]:
    """How many bytes all values of each column begin with."""
    if not names:
        return []
    ends = docs.agg(*[f(F.encode(F.col(n), "UTF-8")) for n in names for f in (F.min, F.max)]).first()
    pairs = [(bytes(ends[2 * k] or b""), bytes(ends[2 * k + 1] or b"")) for k in range(len(names))]
    return [next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b))) if a != b else 0 for a, b in pairs]


def _values(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table, read by the JVM from one literal."""
    names = [part.split()[0] for part in schema.split(", ")]
    text = json.dumps([dict(zip(names, r, strict=True)) for r in rows])
    fields = ", ".join(f"{n}: {kind}" for n, kind in (part.split() for part in schema.split(", ")))
    return spark.range(1).select(F.inline(F.from_json(F.lit(text), f"array<struct<{fields}>>")))


def number_rank(column: Column) -> Column:
    limit = F.lit(1 << 60)
    return F.coalesce(F.greatest(-limit, F.least(limit, column.cast("long"))), -limit)


@dataclass
class _Search:
    """The range [low, low + steps * step) in which a node's cut is sought, and the bytes before it."""

    node: int
    leaves: int
    dim: int
    goal: float
    low: int
    high: int
    before: float = 0
    on_tie: bool = False
    value: int = 0

    def step(self, sums: int) -> int:
        return max(1, -(-(self.high - self.low + 1) // sums))


def kd_shards(docs: DataFrame, target_bytes: int | None = None, leaves: int | None = None, text_col: str = "text", id_col: str = "doc_id", number_dims: tuple[str, ...] = (), text_dims: tuple[str, ...] = ()) -> DataFrame:
    """(id, size, text_crc32, law, shard, slot). Give target_bytes or the number of leaves."""
    spark = docs.sparkSession
    size = F.coalesce(F.octet_length(text_col).cast("long"), F.lit(0).cast("long")) + 1
    dims = [number_rank(F.col(id_col)), number_rank(size), *[number_rank(F.col(n)) for n in number_dims], *[text_rank(F.col(n), skip) for n, skip in zip(text_dims, _common_bytes(docs, text_dims), strict=True)]]
    rows = docs.select(F.col(id_col).alias("id"), size.alias("size"), F.coalesce(F.crc32(F.encode(text_col, "UTF-8")), F.lit(0).cast("long")).alias("crc"), *[d.alias(f"d{k}") for k, d in enumerate(dims)])
    # 40 bits of the row's values, then 22 of its place, which tell equal rows apart; written once, so that they stay
    tie = F.shiftleft(F.shiftrightunsigned(F.xxhash64("id", "crc", "size"), 24), 22) + F.shiftrightunsigned(F.xxhash64(F.monotonically_increasing_id()), 42)
    rows = rows.withColumns({"tie": tie, "node": F.lit(1).cast("long")})
    rows = C.stored(rows, "shards")
    names = [f"d{k}" for k in range(len(dims))]
    stats = _stats(rows, names)
    n_rows = sum(s["n"] for s in stats.values())
    total = sum(s["bytes"] for s in stats.values())
    if leaves is None:
        if not target_bytes:
            raise ValueError("give target_bytes or leaves")
        leaves = max(1, -(-total // target_bytes))
    root = {d: max(1, s[f"{d}_max"] - s[f"{d}_min"]) for s in stats.values() for d in names}
    plan, first_leaf = {1: leaves}, {1: 0}  # of each node: leaves, and the number of its first
    while any(k > 1 for k in plan.values()) and stats:
        searches = []
        for node, k in plan.items():
            if k > 1 and node in stats:
                s = stats[node]
                dim = max(range(len(names)), key=lambda d: ((s[f"d{d}_max"] - s[f"d{d}_min"]) / root[f"d{d}"], -d))
                searches.append(_Search(node, k, dim, s["bytes"] * (k // 2) / k, s[f"d{dim}_min"], s[f"d{dim}_max"]))
        cuts = _cuts(rows, searches, names)
        children = {n: (2 * n, 2 * n + 1) for n, k in plan.items() if k > 1}
        table = _values(spark, [(s.node, s.dim, v, t) for s, (v, t) in zip(searches, cuts, strict=True)] or [(0, 0, 0, 0)], "node long, dim int, value long, cut long")
        at = _pick(names, F.col("dim"))
        right = (at > F.col("value")) | ((at == F.col("value")) & (F.col("tie") > F.col("cut")))
        moved = rows.join(F.broadcast(table), "node", "left").withColumn("node", F.when(F.col("dim").isNull(), F.col("node")).otherwise(F.col("node") * 2 + right.cast("long")))
        rows = C.stored(moved.drop("dim", "value", "cut"), "shards")
        for n, (a, b) in children.items():
            k, f = plan.pop(n), first_leaf.pop(n)
            plan[a], plan[b], first_leaf[a], first_leaf[b] = k // 2, k - k // 2, f, f + k // 2
        stats = _stats(rows, names)
    shard = _values(spark, [(n, f) for n, f in first_leaf.items()], "node long, shard int")
    rows = rows.join(F.broadcast(shard), "node")
    numbered = _numbered(rows, max(1, -(-n_rows // (SLOT_ROWS * leaves))))
    return numbered.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot")


def _pick(names: list[str], dim: Column) -> Column:
    out = F.lit(None).cast("long")
    for k, n in enumerate(names):
        out = F.when(dim == k, F.col(n)).otherwise(out)
    return out


def _stats(rows: DataFrame, names: list[str]) -> dict[int, dict]:
    """Of each node: rows, bytes, and the least and largest value of each dimension."""
    bounds = [f(n).alias(f"{n}_{k}") for n in names for k, f in (("min", F.min), ("max", F.max))]
    return {r["node"]: r.asDict() for r in rows.groupBy("node").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), *bounds).collect()}


def _cuts(rows: DataFrame, searches: list[_Search], names: list[str]) -> list[tuple[int, int]]:
    """Of each search the cut (value, tie): rows up to it, itself included, go left."""
    spark, done = rows.sparkSession, {}
    live = list(searches)
    sums = max(8, MAX_SUMS // max(1, len(searches)))
    while live:
        state = _values(spark, [(s.node, s.dim, s.on_tie, s.value, s.low, s.high, s.step(sums)) for s in live], "node long, dim int, on_tie boolean, value long, low long, high long, step long")
        at = _pick(names, F.col("dim"))
        key = F.when(F.col("on_tie"), F.col("tie")).otherwise(at)
        inside = (key >= F.col("low")) & (key <= F.col("high")) & (~F.col("on_tie") | (at == F.col("value")))
        cell = F.expr("(key - low) div step")
        got = rows.join(F.broadcast(state), "node").withColumn("key", key).where(inside).withColumn("cell", cell).groupBy("node", "cell").agg(F.sum("size").alias("w"), F.count("*").alias("n"))
        cells: dict[int, list] = {}
        for r in got.collect():
            cells.setdefault(r["node"], []).append((r["cell"], r["w"], r["n"]))
        still = []
        for s in live:
            step, before = s.step(sums), s.before
            found = sorted(cells[s.node])
            for cell, w, n in found:
                if before + w >= s.goal or cell == found[-1][0]:
                    break
                before += w
            low = s.low + cell * step
            high = min(s.high, low + step - 1)
            if s.on_tie and (n == 1 or step == 1):
                whole = abs(before + w - s.goal) <= abs(before - s.goal)
                done[s.node] = s.value, high if whole else low - 1
                continue
            s.low, s.high, s.before = low, high, before
            if not s.on_tie and step == 1:
                s.on_tie, s.value, s.low, s.high = True, low, 0, _TIES - 1
            still.append(s)
        live = still
    return [done[s.node] for s in searches]


def _numbered(rows: DataFrame, buckets: int) -> DataFrame:
    """slot: 0, 1, ... in each shard, numbered within hash buckets that are laid end to end."""
    from pyspark.sql import Window

    rows = rows.withColumn("bucket", F.pmod("tie", F.lit(buckets)))
    counts = rows.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    ends = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(ends), F.lit(0)).alias("first"))
    inside = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("tie", "id"))
    return rows.join(starts, ["shard", "bucket"]).withColumn("slot", F.col("first") + inside - 1)
