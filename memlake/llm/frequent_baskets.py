"""Closed frequent itemsets of baskets, and their rules.

Items stand in the order of falling support (ties: by id). Items are hashed to GROUPS groups; a basket gives each
group that it has items of its prefix up to the last of them, and equal prefixes are counted together before
they are shuffled. Each group is a shard: it builds a frequent-pattern tree of its prefixes and mines the
itemsets whose last item is one of its own, with a tree of the closed itemsets found so far, which says
whether a set is subsumed. A shard whose prefixes exceed SPLIT_ROWS is split by its items, then by pairs, and
so on, each with what stands before it, so that no tree is larger.

What a shard takes for closed may be part of a set that another shard has, as often: both then have the
same baskets. Each set carries the exclusive-or of its baskets' hashes, so sets of equal support and equal
baskets meet by (support, signature), and of them only the largest stays.

Nothing that grows with the input goes through one task, to the driver or into a broadcast: baskets are hashed,
items' supports come to the rows by a salted shuffle join, the driver learns only how many baskets there are.
A basket holds its frequent items in one row: with a least share of the baskets there are at most 1 / share
times the mean basket's items of them.

Rules: taking one item out of a set asks for the support of the rest, which is that of the largest support
among its group's sets that contain it; they are found in the group's tree of closed itemsets.

Defined results: rows without basket or item are left out; repeated rows count once; baskets without
frequent items count as baskets. An empty table has no itemsets. Other columns are not carried.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlake.llm import common as C

#: Shards of items.
GROUPS = 1024
#: Distinct prefixes of one shard beyond which it is split.
SPLIT_ROWS = 500_000
#: Parts of the rows of one item in the join that brings its support.
SALTS = 32

MINED = "group long, items array<bigint>, supports array<bigint>, support long, signature long"


class PatternTree:
    """Prefixes as paths from the root; each node has the baskets that pass it, as a count and a signature."""

    def __init__(self, paths: Iterable[tuple[Sequence[int], int, int]]):
        self.above, self.code, self.count, self.signature = [-1], [-1], [0], [0]
        self.nodes: dict[int, list[int]] = defaultdict(list)
        below: dict[tuple[int, int], int] = {}
        for path, n, signature in paths:
            at = 0
            for code in path:
                node = below.get((at, code))
                if node is None:
                    node = below[at, code] = len(self.code)
                    self.above.append(at)
                    self.code.append(code)
                    self.count.append(0)
                    self.signature.append(0)
                    self.nodes[code].append(node)
                self.count[node] += n
                self.signature[node] ^= signature
                at = node

    def before(self, code: int) -> list[tuple[list[int], int, int]]:
        """What stands before the item: a path for each of its nodes, from the root."""
        found = []
        for node in self.nodes[code]:
            path, at = [], self.above[node]
            while at:
                path.append(self.code[at])
                at = self.above[at]
            found.append((path[::-1], self.count[node], self.signature[node]))
        return found


class ClosedTree:
    """Closed itemsets as paths in the items' order; each node knows the largest support of the sets through it."""

    def __init__(self):
        self.above, self.code, self.support = [-1], [-1], [0]
        self.below: dict[tuple[int, int], int] = {}
        self.at: dict[tuple[int, int], list[int]] = defaultdict(list)
        self.levels: dict[int, set[int]] = defaultdict(set)

    def add(self, items: Sequence[int], support: int) -> None:
        at = 0
        for code in items:
            node = self.below.get((at, code))
            if node is None:
                node = self.below[at, code] = len(self.code)
                self.above.append(at)
                self.code.append(code)
                self.support.append(0)
            if support > self.support[node]:
                self.support[node] = support
                self.at[code, support].append(node)
                self.levels[code].add(support)
            at = node

    def _has(self, node: int, items: Sequence[int]) -> bool:
        """Whether the path to the node, whose item is the last of items, has them all."""
        k, at = len(items) - 2, self.above[node]
        while k >= 0 and at:
            if self.code[at] == items[k]:
                k -= 1
            elif self.code[at] < items[k]:
                return False
            at = self.above[at]
        return k < 0

    def subsumes(self, items: Sequence[int], support: int) -> bool:
        """Whether a set with these items and this support is there. No set with them has more."""
        return any(self.support[v] == support and self._has(v, items) for v in self.at.get((items[-1], support), ()))

    def largest(self, items: Sequence[int]) -> int:
        """The largest support of a set with these items; 0 if there is none."""
        last = items[-1]
        return next((s for s in sorted(self.levels.get(last, ()), reverse=True) if self.subsumes(items, s)), 0)


def mine(paths: Iterable[tuple[Sequence[int], int, int]], least: int, own: set[int] | None, suffix: Sequence[int] = ()) -> list[tuple[list[int], int, int]]:
    """Closed sets (items in order, support, signature) of the paths' items; own: items that may be last (None: any). suffix: what follows every path."""
    found, closed = [], ClosedTree()

    def steps(tree: PatternTree, last: set[int] | None):
        return iter(sorted((c for c in tree.nodes if last is None or c in last), reverse=True))

    tree = PatternTree(paths)
    stack = [(tree, list(suffix), steps(tree, own))]
    while stack:
        tree, after, rest = stack[-1]
        code = next(rest, None)
        if code is None:
            stack.pop()
            continue
        n = sum(tree.count[v] for v in tree.nodes[code])
        if n < least:
            continue
        before, signature, often = tree.before(code), 0, Counter()
        for path, count, sign in before:
            signature ^= sign
            for c in path:
                often[c] += count
        always = sorted(c for c, k in often.items() if k == n)
        # in order: what stands before the item, the item, what follows
        items = sorted([*always, code, *after])
        if closed.subsumes(items, n):
            continue
        closed.add(items, n)
        found.append((items, n, signature))
        some = {c for c, k in often.items() if least <= k < n}
        if some:
            inner = PatternTree(([c for c in path if c in some], count, sign) for path, count, sign in before)
            stack.append((inner, items, steps(inner, None)))
    return found


def _group(item: Column) -> Column:
    return F.pmod(F.xxhash64(item), F.lit(GROUPS))


def _projected(baskets: DataFrame) -> DataFrame:
    """(group, suffix, prefix, n, signature): each basket's prefix up to the last item of each group that it has."""
    groups = F.transform("items", lambda x: _group(x["item"]))
    named = baskets.select("items", F.xxhash64("basket").alias("hash"), groups.alias("groups"))
    each = named.select("items", "hash", F.reverse("groups").alias("back"), F.explode(F.array_distinct("groups")).alias("group"))
    # array_position takes a literal or an expression, from 1
    last = F.size("items") - F.expr("array_position(back, group)") + 1
    cut = each.select("group", F.slice("items", F.lit(1), last.cast("int")).alias("prefix"), "hash")
    none = F.expr("slice(prefix, 1, 0)")
    return cut.groupBy("group", "prefix").agg(F.count("*").alias("n"), F.bit_xor("hash").alias("signature")).withColumn("suffix", none)


def _deeper(rows: DataFrame, heavy: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """Heavy shards split by the item before their suffix: (the new shards' rows, the sets that they stand for)."""
    split = rows.join(heavy.hint("merge"), ["group", "suffix"], "left_semi")
    own = F.size("suffix") > 0
    each = split.select("group", "suffix", "prefix", "n", "signature", F.posexplode("prefix").alias("at", "item")).where(own | (_group(F.col("item.item")) == F.col("group")))
    shorter = each.select("group", F.concat(F.array("item"), F.col("suffix")).alias("suffix"), F.expr("slice(prefix, 1, at)").alias("prefix"), "n", "signature")
    # a new shard's first level has its items only once each, so that all of its baskets are in its rows
    shorter = shorter.groupBy("group", "suffix", "prefix").agg(F.sum("n").alias("n"), F.bit_xor("signature").alias("signature"))
    shorter = C.stored(shorter, "deeper")
    totals = shorter.groupBy("group", "suffix").agg(F.sum("n").alias("support"), F.bit_xor("signature").alias("whole")).where(F.col("support") >= least)
    totals = C.stored(totals, "suffixes")
    sets = totals.select("group", F.col("suffix.item").alias("items"), F.transform("suffix", lambda x: -x["less"]).alias("supports"), "support", F.col("whole").alias("signature"))
    kept = shorter.join(totals.select("group", "suffix").hint("merge"), ["group", "suffix"], "left_semi")
    return kept.where(F.size("prefix") > 0), sets


def _mined(rows: DataFrame, least: int) -> DataFrame:
    """The sets that each shard takes for closed."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        prefix = table.column("prefix").chunk(0)
        flat = prefix.flatten()
        less, item = flat.field("less").to_pylist(), flat.field("item").to_pylist()
        suffix = [(x["less"], x["item"]) for x in table.column("suffix")[0].as_py()]
        keys = [*zip(less, item, strict=True)]
        order = sorted({*keys, *suffix})
        code = {k: n for n, k in enumerate(order)}
        codes = [code[k] for k in keys]
        ends = prefix.offsets.to_pylist()
        # a slice's offsets begin where the slice does
        paths = ((codes[a - ends[0] : b - ends[0]], n, s) for a, b, n, s in zip(ends, ends[1:], table.column("n").to_pylist(), table.column("signature").to_pylist(), strict=False))
        group = table.column("group")[0].as_py()
        own = None if suffix else {code[k] for k, g in zip(keys, table.column("mine").chunk(0).flatten().to_pylist(), strict=True) if g}
        found = mine(paths, least, own, [code[k] for k in suffix])
        kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.int64()]
        out = [(group, [order[c][1] for c in items], [-order[c][0] for c in items], n, s) for items, n, s in found]
        cols = zip(*out, strict=True) if out else [[]] * 5
        return pa.table([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["group", "items", "supports", "support", "signature"])

    fed = rows.withColumn("mine", F.transform("prefix", lambda x: _group(x["item"]) == F.col("group")))
    return fed.groupBy("group", "suffix").applyInArrow(run, MINED)


def itemsets(rows: DataFrame, least: int = 8, share: int = 5000) -> tuple[DataFrame, int]:
    """(group, items, supports, support, signature) of every set that some shard takes for closed, and the number of baskets.

    rows (basket, item). A set is frequent with a support of least or more, and of share-th part of all baskets or more.
    """
    C.small_batches(rows.sparkSession)
    pairs = C.stored(rows.toDF("basket", "item").where("basket is not null and item is not null").distinct(), "pairs")
    n_baskets = pairs.select("basket").distinct().count()
    least = max(least, -(-n_baskets // share))
    often = pairs.groupBy("item").agg(F.count("*").alias("support")).where(F.col("support") >= least)
    salted = often.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = pairs.withColumn("salt", F.pmod(F.xxhash64("basket"), F.lit(SALTS)).cast("int"))
    known = dealt.join(salted.hint("shuffle_hash"), ["item", "salt"])
    baskets = known.groupBy("basket").agg(F.sort_array(F.collect_list(F.struct((-F.col("support")).alias("less"), "item"))).alias("items"))
    level = C.stored(_projected(baskets), "prefixes")
    found = []
    while True:
        shards = level.groupBy("group", "suffix").agg(F.count("*").alias("n"))
        heavy = C.stored(shards.where(F.col("n") > SPLIT_ROWS).select("group", "suffix"), "heavy")
        some = bool(heavy.head(1))
        light = level.join(heavy.hint("merge"), ["group", "suffix"], "left_anti") if some else level
        found.append(C.stored(_mined(light, least), "mined"))
        if not some:
            break
        level, sets = _deeper(level, heavy, least)
        level = C.stored(level, "prefixes")
        found.append(sets)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out, n_baskets


def closed(mined: DataFrame) -> DataFrame:
    """Of sets that are in the same baskets the largest: (items, supports, support, n_items)."""
    sized = mined.withColumn("n_items", F.size("items"))
    best = sized.groupBy("support", "signature").agg(F.max(F.struct("n_items", "items", "supports")).alias("best"))
    return best.select("best.items", "best.supports", "support", F.col("best.n_items").cast("long").alias("n_items"))


def supports_of(rests: DataFrame, mined: DataFrame) -> DataFrame:
    """(items, n): the support of each of rests (group, items in order, supports), a frequent set of its last item's group."""

    def run(key: tuple, asked: pa.Table, sets: pa.Table) -> pa.Table:
        names = lambda t: [[*zip((-s for s in sup), items, strict=True)] for items, sup in zip(t.column("items").to_pylist(), t.column("supports").to_pylist(), strict=True)]
        have, want = (names(sets), names(asked)) if asked.num_rows else ([], [])
        code = {k: n for n, k in enumerate(sorted({k for x in (*have, *want) for k in x}))}
        tree = ClosedTree()
        for items, n in zip(have, sets.column("support").to_pylist(), strict=False):
            tree.add([code[k] for k in items], n)
        found = [tree.largest([code[k] for k in items]) for items in want]
        return pa.table([asked.column("items").combine_chunks(), pa.array(found, pa.int64())], names=["items", "n"])

    asked, sets = rests.select("group", "items", "supports"), mined.select("group", "items", "supports", "support")
    return asked.groupBy("group").cogroup(sets.groupBy("group")).applyInArrow(run, "items array<bigint>, n long")


def rules(sets: DataFrame, mined: DataFrame, n_baskets: int, least_percent: int = 10) -> DataFrame:
    """(items, item, without, own): item follows from the rest of items; without: the rest's support, own: the item's.

    A rule holds if 100 * support >= least_percent * without, and support * n_baskets > without * own.
    """
    several = sets.where("n_items >= 2")
    each = several.select("items", "supports", "support", F.posexplode("items").alias("at", "item"))
    drop = lambda name: F.filter(name, lambda _, k: k != F.col("at"))
    each = each.select("items", "support", "item", F.get("supports", F.col("at")).alias("own"), drop("items").alias("rest"), drop("supports").alias("rests"))
    pairs = each.where("size(items) = 2").withColumn("without", F.get("rests", F.lit(0)))
    longer = C.stored(each.where("size(items) > 2"), "rests")
    asked = longer.select(_group(F.element_at("rest", -1)).alias("group"), F.col("rest").alias("items"), F.col("rests").alias("supports")).distinct()
    known = supports_of(asked, mined).select(F.col("items").alias("rest"), F.col("n").alias("without"))
    both = pairs.unionByName(longer.join(known.hint("merge"), "rest"))
    holds = (100 * F.col("support") >= least_percent * F.col("without")) & (F.col("support") * F.lit(n_baskets).cast("long") > F.col("without") * F.col("own"))
    return both.where(holds).select("items", "item", "without", "own")
