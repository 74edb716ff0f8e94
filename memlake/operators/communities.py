"""Communities by modularity: local moves of nodes, then of whole communities, level by level.

Modularity of a partition: the share of weight inside communities less resolution times the share that
their degrees would have by chance. A round moves nodes to the neighbouring community of the largest gain, half
of the nodes at a time (by a hash of node and round), as neighbours that move at once may undo each other. A
level ends when rounds no longer gain; the best state of all rounds is kept, and its communities are the nodes
of the next level, with edges added up and what is inside as loops. The first level starts from label
propagation or from single nodes, whichever has the larger modularity: so the result is never below either.

A round shuffles the edges once by the end that votes, unless the nodes are few enough to be broadcast, and
once, combined, by node; a hub's rows are split by adaptive execution. Nothing but sums comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlake.operators.graph import components, label_propagation
from memlake.shared import stored

ROUNDS, LEVELS = 8, 6
#: A level goes on while two rounds together gain this much, the next level begins if the last one gained it.
LEAST_GAIN = 1e-4
#: What is known of each node is broadcast up to this number of nodes (some 100 bytes each); beyond it it is joined by a shuffle.
MAX_BROADCAST_NODES = 500_000


def largest_component(edges: DataFrame) -> DataFrame:
    """The edges (a, b, ..) of the component with the most nodes; of equal ones that with the smallest node."""
    edges = stored(edges, "edges")
    found = stored(components(edges), "components")
    first = found.groupBy("component").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "component").limit(1)
    inside = found.join(F.broadcast(first.select("component")), "component", "left_semi").select(F.col("node").alias("a"))
    return edges.join(inside, "a", "left_semi")


def _level(edges: DataFrame) -> tuple[DataFrame, DataFrame, float, bool]:
    """(x, y, w) both ways without loops; (node, k, own) with each node's degree and its loop; twice the weight; whether the nodes are few enough for a broadcast."""
    ends = edges.select(F.col("a").alias("x"), F.col("b").alias("y"), F.col("weight").cast("double").alias("w"))
    both = ends.unionByName(ends.select(F.col("y").alias("x"), F.col("x").alias("y"), "w"))
    loop = F.when(F.col("x") == F.col("y"), F.col("w")).otherwise(0.0)
    nodes = stored(both.groupBy(F.col("x").alias("node")).agg(F.sum("w").alias("k"), (F.sum(loop) / 2).alias("own")), "nodes")
    links = stored(both.where("x <> y").groupBy("x", "y").agg(F.sum("w").alias("w")), "links")
    double, n = nodes.agg(F.coalesce(F.sum("k"), F.lit(0.0)), F.count("*")).first()
    return links, nodes, double, n <= MAX_BROADCAST_NODES


def modularity(edges: DataFrame, labels: DataFrame, resolution: float = 1.0) -> DataFrame:
    """(community, n_nodes, inside, degree, share): share is the community's part of the modularity, which is their sum.

    edges (a, b, weight), each pair in one row; labels (node, community), one row for a node. Nodes without label are left out.
    """
    links, nodes, double, _ = _level(edges)
    named = nodes.join(labels.select("node", "community"), "node")
    x, y = (labels.select(F.col("node").alias(e), F.col("community").alias(f"c{e}")) for e in ("x", "y"))
    same = links.join(x, "x").join(y, "y").where("cx = cy").groupBy(F.col("cx").alias("community")).agg((F.sum("w") / 2).alias("between"))
    sums = named.groupBy("community").agg(F.count("*").alias("n_nodes"), F.sum("own").alias("loops"), F.sum("k").alias("degree"))
    inside = F.coalesce("between", F.lit(0.0)) + F.col("loops")
    share = 2 * inside / F.lit(double) - resolution * (F.col("degree") / F.lit(double)) ** 2
    return sums.join(same, "community", "left").select("community", "n_nodes", inside.alias("inside"), "degree", share.alias("share"))


def _round(links: DataFrame, now: DataFrame, double: float, resolution: float, small: bool) -> DataFrame:
    """(node, k, own, community, same, target): the weight to the node's own community, and where it gains most. small: now may be broadcast."""
    sent = F.broadcast if small else lambda df: df
    totals = now.groupBy("community").agg(F.sum("k").alias("total"))
    votes = links.join(sent(now.select(F.col("node").alias("y"), "community")), "y").select(F.col("x").alias("node"), "community", "w")
    mine = now.select("node", "community", F.lit(0.0).alias("w"))
    options = votes.unionByName(mine).groupBy("node", "community").agg(F.sum("w").alias("w")).join(sent(totals), "community")
    at = now.select("node", "k", "own", F.col("community").alias("here"))
    stays = F.col("community") == F.col("here")
    gain = F.round(F.col("w") - resolution * F.col("k") * (F.col("total") - F.when(stays, F.col("k")).otherwise(0.0)) / double, 9)
    scored = options.join(sent(at), "node").withColumns({"gain": gain, "stays": stays})
    # of equal gains the own community, then the smallest label
    best = F.min_by("community", F.struct(-F.col("gain"), ~F.col("stays"), "community")).alias("target")
    kept = scored.groupBy("node").agg(F.first("k").alias("k"), F.first("own").alias("own"), F.first("here").alias("community"), F.sum(F.when(F.col("stays"), F.col("w")).otherwise(0.0)).alias("same"), best)
    return stored(kept, "round")


def _quality(state: DataFrame, double: float, resolution: float) -> tuple[float, int]:
    """The modularity of a round's communities, and how many nodes would gain elsewhere."""
    sums = state.groupBy("community").agg(F.sum("k").alias("k"), F.sum("same").alias("same"), F.sum("own").alias("own"), F.count_if(F.col("target") != F.col("community")).alias("open"))
    row = sums.agg(F.sum(F.col("same") / 2 + F.col("own")), F.sum((F.col("k") / F.lit(double)) ** 2), F.sum("open")).first()
    return 2 * row[0] / double - resolution * row[1], row[2]


def _moved(links: DataFrame, state: DataFrame, double: float, resolution: float, small: bool) -> tuple[DataFrame, float]:
    """(node, community) after local moves from a round's state, and their modularity."""
    best, kept, since = float("-inf"), None, 0.0
    for turn in range(ROUNDS + 1):
        quality, open_nodes = _quality(state, double, resolution)
        if quality > best:
            best, kept = quality, state
        if not open_nodes or turn == ROUNDS or turn % 2 == 0 and turn and best - since < LEAST_GAIN:
            break
        if turn % 2 == 0:
            since = best
        moves = F.pmod(F.xxhash64("node", F.lit(turn // 2)), F.lit(2)) == turn % 2
        now = state.select("node", "k", "own", F.when(moves, F.col("target")).otherwise(F.col("community")).alias("community"))
        state = _round(links, now, double, resolution, small)
    return kept.select("node", "community"), best


def communities(edges: DataFrame, resolution: float = 1.0) -> DataFrame:
    """(node, community) of edges (a, b, weight): a community has the name of its smallest node.

    Weights are positive; an edge given twice counts twice. Isolated nodes aren't in edges, hence in no community.
    """
    edges = stored(edges.select("a", "b", "weight").where("a is not null and b is not null and weight > 0"), "edges")
    links, nodes, double, small = _level(edges)
    if not double:
        return nodes.select("node", F.col("node").alias("community"))
    spread = label_propagation(edges).join(nodes, "node").select("node", "k", "own", "community")
    single = nodes.select("node", "k", "own", F.col("node").alias("community"))
    start = max((_round(links, s, double, resolution, small) for s in (spread, single)), key=lambda s: _quality(s, double, resolution)[0])
    labels, before = None, float("-inf")
    for _ in range(LEVELS):
        found, quality = _moved(links, start, double, resolution, small)
        found = stored(found, "found")
        labels = found if labels is None else stored(labels.join(found.toDF("community", "above"), "community").select("node", F.col("above").alias("community")), "labels")
        if quality - before < LEAST_GAIN:
            break
        before = quality
        named = found.withColumnRenamed("community", "c")
        pairs = links.join(named.toDF("x", "a"), "x").join(named.toDF("y", "b"), "y").where("x < y")
        loops = nodes.join(named, "node").where("own > 0").select(F.col("c").alias("a"), F.col("c").alias("b"), F.col("own").alias("w"))
        whole = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "w").unionByName(loops)
        links, nodes, double, small = _level(whole.groupBy("a", "b").agg(F.sum("w").alias("weight")))
        single = nodes.select("node", "k", "own", F.col("node").alias("community"))
        start = _round(links, single, double, resolution, small)
    names = labels.groupBy("community").agg(F.min("node").alias("name"))
    return labels.join(names, "community").select("node", F.col("name").alias("community"))
