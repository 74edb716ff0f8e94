"""The bitemporal graph: weights, as-of views, hops, components, communities, entities and merges.

Iterative operators cut their lineage with written tables in the session's shared folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlake.functions import text as X
from memlake.shared import stored as written


def edge_weights(relations: DataFrame) -> DataFrame:
    """(a, b, weight): strengths summed over unordered pairs."""
    pair = relations.groupBy(F.least("entity_a", "entity_b").alias("a"), F.greatest("entity_a", "entity_b").alias("b"))
    return pair.agg(F.sum("strength").alias("weight"), F.count("*").alias("n"))


def as_of(relations: DataFrame, day: str) -> DataFrame:
    """Edges valid on a day: begun (or of unknown begin) and not ended."""
    d = F.lit(day).cast("date")
    return relations.where((F.col("valid_from").isNull() | (F.col("valid_from") <= d)) & (F.col("valid_to").isNull() | (F.col("valid_to") > d)))


def hops(edges: DataFrame, seeds: DataFrame, k: int) -> DataFrame:
    """(node, depth): nodes within k undirected hops of the seeds (one column). Each hop writes the nodes that are new."""
    both = written(edges.select(F.col("a").alias("x"), F.col("b").alias("y")).union(edges.select("b", "a")), "edges")
    rim = seen = written(seeds.toDF("node").distinct().withColumn("depth", F.lit(0)), "hops")
    for d in range(1, k + 1):
        found = both.join(rim.select(F.col("node").alias("x")), "x").select(F.col("y").alias("node")).distinct().join(seen, "node", "left_anti")
        rim = written(found.withColumn("depth", F.lit(d)), "hops")
        seen = seen.union(rim)
    return seen


#: Nodes with a new label that are sent to all tasks; more are joined by a shuffle.
SENT_NODES = 500_000


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable.

    In each round every node takes the smallest of its neighbours and itself, chains are followed to their ends, and edges are
    set to what their ends have become: loops and repetitions go, so that later rounds have few edges. Edges may be repeated.
    """
    rest = written(edges.select("a", "b").where("a is not null and b is not null"), "edges")
    now = None
    while True:
        ends = rest.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("near")), F.struct(F.col("b").alias("node"), F.col("a").alias("near")))).alias("e")).select("e.*")
        least = written(ends.groupBy("node").agg(F.least(F.col("node"), F.min("near")).alias("component")), "components")
        if now is None:
            now = least
        moved = least.where("node <> component")
        n = moved.count()
        if not n:
            return now
        sent = F.broadcast if n <= SENT_NODES else lambda rows: rows
        moved = _followed(moved, sent)
        step = lambda rows, c: rows.join(sent(moved.toDF(c, "__to")), c, "left").withColumn(c, F.coalesce("__to", c)).drop("__to")  # noqa: E731, B023
        now = written(step(now, "component").select("node", "component"), "components")
        # once one end is set, what is repeated goes before the other is
        half = step(rest, "a").where("a <> b")
        half = half if n <= SENT_NODES else half.distinct()
        rest = written(step(half, "b").where("a <> b").select("a", "b").distinct(), "edges")


def _followed(moved: DataFrame, sent) -> DataFrame:
    """(node, component) with components that moved themselves followed to the end, by pointer doubling."""
    while True:
        far = moved.join(sent(moved.toDF("component", "__far")), "component", "left")
        done = written(far.select("node", F.coalesce("__far", "component").alias("component"), F.col("__far").isNotNull().alias("further")), "moved")
        moved = done.select("node", "component")
        if not done.where("further").head(1):
            return moved


def label_propagation(edges: DataFrame, rounds: int = 5) -> DataFrame:
    """(node, community): each round takes the label of the largest weight among neighbours and itself, ties to the smallest; odd and even nodes by turns. It stops after `rounds`, settled or not."""
    both = written(edges.select(F.col("a").alias("x"), F.col("b").alias("y"), "weight").union(edges.select("b", "a", "weight")).where("x is not null and y is not null"), "edges")
    now = written(both.select(F.col("x").alias("node")).distinct().withColumn("community", F.col("node")), "communities")
    for turn in range(rounds):
        # only those whose turn it is are voted for
        asked = both.where(F.pmod(F.xxhash64("x"), F.lit(2)) == turn % 2)
        votes = asked.join(now.toDF("y", "l"), "y").groupBy("x", "l").agg(F.sum("weight").alias("w"))
        best = votes.groupBy(F.col("x").alias("node")).agg(F.min_by("l", F.struct(-F.col("w"), "l")).alias("l"))
        now = written(now.join(best, "node", "left").select("node", F.coalesce("l", "community").alias("community")), "communities")
    return now


def text_clusters(texts: DataFrame, least: float = 0.12, size: int = 3) -> DataFrame:
    """(id, cluster) of the texts (id, text) in single-link clusters of at least `size`: two link where the Jaccard of their words of four letters and more is `least`.

    Equal sets are one first. Similar sets share a word of their prefixes, in the order of how many sets have a word; the cluster is its smallest id.
    """
    words = F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"(?<![\p{L}\p{N}_])[a-z]{4,}(?![\p{L}\p{N}_])"), F.lit(0))))
    rows = written(texts.select("id", words.alias("w")).where(F.size("w") > 0), "words")
    sets = written(rows.groupBy("w").agg(F.min("id").alias("key")), "sets")
    prefix = written(rarest_words(sets, ["key"], "w", least, []), "prefixes")
    met = prefix.toDF("a", "word").join(prefix.toDF("b", "word"), "word").where("a < b").select("a", "b").distinct()
    of = lambda side, name: sets.select(F.col("key").alias(side), F.col("w").alias(name))
    edges = met.join(of("a", "x"), "a").join(of("b", "y"), "b").where(X.jaccard(F.col("x"), F.col("y")) >= least).select("a", "b")
    linked = components(edges).toDF("key", "component")
    members = rows.join(sets, "w").select("id", "key").join(linked, "key", "left").select("id", F.coalesce("component", "key").alias("cluster"))
    large = members.groupBy("cluster").agg(F.count("*").alias("members")).where(F.col("members") >= size).select("cluster")
    return written(members.join(large, "cluster").select("id", "cluster"), "clusters")


def extend_communities(edges: DataFrame, known: DataFrame) -> DataFrame:
    """(node, community) of nodes not yet in known: that of the heaviest known neighbour."""
    both = edges.select(F.col("a").alias("node"), F.col("b").alias("y"), "weight").union(edges.select("b", "a", "weight"))
    fresh = both.join(known.select("node"), "node", "left_anti").join(known.toDF("y", "community"), "y")
    return fresh.groupBy("node").agg(F.min_by("community", F.struct(-F.col("weight"), "community")).alias("community"))


def rarest_words(sets: DataFrame, key: list[str], words: str, least: float, within: list[str]) -> DataFrame:
    """(key.., word) of the rarest words of each set, as many as any two sets of Jaccard `least` share one of at least; how rare a word is counts `within` some columns."""
    held = sets.select(*key, *[c for c in within if c not in key], F.size(words).alias("__n"), F.explode(words).alias("word"))
    counted = held.join(held.groupBy(*within, "word").agg(F.count("*").alias("__times")), [*within, "word"])
    rank = F.row_number().over(Window.partitionBy(*key).orderBy("__times", "word"))
    return counted.withColumn("__rank", rank).where(F.col("__rank") <= F.col("__n") - F.ceil(least * F.col("__n") - 1e-9) + 1).select(*key, *[c for c in within if c not in key], "word")


def candidate_pairs(names: DataFrame, least: float = 0.3) -> DataFrame:
    """Pairs (a, b, similarity) of one kind that share a word. Names of equal words are one first, by their smallest id,
    so that a frequent name is no large block (what equal names have in common is in survivors()); then pairs meet by
    the rarer of their words only."""
    words = F.array_distinct(F.filter(X.tokens(F.col("name")), lambda w: F.char_length(w) > 1))
    rows = names.select("id", "kind", words.alias("w")).where(F.size("w") > 0)
    sets = written(rows.groupBy("kind", F.array_sort("w").alias("w")).agg(F.min("id").alias("id")), "names")
    rare = written(rarest_words(sets, ["id"], "w", least, ["kind"]), "rare")
    met = rare.select("kind", "word", F.col("id").alias("a")).join(rare.select("kind", "word", F.col("id").alias("b")), ["kind", "word"]).where("a < b").select("a", "b").distinct()
    of = lambda side, name: sets.select(F.col("id").alias(side), F.col("w").alias(name))
    pairs = met.join(of("a", "wa"), "a").join(of("b", "wb"), "b")
    return pairs.select("a", "b", F.round(X.jaccard(F.col("wa"), F.col("wb")), 6).alias("similarity")).where(F.col("similarity") >= least)


def survivors(entities: DataFrame, keys: list[Column], rank: Column) -> DataFrame:
    """(loser, winner): of entities equal in all keys the one of the largest rank survives."""
    best = entities.groupBy(*[k.alias(f"k{i}") for i, k in enumerate(keys)]).agg(F.max_by("id", rank).alias("winner"), F.count("*").alias("n")).where("n > 1")
    keyed = entities.select("id", *[k.alias(f"k{i}") for i, k in enumerate(keys)])
    return keyed.join(best, [f"k{i}" for i in range(len(keys))]).where("id <> winner").select(F.col("id").alias("loser"), "winner")


def repoint(edges: DataFrame, merges: DataFrame) -> DataFrame:
    """Edges with losers replaced by winners; self loops go, equal edges become one with the smallest id."""
    for side in ("a", "b"):
        edges = edges.join(merges.select(F.col("loser").alias(side), F.col("winner").alias("__w")), side, "left").withColumn(side, F.coalesce("__w", side)).drop("__w")
    return edges.where("a <> b").groupBy("a", "relation", "b").agg(F.min("id").alias("id"))


def scd2(facts: DataFrame, entity: str, value: str, since: str, id_col: str) -> DataFrame:
    """Versions of a single-valued attribute: runs of equal values, each valid until the next begins."""
    w = Window.partitionBy(entity).orderBy(since, id_col)
    changed = facts.withColumn("__new", F.coalesce(F.lag(value).over(w) != F.col(value), F.lit(True)))
    starts = changed.where("__new")
    return starts.select(entity, value, F.col(since).alias("valid_from"), F.lead(since).over(w).alias("valid_to"), F.lead(since).over(w).isNull().alias("is_current"), F.lead(id_col).over(w).alias("superseded_by"))


def decayed(edges: DataFrame, day: str, stale_days: int = 365, weak: float = 1.0) -> DataFrame:
    """Weak edges not seen for long end today, at strength 0."""
    stale = (F.col("strength") > 0) & (F.col("strength") <= weak) & (F.col("last_seen") < F.date_add(F.lit(day).cast("date"), -stale_days))
    return edges.withColumns({"valid_to": F.when(stale, F.coalesce("valid_to", F.lit(day).cast("date"))).otherwise(F.col("valid_to")), "reason": F.when(stale, "decayed"), "strength": F.when(stale, 0.0).otherwise(F.col("strength"))})


def chain_ends(merges: DataFrame, limit: int = 32) -> DataFrame:
    """(loser, winner) with winners that were merged themselves followed to the end, by pointer doubling."""
    now = written(merges.select("loser", "winner"), "merges")
    for _ in range(limit):
        step = now.join(now.toDF("winner", "__next"), "winner", "left")
        done = written(step.select("loser", F.coalesce("__next", "winner").alias("winner"), F.col("__next").isNotNull().alias("moved")), "merges")
        now = done.select("loser", "winner")
        if not done.where("moved").head(1):
            break
    return now
