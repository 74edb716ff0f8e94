"""Upkeep: lookups by cascade, reports, reflow, give-up, pruning, names of topics and folders."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlake.functions import text as X
from memlake.shared import stored


def find_entity(entities: DataFrame, wanted: str, id_col: str = "id", name_col: str = "name") -> DataFrame:
    """By id, else by slug, else by name in any case: the first way that finds something, then the smallest id."""
    how = F.when(F.col(id_col).cast("string") == wanted, 0).when(X.slug(F.col(name_col)) == X.slug(F.lit(wanted)), 1).when(F.lower(name_col) == wanted.lower(), 2)
    return entities.withColumn("how", how).where("how is not null").orderBy("how", id_col).limit(1)


def running(rows: DataFrame, group: Sequence[str], order: Sequence[Column], size: Column, name: str) -> DataFrame:
    """Add the running sum of size in each group, in order, without a task that holds a whole group.

    Rows are dealt out by ranges of the order and written; the sums of earlier ranges, one number a group
    and range, are added to those within a range.
    """
    held = rows.withColumn("__size", size).repartitionByRange(*[F.col(c) for c in group], *order)
    held = stored(held.withColumn("__range", F.spark_partition_id()), "ranges")
    sums = held.groupBy(*group, "__range").agg(F.sum("__size").alias("__sum"))
    before = Window.partitionBy(*group).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*group, "__range", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__start"))
    keys = [held[c].eqNullSafe(starts[c]) for c in (*group, "__range")]
    inside = F.sum("__size").over(Window.partitionBy(*[held[c] for c in (*group, "__range")]).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return held.join(starts, reduce(lambda a, b: a & b, keys)).select(*[held[c] for c in rows.columns], (F.col("__start") + inside).alias(name))


def in_order(ids: DataFrame, cold: DataFrame, key: str, position: str) -> DataFrame:
    """A list without the cold ones, positions closed up."""
    left = ids.join(cold.select(key), key, "left_anti")
    counted = running(left, [], [F.col(position)], F.lit(1), "__n")
    return counted.withColumn(position, F.col("__n") - 1).drop("__n")


def detail(rows: DataFrame, group: Sequence[str], label: Column) -> DataFrame:
    """Counts by label within each group, as one line: 'a: 3, b: 1'."""
    counts = rows.groupBy(*group, label.alias("label")).agg(F.count("*").alias("n"))
    parts = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "label", "n")))
    line = F.array_join(F.transform(parts, lambda p: F.concat(p["label"], F.lit(": "), p["n"].cast("string"))), ", ")
    return counts.groupBy(*group).agg(F.sum("n").alias("n"), line.alias("detail"))


def age_label(days: Column) -> Column:
    return F.when(days.isNull(), "never").when(days < 1, "today").when(days < 2, "yesterday").when(days < 14, F.concat(F.floor(days).cast("string"), F.lit(" days"))).otherwise(F.concat(F.floor(days / 7).cast("string"), F.lit(" weeks")))


def reflow(rows: DataFrame, version: str, current: int, order: Sequence[str], cap: int) -> DataFrame:
    """The oldest rows of an outdated version, up to cap: what to do again."""
    return rows.where(F.col(version) < current).orderBy(*order).limit(cap)


def given_up(attempts: DataFrame, key: str, cap: int) -> tuple[DataFrame, DataFrame]:
    """(to retry, given up) by the number of failed attempts of each key."""
    n = attempts.groupBy(key).agg(F.count("*").alias("attempts"))
    return n.where(F.col("attempts") < cap), n.where(F.col("attempts") >= cap)


def pruned_bullets(text: Column, cutoff: str) -> Column:
    """Lines that begin with a dated bullet older than the cutoff go."""
    day = lambda line: F.try_to_date(F.regexp_extract(line, r"^[-*] (\d{4}-\d{2}-\d{2})", 1), "yyyy-MM-dd")
    return F.array_join(F.filter(F.split(text, "\n"), lambda x: F.coalesce(day(x) >= F.lit(cutoff).cast("date"), F.lit(True))), "\n")


def topic(tag: Column, synonyms: Mapping[str, str], qualifiers: Sequence[str]) -> Column:
    """Synonym, without leading qualifiers, last word in the singular, synonym again."""
    table = F.create_map(*[F.lit(x) for kv in synonyms.items() for x in kv]) if synonyms else None
    swap = lambda c: F.coalesce(table[c], c) if table is not None else c
    word = swap(F.trim(F.lower(tag)))
    word = F.regexp_replace(word, rf"^(?:(?:{'|'.join(qualifiers)})\s+)+(?=\S)", "") if qualifiers else word
    return swap(singular(word))


def singular(word: Column) -> Column:
    """The usual English endings; words in -ss, -us and -is stay."""
    return F.when(word.rlike("(ss|us|is)$"), word).when(word.rlike("[^aeiou]ies$"), F.regexp_replace(word, "ies$", "y")).when(word.rlike("(ch|sh|x|z|s)es$"), F.regexp_replace(word, "es$", "")).otherwise(F.regexp_replace(word, "s$", ""))


def paths(nodes: DataFrame, key: str, parent: str, name: str, levels: int = 8) -> DataFrame:
    """(key, path): names from the top, by parent pointers, at most so many levels; a pointer to itself is a top."""
    up = nodes.select(F.col(key).alias("__k"), F.col(parent).alias("__p"), F.col(name).alias("__n"))
    now = nodes.select(key, F.when(F.col(parent) != F.col(key), F.col(parent)).alias("__at"), F.col(name).alias("path"))
    for _ in range(levels - 1):
        step = now.join(up, F.col("__at") == F.col("__k"), "left")
        now = step.select(key, F.when(F.col("__p") != F.col("__k"), F.col("__p")).alias("__at"), F.when(F.col("__n").isNull(), F.col("path")).otherwise(F.concat_ws("/", "__n", "path")).alias("path"))
    return now.select(key, "path")


def first_mention(docs: DataFrame, needles: Sequence[str], text_col: str = "text") -> DataFrame:
    """Whether some text mentions one of the needles (four letters at least); one row."""
    usable = [n.lower() for n in needles if len(n) >= 4]
    hit = reduce(lambda a, b: a | b, [F.contains(F.lower(text_col), F.lit(n)) for n in usable], F.lit(False))
    return docs.agg(F.coalesce(F.bool_or(hit), F.lit(False)).alias("mentioned"), F.count_if(hit).alias("texts"))
