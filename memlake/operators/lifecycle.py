"""State changes as set operations: patches, guarded transitions, cascades, queues, counters, reconciliation."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlake.functions import text as X


def patched(metadata: Column, patch: Column) -> Column:
    """A map with another's entries laid over it; null values take keys away."""
    return F.map_filter(F.map_zip_with(metadata, patch, lambda k, a, b: F.when(F.map_contains_key(patch, k), b).otherwise(a)), lambda k, v: v.isNotNull())


def filled(old: DataFrame, new: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Upsert in which values that aren't empty win."""
    theirs = new.select(F.col(key), *[F.col(c).alias(f"__n_{c}") for c in columns])
    given = lambda c: F.when(F.col(f"__n_{c}").cast("string") != "", F.col(f"__n_{c}"))
    return old.join(theirs, key, "full_outer").select(key, *[F.coalesce(given(c), F.col(c)).alias(c) for c in columns])


def transition(rows: DataFrame, orders: DataFrame, key: str, allowed: dict[str, Sequence[str]]) -> DataFrame:
    """Status changes that are asked for and allowed from the present status; `applied` says which were."""
    ask = orders.groupBy(key).agg(F.min("wanted").alias("wanted"))
    ok = reduce(lambda a, b: a | b, [(F.col("status") == s) & F.col("wanted").isin(*to) for s, to in allowed.items()])
    both = rows.join(ask, key, "left")
    return both.withColumn("applied", F.coalesce(ok, F.lit(False))).withColumn("status", F.when(F.col("applied"), F.col("wanted")).otherwise(F.col("status"))).drop("wanted")


def cascade(gone: DataFrame, key: str, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Each table without the rows of the keys that go."""
    keys = gone.select(key).distinct()
    return {name: t.join(keys, key, "left_anti") for name, t in tables.items()}


def first_groups(rows: DataFrame, group: str, order: str, n: int) -> DataFrame:
    """Rows of the n groups that come first in scan order; the groups are found by an aggregate and a top-n."""
    firsts = rows.groupBy(group).agg(F.min(order).alias("__first")).orderBy("__first", group).limit(n)
    return rows.join(firsts.drop("__first"), group, "left_semi")


def regrouped(parts: DataFrame, group: str, part: str, items: str) -> DataFrame:
    """Parts of a group joined in the order of their numbers."""
    lists = F.sort_array(F.collect_list(F.struct(part, items)))
    return parts.groupBy(group).agg(F.flatten(F.transform(lists, lambda p: p[items])).alias(items), F.count("*").alias("parts"))


def greedy_skip(rows: DataFrame, group: Sequence[str], rank: str, size: str, budget: int, most: int) -> DataFrame:
    """Of the first `most` rows of each group those that fit the budget one after the other; misfits are passed over."""
    top = rows.withColumn("__rn", F.row_number().over(Window.partitionBy(*group).orderBy(rank))).where(F.col("__rn") <= most)
    lists = top.groupBy(*group).agg(F.sort_array(F.collect_list(F.struct(F.col(rank).alias("r"), F.col(size).cast("long").alias("s")))).alias("x"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<bigint>").alias("kept"))

    def step(a, x):
        fits = a["used"] + x["s"] <= budget
        return F.struct(F.when(fits, a["used"] + x["s"]).otherwise(a["used"]).alias("used"), F.when(fits, F.concat(a["kept"], F.array(x["r"].cast("long")))).otherwise(a["kept"]).alias("kept"))

    return lists.select(*group, F.explode(F.aggregate("x", start, step, lambda a: a["kept"])).alias(rank))


def absent(present: DataFrame, known: DataFrame, key: str, misses: str, threshold: int) -> DataFrame:
    """Miss counters after an enumeration: reset where seen, one more where not; an empty enumeration changes nothing."""
    seen = present.select(key).distinct().withColumn("__seen", F.lit(True))
    any_seen = seen.agg((F.count("*") > 0).alias("__any"))
    both = known.join(seen, key, "left").join(F.broadcast(any_seen), F.lit(True))
    now = F.when(~F.col("__any"), F.col(misses)).when(F.col("__seen"), 0).otherwise(F.col(misses) + 1)
    return both.select(key, now.alias(misses), (now >= threshold).alias("revoked"))


def unique_matches(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(left_id, right_id) of keys that occur once on either side: contested ones match nobody."""
    one = lambda d, name: d.groupBy(key).agg(F.min("id").alias(name), F.count("*").alias("n")).where("n = 1").select(key, name)
    return one(left, "left_id").join(one(right, "right_id"), key).select("left_id", "right_id")


def reconcile(tasks: DataFrame, actions: DataFrame, by_id: str, by_print: str) -> DataFrame:
    """Tasks against actions: by id, then the rest one to one by fingerprint, first to first; what is left is new or gone."""
    same = tasks.select(F.col(by_id), F.col("task")).join(actions.select(F.col(by_id), F.col("id")), by_id).select("task", "id", F.lit("id").alias("how"))
    rest_t, rest_a = tasks.join(same, "task", "left_anti"), actions.join(same, "id", "left_anti")
    nth = lambda d, o: d.withColumn("__n", F.row_number().over(Window.partitionBy(by_print).orderBy(o)))
    second = nth(rest_t, "task").select("task", by_print, "__n").join(nth(rest_a, "id").select("id", by_print, "__n"), [by_print, "__n"], "full_outer")
    how = F.when(F.col("task").isNull(), "gone").when(F.col("id").isNull(), "new").otherwise("fingerprint")
    return same.unionByName(second.select("task", "id", how.alias("how")))


def intent(query: str, entities: DataFrame, name_col: str, longest: int = 5) -> DataFrame:
    """The entity with the longest name among the query's runs of up to five words; none: general."""
    words = query.lower().split()
    grams = sorted({" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)})
    return entities.where(F.lower(name_col).isin(grams)).orderBy(F.desc(F.char_length(name_col)), name_col).limit(1)


def quoted_back(snippets: DataFrame, responses: DataFrame, key: str, least: float = 0.6) -> DataFrame:
    """Snippets of which so much of the words comes back in the response."""
    from memlake.functions.mail import reuse

    both = snippets.join(responses.select(key, F.col("text").alias("__r")), key)
    return both.withColumn("reuse", F.round(reuse(F.col("text"), F.col("__r")), 6)).where(F.col("reuse") >= least).drop("__r")


#: Rows of a task that brings pairs together.
TASK_ROWS = 250_000


def met_together(rows: DataFrame, least: int) -> DataFrame:
    """(a, b, together): pairs a < b that stand together in `least` groups; rows (s, o) of members and groups, repeated or not.

    Tasks are as many as rows and pairs ask for, so that none holds more for larger tables; nothing merges them again.
    """
    n = -(-rows.count() // TASK_ROWS) or 1
    p = rows.repartition(n, "o").distinct()
    met = p.toDF("a", "o").join(p.toDF("b", "o").hint("merge"), "o").where("a < b")
    # some three pairs a row, where a group has seven
    pairs = met.select("a", "b").repartition(4 * n, "a", "b")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("together")).where(F.col("together") >= least)


def column_totals(cells: DataFrame, table: str, column: str, value: str) -> DataFrame:
    """Sums of the columns of which half the values are numbers, ids (whole numbers of one width from three digits on) left out."""
    number = F.expr(f"try_cast(replace(replace({value}, ',', ''), '$', '') as double)")
    given = F.col(value) != ""
    stats = cells.groupBy(table, column).agg(
        F.count_if(given).alias("n"), F.count_if(number.isNotNull() & given).alias("numbers"), F.sum(number).alias("total"),
        F.bool_and(F.col(value).rlike(r"^\d{3,}$")).alias("digits"), F.countDistinct(F.char_length(value)).alias("widths"),
    )
    return stats.where((F.col("numbers") * 2 >= F.col("n")) & ~(F.col("digits") & (F.col("widths") == 1))).select(table, column, "n", F.round("total", 4).alias("total"))


def words_overlap(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(F.array_distinct(X.tokens(a)), F.array_distinct(X.tokens(b))))
