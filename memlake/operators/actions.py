"""Actions: buckets and quotas, time to live, duplicates by fingerprint or by words within an interval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlake.functions import text as X
from memlake.operators.graph import rarest_words
from memlake.shared import stored

# Quotas, limits and thresholds that results depend on.
QUOTAS = {"overdue": 3, "due_today": 3, "upcoming": 2}
TTL_DAYS, OVERDUE_TTL_DAYS = 120, 730
WINDOW_DAYS, SAME_WORDS = 7, 0.85
RESOLVED_WORDS = ["done", "resolved", "completed", "sorted", "handled"]
RESOLVED_PHRASES = ["taken care of", "sent through", "no longer needed", "all good", "received, thanks", "received with thanks"]
NOT_RESOLVED = ["not done", "get it done", "get this done", "well done", "yet to be", "to be done", "isn't done", "still need"]
# End of fixed values.


def signals_resolution(text: Column) -> Column:
    """A word or phrase that says that something is settled, and none that says that it isn't."""
    low = F.lower(F.coalesce(text, F.lit("")))
    said = low.rlike(rf"(?U)\b({'|'.join(RESOLVED_WORDS)})\b") | X.any_contained(low, RESOLVED_PHRASES)
    return said & ~X.any_contained(low, NOT_RESOLVED)


def bucket(deadline: Column, as_of: str, ahead: int = 7) -> Column:
    day = F.lit(as_of).cast("date")
    return F.when(deadline < day, "overdue").when(deadline == day, "due_today").when(deadline <= F.date_add(day, ahead), "upcoming")


def round_robin(actions: DataFrame, owner: str, bucket_col: str, order: list[Column], limit: int) -> DataFrame:
    """Each bucket's quota first, then the rest in turns, up to limit per owner."""
    rank = F.row_number().over(Window.partitionBy(owner, bucket_col).orderBy(*order))
    quota = F.create_map(*[x for k, v in QUOTAS.items() for x in (F.lit(k), F.lit(v))])[F.col(bucket_col)]
    place = F.array_position(F.array(*map(F.lit, QUOTAS)), F.col(bucket_col))
    ranked = actions.withColumn("__turn", F.greatest(F.lit(0), rank - quota)).withColumn("__place", place).withColumn("__rank", rank)
    pick = F.row_number().over(Window.partitionBy(owner).orderBy("__turn", "__place", "__rank"))
    return ranked.withColumn("pick", pick).where(F.col("pick") <= limit).drop("__turn", "__place", "__rank")


def ttl(deadline: Column, created: Column, as_of: str, days: int = TTL_DAYS, overdue_days: int = OVERDUE_TTL_DAYS) -> Column:
    """ttl, ttl_overdue or null."""
    day = F.lit(as_of).cast("date")
    return F.when(deadline.isNull() & (created < F.date_add(day, -days)), "ttl").when(deadline < F.date_add(day, -overdue_days), "ttl_overdue")


def first_of_each(actions: DataFrame, key: list[str], id_col: str) -> DataFrame:
    """All but the smallest id of each key: what to archive. Combined before the shuffle."""
    kept = actions.groupBy(*key).agg(F.min(id_col).alias("kept"), F.count("*").alias("n")).where("n > 1")
    return actions.join(kept, key).where(F.col(id_col) != F.col("kept")).select(id_col, "kept")


def near_duplicates(actions: DataFrame, owner: str, id_col: str, day_col: str, text_col: str, window_days: int = WINDOW_DAYS, least: float = SAME_WORDS) -> DataFrame:
    """Pairs of one owner within the window with nearly the same words.

    Equal sets of words of one owner are one first: which sets are much the same is found among these, by the rarest
    of their words. Rows then meet by set and by cell of days of the window's width, in their own and the next ones:
    an equality join that makes each pair once, so that pairs are neither shuffled nor joined again. Ids are unique.
    """
    words = F.array_sort(F.array_distinct(X.tokens(F.col(text_col))))
    rows = stored(actions.select(F.col(owner).alias("owner"), F.col(id_col).alias("id"), F.col(day_col).alias("day"), words.alias("w")).where(F.size("w") > 0), "actions")
    sets = stored(rows.groupBy("owner", "w").agg(F.min("id").alias("key")), "sets")
    rare = stored(rarest_words(sets, ["key"], "w", least, ["owner"]), "rare")
    met = rare.select("owner", "word", F.col("key").alias("x")).join(rare.select("owner", "word", F.col("key").alias("y")), ["owner", "word"]).select("x", "y").distinct()
    of = lambda side: sets.select(F.col("key").alias(side), F.col("w").alias(f"w{side}"))
    alike = met.join(of("x"), "x").join(of("y"), "y").select("x", "y", F.round(X.jaccard(F.col("wx"), F.col("wy")), 6).alias("similarity")).where(F.col("similarity") >= least)
    alike = stored(alike, "alike")
    cell = F.floor(F.unix_date("day") / (window_days + 1))
    named = stored(rows.join(sets, ["owner", "w"]).select("key", "id", "day", cell.alias("cell")), "named")
    left = named.join(alike, F.col("key") == F.col("x")).select(F.col("y").alias("key"), F.col("id").alias("a"), F.col("day").alias("day_a"), "similarity", F.explode(F.array(F.col("cell"), F.col("cell") + 1, F.col("cell") - 1)).alias("cell"))
    right = named.select("key", F.col("id").alias("b"), F.col("day").alias("day_b"), "cell")
    return left.join(right, ["key", "cell"]).where((F.col("a") < F.col("b")) & (F.abs(F.datediff("day_a", "day_b")) <= window_days)).select("a", "b", "similarity")
