"""Memory dynamics: feedback, decay, tiers, salience, arms and drift."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Weights and thresholds that results depend on.
USE_BOOST, PRIOR, HALF_LIFE_DAYS = 0.5, 3.0, 90.0
COLD_BELOW, EXEMPT_SALIENCE, INITIAL_STRENGTH, LEAST_STRENGTH = 0.25, 6.0, 5.0, 0.1
HOT_STRENGTH, COLD_SALIENCE = 7.0, 3.5
# End of fixed values.


#: Proposals of a gamma draw: all are rejected once in 10^15 draws or less; the mode stands in then.
GAMMA_TRIES = 12


def age_days(as_of: str, ts: Column) -> Column:
    return (F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros(ts)) / 86400e6


def half_life_weight(age: Column, days: float = HALF_LIFE_DAYS) -> Column:
    return F.exp(-F.log(F.lit(2.0)) * age / days)


def retention(strength: Column, days_since: Column) -> Column:
    """Ebbinghaus' curve; 1 for what was just seen."""
    s = F.when(strength <= 0, INITIAL_STRENGTH).otherwise(strength)
    return F.when(days_since <= 0, 1.0).otherwise(F.exp(-days_since / F.greatest(s, F.lit(LEAST_STRENGTH))))


def feedback_quality(events: DataFrame, as_of: str) -> DataFrame:
    """(doc_id, quality, uses, exposures); documents that were only shown get no row."""
    w = half_life_weight(age_days(as_of, F.col("ts")))
    used = F.col("kind") == "used"
    sums = events.groupBy("doc_id").agg(F.sum(F.when(used, w).otherwise(0.0)).alias("u"), F.count_if(used).alias("uses"), F.count_if(~used).alias("exposures"))
    return sums.where("u > 0").select("doc_id", F.round(1 + USE_BOOST * F.col("u") / (F.col("u") + PRIOR), 6).alias("quality"), "uses", "exposures")


def decay_pass(rows: DataFrame) -> DataFrame:
    """Of (strength, days_since, salience): retention, and whether the row goes cold."""
    r = retention(F.col("strength"), F.col("days_since"))
    return rows.withColumns({"retention": F.round(r, 6), "cold": (r < COLD_BELOW) & (F.col("salience") < EXEMPT_SALIENCE)})


def next_tier(tier: Column, strength: Column, salience: Column) -> Column:
    return F.when((strength >= HOT_STRENGTH) & tier.isin("", "warm"), "hot").when((salience < COLD_SALIENCE) & ~tier.isin("core", "hot"), "cold").otherwise(tier)


def salience(reply_depth: Column, owner: Column, starred: Column, important: Column, promoted: Column, entities: Column, source: Column, no_reply: Column, age: Column) -> Column:
    """Structural importance from 1 to 10."""
    on = lambda c, x: F.when(c, x).otherwise(0.0)
    score = (
        3.0 + on(reply_depth >= 1, 1.5) + on(reply_depth >= 2, 0.5) + on(owner, 1.5) + on(starred, 1.0) + on(important, 0.5) - on(promoted, 1.5)
        + F.least(F.lit(1.5), 0.3 * entities) + on(source.isin("calendar", "gdrive"), 0.5) - on(no_reply, 2.0)
        + F.when(age < 7, 2.0).when(age < 30, 1.0).when(age < 90, 0.5).otherwise(0.0)
    )
    return F.round(F.greatest(F.lit(1.0), F.least(F.lit(10.0), score)), 2)


def arm_posterior(outcomes: DataFrame, arm: str, good: Column, prior: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
    """(arm, alpha, beta, mean): a Beta posterior of each arm."""
    counts = outcomes.groupBy(arm).agg((F.count_if(good) + prior[0]).alias("alpha"), (F.count_if(~good) + prior[1]).alias("beta"))
    return counts.withColumn("mean", F.round(F.col("alpha") / (F.col("alpha") + F.col("beta")), 6))


def _uniform(seed: int, *key: Column) -> Column:
    """From (0, 1): the same for a seed and a key on any partitioning."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *key), 11) + 0.5) / float(1 << 53)


def _gamma(shape: Column, seed: int, key: Column) -> Column:
    """A draw of Gamma(shape, 1), shape of 1 and more: the first of GAMMA_TRIES proposals that is accepted (each is by 95 % and more)."""
    d = shape - 1.0 / 3.0
    c = 1.0 / F.sqrt(9.0 * d)

    def proposal(k: Column) -> Column:
        normal = F.sqrt(-2.0 * F.log(_uniform(seed, key, k, F.lit(1)))) * F.cos(2.0 * math.pi * _uniform(seed, key, k, F.lit(2)))
        v = F.pow(1.0 + c * normal, F.lit(3.0))
        u = _uniform(seed, key, k, F.lit(3))
        return F.when((v > 0) & (F.log(u) < 0.5 * normal * normal + d - d * v + d * F.log(F.greatest(v, F.lit(1e-300)))), d * v)

    tried = F.filter(F.transform(F.sequence(F.lit(0), F.lit(GAMMA_TRIES - 1)), proposal), lambda x: x.isNotNull())
    return F.coalesce(F.get(tried, F.lit(0)), d)


def thompson(arms: DataFrame, arm: str, seed: int, rounds: int = 1) -> DataFrame:
    """(round, arm, draw, chosen): a Beta draw of each arm's posterior in each round, and the arm of the largest draw (ties: the smallest arm).

    arms (arm, alpha, beta), both 1 and more. A draw hangs on the seed, the round and the arm only. Arms without alpha or beta are at their mean, 0.5.
    """
    each = arms.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1)))) if rounds else arms.limit(0).withColumn("round", F.lit(0))
    key = F.xxhash64(F.col("round"), F.col(arm).cast("string"))
    a, b = (_gamma(F.greatest(F.col(c).cast("double"), F.lit(1.0)), seed + k, key) for k, c in enumerate(("alpha", "beta")))
    drawn = each.select("round", arm, F.round(F.coalesce(a / (a + b), F.lit(0.5)), 9).alias("draw"))
    best = drawn.groupBy("round").agg(F.min_by(arm, F.struct(-F.col("draw"), arm)).alias("__best"))
    return drawn.join(best, "round").select("round", arm, "draw", (F.col(arm) == F.col("__best")).alias("chosen"))


def noise_floor(metrics: DataFrame, ts: str, value: str, least: float = 0.05) -> DataFrame:
    """Twice the deviation of the daily means, `least` at least."""
    daily = metrics.groupBy(F.to_date(ts).alias("day")).agg(F.avg(value).alias("m"))
    return daily.agg(F.count("*").alias("days"), F.round(F.avg("m"), 6).alias("baseline"), F.round(F.greatest(F.lit(least), 2 * F.stddev_pop("m")), 6).alias("floor"))
