"""Checks, findings and federation: statistics, contracts, claims from many contributors, layered snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, key: str, version: str, payload: list[str]) -> DataFrame:
    """Rows of both by key; a new row replaces an old one unless its version is equal. `changed` marks what was written."""
    left, right = old.select(F.struct(*old.columns).alias("o"), F.col(key).alias("__k")), new.select(F.struct(*new.columns).alias("n"), F.col(key).alias("__k"))
    both = left.join(right, "__k", "full_outer")
    keep = F.col("n").isNull() | F.col(f"o.{version}").eqNullSafe(F.col(f"n.{version}"))
    pick = lambda c: F.when(keep, F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")).alias(c)
    return both.select(F.col("__k").alias(key), *[pick(c) for c in [version, *payload]], (~keep).alias("changed"))


def record_findings(open_ones: DataFrame, detected: DataFrame) -> DataFrame:
    """(ref_id, state, verdict) after a run: detected again stays open (closed for good if it has a verdict), not detected is resolved, else new."""
    both = open_ones.withColumn("__was", F.lit(True)).join(detected.select("ref_id").distinct().withColumn("__is", F.lit(True)), "ref_id", "full_outer")
    state = F.when(F.col("verdict").isNotNull(), "closed").when(F.col("__was").isNull(), "new").when(F.col("__is").isNull(), "resolved").otherwise("open")
    return both.select("ref_id", state.alias("state"), "verdict")


def problems(rules: dict[str, Column]) -> Column:
    """Names of the rules that a row breaks."""
    return F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in rules.items()]))


def claims(rows: DataFrame, key: list[str]) -> DataFrame:
    """Contributors' claims as one fact each: sources, contributors, best confidence, first validity, last end, last value that isn't empty."""
    return rows.groupBy(*key).agg(
        F.countDistinct("contributor").alias("contributors"),
        F.count("*").alias("sources"),
        F.round(F.max("confidence"), 6).alias("confidence"),
        F.min("valid_from").alias("valid_from"),
        F.max("valid_to").alias("valid_to"),
        F.max_by("value", F.when(F.col("value") != "", F.struct("id", "value"))).alias("value"),
    )


def corroborated(facts: DataFrame, relation: str = "relation", weak: str = "mentioned_with") -> DataFrame:
    """Two sources at least; for weak relations also two contributors."""
    return facts.where((F.col("sources") >= 2) & ((F.col(relation) != weak) | (F.col("contributors") >= 2)))


def layered(local: DataFrame, shared: DataFrame, key: str, payload: list[str]) -> DataFrame:
    """Local values win where they are given, the shared layer fills in, `origin` says whose row it is."""
    a = local.select(F.col(key), *[F.col(c).alias(f"__l_{c}") for c in payload], F.lit(True).alias("__l"))
    b = shared.select(F.col(key), *payload)
    both = a.join(b, key, "full_outer")
    return both.select(key, *[F.coalesce(f"__l_{c}", c).alias(c) for c in payload], F.when(F.col("__l").isNull(), "shared").otherwise("local").alias("origin"))


def name_parts(name: Column) -> Column:
    return F.filter(F.split(F.lower(name), r"\s+"), lambda w: F.char_length(w) >= 4)


def grounded(names: Column, source: Column) -> Column:
    """The names that stand in the source, whole or by a word of four letters."""
    low = F.lower(F.coalesce(source, F.lit("")))
    return F.filter(names, lambda n: F.contains(low, F.lower(n)) | F.exists(name_parts(n), lambda w: F.contains(low, w)))


def org_variants(entities: DataFrame, canonical: list[str], least: float = 60.0) -> DataFrame:
    """(variant_org, canonical_org, score, entity_count): spellings that are not canonical, with the canonical one most like them.

    Names are counted before they are compared, and the canonical names are a short list.
    """
    from memlake.functions.packed import token_set

    counts = entities.where(F.coalesce("org", F.lit("")) != "").groupBy(F.col("org").alias("variant_org")).agg(F.count("*").alias("entity_count"))
    names = F.array(*[F.lit(c) for c in sorted(canonical) if c not in ("external", "unknown")])
    pairs = counts.where(~F.col("variant_org").isin(canonical)).withColumn("canonical_org", F.explode(names))
    scored = pairs.withColumn("score", F.round(token_set(F.lower("variant_org"), F.lower("canonical_org")), 4))
    best = scored.groupBy("variant_org", "entity_count").agg(F.max("score").alias("score"), F.min_by("canonical_org", F.struct(-F.col("score"), "canonical_org")).alias("canonical_org"))
    return best.where(F.col("score") >= least).select("variant_org", "canonical_org", "score", "entity_count")
