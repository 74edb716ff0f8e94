"""A shared layer of entities over a local one: matching, merges that can be undone, replacement by snapshots.

References to entities (ends of relations, observations) are never thrown together: a merge moves them and
logs each move; what is shown is made from them. So a merge is undone by the log, through later merges too, and
the graph is what it was.

State: entities (id, name, kind, email, aliases, origin), relations (id, a, relation, b, origin), observations
(id, entity, text), log (seq, what, row, side, from_id, to_id). aliases is one text, parts between commas or bars; origin is
local or shared.

Matching (drifted): a shared entity takes over the one local entity that is its namesake: by e-mail, else,
within its kind, by key, alias, or words (Jaccard 0.8 and more). With more than one there is no match, nor for a
local entity that two shared ones claim. Locals are grouped by what is compared before they are joined, so that
a name that a third of them has is one row.

Defined results: role mailboxes match nobody and, on the shared side, keep an entity from matching by name. Empty names,
e-mails and keys match nothing. An entity's own id is no match. Merges in a circle, or into an entity itself, are passed over.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlake.functions import text as X
from memlake.operators.graph import chain_ends, rarest_words
from memlake.shared import stored

SAME_WORDS = 0.8


@dataclass(frozen=True)
class Layers:
    entities: DataFrame
    relations: DataFrame
    observations: DataFrame
    log: DataFrame


def edges(layers: Layers) -> DataFrame:
    """(a, relation, b, id, origin) as shown: no loops, of equal ones that with the smallest id, local before shared."""
    shown = layers.relations.where("a <> b").groupBy("a", "relation", "b").agg(F.min(F.struct("origin", "id")).alias("first"))
    return shown.select("a", "relation", "b", "first.id", "first.origin")


def _references(layers: Layers, origin: str | None = None) -> DataFrame:
    """(what, row, side, entity)."""
    rel = layers.relations if origin is None else layers.relations.where(F.col("origin") == origin)
    ends = rel.select(F.lit("relation").alias("what"), F.col("id").alias("row"), F.inline(F.array(F.struct(F.lit("a").alias("side"), F.col("a").alias("entity")), F.struct(F.lit("b").alias("side"), F.col("b").alias("entity")))))
    return ends.unionByName(layers.observations.select(F.lit("observation").alias("what"), F.col("id").alias("row"), F.lit("").alias("side"), "entity"))


def _moved(layers: Layers, moves: DataFrame) -> Layers:
    """References set to what moves (what, row, side, target) say."""
    moves = stored(moves.select("what", "row", "side", "target"), "moves")
    relations = layers.relations
    for side in ("a", "b"):
        own = moves.where((F.col("what") == "relation") & (F.col("side") == side)).select(F.col("row").alias("id"), "target")
        relations = relations.join(own, "id", "left").withColumn(side, F.coalesce("target", side)).drop("target")
    own = moves.where("what = 'observation'").select(F.col("row").alias("id"), "target")
    observations = layers.observations.join(own, "id", "left").withColumn("entity", F.coalesce("target", "entity")).drop("target")
    return replace(layers, relations=stored(relations, "relations"), observations=stored(observations, "observations"))


def merged(layers: Layers, merges: DataFrame, seq: int) -> Layers:
    """Losers go and what refers to them moves to their winners; merges (loser, winner), chains are followed to their ends. Without merges nothing is written."""
    first = stored(merges.where("loser <> winner").groupBy("loser").agg(F.min("winner").alias("winner")), "merges")
    if not first.head(1):
        return layers
    ends = chain_ends(first)
    ends = stored(ends.join(ends.select(F.col("loser").alias("winner")), "winner", "left_anti").select("loser", "winner"), "ends")
    if not ends.head(1):
        return layers
    moves = _references(layers).join(ends, F.col("entity") == F.col("loser")).select(F.lit(seq).alias("seq"), "what", "row", "side", F.col("loser").alias("from_id"), F.col("winner").alias("to_id"))
    moves = stored(moves, "moves")
    after = _moved(layers, moves.withColumnRenamed("to_id", "target"))
    entities = layers.entities.join(ends.select(F.col("loser").alias("id")), "id", "left_anti")
    return replace(after, entities=stored(entities, "entities"), log=stored(layers.log.unionByName(moves), "log"))


def undone(layers: Layers, revived: DataFrame) -> Layers:
    """References go back to revived entities (one column) that they were moved away from; of several to the one that had them first.

    The moves from then on are taken out of the log: later merges on the way are undone for these references, and for them only.
    """
    ids = revived.toDF("from_id").distinct()
    back = layers.log.join(ids, "from_id", "left_semi").groupBy("what", "row", "side").agg(F.min(F.struct("seq", "from_id")).alias("first"))
    back = stored(back.select("what", "row", "side", F.col("first.seq").alias("since"), F.col("first.from_id").alias("target")), "back")
    if not back.head(1):
        return layers
    kept = layers.log.join(back.select("what", "row", "side", "since"), ["what", "row", "side"], "left").where(F.col("since").isNull() | (F.col("seq") < F.col("since"))).drop("since")
    return replace(_moved(layers, back), log=stored(kept, "log"))


# -- matching ----------------------------------------------------------------------------------------


def _prepared(rows: DataFrame) -> DataFrame:
    """With what is compared: mail, key, lower name, sorted words; null where empty."""
    some = lambda c: F.when(c != "", c)
    mail = some(F.lower(F.trim(F.coalesce("email", F.lit("")))))
    role = F.coalesce(X.is_role_mailbox(mail), F.lit(False))
    words = F.array_sort(F.array_distinct(X.tokens(F.col("name"))))
    return rows.select("id", "kind", F.when(~role, mail).alias("mail"), role.alias("role"), some(X.slug(X.canonical_name(F.col("name")))).alias("key"), some(F.lower(F.trim(F.coalesce("name", F.lit(""))))).alias("low"), F.when(F.size(words) > 0, words).alias("words"), "aliases")


def drifted(shared: DataFrame, local: DataFrame) -> DataFrame:
    """(shared_id, local_id, how) of the unambiguous matches; how: mail or name. Both (id, name, kind, email, aliases)."""
    ours, theirs = stored(_prepared(shared), "shared"), stored(_prepared(local), "local")
    # what the local entity of the same id, which is no match, takes part in
    own = theirs.select("id", *[F.col(c).alias(f"own_{c}") for c in ("kind", "mail", "role", "low", "key", "words")])
    ours = stored(ours.join(own, "id", "left").withColumn("aliases", F.filter(F.transform(F.split(F.coalesce("aliases", F.lit("")), "[|,]"), lambda a: F.lower(F.trim(a))), lambda a: a != "")), "asked")

    def grouped(rows: DataFrame, *by: str) -> DataFrame:
        return rows.groupBy(*by).agg(F.count("*").alias("n"), F.min("id").alias("lo"), F.max("id").alias("hi"))

    def others(found: DataFrame, mine: Column) -> DataFrame:
        """(id, n, other): how many locals but the own one, and one of them; mine: whether the own one is in the group."""
        mine = F.coalesce(mine, F.lit(False))
        left = found.select("id", (F.col("n") - mine.cast("int")).alias("n"), F.when(mine & (F.col("lo") == F.col("id")), F.col("hi")).otherwise(F.col("lo")).alias("other"))
        return left.where("n > 0")

    by_mail = others(ours.join(grouped(theirs.where("mail is not null"), "mail"), "mail"), F.col("own_mail") == F.col("mail"))
    first = stored(by_mail.where("n = 1").select("id", "other"), "mail")
    named = ours.where(~F.col("role")).join(first, "id", "left_anti")
    open_ones = theirs.where(~F.col("role"))
    same_kind = (F.col("own_kind") == F.col("kind")) & ~F.col("own_role")
    by_key = others(named.join(grouped(open_ones.where("key is not null"), "kind", "key"), ["kind", "key"]), same_kind & (F.col("own_key") == F.col("key")))
    called = named.select("id", "kind", "own_kind", "own_role", "own_low", F.explode(F.array_distinct("aliases")).alias("low"))
    by_alias = others(called.join(grouped(open_ones.where("low is not null"), "kind", "low"), ["kind", "low"]), same_kind & (F.col("own_low") == F.col("low")))
    # names of the same words are one set; sets meet by the rarest of their words
    sets = stored(grouped(open_ones.where("words is not null"), "kind", "words").withColumn("set", F.xxhash64("kind", F.array_join("words", " "))), "sets")
    asked = stored(named.where("words is not null").select("kind", "words").distinct().withColumn("set", F.xxhash64("kind", F.array_join("words", " "))), "asked_sets")
    every = stored(sets.select("kind", "words", "set").unionByName(asked.select("kind", "words", "set")).distinct(), "every")
    rare = stored(rarest_words(every, ["set"], "words", SAME_WORDS, ["kind"]), "rare")
    left = rare.join(asked.select("set"), "set", "left_semi").select("kind", "word", F.col("set").alias("a"))
    right = rare.join(sets.select("set"), "set", "left_semi").select("kind", "word", F.col("set").alias("b"))
    met = left.join(right, ["kind", "word"]).select("a", "b").distinct()
    near = met.join(asked.select(F.col("set").alias("a"), F.col("words").alias("wa")), "a").join(sets.select(F.col("set").alias("b"), F.col("words").alias("wb"), "n", "lo", "hi"), "b").where(X.jaccard(F.col("wa"), F.col("wb")) >= SAME_WORDS)
    keyed = named.where("words is not null").withColumn("a", F.xxhash64("kind", F.array_join("words", " ")))
    by_words = others(keyed.join(near, "a"), same_kind & (F.col("own_words") == F.col("wb")))
    claims = by_key.unionByName(by_alias).unionByName(by_words).groupBy("id").agg(F.max("n").alias("n"), F.min("other").alias("other"), F.max("other").alias("last"))
    second = claims.where("n = 1 and other = last").select("id", "other")
    found = stored(first.withColumn("how", F.lit("mail")).unionByName(second.withColumn("how", F.lit("name"))), "claims")
    alone = found.groupBy("other").agg(F.count("*").alias("n")).where("n = 1").select("other")
    return found.join(alone, "other", "left_semi").select(F.col("id").alias("shared_id"), F.col("other").alias("local_id"), "how")


# -- snapshots ---------------------------------------------------------------------------------------


def imported(layers: Layers, entities: DataFrame, relations: DataFrame, gone: DataFrame, seq: int) -> Layers:
    """The shared layer replaced by a snapshot.

    entities (id, name, kind, email, aliases), relations (id, a, relation, b), gone (id, merged_into or null). In order: entities
    that were merged away and are back take back what was theirs; local namesakes merge into shared entities; shared
    rows are written, local ones of the same id win; shared relations are the snapshot's; entities that are gone merge into what they
    were merged into, or else become local if anything local refers to them, or go; so do shared entities that the snapshot has not got.
    """
    fresh = stored(entities.dropDuplicates(["id"]), "snapshot")
    back = fresh.select("id").join(layers.log.select(F.col("from_id").alias("id")).distinct(), "id", "left_semi").join(layers.entities.select("id"), "id", "left_anti")
    layers = undone(layers, back)
    local = layers.entities.where("origin = 'local'")
    namesakes = drifted(fresh, local).join(local.select(F.col("id").alias("shared_id")), "shared_id", "left_anti").select(F.col("local_id").alias("loser"), F.col("shared_id").alias("winner"))
    layers = merged(layers, namesakes, seq)
    had = layers.entities
    kept = had.where("origin = 'local'").unionByName(had.where("origin = 'shared'").join(fresh.select("id"), "id", "left_anti"))
    known = had.where("origin = 'shared'").select("id", F.col("aliases").alias("__known"))
    new = fresh.join(had.where("origin = 'local'").select("id"), "id", "left_anti").join(known, "id", "left")
    new = new.withColumn("aliases", F.when(F.coalesce("__known", F.lit("")) != "", F.col("__known")).otherwise(F.col("aliases"))).withColumn("origin", F.lit("shared"))
    whole = layers.relations.where("origin = 'local'").unionByName(relations.select("id", "a", "relation", "b").withColumn("origin", F.lit("shared")))
    layers = replace(layers, entities=stored(kept.unionByName(new.select(kept.columns)), "entities"), relations=whole)
    ours = layers.entities.where("origin = 'shared'").select("id")
    told = gone.dropDuplicates(["id"])
    follow = told.where("merged_into is not null").join(ours, "id", "left_semi").join(ours.withColumnRenamed("id", "merged_into"), "merged_into", "left_semi")
    layers = merged(layers, follow.select(F.col("id").alias("loser"), F.col("merged_into").alias("winner")), seq)
    lost = layers.entities.where("origin = 'shared'").select("id").join(told.select("id"), "id", "left_semi").unionByName(layers.entities.where("origin = 'shared'").select("id").join(fresh.select("id"), "id", "left_anti")).distinct()
    used = _references(layers, "local").select(F.col("entity").alias("id")).distinct().withColumn("used", F.lit(True))
    fate = stored(lost.join(used, "id", "left").select("id", F.coalesce("used", F.lit(False)).alias("stays")), "lost")
    entities = layers.entities.join(fate, "id", "left").where("stays is null or stays").withColumn("origin", F.when(F.col("stays"), "local").otherwise(F.col("origin"))).drop("stays")
    return replace(layers, entities=stored(entities, "entities"))
