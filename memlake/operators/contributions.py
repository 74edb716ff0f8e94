"""What a store tells others: claims from its relations, by an allow-list, without what is private, never an echo.

Every guard fails closed: a row leaves only if each of them is met. A relation is told if it is local, its kind is on the
list, it stands on a document that is known and not cold, and both its ends are local entities of a kind that
is shared, with a name that looks like one and no role mailbox. Claims have no addresses and no document: of the
document there is a keyed hash, of names what is left without affiliations and brackets, of aliases those that look
like names.

Defined results: nothing leaves without a secret or an empty allow-list; null origins count as local, all other nulls fail. Equal
claims are one. An id that several entities have is told of none.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlake.functions import keys as K
from memlake.functions import text as X

KINDS = ("person", "org")
CLAIM = "kind string, subject string, relation string, object string, name string, entity_kind string, aliases string, confidence double, valid_from date, source_ref string"


def shareable(entities: DataFrame, kinds: Sequence[str] = KINDS) -> DataFrame:
    """(entity, name, entity_kind, aliases) of the entities (id, name, kind, email, aliases, origin) that may be told of."""
    alone = entities.where("id is not null").groupBy("id").agg(F.count("*").alias("n"), F.first("name").alias("name"), F.first("kind").alias("kind"), F.first("email").alias("email"), F.first("aliases").alias("aliases"), F.first(F.coalesce("origin", F.lit("local"))).alias("origin"))
    name = K.clean_name(K.without_affiliation(F.col("name")))
    role = F.coalesce(X.is_role_mailbox(F.col("email")), F.lit(False))
    fit = (F.col("n") == 1) & (F.col("origin") == "local") & F.col("kind").isin(*kinds) & ~role & K.is_name_like(name)
    return alone.where(F.coalesce(fit, F.lit(False))).select(F.col("id").alias("entity"), name.alias("name"), F.col("kind").alias("entity_kind"), K.safe_aliases(F.col("aliases")).alias("aliases"))


def contributions(relations: DataFrame, entities: DataFrame, documents: DataFrame, allowed: Sequence[str], secret: str, kinds: Sequence[str] = KINDS) -> DataFrame:
    """Claims (CLAIM): one for a relation, and one for each of its ends, for every document that says so.

    relations (a, relation, b, doc_id, valid_from, confidence, origin), documents (doc_id, cold).
    """
    spark = relations.sparkSession
    if not secret or not allowed:
        return spark.createDataFrame([], CLAIM)
    warm = documents.groupBy("doc_id").agg(F.bool_and(~F.coalesce("cold", F.lit(True))).alias("warm")).where("warm").select("doc_id")
    local = relations.where((F.coalesce("origin", F.lit("local")) == "local") & F.col("relation").isin(*allowed) & (F.col("doc_id") != ""))
    fit = shareable(entities, kinds)
    end = lambda side: fit.select(F.col("entity").alias(side), F.struct("name", "entity_kind", "aliases").alias(f"{side}_end"))
    # documents come last: equal claims stand on one document, so rows dealt by it become claims, once each, where they are
    told = local.select("a", "relation", "b", "doc_id", "valid_from", "confidence").join(end("a"), "a").join(end("b"), "b").join(warm, "doc_id")
    text = lambda c: F.col(c) if isinstance(c, str) else F.lit(None).cast("string")

    def claim(kind: str, subject: str, end_col: str | None):
        named = (lambda f: F.col(f"{end_col}.{f}")) if end_col else (lambda f: text(None))
        confidence = F.lit(1.0) if end_col else F.coalesce("confidence", F.lit(1.0)).cast("double")
        return F.struct(F.lit(kind).alias("kind"), F.col(subject).alias("subject"), text(None if end_col else "relation").alias("relation"), text(None if end_col else "b").alias("object"), named("name").alias("name"), named("entity_kind").alias("entity_kind"), named("aliases").alias("aliases"), confidence.alias("confidence"))

    each = told.select("doc_id", "valid_from", F.explode(F.array(claim("entity", "a", "a_end"), claim("entity", "b", "b_end"), claim("relation", "a", None))).alias("c"))
    once = each.select("c.*", "valid_from", "doc_id").distinct()
    return once.withColumn("source_ref", K.source_ref(secret, F.col("doc_id").cast("string"))).drop("doc_id")
