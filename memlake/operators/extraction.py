"""Extractions of threads, applied to the graph: entities, links, relations, topics, digests, actions and
the ids of actions that were dropped, in one version.

An extraction is one nested row a thread (EXTRACTION). Applying a batch writes all of these tables as one version
of a TableSet: readers see all of it or nothing. Every row is keyed by what it says (links by message and
entity, relations by source and triple, actions by thread and words), so that a batch applied again changes
nothing, and counts are taken from keys instead of being counted up.

Actions: those of automated mail and of mail older than AGE_DAYS that has left the inbox are not taken. Within an
extraction each is held against those kept before it. Across threads, of one owner's actions that are much the
same within WINDOW_DAYS only the first stays, each held against those kept before it; actions that are
stored already come first. Resolved ones are closed by the words, within their thread.

Defined results: extractions without messages are passed over; of several of one thread in a batch the one whose lead is the
latest counts (ties: the smallest hash). Names of nothing but marks name no entity; junk names neither. Null lists are
empty. Relations and owners that name no entity of the extraction are kept by name only (entity null) or, for
relations, dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlake.functions import text as X
from memlake.operators.graph import components, rarest_words
from memlake.session import ship
from memlake.shared import scratch, stored
from memlake.sources.store import TableSet

EXTRACTION = """
thread_id string, org string, content_type string, in_inbox boolean, summary string, topics array<string>,
messages array<struct<message_id:string,day:date,sender:string>>,
entities array<struct<name:string,kind:string,org:string,email:string>>,
relations array<struct<a:string,relation:string,b:string,strength:double>>,
actions array<struct<description:string,owner:string,due:date>>,
resolved array<string>
"""

#: Ids of a batch are broadcast up to this number (some 100 bytes each); beyond it they are joined by a shuffle.
MAX_BROADCAST_IDS = 1_000_000
#: Actions of one owner and two cells of days that a task compares in memory; more meet by their words.
IN_PLACE = 64

# Gates and thresholds that results depend on.
AGE_DAYS, WINDOW_DAYS = 60, 7
SAME_IN_BATCH, SAME_WORDS, LENGTHS = 0.75, 0.85, 0.6
# End of fixed values.

TABLES = {
    "entities": "entity string, name string, kind string, org string, email string, first_seen date, last_seen date, n_messages long",
    "links": "message_id string, entity string, day date",
    "relations": "thread_id string, a string, relation string, b string, strength double, valid_from date",
    "topics": "message_id string, topic string",
    "digests": "thread_id string, message_id string, day date, org string, content_type string, summary string, topics string",
    "dropped": "action string",
    "actions": "action string, thread_id string, owner string, owner_entity string, text string, norm string, due date, day date, status string, resolved_by string",
}


def led(batch: DataFrame) -> DataFrame:
    """Extractions with the earliest message as their lead: message_id and day in place of messages."""
    first = F.array_min(F.transform(F.filter("messages", lambda m: m["message_id"].isNotNull()), lambda m: F.struct(m["day"].isNull().alias("none"), m["day"].alias("day"), m["message_id"].alias("message_id"))))
    return batch.withColumn("lead", first).where("lead is not null and thread_id is not null").withColumns({"message_id": F.col("lead.message_id"), "day": F.col("lead.day")}).drop("lead", "messages")


def one_a_thread(read: DataFrame, also: str) -> DataFrame:
    """Of several stored rows of a thread that with the latest lead; ties by the hash of all but the column `also`. Only threads that have several rows are shuffled whole."""
    several = stored(read.groupBy("thread_id").agg(F.count("*").alias("n")).where("n > 1").select("thread_id"), "several")
    if not several.head(1):
        return read
    rest = [c for c in read.columns if c != "thread_id"]
    order = F.struct("day", -F.xxhash64(F.to_json(F.struct(*sorted(c for c in read.columns if c != also)))))
    best = read.join(few(several), "thread_id", "left_semi").groupBy("thread_id").agg(F.max_by(F.struct(*rest), order).alias("r")).select("thread_id", "r.*")
    return stored(read.join(few(several), "thread_id", "left_anti").unionByName(best), "extractions")


def people(entities: Column) -> Column:
    """Names and ids (kind:slug; null for a name without letters or digits) made once for each: id of the name as given, entity of the canonical one, null for junk.

    Step by step, as what a lambda names twice is computed twice.
    """
    named = F.transform(entities, lambda e: F.struct(X.canonical_name(e["name"]).alias("name"), F.coalesce(e["kind"], F.lit("person")).alias("kind"), e["org"].alias("org"), e["email"].alias("email")))
    kept = lambda p: [p[c].alias(c) for c in ("name", "kind", "org", "email")]
    bare = F.transform(named, lambda p: F.struct(*kept(p), X.slug(p["name"]).alias("slug"), X.canonical_name(p["name"]).alias("again"), X.is_junk_name(p["name"], p["kind"]).alias("junk")))
    told = F.transform(bare, lambda p: F.struct(*kept(p), p["slug"].alias("slug"), F.when(p["junk"], "").when(p["again"] == p["name"], p["slug"]).otherwise(X.slug(p["again"])).alias("fit")))
    name = lambda p, c: F.when(p[c] != "", F.concat_ws(":", p["kind"], p[c]))
    return F.transform(told, lambda p: F.struct(*kept(p), name(p, "slug").alias("id"), name(p, "fit").alias("entity")))


def distinct_in_order(descriptions: Column) -> Column:
    """Indexes of the array's texts that are kept: not equal to one kept before, nor contained in it or containing it, nor of nearly the same words."""
    norms = F.transform(descriptions, X.normalised_title)
    none = F.array().cast("array<struct<at:int,norm:string>>")

    def same(a: Column, b: Column) -> Column:
        return (a == b) | F.contains(a, b) | F.contains(b, a) | (X.jaccard(F.split(a, " "), F.split(b, " ")) >= SAME_IN_BATCH)

    def step(kept: Column, x: Column) -> Column:
        return F.when((x["norm"] == "") | F.exists(kept, lambda k: same(k["norm"], x["norm"])), kept).otherwise(F.concat(kept, F.array(x)))

    rows = F.transform(norms, lambda n, k: F.struct(k.cast("int").alias("at"), n.alias("norm")))
    return F.aggregate(rows, none, step)


def proposed(found: DataFrame, as_of: str) -> DataFrame:
    """Actions of extractions past the gates, de-duplicated within each: keyed by thread and words."""
    old = ~F.coalesce("in_inbox", F.lit(False)) & (F.datediff(F.lit(as_of).cast("date"), "day") > AGE_DAYS)
    gated = found.where(~F.coalesce(old, F.lit(False)) & (F.coalesce("content_type", F.lit("")) != "notification"))
    actions = F.coalesce("actions", F.array().cast("array<struct<description:string,owner:string,due:date>>"))
    rows = gated.withColumn("acts", actions).withColumn("kept", distinct_in_order(F.transform("acts", lambda a: F.coalesce(a["description"], F.lit("")))))
    # not explode: Spark would filter by the size of kept, and make it twice for that
    each = rows.select("thread_id", "day", "people", F.explode_outer("kept").alias("k"), "acts").where("k is not null").withColumn("a", F.get("acts", F.col("k.at")))
    owner = F.trim(F.coalesce("a.owner", F.lit("")))
    at = F.array_position(F.col("people.name"), X.canonical_name(F.col("a.owner")))
    unclear = (owner == "") | (F.lower(owner) == "unclear")
    return each.select(
        F.sha2(F.concat_ws("\n", "thread_id", "k.norm"), 256).alias("action"),
        "thread_id",
        F.when(unclear, "unclear").otherwise(owner).alias("owner"),
        F.when(~unclear, F.get(F.col("people.id"), (at - 1).cast("int"))).alias("owner_entity"),
        F.trim("a.description").alias("text"),
        F.col("k.norm").alias("norm"),
        F.col("a.due").alias("due"),
        "day",
        F.lit("open").alias("status"),
        F.lit(None).cast("string").alias("resolved_by"),
    )


def much_the_same(rows: DataFrame) -> DataFrame:
    """(early, late): pairs of rows (n, owner, norm, day) of one owner within the window, early of the smaller n.

    Much the same: equal words of the title, or, with lengths not too different, the words of one among the other's, or
    nearly the same words. The row with fewer words is met by its rarest ones, the other by all: an equality
    join of word and cell of days, whose rows have the titles, so that only pairs that are much the same leave it. Rows
    equal in owner, norm and day are one before.
    """
    words = F.array_distinct(F.split("norm", " "))
    sets = rows.select("n", "owner", "norm", "day", words.alias("w"))
    rare = rarest_words(sets, ["n", "norm", "day"], "w", SAME_WORDS, ["owner"])
    cell = F.floor(F.unix_date("day") / (WINDOW_DAYS + 1))
    few = rare.select("owner", "word", F.col("n").alias("a"), F.col("norm").alias("x"), F.col("day").alias("da"), F.explode(F.array(cell, cell - 1, cell + 1)).alias("cell"))
    many = sets.select("owner", F.explode("w").alias("word"), F.col("n").alias("b"), F.col("norm").alias("y"), F.col("day").alias("db"), cell.alias("cell"))
    x, y = (F.array_distinct(F.split(c, " ")) for c in ("x", "y"))
    size = F.char_length
    lengths = F.least(size("x"), size("y")) / F.greatest(size("x"), size("y")) >= LENGTHS
    shared = (F.size(F.array_except(x, y)) == 0) | (X.jaccard(x, y) >= SAME_WORDS)
    near = (F.col("a") != F.col("b")) & (F.abs(F.datediff("da", "db")) <= WINDOW_DAYS)
    alike = (F.col("x") == F.col("y")) | ((F.size(x) <= F.size(y)) & lengths & shared)
    return few.join(many, ["owner", "word", "cell"]).where(near & alike).select(F.least("a", "b").alias("early"), F.greatest("a", "b").alias("late")).distinct()


def near_in_place(rows: DataFrame) -> DataFrame:
    """(a, b): pairs as of much_the_same, in any order, among rows of one owner and cell of days or the cell before; (a, null) for each row where these are more than IN_PLACE.

    A row goes to two cells and is compared there, so that the shuffle has two rows for each instead of some for each of its words.
    """
    cell = F.floor(F.unix_date("day") / (WINDOW_DAYS + 1))
    dealt = rows.select("owner", F.explode(F.array(cell, cell + 1)).alias("cell"), cell.alias("own"), F.unix_date("day").alias("day"), "n", "norm")
    dealt = dealt.repartition("owner", "cell").sortWithinPartitions("owner", "cell")
    ship(rows.sparkSession)
    most = IN_PLACE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, size = None, [], 0
        for batch in batches:
            pairs: list[tuple[int, int | None]] = []
            for owner, cell, own, day, n, norm in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
                if (owner, cell) != at:
                    pairs += _alike(held)
                    at, held, size = (owner, cell), [], 0
                size += 1
                if size <= most:
                    held.append((n, day, own == cell, norm))
                    continue
                pairs += [(x[0], None) for x in held]
                held = []
                pairs.append((n, None))
            yield _pairs(pairs)
        yield _pairs(_alike(held))

    return dealt.mapInArrow(run, "a long, b long")


def _pairs(pairs: list[tuple[int, int | None]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in range(2)], names=["a", "b"])


def _alike(rows: list[tuple[int, int, bool, str]]) -> list[tuple[int, int]]:
    """The pairs of rows (n, day, own, norm) that are much the same; two that are both of the cell before are compared there."""
    if len(rows) < 2:
        return []
    out, sets = [], [set(r[3].split(" ")) for r in rows]
    for k, (a, da, own, x) in enumerate(rows):
        for j in range(k):
            b, db, other, y = rows[j]
            if not (own or other) or abs(da - db) > WINDOW_DAYS:
                continue
            v, w = sorted((sets[k], sets[j]), key=len)
            near = min(len(x), len(y)) >= LENGTHS * max(len(x), len(y)) and (v <= w or len(v & w) >= SAME_WORDS * len(v | w))
            if x == y or near:
                out.append((a, b))
    return out


def kept_in_order(pairs: DataFrame) -> DataFrame:
    """(n) of the rows that go, of pairs (early, late) of numbers: each stays unless one that stays comes before it.

    What is linked by pairs is decided together, in order, and apart from all else.
    """
    linked = components(pairs.select(F.col("early").alias("a"), F.col("late").alias("b"))).toDF("early", "component")
    ordered = pairs.join(linked, "early").select("component", "early", "late").repartition("component").sortWithinPartitions("component", "late")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, gone = None, set()
        for batch in batches:
            out = []
            for component, early, late in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if component != at:
                    at, gone = component, set()
                if early not in gone and late not in gone:
                    gone.add(late)
                    out.append(late)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64())], names=["n"])

    return ordered.mapInArrow(run, "n long")


def few(df: DataFrame) -> DataFrame:
    """df, to be broadcast if it has at most MAX_BROADCAST_IDS rows: what a batch touches, held against whole tables."""
    return F.broadcast(df) if df.count() <= MAX_BROADCAST_IDS else df


def paired(first: DataFrame) -> DataFrame:
    """(early, late, action): pairs of much the same rows of first (n, owner, norm, day, place) by their numbers in the order of places, with the later one's action. Only what is in pairs is put in order."""
    near = stored(near_in_place(first), "near")
    met, crowd = near.where("b is not null"), near.where("b is null")
    if crowd.head(1):
        held = stored(first.join(few(stored(crowd.select(F.col("a").alias("n")).distinct(), "crowd")), "n", "left_semi"), "crowded")
        met = met.unionByName(much_the_same(held).toDF("a", "b"))
    met = stored(met, "met")
    if not met.head(1):
        return met.toDF("early", "late").withColumn("action", F.lit(None).cast("string"))
    among = few(stored(met.select(F.explode(F.array("a", "b")).alias("n")).distinct(), "among"))
    # numbers go up with the place
    numbered = stored(first.select("n", "place").join(among, "n", "left_semi").orderBy("place").select("n", F.monotonically_increasing_id().alias("at"), F.col("place.action").alias("action")), "numbered")
    of = lambda c: numbered.select(F.col("n").alias(c), F.struct("at", "action").alias(f"_{c}"))
    both = met.join(few(of("a")), "a").join(few(of("b")), "b")
    return both.select(F.least("_a.at", "_b.at").alias("early"), F.greatest("_a", "_b").alias("late")).select("early", F.col("late.at").alias("late"), F.col("late.action").alias("action")).distinct()


def merged_actions(old: DataFrame, new: DataFrame, dropped: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stored actions and those of new ones that aren't much the same as one kept before them; and the ids of all that were dropped.

    What was dropped once is not asked again, though what it was held against may be done by now. Of what is stored
    only the owners of new actions are looked at: nothing stored is much the same as something else that is open.
    """
    names = [c.split()[0] for c in TABLES["actions"].split(", ")]
    fresh, known = stored(new, "asked"), old.select("action").unionByName(dropped)
    if known.head(1):
        known = known.join(few(fresh.select("action")), "action", "left_semi")
        fresh = stored(fresh.join(known, "action", "left_anti"), "fresh")
    if not fresh.head(1):
        return old.select(names), dropped
    owners = stored(fresh.select("owner").distinct(), "owners")
    open_ones = old.where("status = 'open'").join(owners, "owner", "left_semi")
    both = open_ones.select("action", "owner", "norm", "day", F.lit(0).alias("turn")).unionByName(fresh.select("action", "owner", "norm", "day", F.lit(1).alias("turn")))
    dated = both.where("day is not null")
    # equal owner, words and day: whatever becomes of the first, the others go
    place = F.struct("turn", "day", "action")
    first = dated.groupBy("owner", "norm", "day").agg(F.min(place).alias("place"), F.count("*").alias("times"))
    first = stored(first.select(F.monotonically_increasing_id().alias("n"), "owner", "norm", "day", "place", "times"), "first")
    several = stored(first.where("times > 1").select("owner", "norm", "day", F.col("place.action").alias("id")), "several")
    again = dated.where("turn = 1").join(several, ["owner", "norm", "day"]).where("action <> id").select("action")
    pairs = stored(paired(first), "pairs")
    if pairs.head(1):
        late = stored(kept_in_order(pairs.select("early", "late")).distinct(), "late")
        again = again.unionByName(pairs.select(F.col("late").alias("n"), "action").join(late, "n", "left_semi").select("action"))
    gone = stored(again.distinct(), "gone")
    return old.select(names).unionByName(fresh.join(gone, "action", "left_anti").select(names)), dropped.unionByName(gone)


def apply(tables: TableSet, batch: DataFrame, as_of: str) -> int:
    """Apply a batch of extractions; gives the version that holds it. What is stored on the way is deleted at the end."""
    with scratch(tables.spark):
        return _apply(tables, batch, as_of)


def _apply(tables: TableSet, batch: DataFrame, as_of: str) -> int:
    version = tables.version()
    spark = tables.spark
    had = {n: tables.read(n) if version else None for n in TABLES}
    old = {n: df if df is not None else spark.createDataFrame([], TABLES[n]) for n, df in had.items()}
    found = one_a_thread(stored(led(batch).withColumn("people", people(F.col("entities"))), "extractions"), "people").drop("entities")
    named = found.select("thread_id", "message_id", "day", F.explode("people").alias("e")).where("e.entity is not null").select("thread_id", "message_id", "day", "e.name", "e.kind", "e.entity", "e")
    # rows of messages and threads that the batch doesn't touch stay as they are, without a shuffle
    told, threads = few(found.select("message_id").distinct()), few(found.select("thread_id"))
    rest = lambda n, ids: old[n].join(ids, ids.columns, "left_anti")
    met = old["links"].join(told, "message_id", "left_semi").unionByName(named.select("message_id", "entity", "day"))
    links = rest("links", told).unionByName(met.groupBy("message_id", "entity").agg(F.min("day").alias("day")).select("message_id", "entity", "day"))
    links = stored(links, "links")
    seen = links.groupBy("entity").agg(F.min("day").alias("first_seen"), F.max("day").alias("last_seen"), F.count("*").alias("n_messages"))
    # the latest word counts, of what was said on one day the smallest; what is stored counts as said on its last day
    org = F.when(~F.coalesce("e.org", F.lit("")).isin("", "unknown"), F.col("e.org"))
    said = named.select("entity", "name", "kind", org.alias("org"), F.nullif(F.trim("e.email"), F.lit("")).alias("email"), "day")
    said = said.unionByName(old["entities"].select("entity", "name", "kind", "org", "email", F.col("last_seen").alias("day")))
    latest = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.struct(-F.unix_date(F.coalesce("day", F.lit("1970-01-01").cast("date"))), c))).alias(c)
    entities = said.groupBy("entity").agg(F.min("name").alias("name"), F.min("kind").alias("kind"), latest("org"), latest("email")).join(seen, "entity", "left")
    triple = "array<struct<a:string,relation:string,b:string,strength:double>>"
    low = lambda name: F.lower(X.canonical_name(name))
    keyed = F.transform(F.coalesce("relations", F.array().cast(triple)), lambda r: F.struct(low(r["a"]).alias("a"), r["relation"].alias("relation"), low(r["b"]).alias("b"), r["strength"].alias("strength")))
    # named in the array: a filter on what explode gives would be computed twice
    called = found.select("thread_id", "day", keyed.alias("r"), F.transform("people", lambda p: F.struct(F.lower(p["name"]).alias("key"), p["entity"].alias("entity"))).alias("people"))
    entity = lambda name: F.array_min(F.transform(F.filter("people", lambda p: p["key"] == name), lambda p: p["entity"]))
    ends = F.transform("r", lambda r: F.struct(entity(r["a"]).alias("a"), entity(r["b"]).alias("b"), r["relation"].alias("relation"), r["strength"].alias("strength")))
    ends = called.select("thread_id", "day", F.explode_outer(ends).alias("r")).select("thread_id", "day", "r.*")
    stated = ends.where("a <> b and relation is not null").groupBy("thread_id", "a", "relation", "b").agg(F.sum("strength").alias("strength"), F.min("day").alias("valid_from"))
    relations = stated.unionByName(rest("relations", threads))
    tags = F.array_distinct(F.filter(F.transform(F.coalesce("topics", F.array().cast("array<string>")), lambda t: F.lower(F.trim(t))), lambda t: t != ""))
    topics = old["topics"].join(told, "message_id", "left_semi").unionByName(found.select("message_id", F.explode(tags).alias("topic"))).distinct()
    topics = rest("topics", told).unionByName(topics)
    digests = found.select("thread_id", "message_id", "day", "org", "content_type", "summary", F.array_join(tags, ", ").alias("topics"))
    digests = digests.unionByName(rest("digests", threads))
    closed = found.select("thread_id", "message_id", F.explode(F.coalesce("resolved", F.array().cast("array<string>"))).alias("what")).groupBy("thread_id", X.normalised_title(F.col("what")).alias("norm")).agg(F.min("message_id").alias("by"))
    actions, dropped = merged_actions(old["actions"], proposed(found, as_of), old["dropped"])
    actions = actions.join(few(stored(closed, "closed")), ["thread_id", "norm"], "left")
    open_one = (F.col("status") == "open") & F.col("by").isNotNull()
    actions = actions.withColumns({"resolved_by": F.when(open_one, F.col("by")).otherwise(F.col("resolved_by")), "status": F.when(open_one, "done").otherwise(F.col("status"))})
    made = {"entities": entities, "links": links, "relations": relations, "topics": topics, "digests": digests, "dropped": dropped, "actions": actions}
    return tables.commit({n: df.select([c.split()[0] for c in TABLES[n].split(", ")]) for n, df in made.items()}, after=version)
