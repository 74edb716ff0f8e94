"""Secret scans by a trigram inverted index, in DataFrame operations only.

Each rule's regex is turned into a Boolean query of trigrams that every match must contain. The postings
of those trigrams (in segments of documents, so that no list is unbounded) are intersected and united as
the query says; only the candidates are searched by the regex. A rule without mandatory trigrams
searches every document.

Spans are code points, end exclusive, leftmost and non-overlapping within a kind. They follow from the
matches and the gaps between them, as both lists come from the same search. Places are running sums of their
lengths, made in blocks, and masking puts a text together from parts cut once: time is in proportion to the
text and to its hits.

Defined results: a null or empty text has no spans. Documents with equal ids are candidates together and
searched each for itself; a null id is always a candidate. An empty table gives an empty result. Input
columns named like a result are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlake.llm import common as C

try:
    from re import _constants as sre
    from re import _parser as sre_parse
except ImportError:  # before Python 3.11
    import sre_constants as sre
    import sre_parse

#: Documents of one segment of the postings: no posting list is longer.
SEGMENT = 20_000
#: Candidate ids are broadcast up to this number (some 30 bytes each); beyond it they are joined by a shuffle.
MAX_BROADCAST_IDS = 1_000_000
#: Values of one block of running sums, and code points of the parts from which a masked text is put together.
RUN, PART_CHARS = 256, 256
#: Literal alternatives followed up in a regex; wider ones count as unknown.
MAX_STRINGS = 64


def either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


@dataclass(frozen=True)
class Rule:
    """kind, regex, and the fewest characters of a group for a match to count. base: of the base kinds."""

    kind: str
    regex: str
    group: int = 0
    least: int = 1
    base: bool = False


_KEYS = "|".join(map(either_case, ("password", "passwd", "secret", "token", "api_?key")))

RULES = (
    Rule("assign", rf"""({_KEYS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    # A run of one class is matched whole, so that its least length can stand in the regex.
    Rule("access", "AKIA[A-Z0-9]{16,}", base=True),
    Rule("hex", "[0-9a-f]{24,}", base=True),
    Rule("forge", "gh[opsu]_[A-Za-z0-9]{36,}"),
    Rule("chat", "xox[abp]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", least=20),
    Rule("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)

#: A query: all of its clauses hold; a clause: one of its alternatives has all of its trigrams.
Query = list[list[frozenset[str]]]


def trigram_query(regex: str) -> Query:
    """Trigrams, lower-cased, that every match of the regex contains; [] where there are none."""
    clauses: Query = []

    def close(strings: set[str] | None) -> None:
        if strings and all(len(s) >= 3 for s in strings):
            ways = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings}
            clauses.append(sorted((w for w in ways if not any(v < w for v in ways)), key=sorted))

    def walk(nodes, strings: set[str] | None) -> set[str] | None:
        """strings: what may stand just before, exactly; None: unknown. Returns the same after the nodes."""
        for op, arg in nodes:
            options, open_end = exact(op, arg)
            if options is not None:
                joined = {a + b for a in strings or {""} for b in options}
                if len(joined) <= MAX_STRINGS:
                    strings = None if open_end and close(joined) is None else joined
                    continue
            close(strings)
            strings = options if options is not None and len(options) <= MAX_STRINGS and not open_end else None
        return strings

    def exact(op, arg) -> tuple[set[str] | None, bool]:
        """The strings a node may match, None if many; whether more may follow them."""
        if op is sre.LITERAL:
            return {chr(arg).lower()}, False
        if op is sre.IN and all(o in (sre.LITERAL, sre.RANGE) for o, _ in arg):
            chars = {chr(c).lower() for o, a in arg for c in ([a] if o is sre.LITERAL else range(a[0], a[1] + 1))}
            return (chars, False) if len(chars) <= 8 else (None, False)
        if op is sre.SUBPATTERN:
            return sequence(arg[-1])
        if op is sre.BRANCH:
            parts = [sequence(a) for a in arg[1]]
            return (set().union(*(p for p, _ in parts)), any(e for _, e in parts)) if all(p is not None for p, _ in parts) else (None, False)
        if op is sre.MAX_REPEAT:
            low, high, inner = arg
            options, open_end = sequence(inner)
            if options is None or low > 8:
                return None, False
            if (low, high) == (0, 1):
                return options | {""}, open_end
            return ({"".join(x) for x in _power(options, low)}, True) if low and len(options) ** low <= MAX_STRINGS else (None, False)
        return None, False

    def sequence(nodes) -> tuple[set[str] | None, bool]:
        strings: set[str] = {""}
        for op, arg in nodes:
            options, open_end = exact(op, arg)
            if options is None or open_end:
                return None, False
            strings = {a + b for a in strings for b in options}
            if len(strings) > MAX_STRINGS:
                return None, False
        return strings, False

    close(walk(sre_parse.parse(regex), {""}))
    return clauses


def _power(options: set[str], n: int) -> list[tuple[str, ...]]:
    return reduce(lambda done, _: [(*d, o) for d in done for o in options], range(n), [()])


def trigram_index(docs: DataFrame, trigrams: Sequence[str], text_col: str = "text", id_col: str = "doc_id", segment: int = SEGMENT) -> DataFrame:
    """(segment, postings: map from trigram to sorted ids) of the trigrams asked for, over all documents."""
    segments = -(-docs.count() // segment) or 1
    low = F.lower(text_col)
    present = F.array_compact(F.array(*[F.when(F.contains(low, F.lit(t)), F.lit(t)) for t in trigrams])) if trigrams else F.array().cast("array<string>")
    rows = docs.select(F.col(id_col).alias("id"), F.explode(present).alias("trigram")).where("id is not null")
    lists = rows.groupBy(F.pmod(F.xxhash64("id"), F.lit(segments)).alias("segment"), "trigram").agg(F.sort_array(F.collect_set("id")).alias("ids"))
    return lists.groupBy("segment").agg(F.map_from_entries(F.collect_list(F.struct("trigram", "ids"))).alias("postings"))


def _matching(query: Query, postings: Column, empty: Column) -> Column:
    """Ids that satisfy the query: postings intersected within an alternative and between clauses, united within a clause."""
    ids = lambda t: F.coalesce(postings[t], empty)
    ways = [[reduce(F.array_intersect, [ids(t) for t in sorted(way)]) for way in clause] for clause in query]
    return reduce(F.array_intersect, [reduce(F.array_union, way) for way in ways])


def candidates(index: DataFrame, rules: Sequence[Rule], id_type: str = "bigint") -> DataFrame:
    """(id, mask): bit k of the mask says that rule k must be searched for in the document."""
    empty = F.array().cast(f"array<{id_type}>")
    tagged = lambda k: lambda i: F.struct(i.alias("id"), F.lit(1 << k).cast("long").alias("bit"))
    found = [F.transform(_matching(q, F.col("postings"), empty), tagged(k)) for k, r in enumerate(rules) if (q := trigram_query(r.regex))]
    if not found:
        return index.select(F.lit(None).cast(id_type).alias("id"), F.lit(0).cast("long").alias("mask")).limit(0)
    return index.select(F.inline(F.concat(*found))).groupBy("id").agg(F.bit_or("bit").alias("mask"))


def spans(text: Column, rule: Rule) -> Column:
    """array<struct<start, end>> of the rule's matches."""
    regex = F.lit(rule.regex)
    matches, size = F.regexp_extract_all(text, regex, F.lit(0)), F.char_length
    parts = [F.split(text, rule.regex, -1).alias("gap"), matches.alias("hit")]
    if rule.group:
        parts.append(F.regexp_extract_all(text, regex, F.lit(rule.group)).alias("part"))
    # the last gap has no hit
    zipped = F.filter(F.arrays_zip(*parts), lambda x: x["hit"].isNotNull())

    def placed(rows: Column) -> Column:
        ends = running(F.transform(rows, lambda x: (size(x["gap"]) + size(x["hit"])).cast("long")), _sum)
        spans = bind(ends, lambda e: F.transform(rows, lambda x, k: F.struct((F.get(e, k) - size(x["hit"])).alias("start"), F.get(e, k).alias("end"), size(x["part" if rule.group else "hit"]).alias("n"))))
        return F.transform(F.filter(spans, lambda x: x["n"] >= rule.least), lambda x: F.struct(x["start"], x["end"]))

    return bind(zipped, placed)


def bind(value: Column, use) -> Column:
    """use(value), with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _sum(a: Column, b: Column) -> Column:
    return a + b


def running(values: Column, join, levels: int = 2) -> Column:
    """Each value joined (an associative function of two) with all before it; values: array<bigint>.

    In blocks of RUN, and the blocks' ends by the same rule, `levels` deep: with two, a million values cost RUN copied
    references each, and a hundred million still less than reading their text.
    """
    def grown(block: Column) -> Column:
        return F.aggregate(F.slice(block, 2, RUN), F.slice(block, 1, 1), lambda done, x: F.concat(done, F.array(join(F.element_at(done, -1), x))))

    def blocks(a: Column) -> Column:
        starts = F.sequence(F.lit(0), F.floor((F.size(a) - 1) / RUN).cast("int"))
        return bind(F.transform(starts, lambda k: grown(F.slice(a, k * RUN + 1, F.lit(RUN)))), moved)

    def moved(done: Column) -> Column:
        ends = running(F.transform(done, lambda x: F.element_at(x, -1)), join, levels - 1)
        return bind(ends, lambda e: F.flatten(F.transform(done, lambda x, k: F.when(k == 0, x).otherwise(F.transform(x, lambda v: join(F.get(e, k - 1), v))))))

    if levels == 1:
        return bind(values, lambda a: F.aggregate(F.slice(a, F.lit(2), F.greatest(F.size(a), F.lit(1))), F.slice(a, 1, 1), lambda done, x: F.concat(done, F.array(join(F.element_at(done, -1), x)))))
    return bind(values, lambda a: F.when(F.size(a) == 0, a).otherwise(blocks(a)))


def scan_secrets(docs: DataFrame, rules: Sequence[Rule] = RULES, text_col: str = "text", id_col: str = "doc_id", carry: list[str] | None = None) -> DataFrame:
    """Add `secrets`: array<struct<start, kind_no, end, kind>>, sorted, of all rules' spans."""
    indexed = [bool(trigram_query(r.regex)) for r in rules]
    trigrams = sorted({t for r in rules for clause in trigram_query(r.regex) for way in clause for t in way})
    id_type = docs.schema[id_col].dataType.simpleString()
    found = C.stored(candidates(trigram_index(docs, trigrams, text_col, id_col), rules, id_type), "candidates").toDF("__id", "__mask")
    if found.count() <= MAX_BROADCAST_IDS:
        found = F.broadcast(found)
    base = C.without(docs if carry is None else docs.select(*carry), ["secrets"])
    names = list(base.columns)
    fed = docs.select(*[F.col(f"`{n}`") for n in names], F.col(text_col).alias("__text"), F.col(id_col).alias("__key"))
    joined = fed.join(found, F.col("__key") == F.col("__id"), "left")
    text, none = F.col("__text"), F.array().cast("array<struct<start:bigint,kind_no:int,end:bigint,kind:string>>")
    parts = []
    for k, (rule, by_index) in enumerate(zip(rules, indexed, strict=True)):
        searched = F.col("__key").isNull() | (F.col("__mask").bitwiseAND(F.lit(1 << k)) != 0) if by_index else F.lit(True)
        parts.append(F.when(searched & text.rlike(rule.regex), F.transform(spans(text, rule), _named(k, rule.kind))).otherwise(none))
    return joined.select(*[F.col(f"`{n}`") for n in names], F.array_sort(F.concat(*parts)).alias("secrets"))


def _named(k: int, kind: str):
    return lambda s: F.struct(s["start"].alias("start"), F.lit(k).alias("kind_no"), s["end"].alias("end"), F.lit(kind).alias("kind"))


def span_list(secrets: Column) -> Column:
    """kind:start:end, comma-joined, in the order of the spans."""
    return F.concat_ws(",", F.transform(secrets, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def masked(docs: DataFrame, rules: Sequence[Rule] = RULES, text_col: str = "text", id_col: str = "doc_id", mark: str = "[SECRET]") -> DataFrame:
    """docs with every span of text_col replaced by the mark, overlapping spans by one.

    The text is cut into parts once; gaps between spans are put together from them.
    """
    out = scan_secrets(docs, rules, text_col, id_col)
    text = F.col(f"`{text_col}`")

    def between(parts: Column, a: Column, b: Column) -> Column:
        first = F.floor(a / PART_CHARS)
        some = F.slice(parts, (first + 1).cast("int"), (F.ceil(b / PART_CHARS) - first).cast("int"))
        cut = F.transform(some, lambda p, k: bind((first + k) * PART_CHARS, lambda at: F.substring(p, (F.greatest(a - at, F.lit(0)) + 1).cast("int"), (b - F.greatest(a, at)).cast("int"))))
        return F.when(a < b, F.array_join(cut, "")).otherwise("")

    def joined(parts: Column) -> Column:
        covered = running(F.transform("secrets", lambda s: s["end"]), lambda a, b: F.greatest(a, b))
        return bind(covered, lambda e: pieces(parts, e))

    def pieces(parts: Column, covered: Column) -> Column:
        # how far spans before each one reach
        reach = F.transform("secrets", lambda s, k: F.struct(s["start"].alias("start"), F.when(k == 0, F.lit(0).cast("long")).otherwise(F.get(covered, k - 1)).alias("done")))
        marked = F.transform(F.filter(reach, lambda r: r["start"] >= r["done"]), lambda r: F.concat(between(parts, r["done"], r["start"]), F.lit(mark)))
        return F.concat(F.array_join(marked, ""), between(parts, F.element_at(covered, -1), F.char_length(text).cast("long")))

    clean = F.when(F.size("secrets") > 0, bind(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PART_CHARS}}}"), F.lit(0)), joined)).otherwise(text)
    return out.withColumn(text_col, clean).drop("secrets")
