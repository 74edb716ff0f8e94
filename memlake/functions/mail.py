"""Column functions on mail: headers, addresses, reply chains, signatures, dates, deadlines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns that results depend on.
REPLY_MARKERS = [
    r"(?im)^on .{5,200}wrote:\s*$",
    r"(?im)^-{2,}\s*original message\s*-{2,}",
    r"(?im)^-{2,}\s*forwarded message\s*-{2,}",
    r"(?im)^from:.*\n(sent|date|to):",
    r"(?m)^_{10,}\s*$",
]
CLOSINGS = "regards|kind regards|best regards|best|cheers|thanks|many thanks|thank you|blessings|sincerely|yours"
IMPERATIVES = (
    "email send review update check prepare create build investigate follow confirm complete schedule coordinate write draft call contact add remove fix "
    "test deploy setup configure run submit request provide arrange register migrate upload document implement organise organize present finalise finalize "
    "publish share order book ensure meet discuss reply respond escalate approve sign process"
).split()
WEEKDAYS = "monday tuesday wednesday thursday friday saturday sunday".split()
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
NUMBERS = {"a": 1, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7}
DEADLINES = [
    r"\bby\s+(next\s+)?(?:Mon(?:day)?|Tue(?:sday)?|Wed(?:nesday)?|Thu(?:rsday)?|Fri(?:day)?|Sat(?:urday)?|Sun(?:day)?)\b",
    r"\bby\s+(?:EOD|COB)\b",
    r"\b(?:EOD|COB)\s+(\w+day|tomorrow|today)\b",
    r"\bby\s+end\s+of\s+(?:the\s+)?(?:week|month|day)\b",
    r"\bend\s+of\s+(?:the\s+)?month\b",
    r"\bEOM\b",
    r"\b(?:this|next)\s+week\b",
    r"\btomorrow\b",
    r"\btoday\b",
    r"\bin\s+\d+\s+(?:days?|weeks?)\b",
    r"\bin\s+(?:a|one|two|three|four|five|six|seven)\s+(?:days?|weeks?)\b",
    r"\bnext\s+(?:Mon(?:day)?|Tue(?:sday)?|Wed(?:nesday)?|Thu(?:rsday)?|Fri(?:day)?|Sat(?:urday)?|Sun(?:day)?)\b",
    r"\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b",
    r"\b\d{4}-\d{2}-\d{2}\b",
    r"\b(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?|Sep(?:tember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)\s+\d{1,2}(?:st|nd|rd|th)?\b",
]
BULK_SUBJECT = r"(?i)^(newsletter|digest|weekly|daily)\b"
# End of fixed values.


def address(header: Column) -> Column:
    """The address in a header: what stands in <>, or the bare address; lower case, '' if none."""
    inner = F.regexp_extract(header, r"<\s*([^<>\s]+@[^<>\s]+)\s*>", 1)
    bare = F.regexp_extract(header, r"([^\s<>,;\"]+@[^\s<>,;\"]+)", 1)
    return F.lower(F.coalesce(F.when(inner != "", inner).otherwise(bare), F.lit("")))


def display_name(header: Column) -> Column:
    """The name before the address, without quotes; '' if there is none."""
    return F.trim(F.regexp_replace(F.regexp_extract(F.coalesce(header, F.lit("")), r"^([^<]*)<", 1), '"', ""))


def sent_at(header: Column) -> Column:
    """RFC 2822 or ISO dates as timestamps; null where neither."""
    iso = F.try_to_timestamp(header)
    rfc = F.try_to_timestamp(F.regexp_replace(F.regexp_replace(header, r"^[A-Za-z]{3},\s*", ""), r"\s*\([A-Z]+\)$", ""), F.lit("d MMM yyyy HH:mm:ss Z"))
    return F.coalesce(rfc, iso)


def own_text(body: Column) -> Column:
    """The text above the earliest reply marker, without quoted lines."""
    body = F.coalesce(body, F.lit(""))
    end = F.least(F.char_length(body) + 1, *[F.nullif(F.regexp_instr(body, F.lit(m)), F.lit(0)) for m in REPLY_MARKERS])
    lines = F.split(F.substring(body, F.lit(1), end - 1), "\n")
    return F.trim(F.array_join(F.filter(lines, lambda x: ~x.rlike(r"^\s*>")), "\n"), F.lit(" \n\r\t"))


def signature(text: Column) -> Column:
    """What follows a '-- ' line, or a closing phrase in the last seven tenths; '' if none."""
    cut = F.regexp_instr(text, F.lit(r"(?m)^-- ?$"))
    close = F.regexp_instr(text, F.lit(rf"(?im)^({CLOSINGS}),?\s*$"))
    late = close > 0.3 * F.char_length(text)
    at = F.when(cut > 0, cut).when(late, close).otherwise(F.lit(0))
    return F.when(at > 0, F.substring(text, at, F.char_length(text))).otherwise("")


def is_bulk(headers: Column, subject: Column) -> Column:
    """By list headers, precedence or automatic submission; headers are array<struct<name,value>>."""
    name, value = (lambda h: F.lower(h["name"])), (lambda h: F.lower(h["value"]))
    listed = F.exists(headers, lambda h: name(h).isin("list-unsubscribe", "list-id") | ((name(h) == "precedence") & value(h).isin("bulk", "list", "junk")) | ((name(h) == "auto-submitted") & (value(h) != "no")))
    return F.coalesce(listed, F.lit(False)) | F.coalesce(subject.rlike(BULK_SUBJECT), F.lit(False))


def _day_of(phrase: Column, written: Column) -> Column:
    """The date that a phrase (lower case) names, relative to a day; null if it names none. Dates are day before month; a month's day is the next one to come."""
    part = lambda pattern, k=1: F.regexp_extract(phrase, pattern, k)
    iso = F.try_to_date(part(r"(\d{4}-\d{2}-\d{2})"), "yyyy-MM-dd")
    dmy, year = r"\b(\d{1,2})[/-](\d{1,2})[/-](\d{2,4})$", part(r"\b\d{1,2}[/-]\d{1,2}[/-](\d{2,4})$").try_cast("int")
    date = lambda y, m, d: F.try_to_date(F.concat_ws("-", y.cast("string"), m.cast("string"), d.cast("string")), "y-M-d")
    numbered = date(F.when(year < 100, year + 2000).otherwise(year), part(dmy, 2), part(dmy, 1))
    head, named = part(r"\b(mon|tue|wed|thu|fri|sat|sun)"), F.lit(None).cast("date")
    for d in WEEKDAYS:
        named = F.when(head == d[:3], F.next_day(written, d[:3])).otherwise(named)
    word, count = part(r"\bin\s+(\w+)\s"), F.lit(None).cast("int")
    for w, n in NUMBERS.items():
        count = F.when(word == w, n).otherwise(count)
    ahead = F.coalesce(word.try_cast("int"), count) * F.when(phrase.rlike("weeks?$"), 7).otherwise(1)
    month, day = F.array_position(F.array(*map(F.lit, MONTHS)), part(r"^([a-z]{3})[a-z]*\s+\d")).cast("int"), part(r"^[a-z]+\s+(\d{1,2})").try_cast("int")
    this = date(F.year(written), month, day)
    return F.coalesce(
        iso,
        numbered,
        F.when(phrase.rlike(r"^(by )?end\s+of\s+(the\s+)?month$|^eom$"), F.last_day(written)),
        F.when(phrase.rlike(r"tomorrow"), F.date_add(written, 1)),
        F.when(phrase.rlike(r"today|^by\s+(eod|cob)$|end\s+of\s+(the\s+)?day"), written),
        F.date_add(written, ahead),
        F.when(month > 0, F.when(this < written, date(F.year(written) + 1, month, day)).otherwise(this)),
        F.when(phrase.rlike(r"end\s+of\s+(the\s+)?week|this\s+week"), F.when(F.dayofweek(written) == 6, written).otherwise(F.next_day(written, "Fri"))),
        F.when(phrase.rlike(r"next\s+week"), F.date_add(written, 7)),
        named,
    )


def deadline(text: Column, written: Column) -> Column:
    """A date named in a request, relative to the day it was written: by the first of the patterns that names one; null if none does."""
    text = F.coalesce(text, F.lit(""))
    return F.coalesce(*[F.when(text.rlike(f"(?i){p}"), _day_of(F.lower(F.regexp_extract(text, f"(?i){p}", 0)), written)) for p in DEADLINES])


def owner_confidence(sender_is_owner: Column, text: Column) -> Column:
    """How sure it is that the owner is asked: 0.8 of own words, 0.6 of an imperative, else 0."""
    return F.when(sender_is_owner, 0.8).when(F.lower(F.regexp_replace(F.split(F.trim(text), r"\s+")[0], "[.,:]+$", "")).isin(IMPERATIVES), 0.6).otherwise(0.0)


def questions(text: Column, most: int = 5) -> Column:
    """The first distinct sentences that ask or command."""
    sentences = F.transform(F.split(F.coalesce(text, F.lit("")), r"(?<=[.!?])\s+"), lambda s: F.trim(s))
    wanted = F.filter(sentences, lambda s: F.endswith(s, F.lit("?")) | F.lower(F.split(s, r"\s+")[0]).isin(IMPERATIVES))
    return F.slice(F.array_distinct(wanted), 1, most)


def reuse(snippet: Column, response: Column, least_tokens: int = 5) -> Column:
    """Share of the snippet's words in the response; 0 for short snippets."""
    from memlake.functions.text import tokens

    words = F.array_distinct(tokens(snippet))
    return F.when(F.size(words) < least_tokens, 0.0).otherwise(F.size(F.array_intersect(words, F.array_distinct(tokens(response)))) / F.size(words))
