"""Column functions on identifiers, names, artifact names, dates across zones, digests and payloads."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words, patterns and numbers that results depend on.
NAME_PARTICLES = "van von de del della der den di da la le du bin al mac mc".split()
PRIORITIES = {"urgent": 1, "high": 2, "normal": 3, "low": 4}
CHUNKER_VERSION = 2
NOISE_SENDERS = [
    "noreply", "no-reply", "no_reply", "donotreply", "do-not-reply", "mailer-daemon", "postmaster", "notifications@", "newsletter", "automated",
    "autorespond", "bounce@", "support@mailchimp", "msonlineservicesteam", "microsoftonline.com", "updates@", "microsoftstore",
]
NOISE_SUBJECTS = [
    r"^unsubscribe", r"your (order|receipt|invoice|statement|bill)", r"password reset", r"verify your email", r"confirm your (subscription|account|email)",
    r"^\[?automated\]?", r"delivery (failed|notification|status)", r"^ops-brain[:\s]", r"^(daily|morning) briefing", r"^out of office", r"^automatic reply",
    r"^now available\b", r"view (this email )?in (your )?browser", r"\bshop (?:now|today)\b", r"^\d+% off\b",
]
PREFERENCE_WORDS = ["preference", "prefer ", "style guide", "tone of voice", "format default", "convention", "always ", "never ", "i like ", "house style"]
SYSTEM_WORDS = ["system", "tool", "automation", "integration", "workflow", "pipeline", "script", "daemon", "platform", "software"]
PENALTIES = {"high": 0.10, "medium": 0.03, "grounding": 0.05, "coverage": 0.02}
# End of fixed values.


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _stripped(c: Column) -> Column:
    return F.regexp_replace(_text(c), r"(?U)^\s+|\s+$", "")


def cluster_key(thread_id: Column, file_id: Column, event_id: Column) -> Column:
    """The thread, else the file, else the event that a chunk belongs to; a chunk's id in place of a file's is cut to the file; null if there is none."""
    given = lambda c: F.when(_text(c) != "", c)
    key = F.coalesce(given(thread_id), given(file_id), F.when(_text(event_id) != "", F.concat(F.lit("cal-"), event_id)))
    return F.regexp_replace(F.regexp_replace(key, "^gdrive-", ""), r"-\d+$", "")


def file_key(doc_id: Column) -> Column:
    """The file of a drive chunk's id; null for other ids. A file's id may hold hyphens and end in digits."""
    found = F.regexp_extract(_text(doc_id), r"^gdrive-(.+)-(\d+)$", 1)
    return F.when(found != "", found)


def base_event_id(value: Column) -> Column:
    """The event that all instances of a series share."""
    return F.regexp_replace(F.regexp_replace(value, "^cal-", ""), r"_\d{8}T\d{6}Z$", "")


def without_affiliation(name: Column) -> Column:
    """A person's name without '.. from X' or '.. at X'; as it is where nothing would be left."""
    head = F.regexp_extract(_stripped(name), r"(?i)^(.+?)\s+(?:from|at)\s+\S.*$", 1)
    return F.when(head != "", _stripped(head)).otherwise(name)


def clean_name(name: Column) -> Column:
    """Without what stands in brackets or after a dash, slash or colon between spaces."""
    short = F.split(F.split(_text(name), r"[(\[]", 2)[0], r"\s[-–—/;:]\s", 2)[0]
    return F.trim(F.regexp_replace(short, r"\s+", " "))


def is_name_like(token: Column) -> Column:
    """Letters and name marks only, at most 40, and every word begins with a capital or is a particle."""
    t = _stripped(token)
    words = F.filter(F.split(t, r"[.,\s]+"), lambda w: w != "")
    return t.rlike(r"^[\p{L} .,'\-]{1,40}$") & (F.size(words) > 0) & F.forall(words, lambda w: w.rlike(r"^\p{Lu}") | F.lower(w).isin(NAME_PARTICLES))


def safe_aliases(aliases: Column) -> Column:
    """The aliases (comma or bar between them) that look like names, cleaned, each once, comma-joined."""
    kept = F.transform(F.filter(F.split(_text(aliases), r"[|,]"), is_name_like), clean_name)
    return F.array_join(F.array_distinct(F.filter(kept, lambda k: k != "")), ",")


def due_millis(deadline: Column, zone: str) -> Column:
    """Midnight of a day in a zone as epoch milliseconds; null for what is no date. The session's zone is UTC."""
    return F.unix_millis(F.to_utc_timestamp(F.try_to_date(deadline, "yyyy-MM-dd").cast("timestamp"), zone))


def due_day(millis: Column, zone: str) -> Column:
    """The day in a zone of epoch milliseconds; null for none and 0."""
    return F.when(millis != 0, F.date_format(F.from_utc_timestamp(F.timestamp_millis(millis), zone), "yyyy-MM-dd"))


def offset_label(zone: str, now: Column) -> Column:
    """'<zone> (GMT+hh:mm)' at a time."""
    minutes = ((F.unix_millis(F.from_utc_timestamp(now, zone)) - F.unix_millis(now)) / 60000).cast("int")
    sign = F.when(minutes < 0, "-").otherwise("+")
    two = lambda c: F.lpad(c.cast("int").cast("string"), 2, "0")
    return F.concat(F.lit(f"{zone} (GMT"), sign, two(F.floor(F.abs(minutes) / 60)), F.lit(":"), two(F.abs(minutes) % 60), F.lit(")"))


def artifact_parts(name: Column) -> Column:
    """struct<file, hash, fingerprint> of '<file>.<hash>.<fingerprint>.mbc.gz'; null for other names."""
    pattern = r"^(.*)\.([^.]*)\.([^.]*)\.mbc\.gz$"
    part = lambda k: F.regexp_extract(name, pattern, k)
    return F.when(name.rlike(pattern), F.struct(part(1).alias("file"), part(2).alias("hash"), part(3).alias("fingerprint")))


def chunker_version(pin: Column, code: int = CHUNKER_VERSION) -> Column:
    """The pinned version, or that of the code where the pin lags behind it."""
    number = F.coalesce(F.regexp_extract(_text(pin), r"\d+", 0).try_cast("long"), F.lit(0))
    return F.when(number >= code, pin).otherwise(str(code))


def without_fences(raw: Column) -> Column:
    s = _stripped(raw)
    bare = F.regexp_replace(F.regexp_replace(s, r"^```[a-zA-Z0-9]*\s*", ""), r"\s*```$", "")
    return _stripped(F.when(F.startswith(s, F.lit("```")), bare).otherwise(s))


def note_slug(summary: Column) -> Column:
    """A file name from the first line."""
    line = F.lower(F.substring(F.split(_text(summary), "\n", 2)[0], 1, 60))
    s = F.substring(F.regexp_replace(F.regexp_replace(line, "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, 50)
    return F.when(s == "", "consolidated-note").otherwise(s)


def memory_kind(summary: Column, tags: Column) -> Column:
    """preference before system before project, by the words of a summary and its tags (array)."""
    low = F.lower(F.concat_ws(" ", _text(summary), F.array_join(F.coalesce(tags, F.array().cast("array<string>")), " ")))
    has = lambda words: low.rlike("|".join(words))  # noqa: E731  the words have no signs of patterns
    return F.when(has(PREFERENCE_WORDS), "preference").when(has(SYSTEM_WORDS), "system").otherwise("project")


def bare_subject(subject: Column) -> Column:
    """Without what stands before the first letter, digit, underscore or bracket."""
    return F.regexp_replace(_text(subject), r"^[^\p{L}\p{N}_\[]+", "")


def is_noise(sender: Column, subject: Column) -> Column:
    """By a part of the sender's address or the subject, bare or as it is."""
    low = F.lower(_text(sender))
    by_sender = F.lit(False)
    for word in NOISE_SENDERS:
        by_sender = by_sender | F.contains(low, F.lit(word))
    pattern = "(?i)" + "|".join(f"(?:{p})" for p in NOISE_SUBJECTS)
    return by_sender | _text(subject).rlike(pattern) | bare_subject(subject).rlike(pattern)


def extractive_summary(subject: Column, text: Column) -> Column:
    """'subject: first sentence', or what there is of them."""
    s = _stripped(subject)
    first = F.coalesce(F.filter(F.transform(F.split(_text(text), "[.!?]"), _stripped), lambda p: p != "")[0], F.lit(""))
    return F.when((s != "") & (first != ""), F.concat(s, F.lit(": "), first)).otherwise(F.concat(s, first))


def priority(name: Column) -> Column:
    low, out = F.lower(F.trim(_text(name))), F.lit(None).cast("int")
    for word, n in PRIORITIES.items():
        out = F.when(low == word, n).otherwise(out)
    return out


def confidence(drafter: Column, critic: Column, high: Column, medium: Column, grounding: Column, coverage: Column) -> Column:
    """0.7 of the drafter's and 0.3 of the critic's (0.5 where 0 or missing), less the penalties, between 0.1 and 1."""
    p = PENALTIES
    penalty = p["high"] * high + p["medium"] * medium + p["grounding"] * grounding + p["coverage"] * coverage
    base = 0.7 * drafter + 0.3 * F.when(F.coalesce(critic, F.lit(0.0)) == 0, 0.5).otherwise(critic)
    return F.round(F.greatest(F.lit(0.10), F.least(F.lit(1.0), base - penalty)), 4)


def quote_stands(quote: Column, source: Column) -> Column:
    """Whether a quote that isn't blank is in the source, whatever the case and white space."""
    even = lambda c: F.trim(F.regexp_replace(F.lower(_text(c)), r"(?U)\s+", " "))
    return (even(quote) != "") & F.contains(even(source), even(quote))


def source_ref(secret: str, doc_id: Column) -> Column:
    """HMAC-SHA256 of an id, in hex."""
    import hashlib

    key = secret.encode() if len(secret.encode()) <= 64 else hashlib.sha256(secret.encode()).digest()
    pad = lambda byte: F.unhex(F.lit(bytes(b ^ byte for b in key.ljust(64, b"\0")).hex()))
    inner = F.unhex(F.sha2(F.concat(pad(0x36), F.encode(doc_id, "UTF-8")), 256))
    return F.sha2(F.concat(pad(0x5C), inner), 256)


def digest_patch(thread_id: Column, text: Column, source_type: Column, date: Column, date_iso: Column, source_date: Column | None = None) -> Column:
    """struct<source_type, date, date_iso>: what is to be set on a digest, null where nothing is. A date that is there stays."""
    want = F.when(F.startswith(_text(thread_id), F.lit("cal-")), "calendar_enriched_v2").otherwise("gmail_enriched_v2")
    said = F.trim(F.regexp_extract(_text(text), r"(?m)^Date:[^\S\n]*(\S.*)$", 1))
    found = F.coalesce(F.when(said != "", said), F.when(_text(source_date) != "", source_date) if source_date is not None else F.lit(None).cast("string"))
    new = F.when(_text(date) == "", found)
    iso = F.when((_text(date_iso) == "") & new.rlike(r"^\d{4}-\d{2}-\d{2}([T ].*)?$"), new)
    return F.struct(F.when(~F.coalesce(source_type == want, F.lit(False)), want).alias("source_type"), new.alias("date"), iso.alias("date_iso"))
