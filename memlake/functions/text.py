"""Column functions on texts, names and addresses. All run in the JVM."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words and patterns that results depend on.
TITLE_STOPWORDS = "the a an and or to of for with on in at by is are was be have has that this it i you we do not".split()
HONORIFICS = "pastor ps pr rev reverend dr mr mrs ms miss sis sister bro brother aunty uncle".split()
ROLE_MAILBOXES = (
    "info hello hi hey support admin team contact contactus enquiries enquiry office mail email noreply no-reply donotreply do-not-reply "
    "notifications newsletter accounts billing hr jobs careers sales help helpdesk service feedback events media press marketing giving prayer "
    "kids youth reception general all everyone staff"
).split()
ACTION_CUES = [
    "?", "can you", "please", "i'll", "i will", "we'll", "we will", "i'm going", "we're going", "let me", "let's", "send", "confirm", "schedule",
    "pay", "wire", "sign", "review", "follow up", "followup", "deadline", "due", "action", "next step", "to-do", "todo", "tomorrow", "next week",
    "monday", "tuesday", "wednesday", "thursday", "friday", "by eod", "by end of",
]
BULK_MARKERS = ["mailchi.mp", "list-unsubscribe", "view in browser", "view this email in your browser"]
STRUCTURAL_JUNK = [r"(?i)^(Re|Fwd|FW|RE|FWD)\s*:", r"https?://", r"\w+@\w+\.\w+", r"[|{}\[\]<>]"]
NUMERIC_JUNK = [r"\d{4}", r"\d{2,}/\d{2,}"]
# End of fixed values.

TOKEN = r"[\p{L}\p{N}]+"


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def has_content(text: Column) -> Column:
    """Whether there is a letter or digit of any script."""
    return F.coalesce(text.rlike(r"[\p{L}\p{N}]"), F.lit(False))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def normalised_title(text: Column) -> Column:
    """Lower case, without punctuation and short stopwords, single spaces."""
    words = F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}_\s]+", " "), r"\s+")
    return F.array_join(F.filter(words, lambda w: (w != "") & ~w.isin(TITLE_STOPWORDS)), " ")


def fingerprint(text: Column) -> Column:
    """SHA-1 of the normalised title; '' where nothing is left."""
    title = normalised_title(text)
    return F.when(title == "", "").otherwise(F.sha1(title))


def _letters() -> tuple[str, str]:
    """Letters that are a to z with marks, and what they are without: by their decomposition, to the end of the extended Latin blocks."""
    pairs = [(c, unicodedata.normalize("NFKD", c)) for c in map(chr, [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]) if c == c.lower()]
    pairs = [(c, "".join(x for x in d if not unicodedata.combining(x))) for c, d in pairs]
    pairs = [(c, d) for c, d in pairs if len(d) == 1 and "a" <= d <= "z"]
    return "".join(c for c, _ in pairs), "".join(d for _, d in pairs)


def slug(name: Column) -> Column:
    """Lower case with hyphens for runs of other characters, at most 80 long. Latin letters lose their marks."""
    low = F.lower(F.coalesce(name, F.lit("")))
    folded = F.when(low.rlike(r"[^\x00-\x7F]"), F.translate(low, *_letters())).otherwise(low)
    return F.substring(F.regexp_replace(F.regexp_replace(folded, "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, 80)


def canonical_name(name: Column) -> Column:
    """Single spaces, without one leading honorific if a word is left."""
    spaced = F.trim(F.regexp_replace(F.coalesce(name, F.lit("")), r"\s+", " "))
    return F.regexp_replace(spaced, rf"^(?i:{'|'.join(HONORIFICS)})\.* ", "")


def is_junk_name(name: Column, kind: Column) -> Column:
    """Names of persons and organisations that can't be ones, by length or pattern."""
    n = F.trim(F.coalesce(name, F.lit("")))
    bad = (F.char_length(n) < 2) | (F.char_length(n) > 60)
    for p in STRUCTURAL_JUNK:
        bad = bad | n.rlike(p)
    digits = n.rlike(NUMERIC_JUNK[0]) | n.rlike(NUMERIC_JUNK[1])
    return kind.isin("person", "org") & (bad | ((kind == "person") & digits))


def is_role_mailbox(email: Column) -> Column:
    local = F.split_part(F.split_part(F.lower(F.trim(email)), F.lit("@"), F.lit(1)), F.lit("+"), F.lit(1))
    return F.contains(email, F.lit("@")) & local.isin(ROLE_MAILBOXES)


def strip_html(html: Column) -> Column:
    """Scripts, styles and heads go; block tags end a line, other tags vanish; lines are trimmed, blank ones dropped."""
    body = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style|head)\b.*?</(script|style|head)>", "")
    body = F.regexp_replace(body, r"(?i)</?(p|div|br|li|ul|ol|tr|table|h1|h2|h3|h4|h5|h6|blockquote|section|article|nav|body|html|header|footer)\b[^>]*>", "\n")
    lines = F.transform(F.split(F.regexp_replace(body, r"<[^>]*>", ""), "\n"), lambda x: F.trim(x))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def url_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z]+://([^/:?#]+)", 1))


def doc_root(doc_id: Column) -> Column:
    """The id without its chunk number."""
    return F.regexp_replace(doc_id, r"-\d+$", "")


def any_contained(text: Column, needles: list[str]) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    out = F.lit(False)
    for n in needles:
        out = out | F.contains(low, F.lit(n))
    return out


def is_bulk_body(text: Column) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    return any_contained(text, BULK_MARKERS) | (F.contains(low, F.lit("unsubscribe")) & F.contains(low, F.lit("http")))


def jaccard(a: Column, b: Column) -> Column:
    """Of two token arrays as sets; 0 where both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def context_prefix(source_type: Column, title: Column, when: Column, group: Column) -> Column:
    """Where a passage comes from, for the index; '' if nothing is known."""
    given = lambda c, before="", after="": F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(before), c, F.lit(after)))
    day = F.substring(when, 1, 10)
    parts = F.when(source_type == "gmail", F.concat_ws(", ", given(title, "Email from "), given(day, "on "), given(group, "(", ")"))).when(
        source_type == "gdrive", F.concat_ws(", ", given(title, "Document: "), given(day, "last updated "), given(group, "(", ")"))
    ).when(source_type == "calendar", F.concat_ws(", ", given(title, "Event: "), given(day, "on "), given(group, "at ")))
    return F.when(F.coalesce(parts, F.lit("")) == "", "").otherwise(F.concat(F.lit("[Context: "), parts, F.lit("] ")))
