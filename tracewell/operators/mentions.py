"""Mentions of people, organisations, places and identifiers by finite English rules.

Each rule gives spans with an entity type and a score; a mention is the best-scored of equal spans and types.  Texts are scanned once
a rule, behind a cheap test for what the rule needs; the result is one array a document, so nothing is shuffled.

Patterns are read as Java's, with Unicode classes and only ``\\n`` as a line's end; patterns that ignore case also take the dotted
capital and the dotless small i for a letter of ``A-Z``, as the rules' definition does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewell.functions.spans import bind, find_spans, first_of_each, folded, holds, overlaps
from tracewell.functions.text import squeeze

MENTION = "array<struct<start:int,end:int,entity_type:string,score:double,normalized:string,rule:string>>"
NAME, VERSION = "tracewell.english", "1"

# What the rules match.
_NAME_WORD = r"[A-Z][A-Za-z'\u2019\u2013-]"
_ORG_WORD = r"[A-Z][A-Za-z&'\u2019.-]*"
_PLACE_WORD = r"[A-Z][A-Za-z.'\u2019\u2013-]+"
_SHORT_WORD = r"[A-Z][a-z'\u2019\u2013-]{1,30}"
ORG_SUFFIX = r"(?:Inc\.?|LLC|Ltd\.?|Corp\.?|Corporation|Company|Bank|University)"
EMAIL = r"(?<![\w.+-])[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,63}(?![\w.-])"
IDENTIFIER = r"\b(case|contract|invoice|payment|account|claim|order)\s*(?:#|no\.?|number)?\s*((?=[A-Z0-9._/-]*\d)[A-Z0-9][A-Z0-9._/-]{2,})\b"
TITLED = rf"\b(?:Mr\.|Mrs\.|Ms\.|Dr\.|Prof\.)\s+{_NAME_WORD}+(?:\s+{_NAME_WORD}+){{0,3}}\b"
TWO_PART = rf"\b{_SHORT_WORD}\s+{_SHORT_WORD}\b"
ORGANIZATION = rf"\b{_ORG_WORD}(?:\s+{_ORG_WORD}){{0,5}}\s+{ORG_SUFFIX}\b"
LOCATION = rf"\b(?:in|at|from)\s+({_PLACE_WORD}(?:\s+{_PLACE_WORD}){{0,2}}(?:,\s*{_PLACE_WORD})?)\b"
HONORIFIC = r"(?:[Mm][Rr]\.|[Mm][Rr][Ss]\.|[Mm][Ss]\.|[Dd][Rr]\.|[Pp][Rr][Oo][Ff]\.)"
#: Possessive: what follows a token can't begin within it.
TITLE_TOKEN = r"\p{Lu}\p{Ll}*+(?:[.&'\u2019-]\p{Lu}?+\p{Ll}*+)*+"
RULED_PERSON = rf"(?<![\w]){HONORIFIC}\s+{TITLE_TOKEN}(?:\s+{TITLE_TOKEN})*"
RULED_ORG = rf"(?=\p{{Lu}})(?<![\w]){TITLE_TOKEN}(?:\s+{TITLE_TOKEN})*\s+(?i:inc\.?|llc|ltd\.?|corp\.?|corporation|company|bank|university)(?![\w])"
NOT_PERSONS = ("Annual Report", "Board Meeting", "Case Number", "Contract Number", "Dear Sir", "Email Subject", "Invoice Number", "New York", "Payment Number")
NOT_FIRST_WORDS = ("A", "An", "At", "By", "For", "From", "In", "On", "The", "To")
SCORES = {"email": 0.995, "identifier": 0.98, "titled": 0.90, "organization": 0.91, "location": 0.72, "two-part": 0.70, "ruler": 0.78, "model": 0.92, "header-email": 1.0, "header-name": 0.96}


def java(pattern: str, ignore_case: bool = False) -> str:
    """A rule's pattern with the same meaning for Java."""
    pattern = pattern.replace(r"\s", r"[\s\x1c-\x1f]")
    return "(?iuUd)" + pattern.replace("A-Z", "A-Z\u0130\u0131") if ignore_case else "(?Ud)" + pattern


EMAIL_J, IDENTIFIER_J = java(EMAIL, True), java(IDENTIFIER, True)
TITLED_J, TWO_PART_J, ORGANIZATION_J, LOCATION_J = java(TITLED), java(TWO_PART), java(ORGANIZATION), java(LOCATION)
_SUFFIXES, _TITLES, _NUMBERED = ("Inc", "LLC", "Ltd", "Corp", "Company", "Bank", "University"), ("Mr.", "Mrs.", "Ms.", "Dr.", "Prof."), ("case", "contract", "invoice", "payment", "account", "claim", "order")


def mention(start: Column, end: Column, kind: str | Column, score: float | Column, normalized: Column, rule: str) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.struct(start.alias("start"), end.alias("end"), kind.alias("entity_type"), F.lit(score).cast("double").alias("score"), normalized.alias("normalized"), F.lit(rule).alias("rule"))


def _plain(spans: Column, kind: str, score: float, rule: str) -> Column:
    return F.transform(spans, lambda s: mention(s["start"], s["end"], kind, score, squeeze(s["hit"]), rule)).cast(MENTION)


def emails(text: Column) -> Column:
    spans = find_spans(text, EMAIL_J, F.contains(text, F.lit("@")))
    return F.transform(spans, lambda s: mention(s["start"], s["end"], "OTHER", SCORES["email"], F.concat(F.lit("email:"), F.lower(s["hit"])), "email")).cast(MENTION)


def identifiers(text: Column, low: Column | None = None) -> Column:
    """``low``, here and below: the folded text, if it is known."""
    spans = find_spans(text, IDENTIFIER_J, holds(folded(text) if low is None else low, *_NUMBERED), groups=2)

    def one(s: Column) -> Column:
        value = F.concat_ws(":", F.lower(F.get(s["groups"], F.lit(0))), F.lower(F.get(s["groups"], F.lit(1))))
        return mention(s["start"], s["end"], "OTHER", SCORES["identifier"], value, "identifier")

    return F.transform(spans, one).cast(MENTION)


def titled_persons(text: Column) -> Column:
    return _plain(find_spans(text, TITLED_J, holds(text, *_TITLES)), "PERSON", SCORES["titled"], "titled")


def organizations(text: Column) -> Column:
    return _plain(find_spans(text, ORGANIZATION_J, holds(text, *_SUFFIXES)), "ORGANIZATION", SCORES["organization"], "organization")


def locations(text: Column) -> Column:
    spans = find_spans(text, LOCATION_J, holds(text, "in", "at", "from"), groups=1)

    def one(s: Column) -> Column:
        place = F.get(s["groups"], F.lit(0))
        return mention(s["end"] - F.length(place), s["end"], "LOCATION", SCORES["location"], squeeze(place), "location")

    return F.transform(spans, one).cast(MENTION)


def ruled(text: Column, low: Column | None = None) -> Column:
    """Honorific persons and suffixed organisations in title case, whatever the case of honorific and suffix."""
    low = folded(text) if low is None else low
    persons = _plain(find_spans(text, java(RULED_PERSON), holds(low, *map(str.lower, _TITLES))), "PERSON", SCORES["ruler"], "ruler")
    companies = _plain(find_spans(text, java(RULED_ORG), holds(low, *map(str.lower, _SUFFIXES))), "ORGANIZATION", SCORES["ruler"], "ruler")
    return bind(companies, lambda c: F.concat(F.filter(persons, lambda p: ~F.exists(c, lambda o: overlaps(o, p) & (o["end"] - o["start"] > p["end"] - p["start"]))), c))


def two_part_persons(text: Column, others: Column) -> Column:
    """Pairs of title-case words that aren't set phrases and don't overlap a mention of another type."""
    spans = find_spans(text, TWO_PART_J)

    def kept(rest: Column) -> Column:
        def good(s: Column) -> Column:
            first = F.regexp_extract(s["hit"], r"(?U)^\S+", 0)
            return ~s["hit"].isin(*NOT_PERSONS) & ~first.isin(*NOT_FIRST_WORDS) & ~F.exists(rest, lambda m: overlaps(m, s))

        return F.filter(spans, good)

    return _plain(bind(F.filter(others, lambda m: m["entity_type"] != "PERSON"), kept), "PERSON", SCORES["two-part"], "two-part")


def dedupe(mentions: Column) -> Column:
    """Of equal spans and types the best score, then the least rule; in order of start, end and type."""
    keyed = F.transform(mentions, lambda m: F.struct(m["start"], m["end"], m["entity_type"], (-m["score"]).alias("less"), m["rule"], m["normalized"]))
    best = first_of_each(F.array_sort(keyed), lambda a, b: (a["start"] == b["start"]) & (a["end"] == b["end"]) & (a["entity_type"] == b["entity_type"]))
    return F.transform(best, lambda m: F.struct(m["start"], m["end"], m["entity_type"], (-m["less"]).alias("score"), m["normalized"], m["rule"])).cast(MENTION)


def base_mentions(text: Column, model: Column | None = None) -> Column:
    """All mentions that rules (and, if given, a model's spans) find in a text."""
    def found(low: Column) -> Column:
        first = [ruled(text, low) if model is None else model.cast(MENTION), emails(text), identifiers(text, low), titled_persons(text), organizations(text), locations(text)]
        return bind(F.concat(*first), lambda found: dedupe(F.concat(found, two_part_persons(text, found))))

    return bind(folded(text), found)


def explode_mentions(docs: DataFrame, mentions: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a mention, with its surface."""
    rows = docs.select(F.col(key), F.col(text).alias("_text"), F.explode(mentions).alias("m"))
    return rows.select(key, F.col("m.start").alias("start"), F.col("m.end").alias("end"), F.col("m.entity_type").alias("entity_type"), F.round("m.score", 6).alias("score"), F.col("m.normalized").alias("normalized"), F.col("m.rule").alias("rule"), F.substring(F.col("_text"), F.col("m.start") + 1, F.col("m.end") - F.col("m.start")).alias("surface"))


def select_across(mentions: DataFrame) -> DataFrame:
    """Of several extractors' equal mentions the winner, with ``loses_to`` for the keys that it replaces.

    ``mentions``: document_id, start, end, entity_type, normalized, score, extractor_order, extractor_name, extractor_version, key.
    """
    same = W.partitionBy("document_id", "start", "end", "entity_type", "normalized").orderBy(F.desc("score"), "extractor_order", "extractor_name", "extractor_version", "key")
    return mentions.withColumn("winner_key", F.first("key").over(same)).withColumn("place", F.row_number().over(same))
