"""Dates in English texts: detection by finite patterns, resolution by explicit formats.

Nothing is guessed: what no format reads stays as an unresolved expression.  Rules for relative expressions: ``today``, ``yesterday``,
``tomorrow``; ``N units ago`` and ``before`` go back, ``later`` and ``after`` go on; ``last`` and ``next`` move by one week, month or
year, ``this`` stays; ``last`` weekday is the latest one strictly before the reference, ``next`` the first strictly after, ``this``
the latest at or before.  Zone abbreviations are those of ``ZONES``; others leave an instant unresolved.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracewell.functions.spans import bind, find_spans, folded, holds
from tracewell.functions.text import SPACE
from tracewell.model import TEMPORAL

# The expressions that are looked for, in order of precedence.
MONTH = "(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?|Sep(?:tember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)"
WEEKDAY = "(?:Monday|Tuesday|Wednesday|Thursday|Friday|Saturday|Sunday)"
NUMBERS = ("one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten")
_SIDE = rf"(?:{MONTH}\s+\d{{1,2}},?\s+\d{{4}}|\d{{4}}-\d{{2}}-\d{{2}})"
JOINT = r"\s+(?:to|through|until|\u2013|\u2014)\s+"
PATTERNS = (
    ("range", rf"\b{_SIDE}{JOINT}{_SIDE}\b", True),
    ("instant", r"\b\d{4}-\d{2}-\d{2}[T ]\d{1,2}:\d{2}(?::\d{2})?(?:\s*(?:Z|[+-]\d{2}:?\d{2}|[A-Z]{2,5}))?\b", False),
    ("instant", rf"\b(?:{WEEKDAY},?\s+)?\d{{1,2}}\s+{MONTH}\s+\d{{4}}\s+\d{{1,2}}:\d{{2}}(?::\d{{2}})?(?:\s*(?:Z|[+-]\d{{4}}|[A-Z]{{2,5}}))?\b", True),
    ("day", r"\b\d{4}-\d{2}-\d{2}\b", False),
    ("day", rf"\b(?:{MONTH}\s+\d{{1,2}}(?:st|nd|rd|th)?,?\s+\d{{4}}|\d{{1,2}}(?:st|nd|rd|th)?\s+{MONTH},?\s+\d{{4}})\b", True),
    ("month", rf"\b{MONTH}\s+\d{{4}}\b", True),
    ("relative", r"\b(?:today|yesterday|tomorrow)\b", True),
    ("relative", rf"\b(?:last|next|this)\s+(?:{WEEKDAY}|week|month|year)\b", True),
    ("relative", rf"\b(?:{'|'.join(NUMBERS)}|\d+)\s+(?:day|days|week|weeks|month|months|year|years)\s+(?:ago|later|before|after)\b", True),
    ("year", r"(?<![\w-])(?:19|20)\d{2}(?![\w-])", False),
)
ZONES = {"Z": "+00:00", "UTC": "+00:00", "GMT": "+00:00", "EST": "-05:00", "EDT": "-04:00", "CST": "-06:00", "CDT": "-05:00", "MST": "-07:00", "MDT": "-06:00", "PST": "-08:00", "PDT": "-07:00", "BST": "+01:00", "CET": "+01:00", "CEST": "+02:00"}
_MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
_UNITS = ("day", "week", "month", "year")
CANDIDATE = "array<struct<start:int,end:int,kind:string,hit:string>>"


def _java(pattern: str, ignore_case: bool) -> str:
    pattern = pattern.replace(r"\s", SPACE)
    return "(?iuUd)" + pattern.replace("A-Z", "A-Z\u0130\u0131") if ignore_case else "(?Ud)" + pattern


def _named(kind: str, rank: int):
    return lambda s: F.struct(s["start"].alias("start"), (s["start"] - s["end"]).alias("less"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), s["hit"].alias("hit"))


def _gates(text: Column, low: Column) -> tuple[Column, ...]:
    """What a text must hold to match each of the patterns, beside digits."""
    joined = text.rlike(rf"(?iuU)\d{SPACE}+(?:to|through|until|\u2013|\u2014){SPACE}")
    clock = holds(text, ":")
    month = holds(low, *_MONTHS)
    unit = holds(low, *_UNITS)
    return joined, clock & holds(text, "-"), clock & month, holds(text, "-"), month, month, holds(low, "today", "yesterday", "tomorrow"), unit & holds(low, "last", "next", "this"), unit & holds(low, "ago", "later", "before", "after"), holds(text, "19", "20")


def candidates(text: Column) -> Column:
    """Non-overlapping expressions: at each place the longest, of equal ones the pattern that comes first."""

    def all_of(known: Column) -> Column:
        parts = []
        for i, ((kind, pattern, ignore), gate) in enumerate(zip(PATTERNS, _gates(text, known["low"]), strict=True)):
            found = find_spans(text, _java(pattern, ignore), gate if kind in ("relative", "year") else known["digits"] & gate)
            parts.append(F.transform(found, _named(kind, i)))
        return F.concat(*parts)

    found = bind(F.struct(folded(text).alias("low"), text.rlike(r"(?U)\d{4}").alias("digits")), all_of)
    first = F.struct(F.lit(0).alias("at"), F.array().cast(CANDIDATE).alias("all"))

    def keep(state: Column, s: Column) -> Column:
        row = F.struct(s["start"].alias("start"), (s["start"] - s["less"]).alias("end"), s["kind"].alias("kind"), s["hit"].alias("hit"))
        taken = F.struct((s["start"] - s["less"]).alias("at"), F.array_append(state["all"], row).alias("all"))
        return F.when(s["start"] >= state["at"], taken).otherwise(state)

    return F.aggregate(F.array_sort(found), first, keep, lambda state: state["all"])


def _month_number(name: Column) -> Column:
    place = F.position(F.lower(F.substring(name, 1, 3)), F.lit("janfebmaraprmayjunjulaugsepoctnovdec"))
    return F.floor((place + 2) / 3)


def _iso_day(year: Column, month: Column, day: Column) -> Column:
    """``yyyy-MM-dd``, or null where there is no such day."""
    value = F.concat_ws("-", year, F.lpad(month.cast("int").cast("string"), 2, "0"), F.lpad(day, 2, "0"))
    return bind(value, lambda v: F.when(F.try_to_date(v, "yyyy-MM-dd").isNotNull(), v))


def parse_day(hit: Column) -> Column:
    """ISO form of a day in one of the written forms, or null."""
    iso, named, turned = r"^(\d{4})-(\d{2})-(\d{2})$", rf"(?i)^({MONTH}){SPACE}+(\d{{1,2}})(?:st|nd|rd|th)?,?{SPACE}+(\d{{4}})$", rf"(?i)^(\d{{1,2}})(?:st|nd|rd|th)?{SPACE}+({MONTH}),?{SPACE}+(\d{{4}})$"

    def read(h: Column) -> Column:
        x = lambda p, i: F.regexp_extract(h, p, i)
        return (
            F.when(h.rlike(iso), F.when(F.try_to_date(h, "yyyy-MM-dd").isNotNull(), h))
            .when(h.rlike(named), _iso_day(x(named, 3), _month_number(x(named, 1)), x(named, 2)))
            .when(h.rlike(turned), _iso_day(x(turned, 3), _month_number(x(turned, 2)), x(turned, 1)))
        )

    return bind(hit, read)


def parse_instant(hit: Column) -> Column:
    """``iso`` and ``zone`` (an offset or null) of an instant, or null."""
    iso = rf"^(\d{{4}}-\d{{2}}-\d{{2}})[T ](\d{{1,2}}):(\d{{2}})(?::(\d{{2}}))?{SPACE}*(Z|[+-]\d{{2}}:?\d{{2}}|[A-Za-z]{{2,5}})?$"
    mail = rf"(?i)^(?:[a-z]{{3,9}},?{SPACE}+)?(\d{{1,2}}{SPACE}+{MONTH}{SPACE}+\d{{4}}){SPACE}+(\d{{1,2}}):(\d{{2}})(?::(\d{{2}}))?{SPACE}*(Z|[+-]\d{{2}}:?\d{{2}}|[A-Z]{{2,5}})?$"

    def read(pattern: str) -> Column:
        found = F.struct(*[F.regexp_extract(hit, pattern, i).alias(f"x{i}") for i in range(1, 6)])
        return bind(found, lambda f: checked(f, parse_day(f["x1"])))

    def checked(f: Column, day: Column) -> Column:
        x = lambda i: f[f"x{i}"]
        said = F.upper(x(5))
        known = F.element_at(F.create_map(*[F.lit(v) for kv in ZONES.items() for v in kv]), said)
        offset = F.when(said == "", F.lit("")).when(said.rlike("^[+-]"), F.concat(F.substring(said, 1, 3), F.lit(":"), F.substring(said, -2, 2))).otherwise(known)
        clock = F.concat_ws(":", F.lpad(x(2), 2, "0"), x(3), F.when(x(4) == "", F.lit("00")).otherwise(x(4)))
        good = (x(2).cast("int") < 24) & (x(3).cast("int") < 60) & (F.coalesce(F.nullif(x(4), F.lit("")), F.lit("0")).cast("int") < 60)
        return bind(F.struct(day.alias("day"), offset.alias("offset")), lambda d: F.when(good & d["day"].isNotNull() & d["offset"].isNotNull(), F.struct(F.concat(d["day"], F.lit("T"), clock, d["offset"]).alias("iso"), F.nullif(d["offset"], F.lit("")).alias("zone"))))

    return F.when(hit.rlike(iso), read(iso)).when(hit.rlike(mail), read(mail))


def zone_name(offset: Column, default: str | None) -> Column:
    return F.when(offset.isNull(), F.lit(default).cast("string")).when(offset.isin("+00:00", "-00:00"), F.lit("UTC")).otherwise(F.concat(F.lit("UTC"), offset))


def reference_day(said: Column) -> Column:
    """The day of a document's own date, from a full date or instant in any of the forms; incomplete ones don't count."""
    text = F.trim(said)
    instant = parse_instant(F.regexp_replace(text, r"\.\d+(?=[Z+-]|$)", ""))
    return F.coalesce(parse_day(text), F.substring(instant["iso"], 1, 10))


def parse_relative(hit: Column, reference: Column) -> Column:
    """The day that a relative expression means, seen from a reference day (``yyyy-MM-dd``), or null."""
    words = F.split(F.lower(F.trim(hit)), rf"{SPACE}+")
    return bind(F.struct(words.alias("words"), F.to_date(reference).alias("base")), lambda k: _moved(k["words"], k["base"]))


def _moved(words: Column, base: Column) -> Column:
    one, two, three = F.get(words, F.lit(0)), F.get(words, F.lit(1)), F.get(words, F.lit(2))
    spelled = F.array_position(F.lit(list(NUMBERS)), one)
    amount = F.when(spelled > 0, spelled).otherwise(F.when(one.rlike(r"^0*\d{1,7}$"), one.cast("int"))).cast("int")
    signed = F.when(three.isin("ago", "before"), -amount).otherwise(amount)
    unit = F.regexp_replace(two, "s$", "")

    def moved(u: Column, n: Column) -> Column:
        # More than that many units lead out of the years 1 to 9999 from anywhere.
        reach = F.when(u == "day", 3_660_000).when(u == "week", 530_000).when(u == "month", 120_000).otherwise(10_000)
        at = F.when(u == "day", F.date_add(base, n)).when(u == "week", F.date_add(base, 7 * n)).when(u == "month", F.add_months(base, n)).when(u == "year", F.add_months(base, 12 * n))
        at = F.when(F.abs(n) <= reach, at)
        return F.when(F.year(at).between(1, 9999), at)

    step = F.when(one == "last", F.lit(-1)).when(one == "next", F.lit(1)).when(one == "this", F.lit(0))
    weekday = F.array_position(F.lit(["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"]), two)
    away = F.pmod(F.weekday(base) + 1 - weekday, F.lit(7))
    by_weekday = F.when(one == "last", F.date_sub(base, F.when(away == 0, 7).otherwise(away).cast("int"))).when(one == "next", F.date_add(base, (7 - away).cast("int"))).when(one == "this", F.date_sub(base, away.cast("int")))
    day = (
        F.when(one == "today", base)
        .when(one == "yesterday", F.date_sub(base, 1))
        .when(one == "tomorrow", F.date_add(base, 1))
        .when(step.isNotNull() & (weekday > 0), by_weekday)
        .when(step.isNotNull(), moved(two, step))
        .when(F.size(words) == 3, moved(unit, signed))
    )
    return day.cast("string")


def resolve(hit: Column, kind: Column, reference: Column, default_zone: str | None = None) -> Column:
    """A temporal expression from its text and kind; ``reference`` is a day or null."""
    sides = F.split(hit, rf"(?iuU){JOINT.replace(chr(92) + 's', SPACE)}", 2)
    month = bind(parse_day(F.concat(F.regexp_extract(hit, rf"(?i)^({MONTH})", 1), F.lit(" 1 "), F.substring(hit, -4, 4))), lambda d: F.struct(d.alias("start"), F.last_day(F.to_date(d)).cast("string").alias("end")))
    instant = parse_instant(hit)

    def made(start: Column, end: Column, precision: str, zone: Column | None = None) -> Column:
        return F.struct(start.alias("start"), end.alias("end"), F.lit(precision).alias("precision"), (F.lit(default_zone).cast("string") if zone is None else zone).alias("zone"))

    value = (
        F.when(kind == "range", bind(sides, lambda x: made(parse_day(F.get(x, F.lit(0))), parse_day(F.get(x, F.lit(1))), "RANGE")))
        .when(kind == "instant", bind(instant, lambda i: made(i["iso"], i["iso"], "INSTANT", zone_name(i["zone"], default_zone))))
        .when(kind == "day", bind(parse_day(hit), lambda d: made(d, d, "DAY")))
        .when(kind == "month", bind(month, lambda m: made(m["start"], m["end"], "MONTH")))
        .when(kind == "year", made(F.concat(hit, F.lit("-01-01")), F.concat(hit, F.lit("-12-31")), "YEAR"))
        .otherwise(bind(parse_relative(hit, reference), lambda d: made(d, d, "DAY")))
    )

    def expression(v: Column) -> Column:
        ok = v["start"].isNotNull() & v["end"].isNotNull()
        return F.struct(
            hit.alias("original_text"),
            F.when(ok, v["start"]).alias("start"),
            F.when(ok, v["end"]).alias("end"),
            F.when(ok, v["precision"]).otherwise("UNRESOLVED").alias("precision"),
            F.when(ok, v["zone"]).otherwise(F.lit(default_zone).cast("string")).alias("timezone"),
            (kind == "relative").alias("is_relative"),
            ok.alias("resolved"),
            F.lit(None).cast("string").alias("evidence_span_id"),
        ).cast(TEMPORAL)

    return bind(value, expression)


FOUND = f"array<struct<start:int,end:int,kind:string,score:double,expression:{TEMPORAL}>>"


def temporals(text: Column, reference: Column, default_zone: str | None = None) -> Column:
    """All temporal expressions of a text with places, kinds and scores (resolved .98, years .92, unresolved .65)."""

    def one(c: Column, day: Column) -> Column:
        def scored(e: Column) -> Column:
            score = F.when(~e["resolved"], 0.65).when(c["kind"] == "year", 0.92).otherwise(0.98)
            return F.struct(c["start"].alias("start"), c["end"].alias("end"), c["kind"].alias("kind"), score.alias("score"), e.alias("expression"))

        return bind(resolve(c["hit"], c["kind"], day, default_zone), scored)

    return bind(reference, lambda day: F.transform(candidates(text), lambda c: one(c, day))).cast(FOUND)
