"""Personal data in texts, with DataFrame functions only.

Regular expressions propose spans; checksums and ranges confirm them (Luhn for cards, mod-97 for IBANs, parts of at most 255
for addresses, digit counts for phones); words near a span adjust its score.  The kinds of ``BASE`` stay whatever their score
is; the others need a score of ``KEEP``.  Of a kind, spans are leftmost and don't overlap; a proposal that fails its check is
dropped and isn't tried again at another place.  Offsets count code points, ends are exclusive.

The patterns hold no groups that repeat without bound, which Java would match by recursion (a long run of digits or labels would exhaust
the stack), and start only where a run starts, so that they take linear time: the few characters on which a repeated group would
depend are replaced by others of the same length first.  An IBAN is as long as its country says, so words after it aren't taken for its end.

A null text counts as empty and has no spans (masking leaves it null).  Rows are independent: ties, repeated rows and empty
tables need no rule.  Other columns are kept where rows are returned, and their names can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions.spans import BLOCK, bind, running

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "secret")
KEEP, NEAR, BOOST = 0.5, 32, 0.3
SCORE = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.8, "secret": 0.3}
CONTEXT = {
    "email": "(?i)mail|contact|write to",
    "ip": r"(?i)\bip\b|host|server|address",
    "card": "(?i)card|visa|master|credit|karte|tarjeta|carte",
    "phone": "(?i)phone|tel|call|mobile|fax",
    "iban": "(?i)iban|account|konto|compte|cuenta|bank",
    "secret": "(?i)token|secret|passw|api.?key|credential|bearer",
}
SPAN = "array<struct<kind:string,start:bigint,end:bigint,score:double>>"

_LOCAL, _LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
#: The countries of each length of an IBAN.
IBAN = {15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU"}
_IBAN = "|".join(f"(?:{c.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}" for n, c in IBAN.items())
#: kind: what a text must match to be looked at, the characters to replace (and by what), the pattern.
_RULES = {
    "email": ("@", (rf"(?<!{_LABEL})\.|\.(?!{_LABEL})", "_"), rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_LABEL}++\.[A-Za-z0-9.-]++"),
    "ip": (r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", None, r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    "card": ("[0-9](?:[ -]?[0-9]){12}", ("(?<![0-9])[ -]|[ -](?![0-9])", "_"), "(?<![0-9 -])[0-9][0-9 -]++"),
    "phone": (r"\+[0-9]", None, r"\+[0-9][ ().0-9-]+[0-9]"),
    "iban": ("[A-Z]{2}[0-9]{2} ?[A-Z0-9]", None, rf"(?<![A-Za-z0-9])(?:{_IBAN})(?![A-Za-z0-9])"),
    "secret": ("[A-Za-z0-9_]{32}", None, r"(?<![A-Za-z0-9_])[A-Za-z0-9_]{32,}+"),
}


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""

    def add(total: Column, i: Column) -> Column:
        x = F.substring(digits, -i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 0, F.when(x > 4, 2 * x - 9).otherwise(2 * x)).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an IBAN without spaces leaves 1 by 97, its first four characters put last and letters read as 10 to 35."""
    turned = F.concat(F.substring(iban, 5, 99), F.substring(iban, 1, 4))

    def add(rest: Column, i: Column) -> Column:
        c = F.ascii(F.substring(turned, i, F.lit(1)))
        return F.when(c < 65, rest * 10 + c - 48).otherwise(rest * 100 + c - 55) % 97

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), add) == 1


def _holds(kind: str, match: Column) -> Column:
    if kind == "ip":
        return match.rlike(rf"^{_PART}\.{_PART}\.{_PART}\.{_PART}$")
    if kind == "card":
        digits = _digits(match)
        return F.when(F.length(digits).between(13, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(match)).between(9, 15)
    if kind == "iban":
        return mod97(F.replace(match, F.lit(" ")))
    if kind == "secret":
        return match.rlike("[0-9]") & match.rlike("[A-Za-z]")
    return F.lit(True)


def found(text: Column, kind: str, changed: Column | None = None) -> Column:
    """Spans of one kind in a text that isn't null: proposals with their places, then those that hold, with scores."""
    gate, change, pattern = _RULES[kind]
    read = F.regexp_replace(text, change[0], change[1]) if change else text
    gaps, hits = F.split(read, pattern, -1), F.regexp_extract_all(read, F.lit(pattern), F.lit(0))
    # A lambda must not hold the arrays themselves: it would make them anew for each element.
    pairs = F.filter(F.zip_with(gaps, hits, lambda g, h: F.struct((F.length(g) + F.length(h)).alias("both"), h.alias("hit"))), lambda p: p["hit"].isNotNull())

    def placed(rows: Column) -> Column:
        ends = running(F.transform(rows, lambda p: p["both"]))
        return F.zip_with(rows, ends, lambda p, e: F.struct((e - F.length(p["hit"])).cast("bigint").alias("start"), p["hit"].alias("hit")))

    spans = bind(pairs, placed)

    def scored(x: Column) -> Column:
        before = F.greatest(x["start"] - NEAR, F.lit(0))
        near = F.substring(text, (before + 1).cast("int"), (x["start"] - before + F.length(x["hit"]) + NEAR).cast("int"))
        # The span itself doesn't count as context.
        near = F.replace(near, x["hit"], F.lit(" "))
        score = F.lit(SCORE[kind]) + F.when(near.rlike(CONTEXT[kind]), BOOST).otherwise(0.0)
        return F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), (x["start"] + F.length(x["hit"])).cast("bigint").alias("end"), F.least(score, F.lit(1.0)).alias("score"))

    kept = F.transform(F.filter(spans, lambda x: _holds(kind, x["hit"])), scored)
    if kind not in BASE:
        kept = F.filter(kept, lambda x: x["score"] >= KEEP)
    looked = F.contains(text, F.lit(gate)) if kind == "email" else text.rlike(gate)
    if kind == "phone":
        looked = F.contains(text, F.lit("+")) & looked
    return F.when(looked, kept).otherwise(F.lit(None)).cast(SPAN)


def spans(text: Column, kinds: tuple[str, ...] = KINDS) -> Column:
    """All spans of a text, by kind as listed, then by start."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    return F.concat(*[F.coalesce(found(text, kind), F.lit([]).cast(SPAN)) for kind in kinds])


def find(docs: DataFrame, key: str = "doc_id", text: str = "text", kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """``key`` and ``spans`` (kind, start, end, score) of every row."""
    return docs.select(F.col(key), spans(F.col(text), kinds).alias("spans"))


def running_most(values: Column) -> Column:
    """The greatest of the values up to each place, in blocks."""

    def most(some: Column) -> Column:
        first = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit([]).cast("array<bigint>").alias("all"))

        def add(state: Column, n: Column) -> Column:
            at = F.greatest(state["at"], n)
            return F.struct(at.alias("at"), F.array_append(state["all"], at).alias("all"))

        return F.aggregate(some, first, add)

    def blocks(rows: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(rows) - 1, F.lit(0)), F.lit(BLOCK))
        return F.transform(starts, lambda k: most(F.slice(rows, k + 1, F.lit(BLOCK))))

    def joined(parts: Column) -> Column:
        before = bind(most(F.transform(parts, lambda p: p["at"])), lambda s: F.concat(F.array(F.lit(0).cast("bigint")), s["all"]))
        placed = F.zip_with(parts, before, lambda p, b: F.when(p.isNotNull(), F.transform(p["all"], lambda v: F.greatest(v, b))))
        return F.flatten(F.filter(placed, lambda p: p.isNotNull()))

    return bind(bind(values, blocks), joined)


def mask(docs: DataFrame, text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """The rows with each run of overlapping spans replaced by its first kind in brackets; ``length`` follows the text."""
    names = docs.columns
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), F.array_sort(F.transform(spans(F.col(text)), lambda s: F.struct(s["start"], s["end"], s["kind"]))).alias("_spans"))
    value = F.col(f"_row.`{text}`")

    def block(some: Column) -> Column:
        """The replaced stretch of some neighbouring spans: where it ends, and its pieces."""

        def step(state: Column, s: Column) -> Column:
            apart = s["start"] >= state["at"]
            gap = F.substring(value, (state["at"] + 1).cast("int"), (s["start"] - state["at"]).cast("int"))
            out = F.when(apart, F.array_append(state["out"], F.concat(gap, F.lit("["), F.upper(s["kind"]), F.lit("]")))).otherwise(state["out"])
            return F.struct(F.greatest(state["at"], s["end"]).cast("bigint").alias("at"), out.alias("out"))

        first = F.struct(F.get(some, F.lit(0))["before"].alias("at"), F.lit([]).cast("array<string>").alias("out"))
        return F.aggregate(some, first, step, lambda s: F.array_join(s["out"], ""))

    def whole(spans_: Column) -> Column:
        # Spans in blocks, so that texts of very many take linear time: each span carries where those before it end.
        starts = F.sequence(F.lit(0), F.size(spans_) - 1, F.lit(BLOCK))
        ends = F.concat(F.array(F.lit(0).cast("bigint")), running_most(F.transform(spans_, lambda s: s["end"])))
        held = F.zip_with(spans_, ends, lambda s, e: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), e.alias("before")))
        last = F.substring(value, (F.array_max(F.transform(spans_, lambda s: s["end"])) + 1).cast("int"), F.lit(2**31 - 1))
        return F.concat(bind(F.filter(held, lambda s: s["kind"].isNotNull()), lambda rows: F.array_join(F.transform(starts, lambda k: block(F.slice(rows, k + 1, F.lit(BLOCK)))), "")), last)

    done = bind(F.col("_spans"), whole)
    changed = F.when(F.size("_spans") > 0, done).otherwise(value)
    rows = held.select("_row", changed.alias("_text"))
    columns = [F.col("_text").alias(c) if c == text else F.when(F.col("_row")[text].eqNullSafe(F.col("_text")), F.col("_row")[c]).otherwise(F.length("_text")).cast(docs.schema[c].dataType).alias(c) if c == length else F.col("_row")[c].alias(c) for c in names]
    return rows.select(*columns)


def listed(all_spans: Column, kinds: tuple[str, ...]) -> Column:
    """``kind:start:end`` of the spans of some kinds, comma-joined."""
    chosen = F.filter(all_spans, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(chosen, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
