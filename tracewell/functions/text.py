"""Text functions: newlines and the map back to the raw text, name forms, similarity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracewell.functions.spans import bind, find_spans, holds
from tracewell.model import TRANSITIONS

#: White space as in Python's ``str.isspace``: Unicode's, and four separators that Java doesn't count.
SPACE = r"[\s\x1c-\x1f]"
BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def leading(text: Column) -> Column:
    """How many white-space characters a text begins with."""
    return F.length(text) - F.length(F.ltrim(text, F.lit(BLANKS)))


def squeeze(text: Column) -> Column:
    """Lower-cased, white space runs as one space, none at the ends."""

    def squeezed(t: Column) -> Column:
        # ASCII words with single spaces between them stay as they are.
        plain = (F.octet_length(t) == F.length(t)) & ~holds(t, "  ", *BLANKS[:9]) & ~F.startswith(t, F.lit(" ")) & ~F.endswith(t, F.lit(" "))
        return F.when(plain, F.lower(t)).otherwise(strip(F.regexp_replace(F.lower(t), rf"(?U){SPACE}+", " ")))

    return bind(text, squeezed)


def normalize_newlines(raw: Column) -> Column:
    return F.regexp_replace(raw, "\r\n?", "\n")


def offset_transitions(raw: Column) -> Column:
    """Where the distance between raw and normalised offsets changes: after each CRLF it is one more."""

    def moved(rows: Column) -> Column:
        return F.concat(F.array(F.struct(F.lit(0).alias("idx"), F.lit(0).alias("delta"))), F.transform(rows, lambda s, i: F.struct((s["end"] - i - 1).alias("idx"), (i + 1).alias("delta"))))

    return bind(find_spans(raw, "\r\n", F.contains(raw, F.lit("\r\n"))), moved).cast(TRANSITIONS)


def to_raw(transitions: Column, index: Column) -> Column:
    """The raw boundary of a normalised one."""
    return (index + F.coalesce(F.array_max(F.transform(F.filter(transitions, lambda t: t["idx"] <= index), lambda t: t["delta"])), F.lit(0))).cast("int")


def to_normalized(transitions: Column, raw_index: Column) -> Column:
    """The first normalised boundary whose raw boundary is at or after a raw one."""
    passed = F.array_max(F.transform(F.filter(transitions, lambda t: t["idx"] + t["delta"] <= raw_index), lambda t: t["delta"]))
    return (raw_index - F.coalesce(passed, F.lit(0))).cast("int")


# Forms of names.
IDENTIFIER_FORM = "(?i)^(email|case|contract|invoice|payment|account|claim|order):(.+)$"
HONORIFIC_FORM = r"(?i)^(?:mr|mrs|ms|dr|prof)\s+"
CORPORATE_FORM = r"(?i)\s+(?:inc|llc|ltd|corp|corporation|company|co|bank|university)$"
SMALL_WORDS = ("the", "of", "and")


def is_identifier(normalized: Column) -> Column:
    return normalized.rlike(IDENTIFIER_FORM)


_WIDE, _PLAIN = "".join(map(chr, range(0xFF01, 0xFF5F))), "".join(map(chr, range(0x21, 0x7F)))
_SEVERAL = (("ß", "ss"), ("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬆ", "st"))


def compatible(text: Column) -> Column:
    """Case folded, with full-width forms, ligatures, sharp s, final sigma and long s in their compatible forms.

    Other compatibility characters stay; names found by the English rules are ASCII but for apostrophes and dashes.
    """
    out = F.lower(F.translate(text, _WIDE + "ςſ", _PLAIN + "σs"))
    for one, several in _SEVERAL:
        out = F.when(F.contains(out, F.lit(one)), F.replace(out, F.lit(one), F.lit(several))).otherwise(out)
    return out


def name_form(text: Column) -> Column:
    """A name for comparison: case folded, without honorific, words separated by one space."""
    bare = F.regexp_replace(strip(compatible(text)), HONORIFIC_FORM, "")
    return strip(F.regexp_replace(bare, r"(?U)[^\w]+", " "))


def aliases(name: Column, is_organization: Column) -> Column:
    """The name; of an organisation also the name without corporate suffix, and the initials of its words."""

    def more(core: Column) -> Column:
        words = F.filter(F.split(core, " "), lambda w: (w != "") & ~w.isin(*SMALL_WORDS))
        initials = bind(words, lambda ws: F.when(F.size(ws) >= 2, F.array_join(F.transform(ws, lambda w: F.substring(w, 1, 1)), "")))
        return F.array_compact(F.array(F.when(core != "", core), initials))

    core = strip(F.regexp_replace(name, CORPORATE_FORM, ""))
    return F.array_sort(F.array_distinct(F.when(is_organization, F.concat(F.array(name), bind(core, more))).otherwise(F.array(name))))


def common_subsequence(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of two texts, by dynamic programming over rows."""
    letters_a, letters_b = F.split(a, ""), F.split(b, "")
    empty = F.transform(letters_b, lambda _: F.lit(0))
    both = F.struct(letters_a.alias("a"), letters_b.alias("b"), empty.alias("row"))

    def solve(s: Column) -> Column:
        def row(previous: Column, letter: Column) -> Column:
            first = F.struct(F.lit(0).alias("left"), F.lit(0).alias("diagonal"), F.array().cast("array<int>").alias("out"))
            pairs = F.zip_with(s["b"], previous, lambda c, up: F.struct(c.alias("c"), up.alias("up")))

            def cell(state: Column, p: Column) -> Column:
                best = F.when(p["c"] == letter, state["diagonal"] + 1).otherwise(F.greatest(state["left"], p["up"]))
                return bind(best, lambda v: F.struct(v.alias("left"), p["up"].alias("diagonal"), F.array_append(state["out"], v).alias("out")))

            return F.aggregate(pairs, first, cell, lambda state: state["out"])

        return F.array_max(F.aggregate(s["a"], s["row"], row))

    return F.when((a == "") | (b == ""), F.lit(0)).otherwise(bind(both, solve))


def token_sort_ratio(a: Column, b: Column) -> Column:
    """Similarity (0 to 1) of two texts with their words sorted: twice the common subsequence by both lengths."""

    def ordered(x: Column) -> Column:
        return F.array_join(F.array_sort(F.filter(F.split(x, r"\s+"), lambda w: w != "")), " ")

    def ratio(s: Column) -> Column:
        total = F.length(s["a"]) + F.length(s["b"])
        return F.when(total == 0, F.lit(1.0)).otherwise(2.0 * common_subsequence(s["a"], s["b"]) / total)

    return bind(F.struct(ordered(a).alias("a"), ordered(b).alias("b")), ratio)
