"""Spans of patterns in texts, with code-point offsets, as column expressions.

Spark has no "find all with offsets".  The pieces between matches and the matches themselves give them: a match ends at the
running sum of the lengths so far.  Sums are taken in blocks, so that long texts with many matches stay linear.  One search marks the
matches, and the text is split at the marks: a split at a pattern would compile the pattern for every text anew.

Higher-order functions evaluate what their lambda holds for every element.  Whatever is costly is therefore bound to a lambda
variable first (``bind``): it is evaluated once, wherever the optimiser moves the projection.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start:int,end:int,hit:string>>"
GROUPED = "array<struct<start:int,end:int,hit:string,groups:array<string>>>"
BLOCK = 256
#: Set around matches and before groups; no characters, so texts hardly ever hold them (those that do are searched twice).
MARK, GROUP_MARK = "\uffff", "\ufffe"
_ALIKE = ("\u0130\u0131\u017f\u212a", "iisk")


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _sums(lengths: Column) -> Column:
    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all"))

    def add(state: Column, n: Column) -> Column:
        at = state["at"] + n
        return F.struct(at.alias("at"), F.array_append(state["all"], at).alias("all"))

    return F.aggregate(lengths, first, add)


def running(lengths: Column) -> Column:
    """Inclusive running sums of an array of integers."""

    def blocks(all_lengths: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(all_lengths) - 1, F.lit(0)), F.lit(BLOCK))
        return F.transform(starts, lambda k: _sums(F.slice(all_lengths, k + 1, F.lit(BLOCK))))

    def joined(parts: Column) -> Column:
        before = bind(_sums(F.transform(parts, lambda p: p["at"])), lambda s: F.concat(F.array(F.lit(0)), s["all"]))
        placed = F.zip_with(parts, before, lambda p, b: F.when(p.isNotNull(), F.transform(p["all"], lambda v: v + b)))
        return F.flatten(F.filter(placed, lambda p: p.isNotNull()))

    return bind(bind(lengths, blocks), joined)


def holds(text: Column, *words: str) -> Column:
    """Whether a text holds any of some words, letter for letter: a gate that costs far less than a pattern."""
    out = F.contains(text, F.lit(words[0]))
    for word in words[1:]:
        out = out | F.contains(text, F.lit(word))
    return out


def folded(text: Column) -> Column:
    """Lower-cased, also those letters that patterns which ignore case take for one of ``a-z``: gates look for words in it."""
    return F.lower(F.when(holds(text, *_ALIKE[0]), F.translate(text, *_ALIKE)).otherwise(text))


def _marked(text: Column, pattern: str, groups: int) -> Column:
    """Gaps and matches in turn, by one search; groups come after their match."""
    held = MARK + "$0" + "".join(f"{GROUP_MARK}${i + 1}" for i in range(groups)) + MARK
    return F.split(F.regexp_replace(text, pattern, held), MARK, -1)


def _one_by_one(text: Column, pattern: str, groups: int) -> Column:
    """The same for texts that hold a mark, by two searches: gaps and matches as structs."""
    hits, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    none = F.lit(None).cast("array<string>")
    taken = (lambda h: F.array(*[F.regexp_extract(h, pattern, i + 1) for i in range(groups)])) if groups else (lambda h: none)
    pairs = F.zip_with(gaps, hits, lambda g, h: F.array(F.struct(g.alias("hit"), none.alias("groups")), F.struct(h.alias("hit"), taken(h).alias("groups"))))
    return F.filter(F.flatten(pairs), lambda p: p["hit"].isNotNull())


def _read(part: Column, groups: int) -> Column:
    """A marked match as a struct."""
    if not groups:
        return F.struct(part.alias("hit"), F.lit(None).cast("array<string>").alias("groups"))
    return bind(F.split(part, GROUP_MARK, -1), lambda g: F.struct(F.get(g, F.lit(0)).alias("hit"), F.slice(g, 2, groups).alias("groups")))


def _placed(parts: Column, made: Callable[[Column, Column], Column], kind: str, many: bool) -> Column:
    """Spans of gaps and matches in turn, from the sums of their lengths."""
    if many:
        ends = lambda rows: running(F.transform(rows, lambda p: F.length(p["hit"])))
        return F.filter(F.transform(F.arrays_zip(parts.alias("p"), ends(parts).alias("e")), lambda z, i: F.when(i % 2 == 1, made(z["p"], z["e"] - F.length(z["p"]["hit"])))), lambda s: s.isNotNull())
    first = F.struct(F.lit(0).alias("at"), F.lit(False).alias("odd"), F.array().cast(kind).alias("all"))

    def add(state: Column, p: Column) -> Column:
        return F.struct((state["at"] + F.length(p["hit"])).alias("at"), (~state["odd"]).alias("odd"), F.when(state["odd"], F.array_append(state["all"], made(p, state["at"]))).otherwise(state["all"]).alias("all"))

    return F.aggregate(parts, first, add, lambda state: state["all"])


def find_spans(text: Column, pattern: str, gate: Column | None = None, many: bool = False, groups: int = 0) -> Column:
    """``start``, ``end`` and ``hit`` of all matches, with ``groups`` the texts of that many too; none where ``gate`` (what a match needs)
    doesn't hold or text is null.

    ``text`` is read twice: a column or a lambda's variable, not an expression.  The pattern must not match the empty text.
    ``many``: sums by blocks, for patterns that match a long text many thousand times; the plan is larger.
    """
    kind = GROUPED if groups else SPAN

    def made(p: Column, start: Column) -> Column:
        return F.struct(start.alias("start"), (start + F.length(p["hit"])).alias("end"), p["hit"].alias("hit"), *([p["groups"].alias("groups")] if groups else []))

    def spans(parts: Column) -> Column:
        # Most texts have no match or one.
        one = bind(_read(F.get(parts, F.lit(1)), groups), lambda p: F.array(made(p, F.length(F.get(parts, F.lit(0))))))
        more = bind(F.transform(parts, lambda p: _read(p, groups)), lambda rows: _placed(rows, made, kind, many))
        return F.when(F.size(parts) == 1, F.array().cast(kind)).when(F.size(parts) == 3, one).otherwise(more)

    found = F.when(holds(text, MARK, GROUP_MARK), bind(_one_by_one(text, pattern, groups), lambda rows: _placed(rows, made, kind, many))).otherwise(bind(_marked(text, pattern, groups), spans))
    wanted = text.isNotNull() if gate is None else text.isNotNull() & gate
    return F.when(wanted, found).otherwise(F.array().cast(kind))


def overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (a["end"] > b["start"])


def inside(a: Column, start: Column, end: Column) -> Column:
    return (a["start"] >= start) & (a["end"] <= end)


def first_of_each(sorted_rows: Column, same: Callable[[Column, Column], Column]) -> Column:
    """Of a sorted array, the first of each run of rows that are the same."""
    return bind(sorted_rows, lambda rows: F.filter(rows, lambda x, i: (i == 0) | ~same(x, F.get(rows, i - 1))))
