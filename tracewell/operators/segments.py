"""Paragraphs, sentences and headings of texts.

A paragraph is a maximal run of lines that aren't blank, trimmed at both ends; a sentence is what ends with ``.``, ``!``, ``?`` or
the paragraph.  Paragraphs and sentences are numbered through the document.  Everything is per row; nothing is shuffled.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions.spans import bind, find_spans, running
from tracewell.functions.text import leading, strip
from tracewell.model import SEGMENT, SEGMENT_KINDS

# White space, line separators, and white space that doesn't end a line.
_W = r"\s\x1c-\x1f"
_LINE = r"\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029"
_H = rf"[{_W}&&[^{_LINE}]]"
#: Groups are possessive: Java matches them by a loop, where a plain group recurses once a repetition.
PARAGRAPH = rf"(?U)[^{_W}]++(?:{_H}*+(?:\r\n|[{_LINE}])?+{_H}*+[^{_W}]++)*+"
SENTENCE = r"[^.!?]++[.!?]*+"
HEADING = r"(?m)^(#{1,6})[ \t]+([^\r\n]+)"


def paragraphs(text: Column) -> Column:
    """``start``, ``end``, ``hit`` of every paragraph."""
    return find_spans(text, PARAGRAPH, many=True)


def _sentences_of(paragraph: Column) -> Column:
    spans = find_spans(paragraph["hit"], SENTENCE, many=True)
    bare = F.transform(spans, lambda s: F.struct((paragraph["start"] + s["start"] + leading(s["hit"])).alias("start"), strip(s["hit"]).alias("hit")))
    return F.transform(F.filter(bare, lambda s: s["hit"] != ""), lambda s: F.struct(s["start"].alias("start"), (s["start"] + F.length(s["hit"])).alias("end"), s["hit"].alias("hit")))


def sentences(text: Column) -> Column:
    """``paragraph``, ``sentence`` (running number), ``start``, ``end``, ``hit`` of every sentence."""

    def numbered(groups: Column) -> Column:
        flat = F.flatten(F.transform(groups, lambda g, p: F.transform(g, lambda s: F.struct(p.alias("paragraph"), s["start"].alias("start"), s["end"].alias("end"), s["hit"].alias("hit")))))
        return F.transform(flat, lambda s, i: F.struct(s["paragraph"].alias("paragraph"), i.alias("sentence"), s["start"].alias("start"), s["end"].alias("end"), s["hit"].alias("hit")))

    return bind(F.transform(paragraphs(text), _sentences_of), numbered)


def _segment(kind: str, start: Column, end: Column, **known: Column) -> Column:
    fields = {"kind": F.lit(kind), "raw_start": start, "raw_end": end}
    for name in ("page", "paragraph", "sentence"):
        fields[name] = known.get(name, F.lit(None)).cast("int")
    for name in ("field", "label"):
        fields[name] = known.get(name, F.lit(None)).cast("string")
    return F.struct(*[v.alias(k) for k, v in fields.items()])


def headings(text: Column) -> Column:
    """``field`` segments of Markdown headings; the label is the level."""

    def one(s: Column) -> Column:
        title = F.length(F.regexp_extract(s["hit"], HEADING, 2))
        return _segment("field", s["end"] - title, s["end"], field=F.lit("heading"), label=F.length(F.regexp_extract(s["hit"], HEADING, 1)))

    return F.transform(find_spans(text, HEADING, F.contains(text, F.lit("#"))), one)


def rank(kind: Column) -> Column:
    return F.array_position(F.lit(list(SEGMENT_KINDS)), kind)


def ordered(segments: Column) -> Column:
    """By start, longest first, kind, field and label."""
    keyed = F.transform(segments, lambda s: F.struct(s["raw_start"], (-s["raw_end"]).alias("less"), rank(s["kind"]).alias("rank"), F.coalesce(s["field"], F.lit("")).alias("f"), F.coalesce(s["label"], F.lit("")).alias("l"), s.alias("segment")))
    return F.transform(F.array_sort(keyed), lambda k: k["segment"])


def text_segments(text: Column, markdown: bool = False) -> Column:
    """All segments of a plain (or Markdown) text, in order."""

    def both(groups: Column) -> Column:
        """From paragraphs with their sentences."""
        outer = F.transform(groups, lambda g, p: _segment("paragraph", g["start"], g["end"], paragraph=p))
        counts = running(F.transform(groups, lambda g: F.size(g["inner"])))
        inner = F.flatten(F.transform(F.arrays_zip(groups.alias("g"), counts.alias("n")), lambda z, p: F.transform(z["g"]["inner"], lambda s, i: _segment("sentence", s["start"], s["end"], paragraph=p, sentence=z["n"] - F.size(z["g"]["inner"]) + i))))
        return F.concat(outer.cast(f"array<{SEGMENT}>"), inner.cast(f"array<{SEGMENT}>"))

    groups = F.transform(paragraphs(text), lambda p: F.struct(p["start"].alias("start"), p["end"].alias("end"), _sentences_of(p).alias("inner")))
    found = bind(groups, both)
    if markdown:
        found = F.concat(found, headings(text).cast(f"array<{SEGMENT}>"))
    return ordered(found)


def explode_paragraphs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    rows = docs.select(F.col(key), F.posexplode(paragraphs(F.col(text))).alias("paragraph", "p"))
    return rows.select(key, "paragraph", F.col("p.start").alias("start"), F.col("p.end").alias("end"), F.col("p.hit").alias("text"))


def explode_sentences(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    rows = docs.select(F.col(key), F.explode(sentences(F.col(text))).alias("s"))
    return rows.select(key, F.col("s.paragraph").alias("paragraph"), F.col("s.sentence").alias("sentence"), F.col("s.start").alias("start"), F.col("s.end").alias("end"), F.col("s.hit").alias("text"))


class Counters(NamedTuple):
    """Numbers at which the next block of a document goes on."""

    paragraph: int = 0
    sentence: int = 0


_PY_PARAGRAPH = re.compile(rf"\S(?:[^\S{_LINE}]*(?:\r\n|[{_LINE}])?[^\S{_LINE}]*\S+)*")
_PY_SENTENCE = re.compile(SENTENCE)


def block_segments(text: str, base: int = 0, page: int | None = None, at: Counters = Counters()) -> tuple[list[dict], Counters]:
    """The same for one block of a loader's text, in Python; numbers go on from ``at``."""
    out, paragraph, sentence = [], at.paragraph, at.sentence
    empty = {"page": page, "paragraph": None, "sentence": None, "field": None, "label": None}
    for p in _PY_PARAGRAPH.finditer(text):
        out.append(empty | {"kind": "paragraph", "raw_start": base + p.start(), "raw_end": base + p.end(), "paragraph": paragraph})
        for s in _PY_SENTENCE.finditer(p.group()):
            kept = s.group().strip()
            if kept:
                start = base + p.start() + s.start() + len(s.group()) - len(s.group().lstrip())
                out.append(empty | {"kind": "sentence", "raw_start": start, "raw_end": start + len(kept), "paragraph": paragraph, "sentence": sentence})
                sentence += 1
        paragraph += 1
    return out, Counters(paragraph, sentence)
