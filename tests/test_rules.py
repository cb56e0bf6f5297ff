"""Segments, mentions, dates and claims, against Python's own expressions and against worked examples."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tracewell.functions import dates, spans, text
from tracewell.operators import claims as c
from tracewell.operators import evidence as ev
from tracewell.operators import mentions as m
from tracewell.operators import segments as sg
from tracewell.plans import corpus

WORDS = ["Alice", "Smith", "approved", "Contract", "#428", "for", "Acme", "Corporation", "on", "March", "3,", "2026", "bob@x.example.com", "did", "not", "may", "pay", "Dr.", "in", "Paris,", "France.", "He", "works", "New", "York", "LLC", "İstanbul", "ß", "\r\n", "\n\n", "\x1c", "é", "1999", "2020-01-05", "!", "?", ". ", "met", "with", " ", "Inc.", "'", "order", "A-12", "the"]


@pytest.fixture(scope="module")
def random_texts(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choices(WORDS, k=rng.randint(0, 60)))) for i in range(300)] + [(1000, None), (1001, ""), (1002, " \n\t\n ")]
    return spark.createDataFrame(rows, "doc_id long, text string").cache(), dict(rows)


def by_id(rows, *names):
    out = {}
    for r in rows:
        out.setdefault(r.doc_id, []).append(tuple(r[n] for n in names))
    return out


@pytest.mark.parametrize(
    "pattern,flags,gate",
    [(m.EMAIL, re.I, "@"), (m.IDENTIFIER, re.I, None), (m.TITLED, 0, None), (m.TWO_PART, 0, None), (m.ORGANIZATION, 0, None), (m.LOCATION, 0, None), (c.WORKS_FOR, 0, None), (c.EVENT, re.I, None), (c.MEETING, re.I, None), *[(p, re.I if i else 0, None) for _, p, i in dates.PATTERNS]],
)
def test_patterns_like_python(random_texts, pattern, flags, gate):
    df, texts = random_texts
    found = spans.find_spans(F.col("text"), m.java(pattern, bool(flags)))
    got = by_id(df.select("doc_id", F.explode(found).alias("s")).select("doc_id", "s.start", "s.end").collect(), "start", "end")
    for i, t in texts.items():
        assert got.get(i, []) == [x.span() for x in re.finditer(pattern, t or "", flags)]


def test_spans_in_blocks(spark):
    df = spark.createDataFrame([("ab " * 1000,), ("x",), ("",), (None,)], "text string")
    for many in (False, True):
        got = df.select(spans.find_spans(F.col("text"), "[ab]b?", many=many).alias("s")).collect()
        assert [(s.start, s.end) for s in got[0].s] == [x.span() for x in re.finditer("[ab]b?", "ab " * 1000)]
        assert [len(r.s) for r in got[1:]] == [0, 0, 0]


def test_paragraphs_and_sentences_like_python(random_texts):
    df, texts = random_texts
    got = by_id(df.select("doc_id", F.explode(sg.text_segments(F.col("text"))).alias("s")).select("doc_id", "s.*").collect(), "kind", "raw_start", "raw_end", "paragraph", "sentence")
    for i, t in texts.items():
        lines, runs, at, start, end = (t or "").splitlines(keepends=True), [], 0, None, 0
        for line in lines:
            if line.strip():
                start = at + len(line) - len(line.lstrip()) if start is None else start
                end = at + len(line.rstrip())
            elif start is not None:
                runs.append((start, end))
                start = None
            at += len(line)
        runs += [(start, end)] if start is not None else []
        want, n = [], 0
        for p, (a, b) in enumerate(runs):
            want.append(("paragraph", a, b, p, None))
            for s in re.finditer(r"[^.!?]+(?:[.!?]+|$)", t[a:b]):
                if s[0].strip():
                    first = a + s.start() + len(s[0]) - len(s[0].lstrip())
                    want.append(("sentence", first, first + len(s[0].strip()), p, n))
                    n += 1
        assert sorted(got.get(i, []), key=str) == sorted(want, key=str)
        blocks, _ = sg.block_segments(t or "")
        assert sorted(((b["kind"], b["raw_start"], b["raw_end"], b["paragraph"], b["sentence"]) for b in blocks), key=str) == sorted(want, key=str)


def test_headings(spark):
    df = spark.createDataFrame([("# One\ntext\n### Three \n#not\n",)], "text string")
    (row,) = df.select(sg.headings(F.col("text")).alias("h")).collect()
    assert [(h.raw_start, h.raw_end, h.label) for h in row.h] == [(2, 5, "1"), (15, 21, "3")]


def test_newlines_and_offsets(spark):
    raws = ["alpha\r\nbeta\rgamma\n", "\r\n\r\nx\r\n", "", "plain", "\r\r\n\n"]
    df = spark.createDataFrame([(r,) for r in raws], "raw string").select("raw", text.normalize_newlines(F.col("raw")).alias("norm"), text.offset_transitions(F.col("raw")).alias("t"))
    rows = df.select("raw", "norm", F.transform(F.sequence(F.lit(0), F.length("norm")), lambda i: text.to_raw(F.col("t"), i)).alias("map"), F.transform(F.sequence(F.lit(0), F.length("raw")), lambda i: text.to_normalized(F.col("t"), i)).alias("back")).collect()
    for r in rows:
        want, i = [0], 0
        while i < len(r.raw):
            i += 2 if r.raw[i : i + 2] == "\r\n" else 1
            want.append(i)
        assert r.norm == re.sub("\r\n?", "\n", r.raw) and list(r.map) == want
        assert list(r.back) == [next(k for k, x in enumerate(want) if x >= j) for j in range(len(r.raw) + 1)]


def test_base_mentions(spark):
    df = spark.createDataFrame([(1, "Robert Williams, Annual Report and New York at Acme Corporation. On March 3 Dr. Jane Roe wrote to bob@x.example.com about invoice no. A-99 in Paris, France.")], "doc_id long, text string")
    got = {(r.surface, r.entity_type): (r.score, r.normalized) for r in m.explode_mentions(df, m.base_mentions(F.col("text"))).collect()}
    assert got[("Robert Williams", "PERSON")] == (0.70, "robert williams") and got[("Acme Corporation", "ORGANIZATION")][0] == 0.91
    assert got[("Dr. Jane Roe", "PERSON")][0] == 0.90 and got[("bob@x.example.com", "OTHER")] == (0.995, "email:bob@x.example.com")
    assert got[("invoice no. A-99", "OTHER")] == (0.98, "invoice:a-99") and got[("Paris, France", "LOCATION")][0] == 0.72
    assert not {k for k, _ in got} & {"Annual Report", "New York", "On March"}


def one(spark, value, reference=None, **more):
    row = {"id": "doc_1", "raw_text": value, "normalized_text": value.replace("\r\n", "\n"), "reference": reference} | more
    df = spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} string" for k in row))
    return ev.extract_documents(df.withColumn("offset_transitions", text.offset_transitions(F.col("raw_text")))).first()


def test_negation_modality_and_pronouns(spark):
    x = one(spark, "Alice Smith did not approve Contract #A-123. Robert Williams may approve the payment. He approved it.")
    assert [(q.predicate, q.polarity, q.modality) for q in x.found_claims] == [("APPROVED", "NEGATED", "ASSERTED"), ("APPROVED", "AFFIRMED", "POSSIBLE")]
    assert one(spark, "Alice Smith and Acme Corporation attended the conference.").found_claims == []


def test_relations_and_meetings(spark):
    x = one(spark, "Alice Smith works for Acme Corporation. Bob Jones allegedly worked for Globex LLC. Carol Keller met with Frank Martin.")
    assert [(q.predicate, q.modality, [(p.role, x.normalized_text[p.start : p.end]) for p in q.participants]) for q in x.found_claims] == [
        ("WORKS_FOR", "ASSERTED", [("source", "Alice Smith"), ("target", "Acme Corporation")]),
        ("WORKS_FOR", "ALLEGED", [("source", "Bob Jones"), ("target", "Globex LLC")]),
        ("MET", "ASSERTED", [("participant", "Carol Keller"), ("participant", "Frank Martin")]),
    ]
    assert {q.score for q in x.found_mentions if q.entity_type == "ORGANIZATION"} == {0.94}


@pytest.mark.parametrize(
    "value,reference,want",
    [
        ("The filing happened yesterday.", "2026-08-14T12:00:00", ("2026-08-13", "2026-08-13", "DAY", None, True, True)),
        ("The filing happened yesterday.", None, (None, None, "UNRESOLVED", None, True, False)),
        ("The filing happened yesterday.", "March 3", (None, None, "UNRESOLVED", None, True, False)),
        ("The term begins in August 2026.", None, ("2026-08-01", "2026-08-31", "MONTH", None, False, True)),
        ("In 1999 it began.", None, ("1999-01-01", "1999-12-31", "YEAR", None, False, True)),
        ("On 3rd March, 2024 it ended", None, ("2024-03-03", "2024-03-03", "DAY", None, False, True)),
        ("March 3, 2024 to 2024-04-01", None, ("2024-03-03", "2024-04-01", "RANGE", None, False, True)),
        ("February 30, 2024 was no day", None, (None, None, "UNRESOLVED", None, False, False)),
        ("at 2026-03-02T09:30:15Z it", None, ("2026-03-02T09:30:15+00:00", "2026-03-02T09:30:15+00:00", "INSTANT", "UTC", False, True)),
        ("Friday, 14 August 2026 10:00:00 -0500", None, ("2026-08-14T10:00:00-05:00", "2026-08-14T10:00:00-05:00", "INSTANT", "UTC-05:00", False, True)),
        ("three months ago", "2026-05-31", ("2026-02-28", "2026-02-28", "DAY", None, True, True)),
        ("last Friday", "2026-08-14", ("2026-08-07", "2026-08-07", "DAY", None, True, True)),
        ("next Monday", "2026-08-14", ("2026-08-17", "2026-08-17", "DAY", None, True, True)),
    ],
)
def test_dates(spark, value, reference, want):
    (found,) = one(spark, value, reference).found_temporals
    e = found.expression
    assert (e.start, e.end, e.precision, e.timezone, e.is_relative, e.resolved) == want
    assert found.score == (0.65 if not e.resolved else 0.92 if e.precision == "YEAR" else 0.98)
    assert value[found.start : found.end] == e.original_text


def test_sentence_scope_of_dates(spark):
    x = one(spark, "In 1990 rain fell.\nAlice Smith paid Invoice #123 on March 3, 2024! It was 2001. In 2002 snow fell.")
    (claim,) = x.found_claims
    assert [t.expression.original_text for t in claim.temporals] == ["March 3, 2024", "2001"]


def test_evidence_of_raw_text(spark):
    raw = "First line.\r\n\r\nAlice  Smith paid Invoice #123. Rain fell.\r\n"
    docs = corpus.documents(spark.createDataFrame([(1, raw, None)], "doc_id long, text string, reference string"))
    x = ev.extract_documents(docs)
    rows = ev.mention_records(x).select("text", "evidence.*").collect()
    assert {r.quote for r in rows} == {"Alice  Smith", "Invoice #123"}
    for r in rows:
        assert raw[r.raw_start : r.raw_end] == r.quote and r.paragraph == 1 and r.sentence == 1 and r.normalized_start == r.raw_start - 2
    claim = ev.claim_records(x).first()
    assert {p.mention_id for p in claim.participants if p.role != "description"} == {r.id for r in ev.mention_records(x).select("id").collect()}


def test_three_bands(spark):
    df = spark.createDataFrame([("a", 0.95), ("b", 0.75), ("c", 0.40), ("d", 0.90), ("e", 0.60)], "id string, score double")
    got = {r.target_ids[0]: r.kind for r in ev.triage(df, "mention", F.array(F.lit("e"))).collect()}
    assert got == {"b": "mention_candidate", "c": "mention_candidate_deferred", "e": "mention_candidate"}


def test_selection_across_extractors(spark):
    rows = [("d", 0, 5, "PERSON", "x", 0.9, 2, "b", "1", "k1"), ("d", 0, 5, "PERSON", "x", 0.9, 1, "a", "1", "k2"), ("d", 0, 5, "PERSON", "x", 0.8, 0, "c", "1", "k3"), ("d", 0, 5, "OTHER", "x", 0.1, 0, "c", "1", "k4")]
    df = spark.createDataFrame(rows, "document_id string, start int, `end` int, entity_type string, normalized string, score double, extractor_order int, extractor_name string, extractor_version string, key string")
    assert {r.key: r.winner_key for r in m.select_across(df).collect()} == {"k1": "k2", "k2": "k2", "k3": "k2", "k4": "k4"}


def test_long_amounts_of_relative_dates(spark):
    from datetime import date, timedelta

    from tracewell.functions.dates import parse_relative

    rows = [("100000 days ago", "2024-05-06"), ("0000000003 days ago", "2024-05-06"), ("9999999 weeks ago", "2024-05-06"), ("99999999999 years ago", "2024-05-06"), ("2024 years ago", "2024-05-06")]
    got = spark.createDataFrame(rows, "hit string, day string").select(parse_relative(F.col("hit"), F.col("day"))).collect()
    assert [str(r[0]) for r in got] == [str(date(2024, 5, 6) - timedelta(100_000)), "2024-05-03", "None", "None", "None"]
