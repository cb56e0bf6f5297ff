"""From offsets to evidence: quotes, page and sentence of a span, acceptance, and the records of a case.

``documents`` are rows of the collection of that name; extraction adds arrays to them.  Everything stays one row a document until
records are exploded, so nothing is shuffled; equal records have equal ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions import dates
from tracewell.functions.ids import stable_id
from tracewell.functions.spans import bind
from tracewell.functions.text import to_normalized, to_raw
from tracewell.model import BOX, CaseConfig
from tracewell.operators import claims as c
from tracewell.operators import mentions as m

#: A header's addresses as the loader located them: field, then display name and address with raw places.
HEADER_PLACE = "array<struct<field:string,name_start:int,name_end:int,address_start:int,address_end:int,address:string>>"


def field_spans(segments: Column, transitions: Column, field: str) -> Column:
    """Normalised spans of a header's values."""
    own = F.filter(segments, lambda s: (s["kind"] == "field") & (s["field"] == field))
    return F.transform(own, lambda s: F.struct(to_normalized(transitions, s["raw_start"]).alias("start"), to_normalized(transitions, s["raw_end"]).alias("end")))


def header_parties(places: Column, transitions: Column, fields: tuple[str, ...]) -> Column:
    """Mentions of the addresses of some headers."""
    own = F.filter(places, lambda p: p["field"].isin(*fields) & p["address_start"].isNotNull())
    return F.transform(own, lambda p: m.mention(to_normalized(transitions, p["address_start"]), to_normalized(transitions, p["address_end"]), "OTHER", m.SCORES["header-email"], F.concat(F.lit("email:"), F.lower(p["address"])), "header-email")).cast(m.MENTION)


def header_names(places: Column, transitions: Column, text: Column) -> Column:
    own = F.filter(places, lambda p: p["name_start"].isNotNull())
    spans = F.transform(own, lambda p: F.struct(to_normalized(transitions, p["name_start"]).alias("start"), to_normalized(transitions, p["name_end"]).alias("end")))
    return F.transform(spans, lambda s: m.mention(s["start"], s["end"], "PERSON", m.SCORES["header-name"], m.squeeze(F.substring(text, s["start"] + 1, s["end"] - s["start"])), "header-name")).cast(m.MENTION)


def extract_documents(documents: DataFrame, config: CaseConfig = CaseConfig(), model: Column | None = None) -> DataFrame:
    """Documents with ``found_mentions``, ``found_claims`` and ``found_temporals``.

    Needs ``normalized_text``; ``reference``, ``segments``, ``offset_transitions`` and ``header_places`` are used where present.
    """
    text, names = F.col("normalized_text"), set(documents.columns)
    reference = dates.reference_day(F.col("reference")) if "reference" in names else F.lit(None).cast("string")
    out = documents.withColumn("found_temporals", dates.temporals(text, reference, config.default_timezone))
    out, email = out.withColumn("_base", m.base_mentions(text, model)), None
    if "header_places" in names:
        places, moves = F.col("header_places"), F.col("offset_transitions")
        recipients = F.concat(*[header_parties(places, moves, (f,)) for f in ("to", "cc", "bcc")])
        day = bind(F.struct(field_spans(F.col("segments"), moves, "date").alias("s"), F.col("found_temporals").alias("t")), lambda x: F.filter(x["t"], lambda t: F.exists(x["s"], lambda s: (t["start"] >= s["start"]) & (t["end"] <= s["end"]))))
        out = out.withColumns({"_from": header_parties(places, moves, ("from",)), "_to": recipients, "_day": day, "_names": header_names(places, moves, text)})
        out = out.withColumn("_base", m.dedupe(F.concat("_base", "_from", "_to", "_names")))
        pairs = bind(F.struct(F.col("_from").alias("s"), F.col("_to").alias("r"), F.col("_day").alias("d")), lambda x: c.email_claims(x["s"], x["r"], x["d"]))
        email = F.when((F.size("_from") > 0) & (F.size("_to") > 0), pairs).otherwise(F.array().cast(c.CLAIM))
    return c.with_claims(out, "normalized_text", "_base", "found_temporals", email).drop("_base", "_from", "_to", "_day", "_names")


def best_segment(segments: Column, start: Column, end: Column) -> Column:
    """The innermost segment around a raw span: shortest, then kind, start and end."""
    around = F.filter(segments, lambda s: (s["raw_start"] <= start) & (s["raw_end"] >= end))
    keyed = F.transform(around, lambda s: F.struct((s["raw_end"] - s["raw_start"]).alias("n"), s["kind"].alias("k"), s["raw_start"], s["raw_end"], s.alias("s")))
    return F.get(F.array_sort(keyed), F.lit(0))["s"]


def boxes_of(boxes: Column, start: Column, end: Column) -> Column:
    """Word boxes that overlap a raw span, in order; boxes of impossible size are left out."""
    good = F.filter(boxes, lambda b: (b["raw_start"] < end) & (b["raw_end"] > start) & (b["page"] >= 1) & (b["x1"] >= b["x0"]) & (b["y1"] >= b["y0"]))
    return F.transform(F.array_sort(good), lambda b: F.struct(b["page"], b["x0"], b["y0"], b["x1"], b["y1"]))


def evidence(raw_text: Column, document_id: Column, transitions: Column, segments: Column, boxes: Column, start: Column, end: Column) -> Column:
    """The record of a normalised span."""

    def made(r: Column) -> Column:
        quote = F.substring(raw_text, r["a"] + 1, r["b"] - r["a"])
        return bind(best_segment(segments, r["a"], r["b"]), lambda s: F.struct(
            stable_id("evidence", document_id, r["a"], r["b"], quote).alias("id"), document_id.alias("document_id"), r["a"].alias("raw_start"), r["b"].alias("raw_end"), start.alias("normalized_start"), end.alias("normalized_end"),
            quote.alias("quote"), s["page"].alias("page"), s["paragraph"].alias("paragraph"), s["sentence"].alias("sentence"), s["field"].alias("field"), boxes_of(boxes, r["a"], r["b"]).alias("boxes"),
        ))

    return bind(F.struct(to_raw(transitions, start).alias("a"), to_raw(transitions, end).alias("b")), made)


def _own(extracted: DataFrame) -> tuple[DataFrame, tuple]:
    names = set(extracted.columns)
    empty = {"segments": "array<struct<kind:string,raw_start:int,raw_end:int,page:int,paragraph:int,sentence:int,field:string,label:string>>", "boxes": f"array<{BOX}>", "offset_transitions": "array<struct<idx:int,delta:int>>"}
    filled = extracted.withColumns({k: F.coalesce(F.col(k), F.array().cast(v)) if k in names else F.array().cast(v) for k, v in empty.items()})
    return filled, (F.col("raw_text"), F.col("id"), F.col("offset_transitions"), F.col("segments"), F.col("boxes"))


def mention_records(extracted: DataFrame, config: CaseConfig = CaseConfig(), name: str = m.NAME, version: str = m.VERSION) -> DataFrame:
    """``mentions`` with their evidence (struct ``evidence``)."""
    filled, own = _own(extracted)
    rows = filled.select("id", "raw_text", "offset_transitions", "segments", "boxes", F.explode("found_mentions").alias("m"))
    rows = rows.select("m", evidence(*own, F.col("m.start"), F.col("m.end")).alias("evidence"))
    score = F.col("m.score")
    return rows.select(
        stable_id("mention", F.col("evidence.id"), F.col("m.entity_type"), F.col("m.normalized"), F.lit(name), F.lit(version)).alias("id"), F.col("evidence.id").alias("evidence_span_id"), F.col("m.entity_type").alias("entity_type"),
        F.col("evidence.quote").alias("text"), F.col("m.normalized").alias("normalized_text"), F.lit(name).alias("extractor_name"), F.lit(version).alias("extractor_version"), score.alias("score"), (score >= config.accept_threshold).alias("accepted"), "evidence",
    )


def claim_records(extracted: DataFrame, config: CaseConfig = CaseConfig(), name: str = m.NAME, version: str = m.VERSION) -> DataFrame:
    """``claims`` with their evidence and that of their dates (``all_evidence``)."""
    filled, own = _own(extracted)
    rows = filled.where(F.size("found_claims") > 0)
    rows = rows.select("id", "raw_text", "offset_transitions", "segments", "boxes", "found_mentions", F.explode("found_claims").alias("c"))
    place = lambda a, b: evidence(*own, a, b)

    def party(p: Column) -> Column:
        def named(known: Column) -> Column:
            of = F.get(F.filter(known, lambda x: (x["start"] == p["start"]) & (x["end"] == p["end"]) & (x["entity_type"] == p["entity_type"])), F.lit(0))
            span = F.struct(to_raw(F.col("offset_transitions"), p["start"]).alias("a"), to_raw(F.col("offset_transitions"), p["end"]).alias("b"))
            ident = bind(span, lambda s: stable_id("evidence", F.col("id"), s["a"], s["b"], F.substring(F.col("raw_text"), s["a"] + 1, s["b"] - s["a"])))
            return F.when(p["start"].isNotNull(), stable_id("mention", ident, p["entity_type"], of["normalized"], F.lit(name), F.lit(version)))

        return F.struct(p["role"].alias("role"), bind(F.col("found_mentions"), named).alias("mention_id"), F.lit(None).cast("string").alias("entity_id"), p["literal"].alias("literal"))

    dated = F.transform(F.col("c.temporals"), lambda t: bind(place(t["start"], t["end"]), lambda e: F.struct(e.alias("e"), t["expression"].withField("evidence_span_id", e["id"]).alias("t"))))
    rows = rows.select("id", "c", place(F.col("c.start"), F.col("c.end")).alias("evidence"), F.transform("c.participants", party).alias("participants"), dated.alias("dated"))
    rows = rows.select("id", "c", "evidence", "participants", F.array_distinct(F.transform("dated", lambda d: d["t"])).alias("temporal"), F.concat(F.array("evidence"), F.transform("dated", lambda d: d["e"])).alias("all_evidence"))
    score = F.col("c.score")
    ident = stable_id("claim", F.col("id"), F.col("evidence.id"), F.col("c.kind"), F.col("c.predicate"), F.to_json("participants"), F.col("c.polarity"), F.col("c.modality"), F.to_json("temporal"), F.lit(name), F.lit(version))
    return rows.select(
        ident.alias("id"), F.col("c.kind").alias("kind"), F.col("c.predicate").alias("predicate"), "participants", F.array("evidence.id").alias("evidence_span_ids"), F.col("c.polarity").alias("polarity"), F.col("c.modality").alias("modality"),
        "temporal", F.lit(name).alias("extractor_name"), F.lit(version).alias("extractor_version"), score.alias("score"), (score >= config.accept_threshold).alias("accepted"), "all_evidence",
    )


def temporal_records(extracted: DataFrame) -> DataFrame:
    filled, own = _own(extracted)
    rows = filled.select("id", "raw_text", "offset_transitions", "segments", "boxes", F.explode("found_temporals").alias("t"))
    rows = rows.select(F.col("id").alias("document_id"), "t", evidence(*own, F.col("t.start"), F.col("t.end")).alias("evidence"))
    kept = [F.col(f"t.expression.{n}").alias(n) for n in ("original_text", "start", "end", "precision", "timezone", "is_relative", "resolved")]
    return rows.select("document_id", *kept, F.col("evidence.id").alias("evidence_span_id"), F.col("t.score").alias("score"), "evidence")


def claim_spans(claims: DataFrame) -> DataFrame:
    """Distinct evidence spans of claims and their dates."""
    return claims.select(F.explode("all_evidence").alias("e")).select("e.*").dropDuplicates(["id"])


def evidence_records(mentions: DataFrame, claims: DataFrame, temporals: DataFrame) -> DataFrame:
    """Distinct evidence spans of all records."""
    parts = [mentions.select("evidence.*"), claims.select(F.explode("all_evidence").alias("e")).select("e.*"), temporals.select("evidence.*")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).dropDuplicates(["id"])


def band(score: Column, config: CaseConfig = CaseConfig()) -> Column:
    """accept, review or deferred; nothing is dropped."""
    return F.when(score >= config.accept_threshold, "accept").when(score >= config.review_threshold, "review").otherwise("deferred")


def triage(records: DataFrame, kind: str, evidence_ids: Column, config: CaseConfig = CaseConfig()) -> DataFrame:
    """Review items of records (mention or claim) that aren't accepted by score."""
    where = band(F.col("score"), config)
    named = F.when(where == "review", f"{kind}_candidate").otherwise(f"{kind}_candidate_deferred")
    reason = F.when(where == "review", f"{kind} score is in the review band").otherwise(f"{kind} score is below the review band")
    rows = records.where(where != "accept")
    return rows.select(stable_id("review", F.lit(kind), F.col("id"), reason).alias("id"), named.alias("kind"), F.array("id").alias("target_ids"), reason.alias("reason"), F.col("score"), evidence_ids.alias("evidence_span_ids"))
