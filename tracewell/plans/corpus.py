"""A synthetic corpus of sentences made from orders: every rule fires a known number of times.

Texts are made from columns, so what is expected can be computed from the columns without reading the texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.functions.ids import stable_id
from tracewell.operators.segments import text_segments

FIRST = ("Alice", "Robert", "Carol", "David", "Erika", "Frank", "Grace")
LAST = ("Smith", "Williams", "Jones", "Keller", "Martin")
COMPANY = ("Acme", "Globex", "Initech", "Umbrella", "Northwind", "Contoso")
SUFFIX = ("Corporation", "Inc", "LLC", "Company")
TEMPLATES = 14


def with_names(orders: DataFrame) -> DataFrame:
    """Orders with the names, numbers and dates that templates use."""
    pick = lambda values, index: F.element_at(F.lit(list(values)), (index % len(values) + 1).cast("int"))
    c, k = F.col("o_custkey"), F.col("o_orderkey")
    return orders.select(
        k.alias("doc_id"), (k % TEMPLATES).cast("int").alias("template"), F.to_date("o_orderdate").alias("day"),
        F.concat_ws(" ", pick(FIRST, c), pick(LAST, F.floor(c / len(FIRST)))).alias("person"), F.concat_ws(" ", pick(FIRST, c + 3), pick(LAST, F.floor(c / len(FIRST)) + 1)).alias("other"),
        F.concat_ws(" ", pick(COMPANY, c), pick(SUFFIX, F.floor(c / len(COMPANY)))).alias("company"), (k + 100_000).cast("string").alias("number"),
    )


def texts(orders: DataFrame) -> DataFrame:
    """``doc_id``, ``template``, ``reference`` and ``text``, with the names they were made of."""
    named = with_names(orders)
    us, month, iso = F.date_format("day", "MMMM d, yyyy"), F.date_format("day", "MMMM yyyy"), F.date_format("day", "yyyy-MM-dd")
    lines = [
        F.concat(F.lit("On "), us, F.lit(", "), "person", F.lit(" approved Contract #"), "number", F.lit(" for "), "company", F.lit(".")),
        F.concat("person", F.lit(" did not approve Invoice #"), "number", F.lit(" in "), month, F.lit(".")),
        F.concat("person", F.lit(" may approve Payment #"), "number", F.lit(" on "), iso, F.lit(".")),
        F.concat("company", F.lit(" paid Order #"), "number", F.lit(" on "), us, F.lit(".")),
        F.lit("He approved it."),
        F.concat("person", F.lit(" works for "), "company", F.lit(".")),
        F.concat("person", F.lit(" did not work for "), "company", F.lit(".")),
        F.concat("person", F.lit(" was the president of "), "company", F.lit(".")),
        F.concat("person", F.lit(" met with "), "other", F.lit(".")),
        F.concat(F.lit("the term ran from "), iso, F.lit(" to "), F.date_format(F.date_add("day", 30), "yyyy-MM-dd"), F.lit(".")),
        F.concat(F.lit("the entry of "), iso, F.lit(" 09:30 was kept for "), F.date_format("day", "yyyy"), F.lit(".")),
        F.concat(F.lit("the filing happened yesterday and "), F.lit("two weeks ago.")),
        F.concat(F.lit("Dr. "), "person", F.lit(" stayed in Berlin.")),
        F.concat(F.lit("write to user"), "number", F.lit("@example.com today.")),
    ]
    text = F.coalesce(*[F.when(F.col("template") == i, line) for i, line in enumerate(lines)])
    return named.select("doc_id", "template", "day", "person", "other", "company", "number", iso.alias("reference"), text.alias("text"))


def documents(rows: DataFrame, key: str = "doc_id", text: str = "text", reference: str | None = "reference") -> DataFrame:
    """Rows of a table of texts as documents of a case: one for each row, with its key in ``doc_id``."""
    from tracewell.functions.text import normalize_newlines, offset_transitions

    raw = F.coalesce(F.col(text).cast("string"), F.lit(""))
    said = F.col(reference).cast("string") if reference and reference in rows.columns else F.lit(None).cast("string")
    base = rows.select(F.col(key).alias("doc_id"), raw.alias("raw_text"), said.alias("reference"))
    digest = F.sha2(F.col("raw_text"), 256)
    return base.select(
        "doc_id", stable_id("doc", F.col("doc_id"), digest).alias("id"), digest.alias("content_sha256"), F.lit("text/plain").alias("media_type"), "raw_text", normalize_newlines(F.col("raw_text")).alias("normalized_text"),
        offset_transitions(F.col("raw_text")).alias("offset_transitions"), text_segments(F.col("raw_text")).alias("segments"), "reference",
    )


def corpus(orders: DataFrame) -> DataFrame:
    return documents(texts(orders))


def mails(orders: DataFrame) -> DataFrame:
    """One e-mail for each order, as documents with header fields and located addresses."""
    from tracewell.functions.text import normalize_newlines, offset_transitions
    from tracewell.model import SEGMENT
    from tracewell.operators.evidence import HEADER_PLACE

    rows = with_names(orders)
    address = lambda name, host: F.concat(F.lit("u"), F.lower(F.replace(name, F.lit(" "), F.lit("."))), "number", F.lit(f"@{host}.example"))
    rows = rows.withColumns({"a": address(F.col("person"), "left"), "b": address(F.col("other"), "right"), "said": F.date_format("day", "yyyy-MM-dd")})
    parts = [("from", F.concat("person", F.lit(" <"), "a", F.lit(">"))), ("to", F.concat("other", F.lit(" <"), "b", F.lit(">"))), ("date", F.col("said"))]
    text, at, segments, places = F.lit(""), F.lit(0), [], []
    for i, (field, value) in enumerate(parts):
        label = f"{field.title()}: "
        text = F.concat(text, F.lit(("\r\n" if i else "") + label), value)
        start = at + len(label) + (2 if i else 0)
        at = start + F.length(value)
        segments.append(F.struct(F.lit("field").alias("kind"), start.alias("raw_start"), at.alias("raw_end"), F.lit(None).cast("int").alias("page"), F.lit(None).cast("int").alias("paragraph"), F.lit(None).cast("int").alias("sentence"), F.lit(field).alias("field"), F.lit(None).cast("string").alias("label")))
        if field != "date":
            name, mail = ("person", "a") if field == "from" else ("other", "b")
            places.append(F.struct(F.lit(field).alias("field"), start.alias("name_start"), (start + F.length(name)).alias("name_end"), (start + F.length(name) + 2).alias("address_start"), (at - 1).alias("address_end"), F.col(mail).alias("address")))
    rows = rows.withColumns({"raw_text": text, "segments": F.array(*segments).cast(f"array<{SEGMENT}>"), "header_places": F.array(*places).cast(HEADER_PLACE)})
    digest = F.sha2(F.col("raw_text"), 256)
    return rows.select("doc_id", stable_id("doc", F.col("doc_id"), digest).alias("id"), digest.alias("content_sha256"), F.lit("message/rfc822").alias("media_type"), "raw_text", normalize_newlines(F.col("raw_text")).alias("normalized_text"), offset_transitions(F.col("raw_text")).alias("offset_transitions"), "segments", "header_places", F.col("said").alias("reference"))
