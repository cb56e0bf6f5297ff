"""Registered queries of the operators: each applies one to its whole table and derives the contract's columns."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm import bpe, fingerprint, language, packing, pii, quality, simhash, tiff, url_filter, warc
from tracewell.llm.runtime import table


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", F.coalesce(quality.fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= quality.CUT).cast("int").alias("predicted"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.identify(language.document_evidence(docs), language.train(docs), "doc_id", "text", "host", "suffix", "markup")


def language_of_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same method where markup and addresses speak too."""
    model = language.train(table(spark, sf_dir, "documents"))
    pages = language.page_evidence(table(spark, sf_dir, "pages"), "page_id")
    return language.identify(pages, model, "page_id", "text", "host", "suffix", "markup")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compare_neighbours(table(spark, sf_dir, "documents"))


def _is(kind: str):
    return lambda s: s["kind"] == kind


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"))
    counts = [F.size(F.filter("spans", _is(kind))).cast("long").alias(f"n_{kind}") for kind in pii.BASE]
    return found.select("doc_id", *counts, F.sha2(pii.listed(F.col("spans"), pii.BASE), 256).alias("base_sha256"), pii.listed(F.col("spans"), pii.KINDS).alias("spans"), F.size("spans").cast("long").alias("n_spans"), F.array_join(F.transform("spans", lambda s: F.round(s["score"], 2).cast("string")), ",").alias("scores"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), rounds=None)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), words=4, d=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiff.digest_documents(table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = warc.new_folder(spark, "warc")
    warc.write_pages(table(spark, sf_dir, "pages"), folder, least=0)
    return warc.read_archives(spark, folder, keep_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filter": op1_url_filter,
    "op2_simhash": op2_simhash,
    "op3_tiff": op3_tiff,
    "op4_quality": op4_quality,
    "op5_language": op5_language,
    "language_of_pages": language_of_pages,
    "op6_bpe": op6_bpe,
    "op7_warc": op7_warc,
    "op8_fingerprint": op8_fingerprint,
    "op9_pii": op9_pii,
    "op10_packing": op10_packing,
}

ORACLES: dict[str, str] = {"op1_url_filter": url_filter.oracle()}
