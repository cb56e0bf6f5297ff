"""Language identification by Bayesian evidence fusion.

log P(language | page) adds the text's likelihood (letter trigrams of its words), the declared markup language, the address
suffix and a host prior.  A host's prior is its documents' expected languages, counted from the text likelihoods by grouped
aggregation, smoothed towards those of its suffix, which are smoothed towards those of all: a host of which little is known
borrows from the level above.  The evidence of a text counts for ``WEIGHT`` trigrams at most, since neighbouring trigrams aren't
independent.  Whole texts are read.

Trigram models are fitted on at most ``PER_LANGUAGE`` labelled rows of each language, those with the least hashes of their
ids, outside the held-out fold; every language that has such a row is fitted.

A text without letters (null, empty, marks only) has no likelihood; its language is null and it is rejected, whatever the other evidence says.
Otherwise a document is rejected if its best language's posterior is below ``LEAST``, or if no language is likelier than the background: any
other language or noise, which has all known trigrams and one for the unknown alike and the prior ``OTHER``.  Its language is null then.  Null hosts, suffixes and
declarations are no evidence; null hosts share one prior.  Equal posteriors go to the language that sorts first.  Without any labelled row no
language is known, and nothing is rejected.  An empty table gives an empty table; very long texts are read in chunks; evidence has names of its own,
so other columns' names can't clash with it, and ``keep`` hands them on.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.llm.quality import fold
from tracewell.llm.runtime import cut

PER_LANGUAGE, LEAST, WEIGHT = 400, 0.5, 40
#: The prior of the background.
OTHER = 0.01
#: How sure a declaration and an address suffix are, and how many documents the level above counts for.
DECLARED, SUFFIXED, ABOVE = 0.8, 0.6, 8.0
#: Hosts of which priors are sent to all tasks; more are joined.
SMALL = 20_000
#: Country suffixes of addresses and the languages that they speak for.
SUFFIX_LANGUAGE = {"fr": "fr", "de": "de", "at": "de", "es": "es", "mx": "es", "ar": "es", "uk": "en", "us": "en", "au": "en", "it": "it", "pt": "pt", "br": "pt", "nl": "nl", "pl": "pl"}


class Model(NamedTuple):
    """Log-likelihoods of trigrams by language; ``codes`` are sorted, the last row is that of trigrams no language has."""

    languages: list[str]
    codes: np.ndarray
    rows: np.ndarray


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Of each code point whether it is a letter: a word's characters without decimal digits and underscores."""
    return np.array([chr(c).isalnum() and not chr(c).isdecimal() for c in range(0x110000)])


def trigrams(text: str) -> np.ndarray:
    """Codes of the letter trigrams of a text's words in lower case; a word's ends count as letters of their own.

    Each letter is the middle of one trigram.
    """
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    letter = _letters()[points]
    points[~letter] = 0
    middle = np.flatnonzero(letter)
    return points[middle - 1] << 42 | points[middle] << 21 | points[middle + 1]


def train(docs: DataFrame, label: str = "lang", key: str = "doc_id", text: str = "text", per_language: int = PER_LANGUAGE) -> Model:
    rows = docs.where(F.col(label).isNotNull() & F.coalesce(fold(F.col(key)) != 0, F.lit(True)))
    languages = sorted(r.l for r in rows.select(F.col(label).alias("l")).distinct().collect())
    if not languages:
        return Model([], np.zeros(0, np.int64), np.zeros((1, 0)))
    ids = rows.select(F.col(key).alias("key"), F.col(label).alias("label"))
    order = [F.xxhash64(F.col("key").cast("string")), F.col("key")]
    sample = None
    for language in languages:
        part = ids.where(F.col("label") == language).orderBy(*order).limit(per_language)
        sample = part if sample is None else sample.unionAll(part)
    # At most PER_LANGUAGE ids of each language.
    source = docs.select(F.col(key).alias("key"), F.col(label).alias("label"), F.col(text).cast("string").alias("text"))
    chosen = source.join(F.broadcast(sample.distinct()), ["key", "label"]).select("label", "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}
        for batch in batches:
            for language, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                codes, n = np.unique(trigrams(value.as_py() or ""), return_counts=True)
                counts.setdefault(language, Counter()).update(dict(zip(codes.tolist(), n.tolist(), strict=True)))
        flat = [(lang, g, n) for lang, c in counts.items() for g, n in c.items()]
        yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in flat], t) for i, t in enumerate([pa.string(), pa.int64(), pa.int64()])], ["l", "g", "n"])

    found = chosen.mapInArrow(work, "l string, g long, n long").groupBy("l", "g").agg(F.sum("n").alias("n")).toArrow().to_pydict()
    number = {x: i for i, x in enumerate(languages)}
    codes, at = np.unique(np.array(found["g"], np.int64), return_inverse=True)
    counts = np.zeros((len(codes), len(languages)))
    np.add.at(counts, (at, [number[x] for x in found["l"]]), found["n"])
    size = counts.sum(axis=0) + 0.5 * (len(codes) + 1)
    return Model(languages, codes, np.log((np.concatenate([counts, np.zeros((1, len(languages)))]) + 0.5) / size))


def likelihood(text: str | None, model: Model, chunk: int = 1 << 20) -> tuple[np.ndarray, int]:
    """Log-likelihoods of a text's languages, the best at 0, and its number of trigrams."""
    return with_background(text, model, chunk)[:2]


def with_background(text: str | None, model: Model, chunk: int = 1 << 20) -> tuple[np.ndarray, int, float]:
    """The same, and the log-likelihood of the background on that scale."""
    text = text or ""
    total, size, k = np.zeros(len(model.languages)), 0, len(model.codes)
    start = 0
    while start < len(text) and k:
        end = min(len(text), start + chunk)
        while end < len(text) and text[end - 1].isalnum():  # not within a word
            end += 1
        codes = trigrams(text[start:end])
        at = np.minimum(np.searchsorted(model.codes, codes), k - 1)
        at[model.codes[at] != codes] = k
        total += np.bincount(at, minlength=k + 1) @ model.rows if len(at) > k else model.rows[at].sum(axis=0)
        start, size = end, size + len(codes)
    if not size:
        return np.zeros(len(model.languages)), 0, 0.0
    out = total * (min(size, WEIGHT) / size)
    return out - out.max(), size, float(-math.log(k + 1) * min(size, WEIGHT) - out.max())


def with_likelihood(docs: DataFrame, model: Model, text: str = "text", columns: list[str] | None = None, name: str = "_ll", size: str = "_grams", other: str = "_other") -> DataFrame:
    """Some columns of the rows (all, if none are named) with the likelihoods, the number of trigrams and the background's likelihood."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.columns if columns is None else columns
    source = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(text).cast("string").alias("_text"))
    schema = T.StructType([source.schema[c] for c in kept] + [T.StructField(name, T.ArrayType(T.DoubleType())), T.StructField(size, T.LongType()), T.StructField(other, T.DoubleType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            found = [with_background(t.as_py(), model) for t in batch.column(len(kept))]
            extra = [pa.array([v for v, _, _ in found], pa.list_(pa.float64())), pa.array([n for _, n, _ in found], pa.int64()), pa.array([b for _, _, b in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *extra], [*kept, name, size, other])

    return source.mapInArrow(work, schema)


def _normal(weights: Column) -> Column:
    """Weights scaled to sum to 1."""
    total = F.aggregate(weights, F.lit(0.0), lambda a, x: a + x)
    return F.transform(F.arrays_zip(weights.alias("w"), F.array_repeat(total, F.size(weights)).alias("t")), lambda x: x["w"] / x["t"])


def host_priors(found: DataFrame, host: str, suffix: str, languages: list[str]) -> DataFrame:
    """``_host``, ``_suffix`` and ``_prior`` (probabilities by language).  ``found``: host, suffix, _ll and _grams of every row."""
    k = len(languages)
    soft = found.where((F.col("_grams") > 0) & (F.col("_other") <= -math.log(OTHER))).select(F.coalesce(F.col(host).cast("string"), F.lit("")).alias("_host"), F.coalesce(F.col(suffix).cast("string"), F.lit("")).alias("_suffix"), _normal(F.transform("_ll", F.exp)).alias("p"))
    hosts = cut(soft.groupBy("_host", "_suffix").agg(*[F.sum(F.get("p", F.lit(i))).alias(f"n{i}") for i in range(k)]))
    level = hosts.groupBy("_suffix").agg(*[F.sum(f"n{i}").alias(f"s{i}") for i in range(k)])
    top = level.agg(*[F.sum(f"s{i}").alias(f"g{i}") for i in range(k)]).first()
    whole = sum(x or 0.0 for x in top)
    share = [((x or 0.0) + 1) / (whole + k) for x in top]
    all_s, all_n = sum((F.col(f"s{i}") for i in range(k)), F.lit(0.0)), sum((F.col(f"n{i}") for i in range(k)), F.lit(0.0))
    level = level.select("_suffix", *[((F.col(f"s{i}") + ABOVE * share[i]) / (all_s + ABOVE)).alias(f"p{i}") for i in range(k)])
    return hosts.join(level, "_suffix").select("_host", "_suffix", F.array(*[(F.col(f"n{i}") + ABOVE * F.col(f"p{i}")) / (all_n + ABOVE) for i in range(k)]).alias("_prior"))


def fuse(found: DataFrame, priors: DataFrame, languages: list[str], host: str, suffix: str, markup: str | None) -> DataFrame:
    """Adds ``_lang`` and ``_posterior`` to rows with likelihoods."""
    k = len(languages)
    named = found.withColumns({"_h": F.coalesce(F.col(host).cast("string"), F.lit("")), "_s": F.coalesce(F.col(suffix).cast("string"), F.lit(""))})
    right = cut(priors.withColumnsRenamed({"_host": "_h", "_suffix": "_s"}))
    joined = named.join(F.broadcast(right) if right.count() <= SMALL else right, ["_h", "_s"], "left")
    listed = F.array(*[F.lit(x) for x in languages])

    def evidence(said: Column, sure: float) -> Column:
        """log P(said | language), 0 where nothing is said, or a language that isn't known."""
        return F.when(F.array_contains(listed, said), F.transform(listed, lambda x: F.when(x == said, F.lit(math.log(sure))).otherwise(F.lit(math.log((1 - sure) / max(1, k - 1)))))).otherwise(F.array_repeat(F.lit(0.0), k))

    country = F.element_at(F.create_map(*[F.lit(x) for kv in SUFFIX_LANGUAGE.items() for x in kv]), F.col("_s"))
    declared = F.lower(F.regexp_extract(F.col(markup).cast("string"), "^[A-Za-z]+", 0)) if markup else F.lit(None).cast("string")
    parts = F.arrays_zip(F.col("_ll").alias("a"), F.coalesce(F.transform("_prior", lambda p: F.ln(p)), F.array_repeat(F.lit(0.0), k)).alias("b"), evidence(declared, DECLARED).alias("c"), evidence(F.coalesce(country, F.lit("")), SUFFIXED).alias("d"))
    total = F.transform(parts, lambda x: x["a"] + x["b"] + x["c"] + x["d"])
    summed = joined.withColumn("_total", total).withColumn("_best", F.array_max("_total"))
    odds = F.aggregate(F.col("_total"), F.lit(0.0), lambda a, x: a + F.exp(x - F.col("_best")))
    # The background says each language as often as any other.
    said = sum((F.when(F.array_contains(listed, x), -math.log(k)).otherwise(0.0) for x in (F.coalesce(declared, F.lit("")), F.coalesce(country, F.lit("")))), F.lit(math.log(OTHER)))
    known = (F.col("_grams") > 0) & (F.col("_other") + said <= F.col("_best") + F.ln(odds))
    return summed.withColumn("_lang", F.when(known, F.get(listed, (F.array_position("_total", F.col("_best")) - 1).cast("int")))).withColumn("_posterior", F.when(known, F.round(1 / odds, 6)))


def identify(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", host: str = "source", suffix: str | None = None, markup: str | None = None) -> DataFrame:
    """``key``, ``language``, ``posterior`` and ``rejected`` of every row."""
    if not model.languages:
        return docs.select(F.col(key), F.lit(None).cast("string").alias("language"), F.lit(None).cast("double").alias("posterior"), F.lit(False).alias("rejected"))
    columns = {"_key": F.col(key), "_name": F.col(host).cast("string"), "_end": F.col(suffix).cast("string") if suffix else F.lit(None).cast("string"), "_said": F.col(markup).cast("string") if markup else F.lit(None).cast("string")}
    source = docs.select(*[c.alias(n) for n, c in columns.items()], F.col(text).alias("_words"))
    found = cut(with_likelihood(source, model, "_words", list(columns)))
    out = fuse(found, host_priors(found, "_name", "_end", model.languages), model.languages, "_name", "_end", "_said")
    return out.select(F.col("_key").alias(key), F.col("_lang").alias("language"), F.col("_posterior").alias("posterior"), F.coalesce(F.col("_posterior") < LEAST, F.lit(True)).alias("rejected"))


def _site(host: Column) -> tuple[Column, Column]:
    """A host in lower case and its address suffix: the last label, if there are several."""
    host = F.lower(host.cast("string"))
    return host, F.nullif(F.regexp_extract(host, r"\.([^.]*)$", 1), F.lit(""))


def _markup(text: Column) -> Column:
    """The language that a text's own markup declares."""
    return F.nullif(F.regexp_extract(text, r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]+)", 1), F.lit(""))


def document_evidence(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """``key``, ``text``, ``host``, ``suffix`` and ``markup`` of documents, whose source may be a host and whose text may hold markup."""
    site, suffix = _site(F.col(host))
    return docs.select(F.col(key), F.col(text).alias("text"), site.alias("host"), suffix.alias("suffix"), _markup(F.col(text)).alias("markup"))


def keep(docs: DataFrame, model: Model, text: str = "text", host: str = "source") -> DataFrame:
    """The rows, with all their columns, that aren't rejected.  Likelihoods are made twice, so that texts aren't shuffled."""
    if not model.languages:
        return docs
    names = docs.columns
    site, suffix = _site(F.col(host))
    brief = docs.select(site.alias("_name"), suffix.alias("_end"), F.col(text).alias("_words"))
    priors = host_priors(with_likelihood(brief, model, "_words", ["_name", "_end"]), "_name", "_end", model.languages)
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), site.alias("_name"), suffix.alias("_end"), _markup(F.col(text)).alias("_said"), F.col(text).alias("_words"))
    out = fuse(with_likelihood(held, model, "_words", ["_row", "_name", "_end", "_said"]), priors, model.languages, "_name", "_end", "_said")
    return out.where(F.col("_posterior") >= LEAST).select("_row.*")


def page_evidence(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``key`` of pages with ``host``, ``suffix`` (the address's last label), ``markup`` (the declared language) and ``text`` without tags."""
    host, suffix = _site(F.regexp_extract(F.col(url), "://([^/?#:]*)", 1))
    bare = F.regexp_replace(F.regexp_replace(F.col(html), r"(?is)<(script|style)\b[^>]*+>.*?</\1\s*>|<!--.*?-->", " "), "<[^>]*+>|&[#A-Za-z0-9]{1,9};", " ")
    return pages.select(F.col(key), bare.alias("text"), host.alias("host"), suffix.alias("suffix"), _markup(F.col(html)).alias("markup"))
