"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

A document's features are its distinct words, hashed to ``BUCKETS`` with weights that grow with the logarithm of their counts, and
statistics of its structure (shares of capitals, digits, marks, repeated words and lines, lengths) and metadata, each cut
into steps, of which every step is a feature.  With latent vectors v, all pairs' interactions are half the sum over factors of
(sum v x)^2 - sum (v x)^2, so a document is scored in time linear in its features.

The model is fitted on the driver on at most ``PER_CLASS`` labelled rows of each class, those with the least hashes of their
ids; of the held-out fold none.  Whole texts are read, for the fit and for scores.  Empty and null texts have structure features only, and a score.
Rows of the labels table without a label are ignored; if no label of one class is there, every score is the other class.
Labels that repeat count once, and an id that has both labels is an example of both classes.  Documents that repeat are scored
each for itself, so ties and repeated rows need no rule; rows that share a labelled id are examples each.  Very long texts are
scored whole, in memory of their distinct words.  An empty table gives an empty table; other columns are never read, so their
names can't clash, and ``keep`` hands them on.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS, STEPS, FACTORS, PER_CLASS, FOLDS, CUT = 1 << 13, 16, 6, 1500, 5, 0.3
#: Sampled texts are reduced to features on the executors; a document has at most BUCKETS of them.
_WORDS: dict[str, int] = {}
_STATS = 12


def bucket(word: str) -> int:
    """A word's hash; the memo is emptied when it is full."""
    found = _WORDS.get(word)
    if found is None:
        if len(_WORDS) > 300_000:
            _WORDS.clear()
        found = _WORDS[word] = zlib.crc32(word.encode("utf-8", "surrogatepass")) % BUCKETS
    return found


def statistics(text: str, words: Counter, n: int, metadata: float | None) -> list[float]:
    """Structure of a text, each from 0 to 1."""
    size = max(1, len(text))
    letters = len(text.translate(_DROP)) if text.isascii() else len(_OTHER.sub("", text))
    upper = len(_UPPER.findall(text))
    digits = sum(map(text.count, "0123456789"))
    spaces = text.count(" ") + text.count("\n")
    marks = size - letters - digits - spaces
    lines = text.split("\n")
    top = max(words.values(), default=0)
    return [
        upper / max(1, letters),
        digits / size,
        max(0, marks) / size,
        letters / size,
        1 - len(words) / max(1, n),
        top / max(1, n),
        1 - len(set(lines)) / len(lines),
        math.log1p(n) / 12,
        min(1.0, sum(map(text.count, "|#$%&*!")) / max(1, n)),
        min(1.0, (letters / max(1, n)) / 20),
        math.log1p(len(lines)) / 12,
        0.0 if metadata is None or metadata < 0 else min(1.0, math.log1p(metadata) / 16),
    ]


def _tables() -> tuple:
    import re

    drop = {c: None for c in range(128) if not chr(c).isalpha()}
    return drop, re.compile(r"[\W\d_]+"), re.compile("[A-ZÀ-ÖØ-Þ]")


_DROP, _OTHER, _UPPER = _tables()


def features(text: str | None, metadata: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Indexes and values of a document's features; the word part has length 1, and so has the structure part."""
    text = text or ""
    words = Counter(text.split())
    n = sum(words.values())
    stats = statistics(text, words, n, metadata)
    at = [BUCKETS + i * STEPS + min(STEPS - 1, int((math.sqrt(s) if i not in (7, 9, 10, 11) else s) * STEPS)) for i, s in enumerate(stats)]
    side = np.full(len(at), 1 / math.sqrt(len(at)))
    if not words:
        return np.array(at), side
    buckets = np.fromiter(map(bucket, words), np.int64, len(words))
    counts = np.log1p(np.fromiter(words.values(), np.float64, len(words)))
    whole = np.bincount(buckets, counts, BUCKETS) if len(buckets) > 400 else None
    if whole is not None:
        index = np.flatnonzero(whole)
        values = whole[index]
    else:
        index, back = np.unique(buckets, return_inverse=True)
        values = np.bincount(back, counts)
    return np.concatenate([index, at]), np.concatenate([values / math.sqrt(float(values @ values)), side])


class Machine:
    """Weights of a factorisation machine."""

    size = BUCKETS + _STATS * STEPS

    def __init__(self, factors: int = FACTORS, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.bias, self.w, self.v = 0.0, np.zeros(self.size), rng.normal(0, 0.05, (self.size, factors))

    def raw(self, index: np.ndarray, values: np.ndarray) -> float:
        vx = self.v[index] * values[:, None]
        total = vx.sum(axis=0)
        return float(self.bias + self.w[index] @ values + 0.5 * (total @ total - (vx * vx).sum()))

    def score(self, index: np.ndarray, values: np.ndarray) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.raw(index, values)))))

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, weights: np.ndarray, epochs: int = 12, rate: float = 0.15, decay: float = 1e-5, seed: int = 7) -> None:
        """AdaGrad over single rows, in an order that the seed fixes."""
        rng = np.random.default_rng(seed)
        gw, gv, gb = np.full(self.size, 1e-2), np.full(self.v.shape, 1e-2), 1e-2
        for _ in range(epochs):
            for i in rng.permutation(len(rows)):
                index, x = rows[i]
                error = (self.score(index, x) - labels[i]) * weights[i]
                if abs(error) < 1e-3:
                    continue
                vx = self.v[index] * x[:, None]
                step = error * x + decay * self.w[index]
                gw[index] += step * step
                self.w[index] -= rate * step / np.sqrt(gw[index])
                step = error * (x[:, None] * vx.sum(axis=0) - vx * x[:, None]) + decay * self.v[index]
                gv[index] += step * step
                self.v[index] -= rate * step / np.sqrt(gv[index])
                gb += error * error
                self.bias -= rate * error / math.sqrt(gb)


def fold(key: Column, folds: int = FOLDS) -> Column:
    return F.crc32(key.cast("string").cast("binary")) % folds


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", text: str = "text", metadata: str | None = "n_chars", per_class: int = PER_CLASS) -> Machine:
    """Fits a machine on labelled rows outside the held-out fold."""
    usable = labels.where(F.col(label).isin(0, 1) & (fold(F.col(key)) != 0)).select(F.col(key).alias("key"), F.col(label).cast("int").alias("label"))
    order = [F.xxhash64(F.col("key").cast("string")), F.col("key")]
    sample = usable.where("label = 0").orderBy(*order).limit(per_class).unionAll(usable.where("label = 1").orderBy(*order).limit(per_class))
    counts = {r.label: r.n for r in usable.groupBy("label").agg(F.count("*").alias("n")).collect()}
    # At most two bounded classes, so it is small enough to send to all tasks.
    source = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"), (F.col(metadata).cast("double") if metadata else F.lit(None).cast("double")).alias("metadata"))
    chosen = source.join(F.broadcast(sample.dropDuplicates(["key", "label"])), "key").select("label", "text", "metadata")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(t.as_py(), m) for t, m in zip(batch.column(1), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([i.astype(np.int32) for i, _ in found], pa.list_(pa.int32())), pa.array([x.astype(np.float32) for _, x in found], pa.list_(pa.float32()))], ["label", "i", "x"])

    got = chosen.mapInArrow(work, "label int, i array<int>, x array<float>").toArrow().to_pydict()
    rows = sorted(zip(got["label"], map(tuple, got["i"]), map(tuple, got["x"]), strict=True))
    machine = Machine()
    y = np.array([r[0] for r in rows], float)
    if len(set(y.tolist())) < 2:
        machine.bias, machine.v[:] = (30.0 if not len(y) or y[0] else -30.0), 0.0
        return machine
    # Classes weigh as in the labels, on whose shares a score is calibrated.
    weight = {c: counts[c] / max(1, int((y == c).sum())) for c in (0, 1)}
    mean = sum(counts.values()) / len(y)
    machine.fit([(np.array(i, np.int64), np.array(x)) for _, i, x in rows], y, np.array([weight[int(c)] / mean for c in y]))
    return machine


def _scores(machine: Machine, texts: pa.Array, metadata: list) -> np.ndarray:
    return np.array([machine.score(*features(t.as_py(), m)) for t, m in zip(texts, metadata, strict=True)])


def score(docs: DataFrame, machine: Machine, key: str = "doc_id", text: str = "text", metadata: str | None = "n_chars") -> DataFrame:
    """``key`` and ``score`` of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)
    source = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"), (F.col(metadata).cast("double") if metadata else F.lit(None).cast("double")).alias("metadata"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_scores(shared.value, batch.column(1), batch.column(2).to_pylist()), pa.float64())], ["key", "score"])

    return source.mapInArrow(work, f"key {source.schema['key'].dataType.simpleString()}, score double").withColumnRenamed("key", key)


def keep(docs: DataFrame, machine: Machine, least: float = CUT, text: str = "text", metadata: str | None = "n_chars") -> DataFrame:
    """The rows, with all their columns, whose score is at least ``least``."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)
    at, beside = docs.columns.index(text), docs.columns.index(metadata) if metadata else None

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(beside).cast(pa.float64()).to_pylist() if beside is not None else [None] * batch.num_rows
            yield batch.filter(pa.array(_scores(shared.value, batch.column(at), values) >= least, pa.bool_()))

    return docs.mapInArrow(work, docs.schema)
