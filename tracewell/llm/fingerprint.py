"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A text's units are its paragraphs: its lines, long ones cut after sentence ends.  A unit's digest is XXH64 of its bytes and of how often it
occurred before, so that repeats count.  A sketch has cells in three parts; each digest is put into one of each (count, XOR of the
digests, XOR of their checks).  Two sketches of one size subtract cell by cell, what both have cancels, and peeling cells that
hold one digest recovers the rest.

A text's fingerprint is the number of its digests, the least digests of ``BINS`` bins, and one sketch of at least twice as many cells as digests.
Parts have 4, 8, 16, ... cells, so a sketch folds to every smaller size.  Two fingerprints are compared without their texts: the bins estimate
their difference, both sketches are folded to a size that should hold it, and if peeling gets stuck, to twice that, up to the smaller sketch.
Likeness is the shared part of both texts' units: 1 - |difference| / |units of both|, exact if the difference was peeled and the bins' estimate
if no size was large enough, which takes texts that have little in common.  Where texts are at hand, ``difference`` goes on to larger sketches.

Two texts without units have likeness 1.  A null text counts as empty.  Repeated rows and rows of one id (ordered by their texts) are followed
by the next row like others.  Very long texts have sketches in proportion.  An empty table gives an empty table; other columns are never read,
so their names can't clash.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.runtime import passed

#: The least cells of a sketch, its cells for each digest (at least), bins of least digests, and the length from which lines are cut.
CELLS, ROOM, BINS, LONG_LINE = 12, 2, 64, 120
_SENTENCE = re.compile(r"(?<=[.!?|])\s+")
_MASK = (1 << 64) - 1


def units(text: str) -> list[bytes]:
    """Lines; those of over ``LONG_LINE`` characters are cut after sentence ends and column bars."""
    out: list[bytes] = []
    for line in text.split("\n"):
        for part in _SENTENCE.split(line) if len(line) > LONG_LINE else (line,):
            if part:
                out.append(part.encode("utf-8", "surrogatepass"))
    return out


def digests(text: str) -> np.ndarray:
    """Distinct 64-bit digests of a text's units; the k-th copy of a unit is hashed with seed k."""
    from xxhash import xxh64_intdigest

    seen: dict[bytes, int] = {}
    out = []
    for u in units(text):
        k = seen.get(u, 0)
        seen[u] = k + 1
        out.append(xxh64_intdigest(u, k))
    return np.unique(np.array(out, np.uint64))


_A, _B, _C = np.uint64(30), np.uint64(27), np.uint64(31)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _seeds(round_: int) -> np.ndarray:
    return np.array([[(s * 0x9E3779B97F4A7C15) & _MASK] for s in (3 * round_ + 1, 3 * round_ + 2, 3 * round_ + 3, 99)], np.uint64)


def _mix(keys: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """A published 64-bit finaliser (splitmix), one row for each seed: the three cells' and the check."""
    x = keys + seeds
    x = (x ^ (x >> _A)) * _M1
    x = (x ^ (x >> _B)) * _M2
    return x ^ (x >> _C)


class Sketch:
    """Cells in three parts; each digest has one cell in each.  ``signs``: -1 for digests that are subtracted."""

    def __init__(self, keys: np.ndarray, cells: int, round_: int = 0, signs: np.ndarray | None = None):
        self.third, self.round = max(1, cells // 3), round_
        self.seeds = _seeds(round_)
        n = 3 * self.third
        self.count = np.zeros(n, np.int64)
        self.keys, self.checks = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
        if len(keys):
            at, check = self.places(keys)
            if signs is None:
                self.count += np.bincount(at, minlength=n)
            else:
                self.count += np.bincount(at, np.tile(signs, 3), n).astype(np.int64)
            np.bitwise_xor.at(self.keys, at, np.tile(keys, 3))
            np.bitwise_xor.at(self.checks, at, np.tile(check, 3))

    def places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cells of digests, part by part, and their checks."""
        mixed = _mix(keys, self.seeds)
        at = (mixed[:3] % np.uint64(self.third)).astype(np.int64)
        at[1] += self.third
        at[2] += 2 * self.third
        return at.ravel(), mixed[3] & np.uint64(0xFFFFFFFF)

    def minus(self, other: Sketch) -> Sketch:
        out = Sketch(np.zeros(0, np.uint64), 3 * self.third, self.round)
        out.count, out.keys, out.checks = self.count - other.count, self.keys ^ other.keys, self.checks ^ other.checks
        return out

    def peel(self) -> tuple[np.ndarray, np.ndarray] | None:
        """What only the first and only the second had, or None if peeling gets stuck.  Cells of one digest go together."""
        count, keys, checks = (self.count + (1 << 15)) % (1 << 16) - (1 << 15), self.keys.copy(), self.checks.copy()
        mine: list[np.ndarray] = []
        theirs: list[np.ndarray] = []
        while True:
            pure = np.flatnonzero(np.abs(count) == 1)
            if not len(pure):
                break
            found, first = np.unique(keys[pure], return_index=True)
            pure = pure[first]
            at, check = self.places(found)
            good = check == checks[pure]
            if not good.all():
                if not good.any():
                    break
                found, pure, check, at = found[good], pure[good], check[good], at.reshape(3, -1)[:, good].ravel()
            sign = count[pure]
            count -= np.bincount(at, np.tile(sign, 3), len(count)).astype(np.int64)
            np.bitwise_xor.at(keys, at, np.tile(found, 3))
            np.bitwise_xor.at(checks, at, np.tile(check, 3))
            mine.append(found[sign > 0])
            theirs.append(found[sign < 0])
        if count.any() or keys.any() or checks.any():
            return None
        empty = np.zeros(0, np.uint64)
        return (np.concatenate([empty, *mine]), np.concatenate([empty, *theirs]))

    def folded(self, third: int) -> Sketch:
        """The same digests in parts of ``third`` cells, which divides this sketch's."""
        if third == self.third:
            return self
        out = Sketch(np.zeros(0, np.uint64), 3 * third, self.round)
        shape = (3, self.third // third, third)
        out.count = self.count.reshape(shape).sum(axis=1).ravel()
        out.keys, out.checks = (np.bitwise_xor.reduce(x.reshape(shape), axis=1).ravel() for x in (self.keys, self.checks))
        return out


class Print:
    """A fingerprint: what its string holds, and nothing else."""

    def __init__(self, n: int, least: np.ndarray, sketch: Sketch):
        self.n, self.least, self.sketch = n, least, sketch

    @classmethod
    def of(cls, keys: np.ndarray, cells: int = CELLS) -> Print:
        """Of sorted distinct digests."""
        third = max(1, cells // 3)
        while 3 * third < ROOM * len(keys):
            third *= 2
        least = np.zeros(BINS, np.uint8)
        if len(keys):
            bins = (keys >> np.uint64(58)).astype(np.int64)
            first = np.flatnonzero(np.diff(bins, prepend=-1))
            least[bins[first]] = keys[first] % np.uint64(255) + np.uint64(1)
        return cls(len(keys), least, Sketch(keys, 3 * third))

    def __str__(self) -> str:
        """Numbers of digests and of a part's cells, least digests, and cells, in hexadecimal.  Counts are known modulo 2**16, checks to 32 bits."""
        s = self.sketch
        cells = s.count.astype(np.uint16).astype(">u2").tobytes() + s.keys.astype(">u8").tobytes() + s.checks.astype(np.uint32).astype(">u4").tobytes()
        return f"{self.n:x}:{s.third:x}:{self.least.tobytes().hex()}:{cells.hex()}"

    @classmethod
    def read(cls, text: str) -> Print:
        n, third, least, cells = text.split(":")
        sketch = Sketch(np.zeros(0, np.uint64), 3 * int(third, 16))
        raw, k = bytes.fromhex(cells), 3 * int(third, 16)
        sketch.count = np.frombuffer(raw, ">u2", k).astype(np.int64)
        sketch.keys = np.frombuffer(raw, ">u8", k, 2 * k).astype(np.uint64)
        sketch.checks = np.frombuffer(raw, ">u4", k, 10 * k).astype(np.uint64)
        return cls(int(n, 16), np.frombuffer(bytes.fromhex(least), np.uint8), sketch)

    def estimate(self, other: Print) -> float:
        """Likeness by the bins' least digests."""
        either = np.count_nonzero(self.least | other.least)
        same = np.count_nonzero((self.least == other.least) & (self.least > 0)) / max(1, either)
        return 2 * same / (1 + same)

    def minus(self, other: Print) -> tuple[np.ndarray, np.ndarray] | None:
        """The digests that only this and only the other has, or None if no common size holds them."""
        most = min(self.sketch.third, other.sketch.third)
        expected = max(abs(self.n - other.n), 0.7 * (self.n + other.n) * (1 - self.estimate(other)))
        third = most
        while third % 2 == 0 and third // 2 >= CELLS // 3 and 3 * (third // 2) >= expected:
            third //= 2
        if 3 * third * 1.3 < abs(self.n - other.n):
            return None
        while True:
            found = self.sketch.folded(third).minus(other.sketch.folded(third)).peel()
            if found is not None or third >= most:
                return found
            third *= 2

    def likeness(self, other: Print) -> float:
        total = self.n + other.n
        if not total:
            return 1.0
        found = self.minus(other)
        return self.estimate(other) if found is None else 1.0 - (len(found[0]) + len(found[1])) / total


def difference(a: np.ndarray, b: np.ndarray, cells: int = CELLS) -> tuple[np.ndarray, np.ndarray]:
    """Digests that only ``a`` and only ``b`` have: from their fingerprints, else from sketches of twice the size again and again.

    Sketches are linear, so a larger one of the difference is made in one go.
    """
    one, two = Print.of(a, cells), Print.of(b, cells)
    found, cells, round_ = one.minus(two), 3 * min(one.sketch.third, two.sketch.third), 0
    keys, signs = np.concatenate([a, b]), np.concatenate([np.ones(len(a)), -np.ones(len(b))])
    while found is None:
        cells, round_ = 2 * cells, round_ + 1
        found = Sketch(keys, cells, round_, signs).peel()
    return found


def edited(text: str, following: str) -> str:
    """The last half of the code points replaced by as many of the next text's first, or all it has."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def dealt_in_order(docs: DataFrame, key: str, text: str, parts: int) -> DataFrame:
    """Rows (``key``, ``text``, ``extra``) in order of the key, dealt to ``parts`` ranges; each range is followed by the next
    one's first rows (``extra``), the last by the first one's.

    The bounds are quantiles of all keys; they only decide how even the ranges are.  A null key sorts first.
    """
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    asked = [i / parts for i in range(1, parts)]
    found = rows.select(F.percentile_approx("key", asked, 10_000).alias("b"), F.min("key").alias("least"), F.sum(F.col("key").isNull().cast("int")).alias("nulls")).first() if asked else rows.select(F.lit(None).cast("array<long>").alias("b"), F.min("key").alias("least"), F.sum(F.col("key").isNull().cast("int")).alias("nulls")).first()
    bounds = sorted({b for b in found.b or [] if found.least is not None and b > found.least})
    own = F.coalesce(passed(bounds, F.col("key")), F.lit(0))
    first = F.col("key").isNull() if found.nulls else F.col("key") == F.lit(found.least)
    back = F.when(first, F.lit(len(bounds)))
    if bounds:
        back = back.when(F.col("key").isin(bounds), own - 1)
    sides = F.filter(F.array(F.struct(own.cast("int").alias("p"), F.lit(0).alias("extra")), F.struct(back.cast("int").alias("p"), F.lit(1).alias("extra"))), lambda s: s["p"].isNotNull())
    dealt = rows.select("key", "text", F.explode(sides).alias("s")).select("key", "text", F.col("s.extra").alias("extra"), F.col("s.p").alias("p"))
    return dealt.repartitionById(len(bounds) + 1, F.col("p")).sortWithinPartitions("extra", F.col("key").asc_nulls_first(), "text").select("key", "text", "extra")


def compare_neighbours(docs: DataFrame, parts: int | None = None, cells: int = CELLS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text, of its edited text, and their likenesses; the next text is that of the next key.

    Rows of one key are ordered by their texts.  Only a row and its successor are in memory.
    """
    parts = parts or max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = dealt_in_order(docs, key, text, parts)
    names = ["key", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kind_name = dealt.schema["key"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        kind = kinds = None

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        held = None
        done = False
        for batch in batches:
            kind = batch.column(0).type
            kinds = [kind, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            for k, t, extra in zip(batch.column(0), batch.column(1), batch.column(2).to_pylist(), strict=True):
                if done:
                    continue
                k, t = k.as_py(), t.as_py()
                own = Print.of(digests(t), cells)
                if held is not None:
                    before, value, mine = held
                    changed = edited(value, t)
                    other = Print.of(digests(changed), cells)
                    rows.append((before, len(value), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), str(mine), str(other), mine.likeness(other), mine.likeness(own)))
                    if len(rows) == 1000:
                        yield made()
                        rows = []
                held, done = (k, t, own), bool(extra)
        if rows:
            yield made()

    return dealt.mapInArrow(work, f"key {kind_name}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double").withColumnRenamed("key", key)


def sketch_documents(docs: DataFrame, cells: int = CELLS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ``fingerprint`` of every text."""
    source = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [digests(t.as_py() or "") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([str(Print.of(k, cells)) for k in found], pa.string())], ["key", "fingerprint"])

    return source.mapInArrow(work, f"key {source.schema['key'].dataType.simpleString()}, fingerprint string").withColumnRenamed("key", key)
