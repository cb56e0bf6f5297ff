"""SimHash near-duplicates by the generalised pigeonhole principle.

A document's fingerprint has 64 bits: for each bit, whether over half of its word shingles' hashes have it.  Two fingerprints
link at ``distance`` or fewer differing bits; a component is what links connect.

Candidates: correlated bits are grouped into ``m`` partitions.  If two fingerprints differ in at most ``d`` bits, then for any
thresholds ``t_i >= -1`` that sum to ``d - m + 1`` some partition differs in at most ``t_i`` bits.  Dynamic programming picks the
thresholds, and ``m`` with them, for which probes and candidates together are estimated to cost least; the estimates come
from the exact first and second moments of all fingerprints' bits.  Every fingerprint is indexed by its partitions' values,
probes all values within the thresholds, and candidates are verified where they meet.

Copies and dense groups: equal fingerprints are one node.  Before the probes, fingerprints are sorted by each partition in turn
and near neighbours in that order that link are contracted; probes then look only for links between different contracted
groups, so a group of thousands of near copies doesn't emit its pairs, and no link between groups is lost.

Where links are asked for by ``similarity`` (of the sets of word shingles) bits aren't enough: at a similarity of 0.8 two
fingerprints differ in some ten of 64 bits, for which partitions select hardly anything.  Texts of equal sets of hashed shingles are
then one node, and two nodes link exactly if their sets' similarity is at least that; the fingerprints' distance doesn't link.
Candidates come from a sketch, the least hash of each of ``BINS`` bins of a set: runs of ``RUN`` bins name ``BINS / RUN`` buckets, which hold
ids only.  Neighbours in some buckets are compared first, in a random order, round after round, and what links is contracted, so that a
group of near copies doesn't emit its pairs.  What then still shares a bucket but not a group is compared by sketches where it meets, each
pair in the first bucket that both have, and by sets unless the sketches' likeness is ``ERRORS`` standard errors below the similarity.  Sets
are made again from the texts of candidates only and meet in cells of bounded size, each set once for a cell.  At a similarity of 0.8 long
texts miss all buckets with a probability of 5e-6, and lie 3.5 standard errors low with one of 2e-4.

Null and blank texts have fingerprint zero and link like others.  A text of fewer words than a shingle has its whole
sequence as the only shingle.  A null id never becomes a component's id unless the component has no other.  Rows may repeat; of rows of one id
but different texts each has its own component.  Very long texts are hashed in chunks.  An empty table gives an empty table; other columns
are never read, and ``keep_one`` hands them on whatever their names.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import accumulate, combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.runtime import written
from tracewell.operators.components import components, spread_join

WORDS, SEED, DISTANCE = 4, 42, 4
#: What a probe row and a candidate comparison cost, relative to each other, and how far sorted neighbours are compared.
PROBE, CANDIDATE, NEAR = 1.0, 0.05, 128
#: Bins of a similarity sketch (in four words of 60 bits), how many neighbouring ones name a bucket, and by how many standard errors the
#: likeness of two sketches may be below a similarity for sets to be compared.
BINS, RUN, ERRORS = 240, 6, 3.5
#: How many bits of a bin's value are kept; a sketch has four words for each of them and four that tell which bins are filled.
BITS = 8
#: One in so many buckets is looked at in a round of contraction, and the number of links from which there is one more.
SAMPLE, AGAIN = 2, 20_000
#: Bits of the filter by which the rows are chosen whose sets are made (at most; a false hit costs a row, no result).
FILTER = 1 << 27
#: Shingles that a cell of sets holds, about, and rows of a bucket that meet in one cell; larger buckets meet part by part.
CELL, BLOCK = 1 << 22, 1024
#: Pairs that a cell of sets takes, about.
PAIRS = 4096
#: Rows whose signatures are worked on at once.
SLICE = 1024
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def sketched(text: str | None, words: int = WORDS, seed: int = SEED, chunk: int = 1 << 16, sets: list | None = None) -> tuple[int, np.ndarray]:
    """Fingerprint and least hash of each bin of a whole text; shingles are hashed in chunks, so memory doesn't grow with the text.

    ``sets`` takes the distinct hashes of each chunk.
    """
    from xxhash import xxh64_digest

    least = np.full(BINS, _NONE)
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0, least
    joined = b" ".join(parts)
    n = max(1, len(parts) - words + 1)
    ends = list(accumulate(map(len, parts), lambda a, b: a + b + 1))
    starts = [0, *(e + 1 for e in ends[: n - 1])]
    ends = ends[words - 1 :] if n > 1 or len(parts) == words else [len(joined)]
    counts = np.zeros(64, np.int64)
    for i in range(0, n, chunk):
        digests = b"".join(map(xxh64_digest, [joined[s:e] for s, e in zip(starts[i : i + chunk], ends[i : i + chunk], strict=True)], repeat(seed)))
        counts += np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        hashes = np.sort(np.frombuffer(digests, ">u8").astype(np.uint64))
        bins = ((hashes >> np.uint64(32)) * np.uint64(BINS) >> np.uint64(32)).astype(np.int64)
        first = np.flatnonzero(np.diff(bins, prepend=-1))
        least[bins[first]] = np.minimum(least[bins[first]], hashes[first])
        if sets is not None:
            sets.append(np.unique(hashes))
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big"), least


def fingerprint(text: str | None, words: int = WORDS, seed: int = SEED, chunk: int = 1 << 16) -> int:
    return sketched(text, words, seed, chunk)[0]


def shingle_set(chunks: list[np.ndarray]) -> np.ndarray:
    """The distinct hashes of a text's shingles, sorted."""
    return np.unique(np.concatenate(chunks)) if chunks else np.zeros(0, np.uint64)


def signatures(least: np.ndarray) -> np.ndarray:
    """Sketches of rows of least hashes, as words: four for each of ``BITS`` bits of the bins' values, and four for which bins are filled.

    An empty bin has the value of the next filled one, changed by the distance; only filled bins count for the likeness.
    """
    n = len(least)
    filled = least != _NONE
    values = (least * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(56)).astype(np.int64)
    place = np.where(filled, np.arange(BINS), 2 * BINS)
    twice = np.minimum.accumulate(np.concatenate([place, place + BINS], axis=1)[:, ::-1], axis=1)[:, ::-1][:, :BINS]
    values = (np.take_along_axis(values, twice % BINS, axis=1) + 97 * (twice - np.arange(BINS))) & 255
    out = np.empty((n, BITS + 1, 4), np.uint64)
    for b in range(BITS + 1):
        bits = np.zeros((n, 4, 64), np.uint8)
        bits[:, :, : BINS // 4] = (filled if b == BITS else values >> b & 1).reshape(n, 4, -1)
        out[:, b] = np.packbits(bits, axis=2, bitorder="little").view(np.uint64).reshape(n, 4)
    return out.reshape(n, -1)


_ODD = np.random.default_rng(SEED).integers(1, 1 << 62, BINS, np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def buckets(words: np.ndarray) -> np.ndarray:
    """Bucket names of rows of sketches, one for each whole run of bins; the low six bits are the run's number."""
    n = len(words)
    bits = np.unpackbits(words.view(np.uint8), axis=1, bitorder="little").reshape(n, BITS + 1, 4, 64)[:, :BITS, :, : BINS // 4].reshape(n, BITS, BINS)
    values = np.packbits(bits, axis=1, bitorder="little").reshape(n, BINS).astype(np.uint64) + np.uint64(1)
    names = (values * _ODD).reshape(n, -1, RUN).sum(axis=2, dtype=np.uint64)
    return (names << np.uint64(6) | np.arange(BINS // RUN, dtype=np.uint64)).view(np.int64)


def fingerprints(docs: DataFrame, words: int = WORDS, key: str = "doc_id", text: str = "text", sketch: bool = False) -> DataFrame:
    """``key``, ``mark`` (a hash of the text, to tell rows of equal ids apart) and ``fp`` (the bits as a signed long).

    ``sketch`` adds ``rid`` (a hash of id and text), ``node`` (a hash of the set of shingles), ``n`` (its size), ``mh`` (its least hash in
    another order) and ``sig``, its sketch.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        longs = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
        for whole in batches:
            for i in range(0, whole.num_rows, SLICE):
                batch = whole.slice(i, SLICE)
                fps, nodes, sizes, leasts = [], [], [], []
                for t in batch.column(3):
                    chunks = [] if sketch else None
                    fp, least = sketched(t.as_py(), words, sets=chunks)
                    fps.append(fp)
                    if sketch:
                        hashes = shingle_set(chunks)
                        nodes.append(xxh64_intdigest(hashes.tobytes()))
                        sizes.append(len(hashes))
                        leasts.append(least)
                more = []
                if sketch:
                    least = np.stack(leasts)
                    sigs = signatures(least)
                    order = np.where(least == _NONE, _NONE, least * _ODD[0])
                    more = [batch.column(2), longs(nodes), pa.array(sizes, pa.int64()), longs(order.min(axis=1)), pa.array([row.tobytes() for row in sigs], pa.binary())]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), longs(fps), *more], ["key", "mark", "fp", "rid", "node", "n", "mh", "sig"][: 3 + len(more)])

    source = docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("mark"), F.xxhash64(key, text).alias("rid"), F.col(text).cast("string").alias("text"))
    return source.mapInArrow(work, f"key {source.schema['key'].dataType.simpleString()}, mark long, fp long" + ", rid long, node long, n long, mh long, sig binary" * sketch)


def moments(nodes: DataFrame) -> tuple[int, np.ndarray]:
    """The number of fingerprints, and how many have both bits set, for all pairs of bits (bit 0 is the lowest)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((64, 64)), 0
        for batch in batches:
            fps = np.ascontiguousarray(batch.column(0).to_numpy(zero_copy_only=False)).view(np.uint8).reshape(-1, 8)
            bits = np.unpackbits(fps, axis=1, bitorder="little").astype(np.float32)
            total += bits.T @ bits
            n += len(bits)
        values = np.append(total.ravel(), n).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values), dtype=np.int32)), pa.array(values)], ["i", "n"])

    rows = nodes.select("fp").mapInArrow(work, "i int, n long").groupBy("i").agg(F.sum("n").alias("n")).collect()
    values = np.zeros(64 * 64 + 1, np.int64)
    for r in rows:
        values[r.i] = r.n
    return int(values[-1]), values[:-1].reshape(64, 64)


def group_bits(n: int, both: np.ndarray, m: int) -> list[list[int]]:
    """``m`` partitions of bits; each takes the bits that correlate most with what it has."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    tied = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(tied, 0)
    free, out = set(range(64)), []
    for i in range(m):
        size = 64 // m + (i < 64 % m)
        left = sorted(free)
        group = [left[int(np.argmax(tied[np.ix_(left, left)].sum(axis=1)))]]
        free.discard(group[0])
        while len(group) < size:
            left = sorted(free)
            group.append(left[int(np.argmax(tied[np.ix_(left, group)].sum(axis=1)))])
            free.discard(group[-1])
        out.append(sorted(group))
    return out


def within(n: int, both: np.ndarray, bits: list[int]) -> list[float]:
    """P(two fingerprints differ in at most t of these bits), t from 0: a beta-binomial with the exact mean and variance."""
    size, n = len(bits), max(n, 1)
    p11 = both[np.ix_(bits, bits)] / n
    p = np.diag(p11)
    p10 = p[:, None] - p11
    p00 = 1 - p[:, None] - p[None, :] + p11
    mean = float((2 * p * (1 - p)).sum())
    off = 2 * (p11 * p00 + p10 * p10.T)
    np.fill_diagonal(off, 2 * p * (1 - p))
    variance = float(off.sum()) - mean * mean
    q = min(max(mean / size, 1e-9), 1 - 1e-9)
    rho = (variance / (size * q * (1 - q)) - 1) / max(1, size - 1)
    if rho > 1e-9:
        a, b = q * (1 / rho - 1), (1 - q) * (1 / rho - 1)
        beta = lambda x, y: math.lgamma(x) + math.lgamma(y) - math.lgamma(x + y)
        each = [math.exp(math.log(math.comb(size, k)) + beta(k + a, size - k + b) - beta(a, b)) for k in range(size + 1)]
    else:
        each = [math.comb(size, k) * q**k * (1 - q) ** (size - k) for k in range(size + 1)]
    return list(accumulate(each))


def allocate(n: int, both: np.ndarray, d: int = DISTANCE, most: int = 6) -> tuple[list[list[int]], list[int]]:
    """Partitions and thresholds of least estimated cost."""
    best: tuple[float, list, list] = (math.inf, [], [])
    for m in range(2, most + 1):
        groups, total = group_bits(n, both, m), d - m + 1
        reach: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for group in groups:
            chance, following = within(n, both, group), {}
            for t in range(-1, d + 1):
                probes = sum(math.comb(len(group), k) for k in range(t + 1))
                cost = n * (t >= 0) + PROBE * n * probes + CANDIDATE * n * n / 2 * (chance[t] if t >= 0 else 0)
                for have, (spent, chosen) in reach.items():
                    if spent + cost < following.get(have + t, (math.inf,))[0]:
                        following[have + t] = (spent + cost, [*chosen, t])
            reach = following
        if total in reach and reach[total][0] < best[0]:
            best = (reach[total][0], groups, reach[total][1])
    return best[1], best[2]


def part(fp, bits: list[int]):
    """The value of some bits of a fingerprint column: runs of neighbouring bits are moved together."""
    out, at, i = F.lit(0).cast("long"), 0, 0
    while i < len(bits):
        j = i
        while j + 1 < len(bits) and bits[j + 1] == bits[j] + 1:
            j += 1
        width = j - i + 1
        mask = (1 << width) - 1
        piece = F.shiftrightunsigned(fp, bits[i]) if bits[i] else fp
        piece = piece.bitwiseAND(F.lit(mask if width < 64 else -1).cast("long"))
        out = out.bitwiseOR(F.shiftleft(piece, at) if at else piece)
        at, i = at + width, j + 1
    return out


class _Forest:
    """Union-find over a batch's positions; keeps one link for each union."""

    def __init__(self, n: int):
        self.up = np.arange(n)
        self.links: list[tuple[int, int]] = []

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        for i, j in zip(a.tolist(), b.tolist(), strict=True):
            x, y = self.find(i), self.find(j)
            if x != y:
                self.up[max(x, y)] = min(x, y)
                self.links.append((i, j))

    def flat(self) -> None:
        while True:
            up = self.up[self.up]
            if (up == self.up).all():
                return
            self.up = up


def near_links(keys: np.ndarray, test: Callable[[np.ndarray, np.ndarray], np.ndarray], near: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between sorted neighbours (up to ``near`` places apart) of equal keys.

    ``test`` tells which of pairs of places link; pairs that are connected already aren't tested.
    """
    forest = _Forest(len(keys))
    left = np.arange(len(keys))
    for s in range(1, near + 1):
        left = left[left + s < len(keys)]
        left = left[keys[left] == keys[left + s]]
        if not len(left):
            break
        open_ = left[forest.up[left] != forest.up[left + s]]
        hit = open_[test(open_, open_ + s)]
        forest.add(hit, hit + s)
        forest.flat()
    return forest.links


def contract(nodes: DataFrame, groups: list[list[int]], d: int, near: int = NEAR) -> DataFrame:
    """Links (``a``, ``b``) that neighbours in the order of some partition's value have; any subset of links is right here."""
    sides = F.array(*[F.struct(F.lit(i).alias("i"), part(F.col("fp"), g).alias("v")) for i, g in enumerate(groups)])
    rows = nodes.select("fp", F.explode(sides).alias("s")).select(F.col("s.i").alias("i"), F.col("s.v").alias("v"), "fp")
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_keys, kept = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            keys = np.concatenate([kept_keys, batch.column(1).to_numpy() * 8 + batch.column(0).to_numpy()])
            fps = np.concatenate([kept, batch.column(2).to_numpy()])
            bits = fps.view(np.uint64)
            links = near_links(keys, lambda i, j, bits=bits: np.bitwise_count(bits[i] ^ bits[j]) <= d, near)
            kept_keys, kept = keys[-near:], fps[-near:]
            if links:
                at = np.array(links)
                yield pa.RecordBatch.from_arrays([pa.array(fps[at[:, 0]]), pa.array(fps[at[:, 1]])], ["a", "b"])

    return rows.repartitionByRange(parts, "i", "v", "fp").sortWithinPartitions("i", "v", "fp").mapInArrow(work, "a long, b long")


@lru_cache(maxsize=64)
def masks(size: int, t: int) -> list[int]:
    """All changes of at most ``t`` of ``size`` bits."""
    return [sum(1 << b for b in c) for k in range(t + 1) for c in combinations(range(size), k)]


def probe_links(nodes: DataFrame, groups: list[list[int]], thresholds: list[int], d: int) -> DataFrame:
    """Pairs of contracted groups (``a``, ``b``) that a verified candidate connects.  ``nodes``: fp, c."""
    used = [(i, g, t) for i, (g, t) in enumerate(zip(groups, thresholds, strict=True)) if t >= 0]
    fp = F.col("fp")
    index = F.array(*[F.struct(F.lit(i).alias("i"), part(fp, g).alias("v")) for i, g, _ in used])

    def around(i: int, g: list[int], t: int):
        changes = F.from_json(F.lit(str(masks(len(g), t))), "array<bigint>")
        return F.transform(changes, lambda m: F.struct(F.lit(i).alias("i"), part(fp, g).bitwiseXOR(m).alias("v")))

    probe = F.concat(*[around(i, g, t) for i, g, t in used])
    left = nodes.select("fp", "c", F.explode(probe).alias("s")).select(F.col("s.i").alias("i"), F.col("s.v").alias("v"), "fp", "c")
    right = nodes.select(F.col("fp").alias("fp2"), F.col("c").alias("c2"), F.explode(index).alias("s")).select(F.col("s.i").alias("i"), F.col("s.v").alias("v"), "fp2", "c2")
    found = left.join(right, (left.i == right.i) & (left.v == right.v) & (left.fp < right.fp2) & (left.c != right.c2) & (F.bit_count(left.fp.bitwiseXOR(right.fp2)) <= d))
    return found.select(F.least("c", "c2").alias("a"), F.greatest("c", "c2").alias("b")).distinct()


def _signatures(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, 4 * (BITS + 1))


def _mixed(shared: DataFrame) -> DataFrame:
    """Members of those buckets (``k``) where different groups (``c``) meet, with the number of members (``g``)."""
    met = shared.groupBy("k").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.count("*").alias("g")).where("low <> high").select("k", "g")
    return shared.join(met, "k")


def _filter(rids: DataFrame, n: int) -> np.ndarray:
    """Bits that are set for the ``n`` row hashes ``rid``; of bounded size."""
    size = min(FILTER, 1 << max(10, (16 * n).bit_length()))
    at = F.pmod("rid", F.lit(size))
    found = rids.select(F.shiftright(at, 6).alias("w"), F.expr(f"shiftleft(1L, cast(pmod(rid, {size}) & 63 as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    words = np.zeros(size >> 6, np.int64)
    words[found["w"].to_numpy()] = found["b"].to_numpy()
    return words.view(np.uint64)


def shingle_sets(docs: DataFrame, rids: DataFrame, n: int, words: int, key: str, text: str) -> DataFrame:
    """``rid`` and ``s`` of rows that have one of the ``n`` row hashes, and maybe of a few more.

    ``s`` has 32 bits of the hash of each distinct shingle, sorted; among sets of a million that changes a similarity by 0.0003 at most.
    """
    shared = docs.sparkSession.sparkContext.broadcast(_filter(rids, n))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            rid = batch.column(0).to_numpy()
            at = rid.view(np.uint64) & np.uint64(64 * len(bits) - 1)
            found, sets, total = [], [], 0
            for i in np.flatnonzero(bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).tolist():
                chunks: list[np.ndarray] = []
                sketched(batch.column(1)[i].as_py(), words, sets=chunks)
                found.append(rid[i])
                sets.append(np.unique(shingle_set(chunks).astype(np.uint32)).tobytes())
                total += len(sets[-1])
                if total > CELL:
                    yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(sets, pa.binary())], ["rid", "s"])
                    found, sets, total = [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(sets, pa.binary())], ["rid", "s"])

    source = docs.select(F.xxhash64(key, text).alias("rid"), F.col(text).cast("string").alias("text"))
    return source.mapInArrow(work, "rid long, s binary")


def maybe_similar(x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray, similarity: float) -> np.ndarray:
    """Whether sizes and sketches (rows of words) leave the similarity possible.

    The bins that either fills are a sample without replacement of the union, so the error vanishes for small sets.
    """
    f, g = x[:, 4 * BITS :], y[:, 4 * BITS :]
    apart = np.bitwise_or.reduce((x ^ y).reshape(-1, BITS + 1, 4), axis=1) & (f | g)
    apart = np.bitwise_count(apart).sum(axis=1, dtype=np.int64)
    either = np.bitwise_count(f | g).sum(axis=1, dtype=np.int64)
    union = np.maximum((n + m) / (1 + similarity), either)
    error = np.sqrt(similarity * (1 - similarity) / np.maximum(either, 1) * np.maximum(1 - (either - 1) / np.maximum(union - 1, 1), 0))
    return (np.minimum(n, m) >= (similarity - 1e-9) * np.maximum(n, m)) & (apart <= (1 - similarity + ERRORS * error) * either + 1e-6)


def first_shared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The number of the first bucket that two sketches share (those that share none have the number of buckets)."""
    same = ~np.bitwise_or.reduce((x ^ y)[:, : 4 * BITS].reshape(-1, BITS, 4), axis=1)
    bits = np.unpackbits(np.ascontiguousarray(same).view(np.uint8), axis=1, bitorder="little").reshape(-1, 4, 64)[:, :, : BINS // 4].reshape(len(x), BINS // RUN, RUN)
    runs = np.concatenate([bits.all(axis=2), np.ones((len(x), 1), bool)], axis=1)
    return runs.argmax(axis=1)


def alike_pairs(pairs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """Those of distinct pairs (``a``, ``b``) whose sizes and sketches don't rule out the similarity, with what ``verified`` needs of both."""
    side = lambda x: nodes.select(F.col("node").alias(x), F.col("rid").alias(f"r{x}"), F.col("n").alias(f"n{x}"), F.col("mh").alias(f"m{x}"), F.col("sig").alias(f"s{x}"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = batch.column("na").to_numpy(), batch.column("nb").to_numpy()
            keep = maybe_similar(_signatures(batch.column("sa")), _signatures(batch.column("sb")), n, m, similarity)
            yield batch.select(["a", "b", *_NEEDED]).filter(pa.array(keep))

    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", *_NEEDED, "sa", "sb").mapInArrow(work, _PAIR)


_NEEDED = [f"{x}{y}" for x in "rnm" for y in "ab"]
_PAIR = ", ".join(f"{x} long" for x in ["a", "b", *_NEEDED])


def meeting_pairs(left: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """Pairs of different groups that share a bucket and may have the similarity, each once.  ``left``: k, node, c, g (rows of the bucket).

    Buckets are cut into parts of ``BLOCK`` rows, and each two parts meet in a cell, so that no task holds a bucket.
    """
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = F.ceil(F.col("g") / BLOCK).cast("int")
    rows = left.withColumn("h", F.pmod(F.xxhash64("node"), cuts).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), cuts - 1)))
    low, high = F.least("h", "j"), F.greatest("h", "j")
    rows = rows.join(nodes.select("node", "rid", "n", "mh", "sig"), "node")
    rows = rows.select(F.xxhash64("k", low, high).alias("cell"), "k", "c", "h", (low != high).alias("cross"), "node", "rid", "n", "mh", "sig")

    def pairs_of(t: pa.Table) -> pa.RecordBatch:
        cell, k, c, h, cross, node, rid, n, mh = [t.column(i).to_numpy() for i in range(9)]
        words = _signatures(t.column(9))
        left, found = np.arange(len(cell)), []
        s = 1
        while True:
            left = left[left + s < len(cell)]
            left = left[cell[left] == cell[left + s]]
            if not len(left):
                break
            for i in range(0, len(left), 8192):
                x = left[i : i + 8192]
                y = x + s
                ok = (k[x] == k[y]) & (c[x] != c[y]) & (node[x] != node[y]) & ~(cross[x] & (h[x] == h[y]))
                x, y = x[ok], y[ok]
                ok = maybe_similar(words[x], words[y], n[x], n[y], similarity)
                x, y = x[ok], y[ok]
                ok = first_shared(words[x], words[y]) >= (k[x] & 63)
                found.append(np.stack([x[ok], y[ok]]))
            s += 1
        x, y = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
        x, y = np.where(node[x] < node[y], x, y), np.where(node[x] < node[y], y, x)
        columns = [v[z] for v in (node, rid, n, mh) for z in (x, y)]
        return pa.RecordBatch.from_arrays([pa.array(v) for v in columns], ["a", "b", *_NEEDED])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([*([] if held is None else held.to_batches()), batch]).combine_chunks()
            cell = t.column(0).to_numpy()
            end = int(np.searchsorted(cell, cell[-1]))
            yield pairs_of(t.slice(0, end))
            held = t.slice(end)
        if held is not None:
            yield pairs_of(held.combine_chunks())

    return rows.repartition(parts, "cell").sortWithinPartitions("cell").mapInArrow(work, _PAIR)


def _similar(held: dict[int, np.ndarray], ra: np.ndarray, rb: np.ndarray, similarity: float) -> np.ndarray:
    """Which pairs of a cell, in order of ``ra``, have sets (``held`` by row hash) of the similarity."""
    keep = np.zeros(len(ra), bool)
    starts = np.flatnonzero(np.concatenate([[True], ra[1:] != ra[:-1]])).tolist()
    others_of = rb.tolist()
    for start, end in zip(starts, [*starts[1:], len(ra)], strict=True):
        one = held[int(ra[start])]
        for i in range(start, end, 256):
            others = [held[r] for r in others_of[i : min(end, i + 256)]]
            sizes = np.array([len(x) for x in others])
            x = np.concatenate(others)
            at = np.minimum(np.searchsorted(one, x), len(one) - 1)
            common = np.add.reduceat(one[at] == x, np.concatenate([[0], np.cumsum(sizes)[:-1]]), dtype=np.int64)
            keep[i : i + len(sizes)] = common >= (similarity - 1e-9) * (len(one) + sizes - common)
    return keep


def verified(close: DataFrame, docs: DataFrame, similarity: float, words: int, key: str, text: str) -> DataFrame:
    """Those pairs of nodes (``a``, ``b``) whose sets of shingles have the similarity.

    Sets meet in cells, named by the least hashes of both, which near copies mostly share; heavy least hashes are split by row.
    """
    close = written(close)
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    side = lambda x: close.select(F.col(f"r{x}").alias("rid"), F.col(f"n{x}").alias("n"), F.col(f"m{x}").alias("m")).distinct()
    rows = side("a").unionByName(side("b")).distinct()
    each = rows.groupBy("m").agg(F.sum("n").alias("n"), F.count("*").alias("rows")).join(close.groupBy(F.col("ma").alias("m")).agg(F.count("*").alias("pairs")), "m", "left")
    total, n, pairs = each.agg(F.sum("n"), F.sum("rows"), F.sum("pairs")).first()
    if not n:
        return close.select("a", "b")
    # Least hashes with more than a partition's share of pairs or shingles, so at most twice as many as partitions.
    cell, share = max(CELL, total // parts), max(PAIRS, pairs // parts)
    heavy = [(r.m, max(-(-r.n // cell), math.isqrt((r.pairs or 0) // share) + 1)) for r in each.where((F.col("n") > cell) | (F.col("pairs") > share)).collect()]
    # A constant: createDataFrame would start Python workers of its own for it.
    heavy = spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps([{"m": m, "cuts": c} for m, c in heavy])), "array<struct<m:bigint,cuts:bigint>>")))

    def block(x: str):
        return F.xxhash64(f"m{x}", F.pmod(F.xxhash64(f"r{x}"), F.coalesce(f"cuts{x}", F.lit(1).cast("long"))))

    for x in "ab":
        close = close.join(F.broadcast(heavy.select(F.col("m").alias(f"m{x}"), F.col("cuts").alias(f"cuts{x}"))), f"m{x}", "left")
    pairs = close.select(F.xxhash64(F.least(block("a"), block("b")), F.greatest(block("a"), block("b"))).alias("cell"), "a", "b", "ra", "rb")
    needed = pairs.select("cell", F.col("ra").alias("rid")).distinct().unionByName(pairs.select("cell", F.col("rb").alias("rid")).distinct()).distinct()
    sets = shingle_sets(docs, rows.select("rid"), n, words, key, text).join(needed, "rid").select("cell", "rid", "s")
    # The sets of a cell come before its pairs.
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("binary")
    both = sets.select("cell", F.lit(0).alias("pair"), F.col("rid").alias("ra"), zero.alias("rb"), zero.alias("a"), zero.alias("b"), "s").unionByName(pairs.select("cell", F.lit(1).alias("pair"), "ra", "rb", "a", "b", none.alias("s")))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, {}
        for batch in batches:
            cell, pair, ra, rb, a, b = [c.to_numpy() for c in batch.columns[:6]]
            keep = np.zeros(len(cell), bool)
            ends = np.flatnonzero(np.concatenate([(cell[1:] != cell[:-1]) | (pair[1:] != pair[:-1]), [True]])).tolist() if len(cell) else []
            start = 0
            for end in ends:
                if cell[start] != at:
                    at, held = cell[start], {}
                if pair[start]:
                    keep[start : end + 1] = _similar(held, ra[start : end + 1], rb[start : end + 1], similarity)
                else:
                    for i in range(start, end + 1):
                        held[int(ra[i])] = np.frombuffer(batch.column(6)[i].as_py(), np.uint32)
                start = end + 1
            yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], ["a", "b"])

    return written(both.repartition(parts, "cell").sortWithinPartitions("cell", "pair", "ra").mapInArrow(work, "a long, b long"))


def similar_links(nodes: DataFrame, docs: DataFrame, similarity: float, words: int, key: str, text: str) -> DataFrame:
    """Links of nodes (``a``, ``b``), by which all nodes of the similarity are connected.  ``nodes``: node, rid, n, mh, sig."""
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, SLICE):
                part = batch.slice(i, SLICE)
                names = buckets(_signatures(part.column(1)))
                yield pa.RecordBatch.from_arrays([pa.array(names.ravel()), pa.array(np.repeat(part.column(0).to_numpy(), names.shape[1]))], ["k", "node"])

    def several(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of a sorted partition that share their bucket; those at its ends may share it with another partition's."""
        held, before = [np.zeros(0, np.int64)] * 2, None
        for batch in batches:
            k, node = [np.concatenate([h, c.to_numpy()]) for h, c in zip(held, batch.columns, strict=True)]
            if not len(k):
                continue
            same = np.concatenate([[before is None or before == k[0]], k[1:] == k[:-1]])
            kept = np.flatnonzero(same[:-1] | same[1:])
            before = k[-2] if len(k) > 1 else before
            held = [k[-1:], node[-1:]]
            yield pa.RecordBatch.from_arrays([pa.array(k[kept]), pa.array(node[kept])], ["k", "node"])
        yield pa.RecordBatch.from_arrays([pa.array(held[0]), pa.array(held[1])], ["k", "node"])

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 3
        for batch in batches:
            k, node, c = [np.concatenate([h, x.to_numpy()]) for h, x in zip(held, batch.columns, strict=True)]
            i = np.flatnonzero((k[:-1] == k[1:]) & (c[:-1] != c[1:]))
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(node[i], node[i + 1])), pa.array(np.maximum(node[i], node[i + 1]))], ["a", "b"])
            held = [x[-1:] for x in (k, node, c)]

    rows = nodes.where("n > 0").select("node", "sig").mapInArrow(spread, "k long, node long")
    rows = rows.repartitionByRange(parts, "k", "node").sortWithinPartitions("k", "node").mapInArrow(several, "k long, node long")
    shared = written(rows)
    left, links = shared.withColumn("c", F.col("node")), None
    turn = 0
    while True:
        sampled = left.where(F.pmod(F.xxhash64("k", F.lit(turn)), F.lit(SAMPLE)) == 0)
        dealt = sampled.select("k", "node", "c", F.xxhash64("node", "k").alias("o")).repartitionByRange(parts, "k", "o").sortWithinPartitions("k", "o")
        pairs = dealt.select("k", "node", "c").mapInArrow(neighbours, "a long, b long").distinct()
        found = verified(alike_pairs(pairs, nodes, similarity), docs, similarity, words, key, text)
        n, turn = found.count(), turn + 1
        links = found if links is None else links.unionByName(found)
        named = components(links).select("node", "root")
        left = written(_mixed(shared.join(named, "node", "left").select("k", "node", F.coalesce("root", "node").alias("c"))))
        if n < AGAIN:
            break
    return links.unionByName(verified(meeting_pairs(left, nodes, similarity), docs, similarity, words, key, text))


def near_duplicates(docs: DataFrame, words: int = WORDS, d: int = DISTANCE, key: str = "doc_id", text: str = "text", similarity: float | None = None) -> DataFrame:
    """``key``, ``mark``, ``fp``, ``component_id`` (the smallest id that links reach) and ``c``, the component's least node, of every row.

    Fingerprints link at ``d`` or fewer bits or, if it is given, texts at a similarity of their sets of word shingles instead.
    """
    rows = written(fingerprints(docs, words, key, text, similarity is not None))
    node = "fp" if similarity is None else "node"
    if similarity is not None:
        nodes = written(rows.groupBy("node").agg(F.min("key").alias("rep"), F.min("rid").alias("rid"), F.min("n").alias("n"), F.min("mh").alias("mh"), F.min("sig").alias("sig")))
        named, links = nodes.select("node", "rep", F.col("node").alias("c")), similar_links(nodes, docs, similarity, words, key, text)
    else:
        nodes = written(rows.groupBy("fp").agg(F.min("key").alias("rep")))
        n, both = moments(nodes)
        groups, thresholds = allocate(n, both, d)
        near = components(contract(nodes, groups, d))
        named = written(nodes.select("fp", "rep").join(near.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "rep", F.coalesce("root", "fp").alias("c")))
        links = probe_links(named.select("fp", "c"), groups, thresholds, d)
    far = components(links).select(F.col("node").alias("c"), "root")
    whole = written(spread_join(named, far, "c").select(node, "rep", F.coalesce("root", "c").alias("c")))
    least = whole.groupBy("c").agg(F.min("rep").alias("component_id"))
    ids = spread_join(whole.select(node, "c"), least, "c").select(node, "component_id", "c")
    rows = rows.select("key", "mark", "fp", *[node] * (node != "fp"))
    return spread_join(rows, ids, node).select(F.col("key").alias(key), "mark", "fp", "component_id", "c")


def keep_one(docs: DataFrame, found: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component: that of the smallest id; of equal ids, one.  A component without any id keeps a row too."""
    rid = F.xxhash64(F.col(key), F.col("mark"))
    first = found.groupBy("c").agg(F.min(F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("key"), "fp", "mark", rid.alias("rid"))).alias("m")).select(F.col("m.rid").alias("_rid"), F.col("m.mark").alias("_mark"))
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(key).alias("_key"), F.xxhash64(text).alias("_mark"))
    held = held.select("_row", F.xxhash64("_key", "_mark").alias("_rid"), "_mark")
    return held.join(first, ["_rid", "_mark"], "left_semi").dropDuplicates(["_rid", "_mark"]).select("_row.*")
