"""Best-fit packing by hierarchical residual packing.

Each partition turns its documents into pieces of at most ``size`` tokens and packs the pieces that don't fill a bin by best
fit, longest first.  Bins that are full up to ``slack`` tokens are done.  The others are items of the next round, in which
``fanin`` neighbouring partitions meet in one task (``coalesce``, so nothing is shuffled) and are packed by best fit again,
until one partition is left, or there can be no fewer (a task's bins are bounded) and a round fills no bin more.  A task never holds
more than ``block`` open bins at once, whatever the lengths are.

Documents longer than ``size`` are cut so that only their first piece is shorter.  A null text counts as empty: one end
token.  Repeated rows are documents of their own; ties are settled by id and piece.  An empty table has no rows.  Other columns
are never read, so their names can't clash.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.bpe import space_bpe
from tracewell.llm.runtime import cut

SIZE, SLACK, FANIN, BLOCK = 1024, 0, 8, 40_000
#: A bin: its number, its tokens, whether it is done, and its pieces in order with their places.
MEMBER = "struct<doc_id:{0},piece:int,start:long,length:long,ids_crc32:long,offset:long>"
BIN = "sequence_id long, used int, done boolean, pieces array<{0}>"


def best_fit(lengths: list[int], size: int) -> list[list[int]]:
    """Bins (lists of indexes) of items that are given longest first; each goes to the fullest bin that still holds it."""
    bins: list[list[int]] = []
    room: list[list[int]] = [[] for _ in range(size + 1)]
    mask = 0
    for i, n in enumerate(lengths):
        fits = mask >> n
        if fits:
            free = n + (fits & -fits).bit_length() - 1
            at = room[free].pop()
            if not room[free]:
                mask &= ~(1 << free)
            bins[at].append(i)
        else:
            free, at = size, len(bins)
            bins.append([i])
        free -= n
        room[free].append(at)
        mask |= 1 << free
    return bins


def _batch(bins: list[tuple[int, int, bool, list[tuple]]], key: pa.DataType) -> pa.RecordBatch:
    kinds = [("doc_id", key), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("offset", pa.int64())]
    flat = [m for b in bins for m in b[3]]
    ends = [0]
    for b in bins:
        ends.append(ends[-1] + len(b[3]))
    members = pa.StructArray.from_arrays([pa.array([m[i] for m in flat], t) for i, (_, t) in enumerate(kinds)], [k for k, _ in kinds])
    return pa.RecordBatch.from_arrays(
        [pa.array([b[0] for b in bins], pa.int64()), pa.array([b[1] for b in bins], pa.int32()), pa.array([b[2] for b in bins], pa.bool_()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), members)],
        ["sequence_id", "used", "done", "pieces"],
    )


class _Numbers:
    """Bin numbers that no other task of any round gives: round, partition, running number."""

    def __init__(self, level: int):
        self.next = (level << 57) | (TaskContext.get().partitionId() << 33)

    def __call__(self) -> int:
        self.next += 1
        return self.next


def _order(item: list[tuple]) -> tuple:
    return (item[0][0] is not None, item[0][0] if item[0][0] is not None else 0, item[0][1])


def _pack(items: list[tuple[int, list[tuple]]], size: int, slack: int, number: _Numbers) -> list[tuple[int, int, bool, list[tuple]]]:
    items.sort(key=lambda x: (-x[0], _order(x[1])))
    out = []
    for chosen in best_fit([n for n, _ in items], size):
        pieces, used = [], 0
        for i in chosen:
            n, members = items[i]
            pieces += [(*m[:5], m[5] + used) for m in members]
            used += n
        out.append((number(), used, used >= size - slack, pieces))
    return out


def local_bins(docs: DataFrame, path: str, size: int = SIZE, end: int = 2, slack: int = SLACK, block: int = BLOCK, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Tokenises and packs each partition for itself."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, number = space_bpe(path), _Numbers(0)
        stop = end.to_bytes(4, "little")
        items: list[tuple[int, list[tuple]]] = []
        kind = None
        for batch in batches:
            kind, full = batch.column(0).type, []
            for doc, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = memoryview(codec.encode(value.as_py()) + stop)
                n = len(ids) // 4
                start, piece = 0, 0
                while start < n:
                    length = (n - start - 1) % size + 1 if piece == 0 else size
                    member = (doc, piece, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), 0)
                    if length == size:
                        full.append((number(), size, True, [member]))
                    else:
                        items.append((length, [member]))
                    start, piece = start + length, piece + 1
            if full:
                yield _batch(full, kind)
            if len(items) >= block:
                yield _batch(_pack(items, size, slack, number), kind)
                items = []
        if items:
            yield _batch(_pack(items, size, slack, number), kind)

    source = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return source.mapInArrow(work, BIN.format(MEMBER.format(source.schema["doc_id"].dataType.simpleString())))


def merge_round(bins: DataFrame, level: int, parts: int, size: int, slack: int, block: int) -> DataFrame:
    """Underfull bins as items of best fit in fewer partitions."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, items, kind = _Numbers(level), [], None
        for batch in batches:
            kind = batch.column(3).type.value_type.field("doc_id").type
            for used, pieces in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True):
                items.append((used, [tuple(p.values()) for p in pieces]))
            if len(items) >= block:
                yield _batch(_pack(items, size, slack, number), kind)
                items = []
        if items:
            yield _batch(_pack(items, size, slack, number), kind)

    return bins.coalesce(parts).mapInArrow(work, bins.schema)


def pack_documents(docs: DataFrame, path: str, size: int = SIZE, end: int = 2, slack: int = SLACK, fanin: int = FANIN, block: int = BLOCK, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``."""
    bins = cut(local_bins(docs, path, size, end, slack, block, key, text))
    done = [bins.where("done")]
    rest = bins.where("not done")
    parts, level, rows = bins.rdd.getNumPartitions(), 0, rest.count()
    while rows > 1 and parts > 1:
        level += 1
        wide, parts = parts, max(-(-parts // fanin), -(-rows // block))
        before = rows
        bins = cut(merge_round(rest, level, parts, size, slack, block))
        done.append(bins.where("done"))
        rest = bins.where("not done")
        filled = bins.count()
        rows = rest.count()
        if filled >= before and parts >= wide:
            break
    out = rest
    for part in done:
        out = out.unionByName(part)
    member = F.col("m")
    return out.select("sequence_id", F.explode("pieces").alias("m")).select(
        member.doc_id.alias(key), member.piece.alias("piece"), member.start.alias("start"), member.length.alias("length"), member.ids_crc32.alias("ids_crc32"), "sequence_id", member.offset.alias("offset")
    )
