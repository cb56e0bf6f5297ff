"""WARC: deterministic sharded writer, and reader.

The writer sorts records by id into shards and writes each shard as files of gzip members, one per record; a file is closed
when its compressed size reaches ``roll`` bytes.  Which record lands in which file depends on the rows alone: shards are
runs of ids in order, cut where the running sum of all rows' payload bytes passes multiples of ``shard`` bytes.  Headers
and digests are made anew from the payload.  Of records with equal payloads of at least ``least`` bytes the one with the
smallest id is a response and the others revisit it.

A task writes each file under a temporary name of its own attempt and renames it when it is complete, so a task that is run
again, or twice at once, leaves the same bytes under the same name.  The job's manifest (file, size, digest, records, id
range) is written last, and by Spark's own commit; readers read what it lists and nothing else.

A null payload counts as empty, a null URL too.  Rows with null ids sort first and, among equal payloads, are the response only if no row
with an id has that payload.  Rows that repeat the smallest id of their payload are responses as well.  An empty table gives
an empty manifest.  Other columns of the input are never read, so their names can't clash; payloads are written whole, however long.
"""

from __future__ import annotations

import base64
import hashlib
import os
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewell.llm.runtime import Written, passed, shared_dir

#: Compressed bytes of a file, payload bytes of a shard, and the most shards.
ROLL, SHARD, SHARDS = 16 << 20, 24 << 20, 65_536
DATE = "2020-01-01T00:00:00Z"
MANIFEST = "file string, bytes long, sha256 string, records long, first_id long, last_id long"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def _name(page: int | None) -> str:
    return f"<urn:page:{'' if page is None else page}>"


def _page(name: str | None) -> int | None:
    number = name[len("<urn:page:") : -1] if name else ""
    return int(number) if number else None


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page: int | None, url: str | None, payload: bytes, refers: int | None, date: str = DATE, level: int = 6) -> bytes:
    """One gzip member: a response, or a revisit (whose HTTP head still tells the payload's length)."""
    revisit = refers is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    target = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_name(page)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{sha1_base32(payload)}",
        f"WARC-Block-Digest: sha1:{sha1_base32(block)}",
        *([f"WARC-Refers-To: {_name(refers)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"] if revisit else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    squeeze = zlib.compressobj(level, zlib.DEFLATED, 31)
    return squeeze.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + squeeze.flush()


def members(stream, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The gzip members of an open file, one record each, read piece by piece."""
    engine, out = zlib.decompressobj(31), []
    while data := stream.read(chunk):
        while data:
            out.append(engine.decompress(data))
            data = engine.unused_data
            if engine.eof:
                yield b"".join(out)
                engine, out = zlib.decompressobj(31), []
    if out:
        raise ValueError("the archive ends within a record")


def parse(raw: bytes) -> dict:
    """A record's fields; raises ValueError where its digests or lengths don't hold."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines)
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next(int(line[15:]) for line in http.split(b"\r\n") if line.lower().startswith(b"content-length:"))
    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if version != "WARC/1.1" or rest[len(block) :] != b"\r\n\r\n" or fields["WARC-Block-Digest"] != "sha1:" + sha1_base32(block):
        raise ValueError(f"damaged record {fields.get('WARC-Record-ID')}")
    if kind == "response" and (len(payload) != length or sha1_base32(payload) != digest):
        raise ValueError(f"damaged payload of {fields.get('WARC-Record-ID')}")
    return {"page_id": _page(fields["WARC-Record-ID"]), "url": fields["WARC-Target-URI"], "payload_bytes": length, "payload_digest": digest, "record_type": kind, "refers_to": _page(fields.get("WARC-Refers-To")), "payload": payload if kind == "response" else None}


class _Shard:
    """The files of one shard, written one after the other."""

    def __init__(self, files: fs.FileSystem, folder: str, shard: int, roll: int):
        self.files, self.folder, self.shard, self.roll, self.number = files, folder, shard, roll, 0
        self.out = None

    def add(self, page: int | None, data: bytes) -> tuple | None:
        if self.out is None:
            self.name = f"shard-{self.shard:06d}-{self.number:05d}.warc.gz"
            self.own = f"{self.folder}/.{self.name}.{TaskContext.get().taskAttemptId()}-{uuid.uuid4().hex}"
            self.out, self.size, self.sha, self.count, self.first = self.files.open_output_stream(self.own, compression=None), 0, hashlib.sha256(), 0, page
        self.out.write(data)
        self.sha.update(data)
        self.size, self.count, self.last = self.size + len(data), self.count + 1, page
        return self.close() if self.size >= self.roll else None

    def close(self) -> tuple | None:
        if self.out is None:
            return None
        self.out.close()
        self.files.move(self.own, f"{self.folder}/{self.name}")
        self.out, self.number = None, self.number + 1
        return (self.name, self.size, self.sha.hexdigest(), self.count, self.first, self.last)


def shard_bounds(sizes: DataFrame, shard: int, most: int = SHARDS) -> list[int]:
    """The first ids of all shards but the first.  ``sizes``: id and size of every record.

    Shards are cut where the running sum of bytes in order of ids passes a multiple of ``shard`` (of a ``most``-th of all, if that is more, which
    bounds what the driver gets); records of one id stay together.  Sums run within ranges and over the ranges' totals.
    """
    spark = sizes.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ids = sizes.where("page_id is not null").groupBy("page_id").agg(F.sum("size").alias("size"))
    at = Written(ids.repartitionByRange(parts, "page_id").withColumn("part", F.spark_partition_id()))
    totals = at.df.groupBy("part").agg(F.sum("size").alias("size")).orderBy("part").collect()
    if not totals:
        return []
    before, held = {}, 0
    for r in totals:
        before[r.part], held = held, held + r.size
    shard = max(shard, -(-held // most))
    start = F.element_at(F.create_map(*[F.lit(x).cast("long") for kv in before.items() for x in kv]), F.col("part").cast("long"))
    run = F.sum("size").over(W.partitionBy("part").orderBy("page_id").rowsBetween(W.unboundedPreceding, 0)) - F.col("size") + start
    found = at.df.withColumn("shard", (run / shard).cast("long")).groupBy("shard").agg(F.min("page_id").alias("first")).collect()
    at.drop()
    return sorted(r["first"] for r in found)[1:]


def write_pages(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", payload: str = "html", least: int = 0, roll: int = ROLL, shard: int = SHARD, date: str = DATE) -> str:
    """Writes every row to archives under ``folder`` (a URI that driver and executors share); returns the manifest's path."""
    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.coalesce(F.col(url).cast("string"), F.lit("")).alias("url"), F.coalesce(F.encode(F.col(payload).cast("string"), "UTF-8"), F.lit(b"")).alias("payload"))
    # Equal payloads have equal SHA-256 and length; only ids and digests are shuffled for that.
    marks = Written(rows.select("page_id", F.sha2("payload", 256).alias("mark"), F.length("payload").cast("long").alias("size"))).df
    groups = marks.where(F.col("size") >= least).groupBy("mark").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("mark", "first")
    revisits = marks.where(F.col("size") >= least).join(groups, "mark").where(F.col("first").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") > F.col("first")))).select("page_id", "mark", "first").distinct()
    bounds = shard_bounds(marks.select("page_id", (F.col("size") + 500).alias("size")), shard)
    where, shards = F.coalesce(passed(bounds, F.col("page_id")), F.lit(0)), len(bounds) + 1
    # A page's own revisit mark sorts just before it, so one shuffle brings both together.
    both = revisits.select("page_id", F.col("mark").alias("url"), F.lit(None).cast("binary").alias("payload"), F.col("first").alias("refers"), F.lit(0).alias("kind")).unionByName(rows.select("*", F.lit(None).cast("long").alias("refers"), F.lit(1).alias("kind")))
    dealt = both.withColumn("shard", where).repartitionById(shards, F.col("shard")).sortWithinPartitions(F.col("page_id").asc_nulls_first(), "kind", "url", "payload")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = fs.FileSystem.from_uri(folder)
        out, done, marks, at = None, [], {}, object()
        for batch in batches:
            for page, link, data, first, kind, number in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if page != at:
                    at, marks = page, {}
                if kind == 0:
                    marks[link] = first
                    continue
                if out is None:
                    out = _Shard(files, path, number, roll)
                refers = marks.get(hashlib.sha256(data).hexdigest()) if marks else None
                if (entry := out.add(page, record(page, link, data, refers, date))) is not None:
                    done.append(entry)
        if out is not None and (entry := out.close()) is not None:
            done.append(entry)
        columns = list(zip(*done, strict=True)) or [()] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()], strict=True)], ["file", "bytes", "sha256", "records", "first_id", "last_id"])

    files, path = fs.FileSystem.from_uri(folder)
    files.create_dir(path, recursive=True)
    manifest = f"{folder}/manifest"
    dealt.mapInArrow(work, MANIFEST).write.mode("error").parquet(manifest)
    # What attempts that died have left.
    for left in files.get_file_info(fs.FileSelector(path)):
        if left.base_name.startswith(".shard-"):
            files.delete_file(left.path)
    return manifest


def read_archives(spark: SparkSession, folder: str, keep_payload: bool = True) -> DataFrame:
    """The records (``RECORD``) of the archives that a folder's manifest lists."""
    manifest = spark.read.parquet(f"{folder}/manifest").select("file", "bytes")
    names = [f.split()[0] for f in RECORD.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = fs.FileSystem.from_uri(folder)

        def made(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in zip(names, kinds, strict=True)], names)

        for batch in batches:
            for name, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows, held, total = [], 0, 0
                with files.open_input_stream(f"{path}/{name}", compression=None) as stream:
                    for raw in members(stream):
                        row = parse(raw)
                        if not keep_payload:
                            row["payload"] = None
                        rows.append(row)
                        held += len(row["payload"] or b"") + 200
                        total += 1
                        if held > 8 << 20:
                            yield made(rows)
                            rows, held = [], 0
                if files.get_file_info(f"{path}/{name}").size != size:
                    raise ValueError(f"{name} isn't the file that the manifest lists")
                if rows:
                    yield made(rows)

    return manifest.repartition(max(1, manifest.count())).mapInArrow(work, RECORD)


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder for archives in the shared one."""
    return os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")
