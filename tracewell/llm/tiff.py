"""Media columns: TIFF.

``read_pages`` walks the image directories of every file (classic and big TIFF, both byte orders), decodes PackBits, LZW,
deflate or plain strips and tiles, undoes the horizontal and the floating-point predictor, and emits one row per page with
its samples in little-endian, row by row, samples of a pixel together.  ``write`` makes such files.

A null file gives no row.  A file or page that can't be decoded (truncated, a loop of directories, an unknown compression,
samples that aren't 1, 2, 4, 8, 16, 32 or 64 bits) gives one row whose ``error`` says why and whose samples are null;
pages before it stay.  A strip never yields more bytes than its rows have, whatever its data claim.  Ids may repeat; other columns
of the input are never read, so their names can't clash.  An empty table has no pages.  Rows that repeat give their pages again, and ties need no rule.
Very large files are decoded strip by strip or tile by tile into one array of samples for a page.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PLAIN, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 13: 4, 16: 8, 17: 8, 18: 8}
_CODES = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 13: "I", 16: "Q", 17: "q", 18: "Q"}
_FLIP = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))
PAGE = "page int, width int, height int, samples_per_pixel int, bits int, sample_format int, compression int, predictor int, samples binary, error string"


class Page(NamedTuple):
    page: int
    width: int
    height: int
    samples_per_pixel: int
    bits: int
    sample_format: int
    compression: int
    predictor: int
    samples: bytes


class TiffError(ValueError):
    """The file isn't a TIFF that can be decoded."""


def unpack_bits(data: bytes, size: int) -> bytes:
    """PackBits: a length byte, then literals (0 to 127) or one repeated byte (129 to 255)."""
    out, i = bytearray(), 0
    while i < len(data) and len(out) < size:
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += 2 + n
        else:
            if n > 128:
                out += data[i + 1 : i + 2] * (257 - n)
            i += 2 if n > 128 else 1
    return bytes(out[:size])


def pack_bits(data: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(data):
        run = 1
        while run < 128 and i + run < len(data) and data[i + run] == data[i]:
            run += 1
        if run > 1:
            out += bytes((257 - run, data[i]))
            i += run
            continue
        j = i + 1
        while j < len(data) and j - i < 128 and not (j + 1 < len(data) and data[j] == data[j + 1]):
            j += 1
        out += bytes((j - i - 1,)) + data[i:j]
        i = j
    return bytes(out)


def lzw_decode(data: bytes, size: int) -> bytes:
    """TIFF's LZW: codes of 9 to 12 bits, high bits first, the width changing one code early; 256 clears, 257 ends."""
    out, held, bits, width = bytearray(), 0, 0, 9
    base = [bytes((i,)) for i in range(256)] + [b"", b""]
    table, last = list(base), None
    for byte in data:
        held, bits = ((held & 0xFFFFFF) << 8) | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code = (held >> bits) & ((1 << width) - 1)
        if code == 257:
            break
        if code == 256:
            table, width, last = list(base), 9, None
            continue
        if last is None:
            if code > 255:
                raise TiffError("LZW data start with a code that isn't a byte")
            entry = table[code]
        elif code < len(table):
            entry = table[code]
            table.append(last + entry[:1])
        elif code == len(table):
            entry = last + last[:1]
            table.append(entry)
        else:
            raise TiffError("LZW code out of range")
        out += entry
        last = entry
        if len(out) >= size:
            break
        if len(table) >= (1 << width) - 1 and width < 12:
            width += 1
    return bytes(out[:size])


def lzw_encode(data: bytes) -> bytes:
    out, held, bits = bytearray(), 0, 0

    def put(code: int, width: int) -> None:
        nonlocal held, bits
        held, bits = (held << width) | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append((held >> bits) & 255)
            held &= (1 << bits) - 1

    put(256, 9)
    table, width, word = {bytes((i,)): i for i in range(256)}, 9, b""
    count = 258
    for i in range(len(data)):
        longer = word + data[i : i + 1]
        if longer in table:
            word = longer
            continue
        put(table[word], width)
        table[longer] = count
        count += 1
        word = data[i : i + 1]
        if count >= 4094:
            put(table[word], width if count < (1 << width) else width + 1)
            put(256, width if count < (1 << width) else width + 1)
            table, width, word, count = {bytes((i,)): i for i in range(256)}, 9, b"", 258
        elif count >= (1 << width):
            width += 1
    if word:
        put(table[word], width)
        count += 1
        if count >= (1 << width) and width < 12:
            width += 1
    put(257, width)
    if bits:
        out.append((held << (8 - bits)) & 255)
    return bytes(out)


def inflate(data: bytes, size: int) -> bytes:
    try:
        return zlib.decompressobj().decompress(data, size) if size else b""
    except zlib.error as e:
        raise TiffError(f"deflate: {e}") from None


def _decode(data: bytes, compression: int, size: int) -> bytes:
    if compression == PLAIN:
        out = data[:size]
    elif compression == LZW:
        out = lzw_decode(data, size)
    elif compression in (DEFLATE, OLD_DEFLATE):
        out = inflate(data, size)
    elif compression == PACKBITS:
        out = unpack_bits(data, size)
    else:
        raise TiffError(f"compression {compression} isn't supported")
    if len(out) < size:
        raise TiffError(f"{len(out)} bytes where {size} are needed")
    return out


def _block(raw: bytes, rows: int, width: int, spp: int, bits: int, predictor: int, order: str) -> np.ndarray:
    """Samples of a strip or tile: rows x width x samples, in the machine's byte order."""
    if bits < 8:
        per = -(-width * spp * bits // 8)
        packed = np.frombuffer(raw, np.uint8).reshape(rows, per)
        shifts = np.arange(8 - bits, -1, -bits, dtype=np.uint8)
        flat = ((packed[:, :, None] >> shifts) & ((1 << bits) - 1)).reshape(rows, -1)[:, : width * spp]
        if predictor == 2:
            raise TiffError("a predictor needs samples of whole bytes")
        return flat.reshape(rows, width, spp).astype(np.uint8)
    size = bits // 8
    if predictor == 3:
        planes = np.cumsum(np.frombuffer(raw, np.uint8).reshape(rows, -1, spp), axis=1, dtype=np.uint8).reshape(rows, size, width * spp)
        return np.ascontiguousarray(planes.transpose(0, 2, 1)).view(f">u{size}").reshape(rows, width, spp).astype(f"=u{size}")
    block = np.frombuffer(raw, f"{order}u{size}").reshape(rows, width, spp).astype(f"=u{size}")
    return np.cumsum(block, axis=1, dtype=block.dtype) if predictor == 2 else block


def pages(data: bytes) -> Iterator[Page]:
    """The pages of a file, one by one.  Raises TiffError where it can't go on."""
    try:
        order = {b"II": "<", b"MM": ">"}[data[:2]]
        big = {42: False, 43: True}[struct.unpack_from(order + "H", data, 2)[0]]
        (at,) = struct.unpack_from(order + ("Q" if big else "I"), data, 8 if big else 4)
    except (KeyError, struct.error):
        raise TiffError("no TIFF header") from None
    seen: set[int] = set()
    number = 0
    while at:
        if at in seen:
            raise TiffError("directories form a loop")
        seen.add(at)
        try:
            tags, at = _directory(data, at, order, big)
            yield _page(data, tags, number, order)
        except (struct.error, IndexError, ValueError, OverflowError, MemoryError) as e:
            raise e if isinstance(e, TiffError) else TiffError(f"page {number}: {e}") from None
        number += 1


def _directory(data: bytes, at: int, order: str, big: bool) -> tuple[dict[int, list[int]], int]:
    head, entry, word = ("Q", 20, "Q") if big else ("H", 12, "I")
    (n,) = struct.unpack_from(order + head, data, at)
    at += struct.calcsize(order + head)
    if at + n * entry > len(data):
        raise TiffError("directory beyond the end of the file")
    tags: dict[int, list[int]] = {}
    room = struct.calcsize(order + word)
    for i in range(n):
        where = at + i * entry
        tag, kind = struct.unpack_from(order + "HH", data, where)
        (count,) = struct.unpack_from(order + word, data, where + 4)
        place = where + 4 + room
        if kind not in _CODES:
            continue
        size = _SIZES[kind] * count
        if size > room:
            (place,) = struct.unpack_from(order + word, data, place)
        if place + size > len(data):
            raise TiffError(f"tag {tag} beyond the end of the file")
        tags[tag] = list(struct.unpack_from(f"{order}{count}{_CODES[kind]}", data, place))
    (following,) = struct.unpack_from(order + word, data, at + n * entry)
    return tags, following


def _page(data: bytes, tags: dict[int, list[int]], number: int, order: str) -> Page:
    def one(tag: int, default: int | None = None) -> int:
        if tags.get(tag):
            return tags[tag][0]
        if default is None:
            raise TiffError(f"page {number} lacks tag {tag}")
        return default

    width, height, spp = one(256), one(257), one(277, 1)
    depths = tags.get(258) or [1]
    bits, compression, predictor, planar = depths[0], one(259, PLAIN), one(317, 1), one(284, 1)
    if len(set(depths)) > 1 or bits not in (1, 2, 4, 8, 16, 32, 64) or predictor not in (1, 2, 3) or predictor == 3 and bits not in (16, 32, 64) or width < 1 or height < 1 or spp < 1:
        raise TiffError(f"page {number}: its shape isn't supported")
    tiled = 322 in tags
    tw, th = (one(322), one(323)) if tiled else (width, min(one(278, height), height))
    offsets, counts = (tags.get(324), tags.get(325)) if tiled else (tags.get(273), tags.get(279))
    if tw < 1 or th < 1 or not offsets:
        raise TiffError(f"page {number} has no strips or tiles")
    counts = counts or [len(data) - offsets[0]]
    across, down, planes = -(-width // tw), -(-height // th), spp if planar == 2 else 1
    if len(offsets) < across * down * planes or len(counts) < len(offsets):
        raise TiffError(f"page {number} lacks strips or tiles")
    each = spp // planes
    out = np.zeros((height, width, spp), f"=u{max(1, bits // 8)}")
    for i in range(across * down * planes):
        plane, cell = divmod(i, across * down)
        y, x = cell // across * th, cell % across * tw
        rows = th if tiled else min(th, height - y)
        raw = data[offsets[i] : offsets[i] + counts[i]]
        if one(266, 1) == 2:
            raw = raw.translate(_FLIP)
        raw = _decode(raw, compression, rows * -(-tw * each * bits // 8))
        block = _block(raw, rows, tw, each, bits, predictor, order)
        out[y : y + rows, x : x + tw, plane * each : (plane + 1) * each] = block[: height - y, : width - x]
    return Page(number, width, height, spp, bits, one(339, 1), compression, predictor, out.astype(out.dtype.newbyteorder("<")).tobytes())


def write(images: list[np.ndarray], compression: int = DEFLATE, predictor: int = 1, rows: int = 256, tile: tuple[int, int] | None = None, order: str = "<", level: int = 1) -> bytes:
    """A classic TIFF with one page per image (height x width or height x width x samples, unsigned or float)."""
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0))
    link = 4
    squeeze = {PLAIN: bytes, LZW: lzw_encode, DEFLATE: lambda b: zlib.compress(b, level), OLD_DEFLATE: lambda b: zlib.compress(b, level), PACKBITS: pack_bits}[compression]
    for image in images:
        a = image[:, :, None] if image.ndim == 2 else image
        height, width, spp = a.shape
        size, floats = a.dtype.itemsize, a.dtype.kind == "f"
        th, tw = tile or (min(rows, height), width)
        offsets, counts = [], []
        for y in range(0, height, th):
            for x in range(0, width, tw):
                block = a[y : y + th, x : x + tw]
                if tile:
                    block = np.pad(block, ((0, th - block.shape[0]), (0, tw - block.shape[1]), (0, 0)))
                block = np.ascontiguousarray(block).view(f"=u{size}")
                if predictor == 2:
                    block = np.concatenate([block[:, :1], np.diff(block, axis=1)], axis=1)
                if predictor == 3:
                    planes = np.ascontiguousarray(block.astype(f">u{size}")).view(np.uint8).reshape(block.shape[0], -1, size).transpose(0, 2, 1).reshape(block.shape[0], -1, spp)
                    raw = np.concatenate([planes[:, :1], np.diff(planes, axis=1)], axis=1).tobytes()
                else:
                    raw = block.astype(f"{order}u{size}").tobytes()
                data = squeeze(raw)
                offsets.append(len(out))
                counts.append(len(data))
                out += data
        out += b"\0" * (len(out) % 2)
        where, kind = ((324, 325), [(322, 4, [tw]), (323, 4, [th])]) if tile else ((273, 279), [(278, 4, [th])])
        tags = [(256, 4, [width]), (257, 4, [height]), (258, 3, [size * 8] * spp), (259, 3, [compression]), (262, 3, [1]), (where[0], 4, offsets), (277, 3, [spp]), (where[1], 4, counts), (284, 3, [1]), (317, 3, [predictor]), (339, 3, [3 if floats else 1] * spp), *kind]
        body = []
        for tag, code, values in sorted(tags):
            raw = struct.pack(f"{order}{len(values)}{_CODES[code]}", *values)
            if len(raw) > 4:
                place = len(out)
                out += raw + b"\0" * (len(raw) % 2)
                raw = struct.pack(order + "I", place)
            body.append(struct.pack(order + "HHI", tag, code, len(values)) + raw.ljust(4, b"\0"))
        struct.pack_into(order + "I", out, link, len(out))
        out += struct.pack(order + "H", len(body)) + b"".join(body)
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def read_pages(files: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """``key`` and the columns of ``PAGE``: one row per page of every file."""
    source = files.select(F.col(key).alias("key"), F.col(content).cast("binary").alias("content")).where("content is not null")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                pager, number, error = pages(content.as_py()), 0, None
                while error is None:
                    try:
                        page = next(pager)
                    except StopIteration:
                        break
                    except TiffError as e:
                        error, page = str(e), Page(number, *[None] * 8)
                    number += 1
                    values = [pa.array([v], t) for v, t in zip(page, [pa.int32()] * 8 + [pa.binary()], strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array([name.as_py()], batch.column(0).type), *values, pa.array([error], pa.string())], ["key", *Page._fields, "error"])

    return source.mapInArrow(work, f"key {source.schema['key'].dataType.simpleString()}, {PAGE}").withColumnRenamed("key", key)


#: Samples in a row, and rows of a page, of stored texts.
WIDTH, ROWS = 64, 4096


def payload(text: str | None) -> bytes:
    """UTF-8, with bytes 0 up to a positive multiple of a row."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b"\0" * (WIDTH - len(raw) % WIDTH if len(raw) % WIDTH or not raw else 0)


def store(data: bytes) -> bytes:
    """A payload as grey pages of 8-bit samples."""
    samples = np.frombuffer(data, np.uint8).reshape(-1, WIDTH)
    return write([samples[i : i + ROWS] for i in range(0, len(samples), ROWS)])


def feature(samples: np.ndarray) -> str:
    """64 bits: whether a column of the picture is brighter than the mean of all."""
    columns = samples.reshape(-1, WIDTH).sum(axis=0, dtype=np.int64)
    return np.packbits(columns * WIDTH > columns.sum()).tobytes().hex()


def digest_documents(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Stores every text as a TIFF, reads the stored bytes back and digests what was read."""
    import hashlib

    source = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    names = ["key", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for value in batch.column(1):
                raw = payload(value.as_py())
                n = len(value.as_buffer()) if value.is_valid else 0
                media = store(raw)
                back = b"".join(p.samples for p in pages(media))
                rows.append((n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-WIDTH:]), len(media), hashlib.sha256(media).hexdigest(), feature(np.frombuffer(back, np.uint8))))
            columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names)

    kind = source.schema["key"].dataType.simpleString()
    return source.mapInArrow(work, f"key {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string").withColumnRenamed("key", key)
