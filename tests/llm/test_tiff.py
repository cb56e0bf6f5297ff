import struct
import zlib

import numpy as np
import pytest

from tracewell.llm import tiff


@pytest.mark.parametrize("compression", [tiff.PLAIN, tiff.LZW, tiff.DEFLATE, tiff.OLD_DEFLATE, tiff.PACKBITS])
@pytest.mark.parametrize("predictor", [1, 2, 3])
@pytest.mark.parametrize("order", "<>")
@pytest.mark.parametrize("tile", [None, (16, 32)])
def test_round_trip(compression, predictor, order, tile):
    rng = np.random.default_rng(5)
    kinds = [np.float32, np.float64] if predictor == 3 else [np.uint8, np.uint16, np.uint32]
    images = []
    for kind in kinds:
        for shape in ((1, 1), (37, 50), (65, 33, 3)):
            images.append((rng.integers(0, 7, shape) * (1.5 if predictor == 3 else 1)).astype(kind))
    data = tiff.write(images, compression, predictor, rows=9, tile=tile, order=order)
    got = list(tiff.pages(data))
    assert [p.samples for p in got] == [i.astype(i.dtype.newbyteorder("<")).tobytes() for i in images]
    assert [(p.height, p.width) for p in got] == [i.shape[:2] for i in images]


@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 3000, 40_000, 200_000])
def test_codecs(n):
    rng = np.random.default_rng(n)
    for top in (2, 256):
        data = rng.integers(0, top, n).astype(np.uint8).tobytes()
        assert tiff.lzw_decode(tiff.lzw_encode(data), n) == data
        assert tiff.unpack_bits(tiff.pack_bits(data), n) == data


def test_small_samples():
    rows = bytes([0b10110000, 0b01000000])
    head = b"II" + struct.pack("<HI", 42, 8)
    tags = [(256, 4), (257, 2), (258, 1), (259, 1), (273, 8 + 2 + 8 * 12 + 4), (277, 1), (278, 2), (279, 2)]
    data = head + struct.pack("<H", 8) + b"".join(struct.pack("<HHII", t, 4, 1, v) for t, v in tags) + b"\0" * 4 + rows
    assert list(next(tiff.pages(data)).samples) == [1, 0, 1, 1, 0, 1, 0, 0]


def test_bad_files():
    good = tiff.write([np.zeros((4, 4), np.uint8)])
    loop = bytearray(good)
    loop[-4:] = loop[4:8]
    for bad in (b"", b"II", b"nonsense", good[:20], good[:-30]):
        with pytest.raises(tiff.TiffError):
            list(tiff.pages(bad))
    with pytest.raises(tiff.TiffError, match="loop"):
        list(tiff.pages(bytes(loop)))


def test_read_pages(spark):
    two = tiff.write([np.arange(6, dtype=np.uint8).reshape(2, 3), np.ones((1, 2), np.uint16)])
    rows = [("a", two, 1), ("b", None, 2), ("c", b"junk", 3), ("a", two, 1)]
    files = spark.createDataFrame(rows, "path string, content binary, page int")
    got = tiff.read_pages(files).collect()
    assert sorted((r.path, r.page, r.width, r.error is None) for r in got) == [("a", 0, 3, True), ("a", 0, 3, True), ("a", 1, 2, True), ("a", 1, 2, True), ("c", 0, None, False)]
    assert tiff.read_pages(files.limit(0)).count() == 0


def test_digest(spark):
    import hashlib

    texts = ["", None, "a" * 64, "é" * 70, "x\n" * 200_000]
    docs = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)], "doc_id long, text string, feature string")
    for r in tiff.digest_documents(docs).collect():
        raw = (texts[r.doc_id] or "").encode()
        size = max(64, -(-len(raw) // 64) * 64)
        padded = raw.ljust(size, b"\0")
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), size, hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        assert r.media_sha256 == hashlib.sha256(tiff.store(padded)).hexdigest()
