import gzip
import hashlib
import io
from pathlib import Path

from tracewell.llm import warc


def brute(rows, least=0):
    """page_id -> (bytes, digest, type, refers)."""
    first = {}
    for p, _, h in rows:
        h = (h or "").encode()
        if p is not None and len(h) >= least:
            first[h] = min(first.get(h, p), p)
    out = []
    for p, _, h in rows:
        h = (h or "").encode()
        f = first.get(h)
        revisit = f is not None and (p is None or p > f)
        out.append((p, len(h), warc.sha1_base32(h), "revisit" if revisit else "response", f if revisit else None))
    return sorted(out, key=str)


ROWS = [(i, f"http://h/{i}", f"<p>{i % 7}</p>" * (i % 5 + 1)) for i in range(300)] + [(5, "http://h/5", "twice"), (5, "http://h/5", "twice"), (900, None, None), (901, "u", ""), (None, "n", "<p>0</p>"), (10**12, "far\r\nX: y", "é" * 5000)]


def test_write_read(spark, tmp_path):
    pages = spark.createDataFrame([(*r, 1, "x") for r in ROWS], "page_id long, url string, html string, shard int, payload string")
    for least in (0, 12):
        folder = f"file://{tmp_path}/a{least}"
        warc.write_pages(pages, folder, least=least, roll=4000, shard=20_000)
        got = [tuple(r)[:1] + tuple(r)[2:6] for r in warc.read_archives(spark, folder).collect()]
        assert sorted(((p, b, d, t, f) for p, b, d, t, f in got), key=str) == brute(ROWS, least)


def test_same_bytes_and_standard_gzip(spark, tmp_path):
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string")
    sums = []
    for k, rows in enumerate((pages.repartition(1), pages.repartition(7))):
        folder = f"{tmp_path}/b{k}"
        warc.write_pages(rows, "file://" + folder, roll=3000, shard=15_000)
        files = sorted(Path(folder).glob("*.warc.gz"))
        assert len(files) > 2 and not list(Path(folder).glob(".shard*"))
        sums.append([(f.name, hashlib.sha256(f.read_bytes()).hexdigest()) for f in files])
        assert gzip.open(files[0]).read().startswith(b"WARC/1.1\r\n")
    assert sums[0] == sums[1]


def test_empty_and_damage(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write_pages(pages, f"file://{tmp_path}/c")
    assert warc.read_archives(spark, f"file://{tmp_path}/c").count() == 0
    raw = gzip.decompress(warc.record(1, "u", b"body", None))
    assert warc.parse(raw)["payload"] == b"body"
    for bad in (raw.replace(b"body", b"bodz"), raw[:-1]):
        try:
            warc.parse(bad)
            raise AssertionError
        except ValueError:
            pass
    assert len(list(warc.members(io.BytesIO(warc.record(1, "u", b"x" * 9999, None) * 3), 100))) == 3


def test_one_far_id_leaves_shards_small(spark, tmp_path):
    sizes = spark.range(20_000).selectExpr("id AS page_id", "1000L AS size")
    far = sizes.unionByName(spark.createDataFrame([(2**62, 1000), (None, 5)], "page_id long, size long"))
    for rows, extra in ((sizes, []), (far, [2**62])):
        bounds = warc.shard_bounds(rows, 2_000_000)
        assert bounds == list(range(2000, 20_000, 2000)) + extra
    assert len(warc.shard_bounds(far, 1000, most=7)) <= 7 and warc.shard_bounds(far.limit(0), 1000) == []
    ids = spark.createDataFrame([(0,), (1999,), (2000,), (19_999,), (2**62,), (None,)], "i long")
    from tracewell.llm.runtime import passed

    assert [r[0] for r in ids.select(passed(bounds, ids["i"])).collect()] == [0, 0, 1, 9, 10, None]
