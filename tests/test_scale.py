"""What the round's findings on time and memory rest on."""

import re

import pandas as pd
from pyspark.sql import functions as F

from tracewell.functions.spans import GROUP_MARK, MARK, find_spans
from tracewell.plans.lineage import spread
from tracewell.sources import discover, loaders


def test_spread_deals_one_file_to_many_tasks(spark, tmp_path):
    spark.range(1000).coalesce(1).write.parquet(f"{tmp_path}/rows")
    rows = spread(spark.read.parquet(f"{tmp_path}/rows"), "id")
    assert rows.rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism
    assert rows.count() == 1000 and rows.distinct().count() == 1000


def test_texts_that_hold_marks(spark):
    texts = ["ab12 é34", f"a{MARK}1{GROUP_MARK}22{MARK}", MARK, "1", "", "no digits", "1 2 3 4"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for many in (False, True):
        got = {r.i: r.s for r in rows.select("i", find_spans(F.col("t"), "([0-9])([0-9]?)", many=many, groups=2).alias("s")).collect()}
        for i, text in enumerate(texts):
            want = [(m.start(), m.end(), m.group(), list(m.groups())) for m in re.finditer("([0-9])([0-9]?)", text)]
            assert [(s.start, s.end, s.hit, list(s.groups)) for s in got[i]] == want


def test_cut_references_are_text(spark):
    page = "<title>a&amp;&lt;b and&amp</title><p>&ampx; &nosuch; &#65; &#66 R&D</p>"
    got = discover.html_to_text(spark.createDataFrame([(1, page)], "page_id long, html string")).collect()[0].text
    assert got == "a&<b and&amp\n&ampx; &nosuch; A &#66 R&D"
    assert loaders.html_text("<p>and&amp</p>") == "and&"


def test_every_third_line_end_in_linear_time(spark, tmp_path):
    import time

    from tracewell import queries

    texts = ["x" * 300_000, "a\nb\nc\nd\ne\nf\ng\nh", "\n\n\n\n", "one\ntwo\n" + "y" * 300_000]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    began = time.time()
    rows = queries.paragraphs(spark, str(tmp_path)).collect()
    assert time.time() - began < 60
    assert sorted((r.doc_id, r.paragraph, r.n_chars) for r in rows) == [(0, 0, 300_000), (1, 0, 5), (1, 1, 5), (1, 2, 3), (3, 0, 300_008)]


def test_loaders_hold_few_bytes_at_once():
    sizes = [5, 900, 200, None, 3000, 1, 0, 999]
    batch = pd.DataFrame({"content": [None if n is None else b"x" * n for n in sizes], "i": range(len(sizes))})
    parts = list(discover.slices(batch, 1000))
    assert [list(p["i"]) for p in parts] == [[0, 1], [2, 3], [4], [5, 6, 7]]
    assert [len(p) for p in discover.slices(batch.iloc[:0], 1000)] == [0]
