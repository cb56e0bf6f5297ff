"""Nulls in any column, empty and very long texts, ties, repeated rows, empty tables and clashing names, for every operator and stage."""

import public_tokenizers
import pytest

import corpus_pipeline
from tracewell.llm import bpe, fingerprint, language, packing, pii, quality, queries, simhash, tiff, url_filter, warc
from tracewell.llm.runtime import shared_dir

LONG = "the quick brown fox jumps over the lazy dog near the river bank. " * 20_000
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = "key string, fp long, mark long, c long, m string, s string, p int, extra int, doc struct<a:int>, _row string, _text string, spans string, piece int, sequence_id long, node long, root long, score double, language string, component_id long, _lang string, _ll string"
ROWS = [
    (1, "The cat sat on the mat with the other cat and looked at the dog for a long time.", "en", "a", 80),
    (2, "The cat sat on the mat with the other cat and looked at the dog for a long time.", "en", "a", 80),
    (2, "The cat sat on the mat with the other cat and looked at the dog for a long time.", "en", "a", 80),
    (2, "Another text of the same id, about rivers and gardens and the people who live there.", None, None, None),
    (3, None, None, None, None),
    (4, "", "en", "b", 0),
    (5, " \n\t ", "en", "b", 4),
    (6, LONG, "en", "b", len(LONG)),
    (None, "A text without an id, but with words of its own to be kept somewhere in the output.", "en", None, 3),
    (7, "퟿\U0001f600 ünïcode ẞ", "de", "c", 9),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, *[None] * 21) for r in ROWS], f"{DOCS}, {CLASH}")


@pytest.fixture(scope="module")
def model(spark):
    plain = spark.createDataFrame(ROWS, DOCS)
    return language.train(plain), quality.train(plain, spark.createDataFrame([(1, 1), (2, 1), (4, 0), (5, 0)], "doc_id long, quality int"))


def operators(model):
    lang, machine = model
    path = public_tokenizers.path
    return {
        "simhash": (lambda d: simhash.near_duplicates(d), 10),
        "simhash_similarity": (lambda d: simhash.near_duplicates(d, words=5, similarity=0.8), 10),
        "tiff": (lambda d: tiff.digest_documents(d), 10),
        "quality": (lambda d: quality.score(d, machine), 10),
        "quality_keep": (lambda d: quality.keep(d, machine), None),
        "language": (lambda d: language.identify(d, lang), 10),
        "language_keep": (lambda d: language.keep(d, lang), None),
        "bpe": (lambda d: bpe.digest_documents(d, path("word_bpe_49k.json")), 10),
        "fingerprint": (lambda d: fingerprint.compare_neighbours(d), 10),
        "sketch": (lambda d: fingerprint.sketch_documents(d), 10),
        "pii": (lambda d: pii.find(d), 10),
        "mask": (lambda d: pii.mask(d), 10),
        "packing": (lambda d: packing.pack_documents(d, path("byte_bpe_50k.json")), None),
        "keep_one": (lambda d: simhash.keep_one(d, simhash.near_duplicates(d, words=5, similarity=0.8)), None),
    }


NAMES = list(operators((None, None)))


@pytest.mark.parametrize("name", NAMES)
def test_odd_rows(docs, model, name):
    work, n = operators(model)[name]
    rows = work(docs).collect()
    assert n is None or len(rows) == n
    if name in ("quality_keep", "language_keep", "mask", "keep_one"):
        assert work(docs).columns == docs.columns


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(docs, model, name):
    work, _ = operators(model)[name]
    assert work(docs.where("doc_id = 99")).collect() == []


def test_equal_texts_have_equal_values(docs, model):
    ops = operators(model)
    for name, columns in (("tiff", ["media_sha256", "feature", "payload_sha256"]), ("bpe", ["ids_sha256", "decoded_sha256"]), ("sketch", ["fingerprint"]), ("quality", ["score"]), ("simhash", ["fp"])):
        rows = [r for r in ops[name][0](docs.where("doc_id = 1 or lang = 'en' and doc_id = 2")).collect()]
        assert len({tuple(r[c] for c in columns) for r in rows}) == 1, name


def test_near_duplicates_of_null_and_copies(docs, model):
    got = simhash.near_duplicates(docs).collect()
    of = {}
    for r in got:
        of.setdefault(r.doc_id, set()).add(r.component_id)
    assert of[1] == {1} and of[2] == {1, 2} and of[3] == of[4] == of[5] == {3} and of[6] == {6} and len(of[None]) == 1


def test_keep_one_keeps_a_row_of_each_group(docs, model):
    kept = simhash.keep_one(docs, simhash.near_duplicates(docs, words=5, similarity=0.8)).select("doc_id", "text").collect()
    assert sorted((r.doc_id or 0, (r.text or "")[:7]) for r in kept) == [(0, "A text "), (1, "The cat"), (2, "Another"), (3, ""), (6, "the qui"), (7, ROWS[9][1][:7])]


PAGES = "page_id long, url string, html string, host string, path string, src string, dst string, w long, trust long, rule string, h string"
PAGE_ROWS = [
    (1, "https://a.example.net/en/x?y", "<a href='//b.org/fr/'>", *[None] * 8),
    (1, "https://a.example.net/en/x?y", "<a href='//b.org/fr/'>", *[None] * 8),
    (2, None, "text", *[None] * 8),
    (3, "no scheme", None, *[None] * 8),
    (None, "http://B.ORG", "", *[None] * 8),
    (4, "://", "<p>" * 100_000, *[None] * 8),
]


def test_pages(spark):
    pages = spark.createDataFrame(PAGE_ROWS, PAGES)
    judged = url_filter.judge(pages).collect()
    assert len(judged) == 6 and {r.verdict for r in judged} <= {"allow", "block"}
    assert {(r.host, r.path) for r in judged if r.page_id in (2, 3, 4)} == {("", "")}
    assert url_filter.judge(pages.limit(0)).collect() == []
    for rows in (pages, pages.where("page_id = 99")):
        folder = warc.new_folder(spark, "edges")
        warc.write_pages(rows, folder, least=0)
        back = warc.read_archives(spark, folder, keep_payload=False).collect()
        assert len(back) == rows.count()
    assert len({r.payload_digest for r in back}) == 0


def test_stages_and_run(spark, tmp_path):
    folder = str(tmp_path)
    good = [(1000 + i, f"The {w} of the river was seen by the people who live in the town near the {w} and its garden number {i}." * 3, "en", f"s{i % 3}", 100) for i, w in enumerate(["bank", "mouth", "source", "bed", "bend", "side"] * 8)]
    junk = [(100 + i, "$$$ BUY!! ### NOW|| " * 20, "en", "s0", 400) for i in range(20)]
    spark.createDataFrame([*good, *junk, *ROWS], DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(r[0], 1) for r in good] + [(r[0], 0) for r in junk], "doc_id long, quality int").withColumn("toxic", __import__("pyspark").sql.functions.lit(0)).write.parquet(f"{folder}/labels.parquet")
    rows = corpus_pipeline.run(spark, folder).collect()
    ids = {r.doc_id for r in rows}
    assert {r[0] for r in good[:6]} <= ids and not {r[0] for r in junk} & ids and 3 not in ids and 4 not in ids and 5 not in ids
    used = {}
    for r in rows:
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in used.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 1024
    assert [len(STAGE) for STAGE in corpus_pipeline.STAGES] == [2] * 5
    empty = spark.createDataFrame([], DOCS)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, folder).collect() == [], name


def test_queries_are_registered():
    assert {int(n[2:].split("_")[0]) for n in queries.QUERIES if n.startswith("op")} == set(range(1, 11))


def test_shared_folder_comes_from_the_session(spark):
    assert shared_dir(spark) == shared_dir(spark)
