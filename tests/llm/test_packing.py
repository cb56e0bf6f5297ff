import random
import zlib
from array import array
from collections import defaultdict

import public_tokenizers
from tokenizers import Tokenizer

from tracewell.llm import packing

BYTE = public_tokenizers.path("byte_bpe_50k.json")


def check(rows, texts, size):
    library = Tokenizer.from_file(BYTE)
    by_doc, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        bins[r.sequence_id].append(r)
    assert set(by_doc) == set(texts)
    for doc, pieces in by_doc.items():
        ids = library.encode(texts[doc] or "", add_special_tokens=False).ids + [2]
        pieces.sort(key=lambda r: r.piece)
        assert [r.piece for r in pieces] == list(range(len(pieces)))
        at = 0
        for r in pieces:
            assert r.start == at and r.ids_crc32 == zlib.crc32(array("I", ids[at : at + r.length]).tobytes())
            assert r.length == size or r.piece == 0
            at += r.length
        assert at == len(ids) and len(pieces) == -(-len(ids) // size)
    for pieces in bins.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= size
    return len(bins), sum(r.length for r in rows)


def test_packs_whole_texts(spark):
    r = random.Random(7)
    texts = {i: " ".join(r.choices(["the", "end", "of", "Straße", "7"], k=r.choice([0, 1, 5, 20, 63, 64, 200]))) for i in range(600)} | {600: None, 601: ""}
    docs = spark.createDataFrame([(i, t, 3) for i, t in texts.items()], "doc_id long, text string, sequence_id int").repartition(9)
    for block in (40_000, 5):
        bins, tokens = check(packing.pack_documents(docs, BYTE, size=64, block=block, fanin=3).collect(), texts, 64)
        if block > 5:
            assert bins <= 1.03 * tokens / 64 + 2
    assert packing.pack_documents(docs.limit(0), BYTE).count() == 0


def test_lengths_that_never_fit_together(spark):
    texts = {i: "a" + " a" * 38 for i in range(500)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(8)
    assert check(packing.pack_documents(docs, BYTE, size=64, block=20).collect(), texts, 64)[0] == 500


def test_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "a b c")] * 3 + [(None, "x")], "doc_id long, text string")
    rows = packing.pack_documents(docs, BYTE, size=8).collect()
    assert sorted((r.doc_id or 0, r.length) for r in rows) == [(0, 2), (1, 4), (1, 4), (1, 4)]


def test_best_fit_takes_the_fullest_bin():
    assert packing.best_fit([6, 5, 4, 3, 1], 10) == [[0, 2], [1, 3, 4]]
