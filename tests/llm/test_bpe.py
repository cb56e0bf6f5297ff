import hashlib
import random
from array import array

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tracewell.llm import bpe

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
PARTS = ["a", "e", "th", "in", "s'", "'s", "é", "é", "ß", "\n", " ", "  ", "\t", "\x1c", "\xa0", "1", "½", "!!", "<|endoftext|>", "　", "字", "😀", "İ", "aaaa", "er", "ing", ".", "\0"]


def texts(n, seed):
    r = random.Random(seed)
    return ["", " ", "\n"] + ["".join(r.choices(r.sample(PARTS, r.choice([2, 4, 12])), k=r.choice([3, 10, 60, 200]))) for _ in range(n)]


@pytest.mark.parametrize("long", [16, 2048])
def test_word_bpe_like_the_library(long):
    library, codec = Tokenizer.from_file(WORD), bpe.SuffixBpe(WORD, long=long, leaf=5)
    assert codec.twin is not None
    for text in texts(1500, 1) + ["anti" * 3000 + " " + "ab" * 5000]:
        ids = library.encode(text, add_special_tokens=False).ids
        assert codec.encode(text) == (array("I", ids).tobytes(), library.decode(ids, skip_special_tokens=False))


def test_byte_bpe_like_the_library():
    codec = bpe.SpaceBpe(BYTE)
    assert codec.fast is not None
    for text in texts(3000, 2):
        assert codec.encode(text) == array("I", codec.tok.encode(text, add_special_tokens=False).ids).tobytes()


@pytest.mark.parametrize("letters", ["a", "ab", "thein", "abcdefghijklmnopqrstuvwxyz"])
def test_tree_is_exact(letters):
    ranks, r = bpe.SuffixBpe(WORD).ranks, random.Random(letters)
    for n in (1, 2, 7, 64, 500, 3000):
        symbols = [*r.choices(letters, k=n), "e</w>"]
        for leaf, threads in ((1, 1), (3, 2), (50, 1)):
            assert bpe.tree(symbols, ranks, leaf, threads) == bpe.merge(symbols, ranks)


def test_documents(spark):
    library = Tokenizer.from_file(WORD)
    rows = [(1, "the end", "x"), (2, None, "x"), (2, "", "x"), (3, "z" * 9000, "x"), (1, "the end", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    for r in bpe.encode_documents(docs, WORD).collect():
        assert r.decoded == library.decode(r.ids, skip_special_tokens=False)
    got = sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digest_documents(docs, WORD).collect())
    want = []
    for i, t, _ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(array("I", ids).tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(want)
    assert bpe.digest_documents(docs.limit(0), WORD).count() == 0


def test_unsplit_runs_go_through_the_tree(monkeypatch):
    """Runs of up to 10**5 letters, by halves, as the library encodes them."""
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    codec, r, calls = bpe.SuffixBpe(path), random.Random(8), []
    tree = bpe.tree
    monkeypatch.setattr(bpe, "tree", lambda *a: calls.append(len(a[0])) or tree(*a))
    for n in (2047, 2048, 5000, 100_000):
        text = "".join(r.choice(["the", "ing", "a", "qx", "tion", "zz"]) for _ in range(n))[:n]
        ids, decoded = codec.encode(text)
        want = library.encode(text, add_special_tokens=False).ids
        assert memoryview(ids).cast("I").tolist() == want and decoded == library.decode(want, skip_special_tokens=False)
    assert calls == [2048, 5000, 100_000]
