import hashlib
import random

import numpy as np

from tracewell.llm import fingerprint as fp


def test_difference_is_exact():
    r = random.Random(2)
    for n in (0, 1, 5, 40, 3000):
        for gone in (0, 1, 7, n):
            a = {r.getrandbits(64) for _ in range(n)}
            b = set(r.sample(sorted(a), max(0, n - gone))) | {r.getrandbits(64) for _ in range(gone)}
            mine, theirs = fp.difference(np.array(sorted(a), np.uint64), np.array(sorted(b), np.uint64))
            assert (set(mine.tolist()), set(theirs.tolist())) == (a - b, b - a)


def test_fingerprints_survive_their_strings_and_fold():
    r = random.Random(4)
    for n in (0, 1, 30, 70_000):
        a = np.array(sorted(r.getrandbits(64) for _ in range(n)), np.uint64)
        b = np.array(sorted({*a[n // 10 :].tolist(), *(r.getrandbits(64) for _ in range(n // 10))}), np.uint64)
        one, two = fp.Print.of(a), fp.Print.of(b)
        again = fp.Print.read(str(one))
        assert str(again) == str(one) and str(fp.Print.of(a)) == str(one)
        mine, theirs = again.minus(fp.Print.read(str(two)))
        assert (set(mine.tolist()), set(theirs.tolist())) == (set(a.tolist()) - set(b.tolist()), set(b.tolist()) - set(a.tolist()))
        small = fp.Sketch(a, 12)
        folded = one.sketch.folded(4)
        assert (folded.keys == small.keys).all() and (folded.count == small.count).all() and (folded.checks == small.checks).all()
    # More of one digest's copies in a cell than 16 bits count.
    assert fp.Print.of(a, 3).sketch.count.sum() == 3 * 70_000


def brute_units(text):
    out = []
    for line in text.split("\n"):
        out += fp._SENTENCE.split(line) if len(line) > fp.LONG_LINE else [line]
    return [u for u in out if u]


def brute_likeness(a, b):
    from collections import Counter

    x, y = Counter(brute_units(a)), Counter(brute_units(b))
    total = sum(x.values()) + sum(y.values())
    return 1.0 if not total else 2 * sum((x & y).values()) / total


def test_neighbours_like_brute_force(spark):
    r = random.Random(6)
    sentence = lambda: " ".join(r.choices(["é", "ab", "cde", "😀"], k=8)) + "."
    texts = [r.choice([" ", "\n"]).join(sentence() for _ in range(r.choice([0, 1, 2, 9, 40]))) for _ in range(150)] + [None, "", "same\n" * 500, "x" * 100_000]
    rows = [(i * 3 % 457, t, "n") for i, t in enumerate(texts)]
    for extra in ([], [(None, "null id", "n"), (3, "again", "n"), (3, texts[1], "n")]):
        for parts in (1, 4, 9):
            docs = spark.createDataFrame(rows + extra, "doc_id long, text string, fingerprint string").repartition(5)
            got = fp.compare_neighbours(docs, parts).collect()
            order = sorted(((i is not None, i or 0, (t or "").encode(), t or "") for i, t, _ in rows + extra))
            want, decoded = [], 0
            for k, (there, i, _, t) in enumerate(order):
                following = order[(k + 1) % len(order)][3]
                half = len(t) // 2
                e = t[: len(t) - half] + following[:half]
                want.append((i if there else None, len(t), hashlib.sha256(e.encode()).hexdigest(), brute_likeness(t, e), brute_likeness(t, following)))
            line = lambda x: (str(x[0]), *x[1:])
            for x, w in zip(sorted(got, key=line), sorted(want, key=line), strict=True):
                assert (x.doc_id, x.n_chars, x.edited_sha256) == w[:3]
                mine, other = fp.Print.read(x.fingerprint), fp.Print.read(x.edited_fingerprint)
                # Likeness comes from the two strings alone; it is exact where the difference could be peeled.
                assert x.near_edited == mine.likeness(other)
                decoded += mine.minus(other) is not None
                assert abs(x.near_edited - w[3]) < (1e-9 if mine.minus(other) is not None else 0.25)
                assert abs(x.near_next - w[4]) < 0.25
            assert decoded > 100
    assert len({x.fingerprint for x in got if x.n_chars == 0}) == 1
    assert fp.compare_neighbours(docs.limit(0)).count() == 0
    one = fp.compare_neighbours(spark.createDataFrame([(7, "abcd")], "doc_id long, text string")).collect()[0]
    assert one.edited_sha256 == hashlib.sha256(b"abab").hexdigest() and one.near_next == 1.0
    assert fp.sketch_documents(spark.createDataFrame([(7, "abcd")], "doc_id long, text string")).collect()[0].fingerprint == one.fingerprint
