import random
import re

import numpy as np
from xxhash import xxh64_intdigest

from tracewell.llm import simhash
from tracewell.operators.components import components


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, d):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in root:
        for b in root:
            if (a ^ b).bit_count() <= d:
                root[find(a)] = find(b)
    return {f: find(f) for f in fps}


def corpus():
    r = random.Random(3)
    vocabulary = [f"w{i}é" for i in range(500)] + ["A", "Ä"]
    out = []
    for _ in range(60):
        words = r.choices(vocabulary, k=r.choice([1, 2, 3, 4, 5, 30, 200]))
        for _ in range(r.choice([1, 1, 2, 12])):
            if r.random() < 0.6:
                words = list(words)
                words[r.randrange(len(words))] = r.choice(vocabulary)
            out.append(r.choice([" ", "\n", " \t"]).join(words))
    return [*out, None, "", " \n", "\xa0", out[0], "x" * 100_000]


def test_fingerprint():
    for text in [*corpus(), "a b c d " * 3000]:
        assert simhash.fingerprint(text) == brute_fingerprint(text)
        assert simhash.fingerprint(text, chunk=7) == brute_fingerprint(text)


def test_query_on_texts(spark):
    texts = corpus()
    rows = [(1000 - i, t, 1, "c") for i, t in enumerate(texts)] + [(1000, texts[0], 1, "c"), (None, "alone in null", 2, "d"), (None, texts[1], 2, "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp int, component_id string").repartition(5)
    got = simhash.near_duplicates(docs).collect()
    fps = [brute_fingerprint(t) for _, t, *_ in rows]
    groups = brute_components(fps, 4)
    least = {}
    for (i, *_), f in zip(rows, fps, strict=True):
        if i is not None:
            least[groups[f]] = min(i, least.get(groups[f], i))
    want = [(i, f, least.get(groups[f])) for (i, *_), f in zip(rows, fps, strict=True)]
    assert sorted(((r.doc_id, r.fp % 2**64, r.component_id) for r in got), key=str) == sorted(want, key=str)
    kept = simhash.keep_one(docs, simhash.near_duplicates(docs)).collect()
    assert sorted(r.doc_id or 0 for r in kept) == sorted(set(least.values()) | {0})
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_dense_clusters_and_probes(spark):
    """Links are found by contraction and by probes alike, whatever the partitions are."""
    r = random.Random(9)
    fps = set()
    for _ in range(40):
        centre = r.getrandbits(64)
        for _ in range(r.choice([1, 3, 60])):
            fps.add(centre ^ sum(1 << b for b in r.sample(range(64), r.choice([0, 1, 2, 3, 4, 6]))))
    signed = [f - 2**64 if f >> 63 else f for f in fps]
    nodes = spark.createDataFrame([(f, f) for f in signed], "fp long, c long")
    n, both = simhash.moments(nodes)
    assert n == len(fps) and both[63, 5] == sum(1 for f in fps if f >> 63 & 1 and f >> 5 & 1)
    c = brute_components(fps, 4)
    want = [{k for k, v in c.items() if v == w} for w in set(c.values())]
    for m in (2, 3, 5):
        groups = simhash.group_bits(n, both, m)
        thresholds = [-1] + [0] * (m - 1)
        thresholds[-1] = 4 - m + 1 - sum(thresholds[:-1])
        links = simhash.probe_links(nodes, groups, thresholds, 4).collect()
        pairs = {(min(a, b), max(a, b)) for a in signed for b in signed if a != b and ((a ^ b) % 2**64).bit_count() <= 4}
        assert {(x.a, x.b) for x in links} == pairs
    root = {x.node: x.root for x in components(simhash.contract(nodes, simhash.group_bits(n, both, 3), 4)).collect()}
    assert all(any(a % 2**64 in g and b % 2**64 in g for g in want) for a, b in root.items())


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 101), (7, 8), (200, 190), (190, 180), (200, 180)]
    got = {x.node: x.root for x in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {101: 100, 200: 180, 190: 180}


def test_thresholds_sum():
    for n in (10, 10**4, 10**7, 10**10):
        p = np.full(64, 0.5) * n
        both = np.full((64, 64), 0.25) * n
        np.fill_diagonal(both, p)
        groups, thresholds = simhash.allocate(n, both)
        assert sum(thresholds) == 4 - len(groups) + 1 and sorted(b for g in groups for b in g) == list(range(64))


def shingles(text, words=5):
    parts = (text or "").lower().split()
    return {tuple(parts[i : i + words]) for i in range(max(1, len(parts) - words + 1))} if parts else set()


def test_similarity_finds_all_near_copies(spark):
    """Against brute force: texts of a similarity of 0.8 or more are together, a cluster of near copies too, unlike texts apart."""
    rng = np.random.default_rng(3)
    vocabulary = [f"w{i}" for i in range(4000)]
    texts = []
    for base in range(12):
        words = list(rng.choice(vocabulary, int(rng.integers(60, 400))))
        texts.append(" ".join(words))
        for changes in (1, 1, 2, 3, 6, 30):
            changed = list(words)
            for i in rng.choice(len(words), min(changes, len(words) // 2), replace=False):
                changed[i] = "x" + str(rng.integers(10**6))
            texts.append(" ".join(changed))
    texts += [None, "", "   ", "one two", "one two", "one two three"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(rows, words=5, similarity=0.8).collect()}
    sets = [shingles(t) for t in texts]
    likely, apart = 0, 0
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] or sets[j]:
                same = len(sets[i] & sets[j]) / len(sets[i] | sets[j])
                if same >= 0.84:
                    assert got[i] == got[j]
                    likely += 1
                if same < 0.05:
                    assert got[i] != got[j]
                    apart += 1
    assert likely > 60 and apart > 1000
    assert got[84] == got[85] == got[86] == 84


def test_sketches_compare_as_bins_do():
    """Likeness by words of bits is that of the filled bins; sketches that share a bucket's name share its run."""
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(300)]
    leasts, sizes = [], []
    for i in range(40):
        words = list(base[: 20 + 7 * i])
        for at in rng.choice(len(words), int(rng.integers(0, 6)), replace=False):
            words[at] = f"x{rng.integers(10**6)}"
        chunks = []
        leasts.append(simhash.sketched(" ".join(words), 5, sets=chunks)[1])
        sizes.append(len(simhash.shingle_set(chunks)))
    words, sizes = simhash.signatures(np.stack(leasts)), np.array(sizes)
    names = simhash.buckets(words)
    assert names.shape == (40, 40) and (names & 63 == np.arange(40)).all()
    x, y = np.triu_indices(40, 1)
    got = simhash.maybe_similar(words[x], words[y], sizes[x], sizes[y], 0.8)
    first = simhash.first_shared(words[x], words[y])
    short = lambda least: (least * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(56)
    empty = np.uint64(2**64 - 1)
    for at, (i, j) in enumerate(zip(x, y)):
        one, two = leasts[i] != empty, leasts[j] != empty
        m = (one | two).sum()
        same = (one & two & (short(leasts[i]) == short(leasts[j]))).sum() / m
        union = max((sizes[i] + sizes[j]) / 1.8, m)
        error = (0.16 / m * max(0, 1 - (m - 1) / (union - 1))) ** 0.5
        assert got[at] == (same >= 0.8 - 3.5 * error - 1e-6 and min(sizes[i], sizes[j]) >= 0.8 * max(sizes[i], sizes[j]))
        shared = [int(k & 63) for k in set(names[i].tolist()) & set(names[j].tolist())]
        assert first[at] == min(shared, default=40)
    assert 5 < got.sum() < 700


def test_a_dense_group_with_stragglers_is_whole(spark, monkeypatch):
    """Copies of one text with ever more changes: components are those of all pairs of 0.8 or more."""
    monkeypatch.setattr(simhash, "AGAIN", 20)
    monkeypatch.setattr(simhash, "CELL", 2000)
    monkeypatch.setattr(simhash, "BLOCK", 16)
    monkeypatch.setattr(simhash, "PAIRS", 50)
    rng = np.random.default_rng(11)
    base = [f"w{i}" for i in range(150)]
    texts = []
    for _ in range(240):
        words = list(base)
        for at in rng.choice(150, int(rng.integers(1, 9)), replace=False):
            words[at] = f"x{rng.integers(10**6)}"
        texts.append(" ".join(words))
    sets = [shingles(t) for t in texts]
    root = list(range(240))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(240):
        for j in range(i):
            if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(rows, words=5, similarity=0.8).collect()}
    assert got == {i: find(i) for i in range(240)}
    assert 1 < len(set(got.values())) < 200


def test_one_id_with_two_texts_keeps_both_components(spark):
    texts = ["a b c d e f g h", "p q r s t u v w", "p q r s t u v w"]
    rows = spark.createDataFrame([(1, texts[0]), (1, texts[1]), (2, texts[2])], "doc_id long, text string")
    kept = simhash.keep_one(rows, simhash.near_duplicates(rows, words=5, similarity=0.8)).collect()
    assert sorted(map(tuple, kept)) == [(1, texts[0]), (1, texts[1])]


def test_links_are_exact_around_the_similarity(spark):
    """Pairs of long texts at 0.8 or a little more link, pairs just below don't; nor do texts of equal fingerprints and other shingles."""
    texts, want = [], []
    for pair in range(60):
        # Two sets of n shingles with m in common: two blocks of words, the second of which differs.
        same, n = (802, 1000) if pair % 2 else (798, 1000)
        common = [f"p{pair}w{i}" for i in range(same - 1)]
        m = len(common) - 4
        own = round(m / 0.8 - m) // 2
        extra = own if pair % 2 else own + 6
        for side in "xy":
            texts.append(" ".join(common + [f"p{pair}{side}{i}" for i in range(extra)]))
        a, b = shingles(texts[-2]), shingles(texts[-1])
        want.append(len(a & b) / len(a | b) >= 0.8)
        assert abs(len(a & b) / len(a | b) - 0.8) < 0.015
    assert 20 < sum(want) < 40
    texts += ["a b c d e f", "a b c d e f a b c d e f"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(rows, words=5, similarity=0.8).collect()}
    assert [got[2 * i] == got[2 * i + 1] for i in range(60)] == want
    assert got[120] != got[121]
