import random

import numpy as np

from tracewell.llm import quality


def rows_of(n, seed=1):
    rng = random.Random(seed)
    good, bad = "analysis result river method garden people water history".split(), "BUY!! click $$$ free|| win### now".split()
    for i in range(n):
        y = i % 3 > 0
        yield i, " ".join(rng.choices(good if y else bad, k=rng.randint(5, 60))), int(y)


def test_linear_time_identity():
    """The sum-of-squares score is the sum over all pairs."""
    machine = quality.Machine()
    rng = np.random.default_rng(0)
    machine.w = rng.normal(size=machine.size)
    index, x = quality.features("some words and MORE words, 12 of them\nand a line", 50)
    pairs = sum(float(machine.v[i] @ machine.v[j]) * a * b for p, (i, a) in enumerate(zip(index, x, strict=True)) for j, b in list(zip(index, x, strict=True))[p + 1 :])
    assert abs(machine.raw(index, x) - (machine.bias + machine.w[index] @ x + pairs)) < 1e-9


def test_held_out_accuracy_and_edges(spark):
    rows = list(rows_of(600))
    docs = spark.createDataFrame([(i, t, len(t), "x") for i, t, _ in rows] + [(9001, None, None, "x"), (9002, "", 0, "x"), (9003, "word " * 100_000, 500_000, "x"), (9001, None, None, "x"), (None, "analysis", 8, "x")], "doc_id long, text string, n_chars long, score string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(9001, None), (7, 0)], "doc_id long, quality int")
    machine = quality.train(docs, labels)
    got = [(r.doc_id, r.score) for r in quality.score(docs, machine).collect()]
    assert len(got) == 605 and all(0 <= s <= 1 for _, s in got)
    truth = {i: y for i, _, y in rows}
    held = [(truth[i], s) for i, s in got if i in truth and __import__("zlib").crc32(str(i).encode()) % 5 == 0]
    assert len(held) > 80 and sum((s >= 0.3) == y for y, s in held) / len(held) > 0.97
    kept = quality.keep(docs, machine)
    assert kept.columns == docs.columns and kept.where("doc_id < 600").count() >= 390
    again = quality.train(docs.repartition(3), labels)
    assert np.allclose(again.w, machine.w)


def test_labels_of_held_out_fold_are_not_read(spark):
    rows = list(rows_of(200))
    docs = spark.createDataFrame([(i, t, len(t)) for i, t, _ in rows], "doc_id long, text string, n_chars long")
    flip = lambda i, y: 1 - y if __import__("zlib").crc32(str(i).encode()) % 5 == 0 else y
    a = quality.train(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int"))
    b = quality.train(docs, spark.createDataFrame([(i, flip(i, y)) for i, _, y in rows], "doc_id long, quality int"))
    assert np.array_equal(a.w, b.w)


def test_one_class_and_empty(spark):
    docs = spark.createDataFrame([(1, "a b", 3), (2, "c", 1)], "doc_id long, text string, n_chars long")
    only = quality.train(docs, spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, quality int"))
    assert all(r.score > 0.99 for r in quality.score(docs, only).collect())
    none = quality.train(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert quality.keep(docs, none).count() == 2 and quality.score(docs.limit(0), none).count() == 0


def test_conflicting_labels_are_examples_of_both(spark):
    """Whatever the order of rows, and however often a label is there."""
    rows = list(rows_of(200))
    docs = spark.createDataFrame([(i, t, len(t)) for i, t, _ in rows], "doc_id long, text string, n_chars long")
    labels = [(i, y) for i, _, y in rows] + [(i, 1 - y) for i, _, y in rows[:40]]
    a = quality.train(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    b = quality.train(docs.repartition(5), spark.createDataFrame(labels[::-1], "doc_id long, quality int").repartition(3))
    assert np.array_equal(a.w, b.w) and np.array_equal(a.v, b.v) and a.bias == b.bias


def test_keep_and_query_columns_against_brute_force(spark):
    """``keep`` keeps what the machine itself scores at the cut or above; folds are those of Python's CRC."""
    import zlib

    rows = list(rows_of(300, seed=5)) + [(900, "", 0), (901, None, 0)]
    docs = spark.createDataFrame([(i, t, len(t or "")) for i, t, _ in rows], "doc_id long, text string, n_chars long")
    machine = quality.train(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int"))
    want = {i: machine.score(*quality.features(t, float(len(t or "")))) for i, t, _ in rows}
    assert {r.doc_id for r in quality.keep(docs, machine).collect()} == {i for i, s in want.items() if s >= quality.CUT}
    got = docs.select("doc_id", (quality.fold(docs.doc_id) == 0).alias("held")).collect()
    assert all(r.held == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
