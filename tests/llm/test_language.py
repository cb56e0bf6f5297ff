import math
import re

import pytest

from tracewell.llm import language


@pytest.fixture(scope="module")
def model(spark):
    words = {"en": "the cat sat on the mat and the dog was there with them", "de": "der hund und die katze sind nicht auf dem dach gewesen", "fr": "le chat est dans la maison avec les autres animaux"}
    rows = [(i, words[x], x) for i, x in enumerate(["en", "de", "fr"] * 20)]
    return language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, suffix string, said string")


def test_identify_fuses_evidence(spark, model):
    rows = [
        (1, "the dog and the cat", "a", None, None),
        (2, "die katze und der hund", "a", None, None),
        (3, "", "a", None, None),
        (4, None, None, None, None),
        (5, "12 34 !!", "a", None, "en"),
        (6, "le", "b", "fr", "fr-CA"),
        (7, "xq", "c", "de", "de"),
        (7, "xq", "c", "de", "de"),
    ]
    got = language.identify(frame(spark, rows), model, host="source", suffix="suffix", markup="said").collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == 8 and by[1].language == "en" and by[2].language == "de" and by[6].language == "fr" and by[7].language == "de"
    for i in (3, 4, 5):
        assert by[i].language is None and by[i].posterior is None and by[i].rejected
    assert not by[1].rejected and by[1].posterior > 0.99


def test_posterior_against_brute_force(spark, model):
    rows = [(i, t, "h", None, None) for i, t in enumerate(["the dog", "le chat est la", "der hund", "the the maison"])]
    got = {r.doc_id: r for r in language.identify(frame(spark, rows), model).collect()}
    found = [language.likelihood(t, model)[0] for _, t, *_ in rows]
    soft = [[math.exp(x) / sum(math.exp(y) for y in v) for x in v] for v in found]
    n = [sum(s[i] for s in soft) for i in range(3)]
    top = [(x + 1) / (sum(n) + 3) for x in n]
    level = [(n[i] + 8 * top[i]) / (sum(n) + 8) for i in range(3)]
    prior = [(n[i] + 8 * level[i]) / (sum(n) + 8) for i in range(3)]
    for (i, *_), v in zip(rows, found, strict=True):
        odds = [math.exp(x) * p for x, p in zip(v, prior, strict=True)]
        assert got[i].posterior == pytest.approx(max(odds) / sum(odds), abs=2e-6)
        assert got[i].language == model.languages[odds.index(max(odds))]


def test_keep_rows_columns_and_empty_table(spark, model):
    rows = spark.createDataFrame([(1, "the cat sat on the mat", "a", "en", 22, "x"), (2, None, "a", "en", 0, "y"), (3, "...", None, None, 3, "z"), (1, "the cat sat on the mat", "a", "en", 22, "x")], "doc_id long, text string, source string, lang string, _grams int, `_name` string")
    kept = language.keep(rows, model)
    assert kept.columns == rows.columns and [tuple(r) for r in kept.collect()] == [(1, "the cat sat on the mat", "a", "en", 22, "x")] * 2
    assert language.keep(rows.limit(0), model).count() == 0
    assert language.identify(rows.limit(0), model).count() == 0


def test_without_labels(spark):
    rows = spark.createDataFrame([(1, "the cat", None, "a")], "doc_id long, text string, lang string, source string")
    none = language.train(rows)
    assert none.languages == [] and language.keep(rows, none).count() == 1
    assert language.identify(rows, none).first().rejected is False


def test_trigrams_by_words():
    """Against words cut by a regular expression."""
    text = "Été: l'hôtel_2 ab1c  x²\nIst ß\u0301 ENDE"
    words = re.findall(r"[^\W\d_]+", text.lower())
    want = [tuple(f"\0{w}\0"[i : i + 3]) for w in words for i in range(len(w))]
    got = [tuple(chr(c >> s & 0x1FFFFF) for s in (42, 21, 0)) for c in language.trigrams(text).tolist()]
    assert got == want
    assert len(language.trigrams("")) == len(language.trigrams("12 _ !")) == 0


def test_long_text_counts_whole(model):
    long = "der hund " * 3 + "the cat " * 50_000
    a, b = language.likelihood(long, model, chunk=1000), language.likelihood(long, model)
    assert a[1] == b[1] == 21 + 300_000 and a[0] == pytest.approx(b[0])
    assert model.languages[b[0].argmax()] == "en"


def test_page_evidence(spark):
    pages = spark.createDataFrame([(1, "https://www.Beispiel.DE/x", "<html lang='de'><script>var x</script><p>Hallo</p>"), (2, None, None)], "page_id long, url string, html string")
    a, b = language.page_evidence(pages).orderBy("page_id").collect()
    assert (a.host, a.suffix, a.markup) == ("www.beispiel.de", "de", "de") and "Hallo" in a.text and "var" not in a.text
    assert b.host is None and b.text is None


def test_other_languages_and_noise_are_rejected(spark, model):
    texts = ["Η γάτα κάθεται στο χαλί και ο σκύλος ήταν εκεί μαζί τους", "koira ja kissa istuvat yhdessä pöydän alla eivätkä lähde pois", "xqzv kjwq vvxz pqkj zzxw qjvk wxqz kvjq", "the cat and the dog sat on the mat"]
    rows = frame(spark, [(i, t, "a", None, None) for i, t in enumerate(texts)])
    got = {r.doc_id: (r.language, r.rejected) for r in language.identify(rows, model).collect()}
    assert got == {0: (None, True), 1: (None, True), 2: (None, True), 3: ("en", False)}
    assert [r.doc_id for r in language.keep(rows, model).collect()] == [3]


def test_pages_with_clashing_columns_like_brute_force(spark, model):
    """All four evidences on pages whose own columns bear the evidence's names; the text's likelihood decides clear pages."""
    html = {"en": "the cat sat on the mat and the dog was there with them", "de": "der hund und die katze sind nicht auf dem dach gewesen", "fr": "le chat est dans la maison avec les autres animaux"}
    rows = [(i, f"https://site{i % 2}.example.{x}/p", f"<html lang={x}><p>{html[x]}</p></html>", "h", "s", "m", "t") for i, x in enumerate(["en", "de", "fr"] * 4)]
    rows += [(100, None, None, "h", "s", "m", "t"), (101, "https://a.de/", "<html lang=de><p>1 2 3</p>", "h", "s", "m", "t"), (0, rows[0][1], rows[0][2], "h", "s", "m", "t")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string, suffix string, markup string, text string")
    got = sorted((r.page_id, r.language, r.rejected) for r in language.identify(language.page_evidence(pages), model, "page_id", "text", "host", "suffix", "markup").collect() if r.language)
    assert got == sorted([(i, x, False) for i, x in enumerate(["en", "de", "fr"] * 4)] + [(0, "en", False)])
    assert language.identify(language.page_evidence(pages.limit(0)), model, "page_id", "text", "host", "suffix", "markup").count() == 0


def test_every_language_is_fitted(spark):
    rows = [(i, f"ab{chr(0x4E00 + i)}c{chr(0x4E00 + i)}d", f"l{i:03d}") for i in range(70)]
    assert len(language.train(spark.createDataFrame(rows * 2, "doc_id long, text string, lang string")).languages) > 50
