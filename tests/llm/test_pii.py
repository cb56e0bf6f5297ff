import random
import re

from pyspark.sql import functions as F

from tracewell.llm import pii, queries

EMAIL, IP, CARD, PHONE = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"


def luhn(d):
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def brute(text):
    digits = lambda m: re.sub("[^0-9]", "", m)
    holds = {"email": lambda m: True, "ip": lambda m: all(int(p) <= 255 for p in m.split(".")), "card": lambda m: 13 <= len(digits(m)) <= 19 and luhn(digits(m)), "phone": lambda m: 9 <= len(digits(m)) <= 15}
    return [(k, m.start(), m.end()) for k, p in zip(pii.BASE, (EMAIL, IP, CARD, PHONE), strict=True) for m in re.finditer(p, text) if holds[k](m[0])]


def texts():
    r = random.Random(4)
    parts = ["a", "b@c.de", "@", ".", "..", "-", " ", "_", "%x", "é", "😀", "1", "255", "0256", "4111111111111111", "4111 1111-1111 1111", "+1 (555) 555-2485", "+49", "(", ")", "10.0.0.1", "\n", "  ", "İ", "x.y", "7"]
    out = ["".join(r.choices(r.sample(parts, r.choice([2, 3, 5, 9, 26])), k=r.choice([2, 6, 20, 60]))) for _ in range(1200)]
    long = ["1 " * 30_000, "a" * 60_000 + "@b.c", "a@" + "b." * 30_000 + "c", "1." * 4000, "9" * 8000, "+1" + " " * 30_000, "-" * 30_000, "x@y.z " * 600, "+4" + "(" * 30_000 + "1"]
    return ["", " ", *out, *long]


def test_base_spans_like_brute_force(spark):
    rows = [(i, t) for i, t in enumerate(texts())]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(16)
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in pii.find(docs, kinds=pii.BASE).collect()}
    for i, t in rows:
        assert got[i] == brute(t), t[:200]


def test_added_kinds_and_context(spark):
    secret = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"
    rows = [(1, "pay to DE89 3704 0044 0532 0130 00 now"), (2, "pay to DE88 3704 0044 0532 0130 00 now"), (3, f'token = "{secret}"'), (4, f"commit {secret}"), (5, None), (6, "call 1.2.3.4")]
    got = {r.doc_id: [(s.kind, s.start, s.end, round(s.score, 2)) for s in r.spans] for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: [("iban", 7, 34, 0.8)], 2: [], 3: [("secret", 9, 49, 0.6)], 4: [], 5: [], 6: [("ip", 5, 12, 0.6)]}


def test_mask(spark):
    rows = [(1, "é a@b.de, 4111111111111111!", 26, "s"), (2, None, 7, "s"), (3, "", 0, "s"), (1, "plain", 5, "s"), (4, "+1 (555) 555-2485", 17, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, spans string")
    out = pii.mask(docs)
    assert out.schema.simpleString() == docs.schema.simpleString()
    assert sorted(map(tuple, out.collect()), key=str) == sorted([(1, "é [EMAIL], [CARD]!", 18, "s"), (2, None, 7, "s"), (3, "", 0, "s"), (1, "plain", 5, "s"), (4, "[PHONE]", 7, "x")], key=str)
    assert pii.mask(docs.limit(0)).count() == 0


def test_query_columns(spark, tmp_path):
    import hashlib

    rows = [(i, t) for i, t in enumerate(["a@b.c 1.1.1.1 +1 555 555 2485", "", None])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.QUERIES["op9_pii"](spark, str(tmp_path)).collect()}
    want = ",".join(f"{k}:{s}:{e}" for k, s, e in brute(rows[0][1]))
    assert (got[0].n_email, got[0].n_ip, got[0].n_card, got[0].n_phone) == (1, 1, 0, 1)
    assert got[0].base_sha256 == hashlib.sha256(want.encode()).hexdigest() and got[0].spans == want
    assert got[2].base_sha256 == hashlib.sha256(b"").hexdigest() and got[1].spans == ""
    _ = F


def test_ibans_end_where_their_country_says(spark):
    texts = ["IBAN GB82 WEST 1234 5698 7654 32 AND go", "DE89370400440532013000 BIC", "DE89 3704 0044 0532 0130 00 BIC COBADEFF", "GB82WEST12345698765433", "iban GB82 WEST 1234 5698 7654 32 DE89 3704 0044 0532 0130 00"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: [(s.start, s.end) for s in r.spans if s.kind == "iban"] for r in pii.find(rows).collect()}
    assert got == {0: [(5, 32)], 1: [(0, 22)], 2: [(0, 27)], 3: [], 4: [(5, 32), (33, 60)]}
    masked = {r.doc_id: r.text for r in pii.mask(rows, length=None).collect()}
    assert masked[0] == "IBAN [IBAN] AND go" and masked[2] == "[IBAN] BIC COBADEFF"


def test_many_spans_in_one_text(spark):
    """Several blocks of spans, some of which overlap."""
    text = " ".join(f"u{i}@a.b 10.0.0.{i % 250}" for i in range(700)) + " a@10.2.3.4 end"
    row = spark.createDataFrame([(1, text)], "doc_id long, text string")
    spans = pii.find(row).first().spans
    assert len(spans) == 700 + 700 + 2
    want, at = [], 0
    for start, end, kind in sorted((s.start, s.end, s.kind) for s in spans):
        if start >= at:
            want.append(text[at:start] + f"[{kind.upper()}]")
        at = max(at, end)
    assert pii.mask(row, length=None).first().text == "".join(want) + text[at:]
