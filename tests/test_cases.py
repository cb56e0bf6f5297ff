"""Files to cases: discovery, loaders, the pipeline, saving, the command line and streams."""

import io
import json
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from tracewell import cli
from tracewell.model import AdapterConflictError, AdapterContractError, BuildFailed, CaseConfig, CompatibilityError, IntegrityError, PersistenceError, SourceError
from tracewell.operators import integrity
from tracewell.plans.case import Case, EnglishRules, ExtractorRegistry, Pipeline
from tracewell.sources import discover, loaders, store
from tracewell.streaming import ingest

CONFIG = CaseConfig()


def put(folder, **files):
    for name, content in files.items():
        path = os.path.join(folder, name.replace("__", "/").replace("_dot_", "."))
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "wb") as f:
            f.write(content if isinstance(content, bytes) else content.encode())
    return str(folder)


MAIL = "From: Alice Smith <alice@example.com>\nTo: Robert Williams <robert@example.com>\nDate: Mon, 2 Mar 2026 09:30:00 -0600\nSubject: Payment\nMIME-Version: 1.0\nContent-Type: text/plain; charset=utf-8\n\nAlice Smith did not approve Payment #932 on March 2, 2026.\n"


@pytest.fixture(scope="module")
def case(spark, tmp_path_factory):
    folder = put(tmp_path_factory.mktemp("mini"), approval_dot_txt="On March 3, 2026, Robert Williams approved Contract #428 for Acme Corporation.", payment_dot_md="# Payment\n\nAcme Corporation paid Contract #428 on March 7, 2026.\n", message_dot_eml=MAIL)
    return Case.build(spark, folder)


def test_mini_case(case):
    assert case.report.complete and case.documents.count() == 3 and case.violations().count() == 0
    titles = {r.title for r in case.events.collect()}
    assert any(t.startswith("Paid:") for t in titles) and "Email Sent" in titles
    assert case.graph.find_path("Acme Corporation", "Contract #428")
    people = {r.text for r in case.mentions.where("entity_type = 'PERSON'").collect()}
    assert "On March" not in people and "Acme Corporation" not in people
    claims = {(r.kind, r.predicate, r.polarity) for r in case.claims.collect()}
    assert {("RELATIONSHIP", "SENT", "AFFIRMED"), ("RELATIONSHIP", "RECEIVED", "AFFIRMED"), ("EVENT", "EMAIL_SENT", "AFFIRMED"), ("EVENT", "APPROVED", "NEGATED")} <= claims
    sent = case.claims.where("predicate = 'SENT'").first()
    assert [t.start for t in sent.temporal] == ["2026-03-02T09:30:00-06:00"]
    event = case.events.where("title like 'Approved%'").first()
    assert [r.quote for r in case.evidence(event.id).collect()] == ["Robert Williams approved Contract #428 for Acme Corporation"]
    assert case.evidence(case.relationships.first().id).count() == 1 and case.evidence(case.entities.first().id).count() >= 1
    assert {r.event_id: r.filenames for r in case.event_sources().collect()}[event.id] == ["approval.txt"]


def test_save_and_load(spark, case, tmp_path):
    a = case.save(f"{tmp_path}/a")
    back = Case.load(spark, a)
    assert back.summary() == case.summary() and [r.title for r in back.timeline.dated.collect()] == [r.title for r in case.timeline.dated.collect()]
    with pytest.raises(PersistenceError):
        case.save(a)
    manifest = json.load(open(f"{a}/manifest.json"))
    manifest["tables"]["claims"]["digest"] = "1"
    bad = f"{tmp_path}/bad"
    os.system(f"cp -r {a} {bad}")
    os.remove(f"{bad}/.manifest.json.crc")
    json.dump(manifest, open(f"{bad}/manifest.json", "w"))
    with pytest.raises(IntegrityError, match="claims"):
        Case.load(spark, bad)
    with pytest.raises(PersistenceError):
        Case.load(spark, f"{tmp_path}/nothing")
    with pytest.warns(store.SanitizedCaseWarning):
        clean = case.save_sanitized(f"{tmp_path}/s")
    sanitized = Case.load(spark, clean)
    assert sanitized.sanitized and sanitized.documents.where("raw_text <> ''").count() == 0 and sanitized.evidence_spans.where("quote <> ''").count() > 0


def test_json(spark, case, tmp_path):
    one, two = f"{tmp_path}/1.json", f"{tmp_path}/2.json"
    store.export_json(case, one)
    store.export_json(case, two)
    content = open(one, "rb").read()
    assert content == open(two, "rb").read() and not [n for n in os.listdir(tmp_path) if n.endswith(".tmp")]
    back = store.import_json(spark, one)
    assert back.summary() == case.summary()
    envelope = json.loads(content)

    def written(change):
        e = json.loads(content)
        change(e)
        path = f"{tmp_path}/x.json"
        open(path, "w").write(json.dumps(e))
        return path

    with pytest.raises(IntegrityError, match="hash"):
        store.import_json(spark, written(lambda e: e["payload"]["entities"][0].update(canonical_name="other")))
    for key, value in (("format", "x"), ("format_version", 2), ("schema_version", "0")):
        with pytest.raises(CompatibilityError):
            store.import_json(spark, written(lambda e, k=key, v=value: e.update({k: v})))
    with pytest.raises(IntegrityError, match="sanitized"):
        store.import_json(spark, written(lambda e: e.update(sanitized="no")))
    with pytest.raises(PersistenceError):
        store.import_json(spark, one, max_bytes=100)
    with pytest.raises(PersistenceError):
        store.export_json(case, one, max_bytes=0)
    for text in ('{"a": 1, "a": 2}', '{"a": NaN}', "[" * 101 + "]" * 101, "[1]", "{", '"\\"[[["'):
        with pytest.raises(IntegrityError):
            store.parse(text)
    store.check_nesting('"' + "[" * 500 + '"')
    with pytest.raises(PersistenceError, match="record limit"):
        store.count_records(envelope["payload"], most=3)


def test_integrity_finds_each_fault(spark, case):
    def found(**changed):
        return {r.rule for r in integrity.violations(case.tables | changed).collect()}

    t = case.tables
    assert "claims: duplicate id" in found(claims=t["claims"].unionByName(t["claims"].limit(1)))
    assert "mentions: unknown evidence" in found(mentions=t["mentions"].withColumn("evidence_span_id", F.lit("evidence_x")))
    assert "evidence_spans: quote isn't the text at its place" in found(evidence_spans=t["evidence_spans"].withColumn("quote", F.lit("x")))
    assert "relationships: unknown target node" in found(relationships=t["relationships"].withColumn("target_id", F.lit("entity_x")))
    assert "documents: offset map is incomplete" in found(documents=t["documents"].withColumn("normalized_text", F.concat("normalized_text", F.lit("!"))))
    assert "documents: digest isn't its source's" in found(source_references=t["source_references"].withColumn("content_sha256", F.lit("0")))
    with pytest.raises(IntegrityError):
        integrity.check(t | {"entities": t["entities"].limit(0)})


def test_failures_and_strict(spark, tmp_path):
    folder = put(tmp_path, a_dot_txt="Alice Smith paid Invoice #381 on August 12, 2026.", b_dot_csv="x", c_dot_txt=b"\xff\xfe\x00", d_dot_pdf=b"%PDF", e_dot_txt=b"\xef\xbb\xbfBOM text.", f_dot_txt=b"\x80bad")
    case = Case.build(spark, folder)
    codes = {r.source_reference_id: r.code for r in case.failures.collect()}
    names = {r.id: r.filename for r in case.source_references.collect()}
    assert {names[k]: v for k, v in codes.items()} == {"b.csv": "UNSUPPORTED_FORMAT", "c.txt": "MALFORMED", "d.pdf": "LOADER_FAILED" if not has("pdfplumber") else "MALFORMED", "f.txt": "MALFORMED"}
    assert not case.report.complete and {r.raw_text for r in case.documents.collect()} == {"Alice Smith paid Invoice #381 on August 12, 2026.", "BOM text."}
    assert case.build_results.where("succeeded").count() == 2
    with pytest.raises(BuildFailed):
        Case.build(spark, folder, strict=True)
    with pytest.raises(SourceError):
        Case.build(spark, f"{tmp_path}/nothing")
    with pytest.raises(BuildFailed):
        Case.build(spark, f"{tmp_path}/b.csv")


def has(name):
    import importlib.util

    return importlib.util.find_spec(name) is not None


def test_copies_and_budgets(spark, tmp_path):
    folder = put(tmp_path, a_dot_txt="Same\r\ntext.", nested__z_dot_txt="Same\r\ntext.", b_dot_md="other", ignored_dot_bin="Same\r\ntext.")
    files = discover.read_files(spark, [p for p, _ in discover.walk(folder).files])
    groups = {r.content_sha256: r for r in discover.by_content(discover.source_references(files)).collect()}
    assert sorted(len(r.source_reference_ids) for r in groups.values()) == [1, 3]
    shared = next(r for r in groups.values() if len(r.source_reference_ids) == 3)
    assert shared.path.endswith("/a.txt") and len(shared.warnings) == 1
    assert len(discover.walk(folder, CaseConfig(max_files=1)).files) == 1 and discover.walk(folder, CaseConfig(max_files=1)).failures[0][0] == "LIMIT_EXCEEDED"
    assert [os.path.basename(p) for p, _ in discover.walk(folder, CaseConfig(max_file_bytes=5)).files] == ["b.md"]
    assert [os.path.basename(p) for p, _ in discover.walk(folder, CaseConfig(max_total_bytes=16)).files] == ["a.txt", "b.md"]
    nested = CaseConfig(max_depth=1)
    put(tmp_path, nested__deep__er__x_dot_txt="x")
    assert [f[0] for f in discover.walk(folder, nested).failures] == ["LIMIT_EXCEEDED"] and len(discover.walk(folder, nested).files) == 4
    os.symlink(f"{folder}/b.md", f"{folder}/link.md")
    os.symlink("/etc", f"{folder}/out")
    assert len(discover.walk(folder).warnings) == 2
    followed = discover.walk(folder, CaseConfig(follow_symlinks=True))
    assert any(p.endswith("link.md") for p, _ in followed.files) and [f[1] for f in followed.failures if "root" in f[1]]
    assert discover.read_store(spark, f"file://{folder}").count() >= 5


def test_a_store_tells_what_it_leaves_out(spark, tmp_path):
    folder = put(tmp_path, a_dot_txt="Alice Smith works for Acme Corp.", big_dot_txt="x" * 2000)
    os.symlink("/nowhere", f"{folder}/gone.txt")
    os.symlink("/etc", f"{folder}/out")
    config = CaseConfig(max_file_bytes=1000, follow_symlinks=True)
    case = Pipeline(spark, config).build_store(f"file://{folder}")
    codes = sorted(r.code for r in case.failures.select("code").collect())
    assert codes == ["LIMIT_EXCEEDED", "SOURCE_UNAVAILABLE", "SOURCE_UNAVAILABLE"]
    assert not case.summary()["complete"] and case.summary()["documents"] == 1
    assert [os.path.basename(p) for p, _ in discover.walk_store(spark, f"file://{folder}", CaseConfig(max_files=1)).files] == ["a.txt"]


def test_budgets_over_a_table(spark):
    rows = [(f"p{i:03d}", 10 + i) for i in range(50)]
    df = spark.createDataFrame(rows, "path string, size long")
    got = {r.path: r.status for r in discover.within_budget(df, CaseConfig(max_file_bytes=40, max_total_bytes=1000, max_files=45)).collect()}
    total = 0
    for n, (path, size) in enumerate(rows, 1):
        total += size
        assert got[path] == ("over_files" if n > 45 else "over_bytes" if total > 1000 else "too_large" if size > 40 else "kept")


def docx(body, core=None, **more):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>')
        if core:
            z.writestr("docProps/core.xml", core)
        for name, data in more.items():
            z.writestr(name, data)
    return out.getvalue()


P = "<w:p><w:r><w:t>{}</w:t></w:r></w:p>"
CELLS = f"<w:tbl><w:tr><w:tc>{P.format('A1')}</w:tc><w:tc>{P.format('B1')}</w:tc></w:tr></w:tbl>"


def test_docx():
    got = loaders.DocxLoader().load(docx(P.format("Alice Smith approved it.") + CELLS, '<c xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title>T</dc:title></c>'), "x.docx", CONFIG)
    assert got.raw_text == "Alice Smith approved it.\nA1\tB1" and got.metadata["table_count"] == 1 and got.metadata["core_properties"]["title"] == "T"
    cells = {s["label"]: got.raw_text[s["raw_start"] : s["raw_end"]] for s in got.segments if s["kind"] == "cell"}
    assert cells == {"table:1;row:0;column:0": "A1", "table:1;row:0;column:1": "B1"}
    assert [s["paragraph"] for s in got.segments if s["kind"] == "paragraph"] == [0, 1, 2]


@pytest.mark.parametrize(
    "content,config,code",
    [
        (loaders.OLE_MAGIC + b"x", CONFIG, "ENCRYPTED"),
        (b"not a zip", CONFIG, "MALFORMED"),
        (docx(P.format("x"), None, a="1", b="2"), CaseConfig(max_docx_members=2), "LIMIT_EXCEEDED"),
        (docx(P.format("x" * 5000)), CaseConfig(max_docx_member_bytes=1000), "LIMIT_EXCEEDED"),
        (docx(P.format("x"), None, bomb="0" * 1_000_000), CONFIG, "LIMIT_EXCEEDED"),
        (docx(P.format("x"), None, **{"../up": "x"}), CONFIG, "MALFORMED"),
        (docx(P.format("too long")), CaseConfig(max_extracted_chars=3), "LIMIT_EXCEEDED"),
    ],
)
def test_docx_failures(content, config, code):
    assert loaders.run_loader(loaders.DocxLoader(), content, "x.docx", config)[1]["code"] == code


def test_mail_parts():
    mail = b'From: a@x.example\nTo: "B, C" <b@x.example>, d@x.example\nMIME-Version: 1.0\nContent-Type: multipart/mixed; boundary=Z\n\n--Z\nContent-Type: text/html\n\n<p>Hello <b>you</b></p><script>bad()</script>\n--Z\nContent-Type: text/plain; charset=bogus\nContent-Disposition: attachment; filename=n.txt\n\nattached caf\xc3\xa9\n--Z--\n'
    got = loaders.EmlLoader().load(mail, "m.eml", CONFIG)
    assert "bad()" not in got.raw_text and "Hello" in got.raw_text and "attached café" in got.raw_text
    assert got.metadata["attachments"][0]["filename"] == "n.txt" and any("replacement" in w for w in got.warnings)
    places = loaders.locate_addresses(got)
    assert [(p["field"], got.raw_text[p["address_start"] : p["address_end"]]) for p in places] == [("from", "a@x.example"), ("to", "b@x.example"), ("to", "d@x.example")]
    assert {s["field"] for s in got.segments if s["kind"] == "field"} == {"from", "to", "body"}


def test_pdf_pages():
    class Page:
        def __init__(self, text, words=(), images=()):
            self.text, self.words, self.images = text, words, images

        def extract_text(self):
            return self.text

        def extract_words(self):
            return self.words

    class Pdf:
        def __init__(self, *pages):
            self.pages = pages

    word = lambda t: {"text": t, "x0": 1, "top": 2, "x1": 3, "bottom": 4}
    got = loaders.PdfLoader().read(Pdf(Page("One one.", [word("One"), word("one."), word("none")]), Page("Two.", [word("Two.")])), CONFIG)
    assert got.raw_text == "One one.\nTwo." and [(b["raw_start"], b["raw_end"], b["page"]) for b in got.metadata["word_boxes"]] == [(0, 3, 1), (4, 8, 1), (9, 13, 2)]
    assert [(s["page"], s["sentence"]) for s in got.segments if s["kind"] == "sentence"] == [(1, 0), (2, 1)]
    for pdf, config, code in ((Pdf(Page("", images=[1])), CONFIG, "OCR_REQUIRED"), (Pdf(Page("a"), Page("b")), CaseConfig(max_pdf_pages=1), "LIMIT_EXCEEDED"), (Pdf(Page("abc")), CaseConfig(max_extracted_chars=2), "LIMIT_EXCEEDED"), (Pdf(Page("a b", [word("a"), word("b")])), CaseConfig(max_pdf_word_boxes=1), "LIMIT_EXCEEDED")):
        with pytest.raises(loaders.LoaderFailure) as e:
            loaders.PdfLoader().read(pdf, config)
        assert e.value.code == code


def test_html_text(spark):
    pages = spark.createDataFrame([(1, "<html><script>x</script><p> One </p>\n\n<div>Two &amp; three<template><p>no</p></template></div>"), (2, None), (3, "")], "page_id long, html string")
    assert {r.page_id: r.text for r in discover.html_to_text(pages).collect()} == {1: "One\nTwo & three", 2: "", 3: ""}


class Upper:
    name, version, supported_suffixes, media_type = "upper", "1", (".up",), "text/x-upper"

    def load(self, content, filename, config):
        return loaders.Loaded(content.decode().upper(), self.media_type)


class Bad(Upper):
    name, supported_suffixes = "bad", (".bad",)

    def load(self, content, filename, config):
        return "text"


class Broken(Upper):
    name, supported_suffixes = "broken", (".broken",)

    def load(self, content, filename, config):
        raise ValueError("no")


def test_registries(spark):
    registry = loaders.default_registry()
    registry.register(Upper())
    with pytest.raises(AdapterConflictError):
        registry.register(Upper())
    registry.register(Upper(), replace=True)
    copy = registry.clone()
    copy.register(Bad())
    assert registry.find("x.bad") is None and copy.find("X.UP").name == "upper" and registry.versions()["upper"] == "1"
    nameless = Upper()
    nameless.supported_suffixes = ("up",)
    with pytest.raises(AdapterContractError):
        copy.register(nameless, replace=True)
    assert loaders.run_loader(Bad(), b"", "x", CONFIG)[1]["code"] == "ADAPTER_CONTRACT" and loaders.run_loader(Broken(), b"", "x", CONFIG)[1]["code"] == "LOADER_FAILED"
    rules = ExtractorRegistry([EnglishRules()])
    with pytest.raises(AdapterConflictError):
        rules.register(EnglishRules())
    with pytest.raises(AdapterContractError):
        rules.register(object())
    rules.remove(EnglishRules.name)
    assert rules.extractors == []
    assert Pipeline(spark).with_loader(Upper()).loaders.find("a.up") and Pipeline(spark).loaders.find("a.up") is None


def test_command_line(spark, case, tmp_path, capsys):
    folder = put(tmp_path / "in", a_dot_txt="Alice Smith met with Bob Jones.")
    assert cli.main(["build", folder, "-o", f"{tmp_path}/c.json", "--json"], spark) == 0
    out = capsys.readouterr().out
    assert out.startswith("Saved:") and json.loads(out.splitlines()[1])["events"] == 1
    assert cli.main(["inspect", f"{tmp_path}/c.json"], spark) == 0 and "1 events" in capsys.readouterr().out
    assert cli.main(["timeline", f"{tmp_path}/c.json"], spark) == 0 and capsys.readouterr().out == "Undated\nMet\nSources: a.txt\n\n"
    assert cli.main(["timeline", f"{tmp_path}/c.json", "--json"], spark) == 0 and json.loads(capsys.readouterr().out)[0]["sources"] == ["a.txt"]
    assert cli.main(["inspect", f"{tmp_path}/none"], spark) == 1


def test_stream(spark, tmp_path):
    source = f"{tmp_path}/in"
    rows = [(1, "Alice Smith paid Invoice #123.", "2024-01-01 00:00:00"), (2, "Alice Smith paid Invoice #123.", "2024-01-01 00:01:00"), (3, "Dr. Jane Roe left.", "2024-01-01 00:02:00")]
    spark.createDataFrame(rows, "doc_id long, text string, at string").withColumn("at", F.to_timestamp("at")).write.parquet(source)
    stream = ingest.distinct_documents(ingest.read_texts(spark, source, "doc_id long, text string, at timestamp"), "at")
    query = ingest.write(ingest.extract_stream(stream), f"{tmp_path}/out", f"{tmp_path}/ckpt")
    query.awaitTermination(300)
    got = spark.read.parquet(f"{tmp_path}/out")
    assert got.select("doc_id").distinct().count() == 2 and got.where("normalized = 'invoice:123'").count() == 1
