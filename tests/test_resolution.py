"""Resolution, derived views and review, on hand-made records."""

import pytest
from pyspark.sql import functions as F

from tracewell.functions.text import aliases, name_form, token_sort_ratio
from tracewell.model import AmbiguousReferenceError, CaseConfig, ConfigurationError, IntegrityError, ResourceLimitError, ReviewDecisionError
from tracewell.operators import resolve as r
from tracewell.operators import review as rv
from tracewell.operators.components import components
from tracewell.plans import views
from tracewell.plans.lineage import cut

MENTION = "id string, entity_type string, text string, normalized_text string, score double, accepted boolean, document_id string, evidence_span_id string"
PARTS = "array<struct<role:string,mention_id:string,entity_id:string,literal:string>>"
TEMPORAL = "array<struct<original_text:string,start:string,end:string,precision:string,timezone:string,is_relative:boolean,resolved:boolean,evidence_span_id:string>>"
CLAIM = f"id string, kind string, predicate string, participants {PARTS}, polarity string, modality string, temporal {TEMPORAL}, score double, accepted boolean"


def mentions(spark, *rows):
    return spark.createDataFrame([(f"m{i}", kind, surface, norm or surface.lower(), score, accepted, doc, f"e{i}") for i, (kind, surface, norm, score, accepted, doc) in enumerate(rows)], MENTION)


def plain(kind, surface, norm=None, score=0.95, accepted=True, doc="d"):
    return kind, surface, norm, score, accepted, doc


def resolved(spark, *rows, config=CaseConfig()):
    keyed = cut(r.keyed(mentions(spark, *rows)))
    found, _ = r.entities(keyed, r.clusters(keyed, config))
    return {tuple(x.mention_ids): x for x in found.collect()}, keyed


def test_types_are_kept_apart(spark):
    found, _ = resolved(spark, plain("PERSON", "John Smith"), plain("PERSON", "JOHN SMITH"), plain("ORGANIZATION", "John Smith"))
    assert set(found) == {("m0", "m1"), ("m2",)}


def test_identifiers(spark):
    found, _ = resolved(spark, plain("OTHER", "alice@example.com", "email:alice@example.com", 1.0), plain("OTHER", "Alice@example.com", "email:alice@example.com", 1.0), plain("OTHER", "bob@example.com", "email:bob@example.com", 1.0))
    assert set(found) == {("m0", "m1"), ("m2",)} and found[("m0", "m1")].score == 1.0


def test_acronyms_merge(spark):
    rows = plain("ORGANIZATION", "International Business Machines"), plain("ORGANIZATION", "IBM"), plain("ORGANIZATION", "IBM Corporation"), plain("ORGANIZATION", "Acme Inc.")
    found, keyed = resolved(spark, *rows)
    assert set(found) == {("m0", "m1", "m2"), ("m3",)}
    scores = {(x.left_id, x.right_id): x.score for x in r.scored_pairs(keyed).collect()}
    assert scores[("m0", "m1")] == 0.99 and scores[("m1", "m2")] == 0.99
    assert found[("m0", "m1", "m2")].canonical_name == "International Business Machines"


@pytest.mark.parametrize("threshold,together", [(0.98, False), (0.90, True)])
def test_fuzzy_names_need_a_low_threshold(spark, threshold, together):
    config = CaseConfig(auto_merge_threshold=threshold)
    found, keyed = resolved(spark, plain("PERSON", "Robert Williams"), plain("PERSON", "Robbert Williams", doc="e"), config=config)
    (pair,) = r.scored_pairs(keyed, config).collect()
    assert pair.score == pytest.approx(0.97 * 30 / 31, abs=1e-6)
    assert (len(found) == 1) == together and r.merge_candidates(r.scored_pairs(keyed, config), config).count() == (0 if together else 1)


def test_unaccepted_and_empty_names(spark):
    found, _ = resolved(spark, plain("PERSON", "Ann Lee"), plain("PERSON", "Ann Lee", accepted=False), plain("PERSON", "--", "--"), plain("PERSON", "--", "--"))
    assert set(found) == {("m0",), ("m2",), ("m3",)}


def test_canonical_name_and_aliases(spark):
    found, _ = resolved(spark, plain("PERSON", "ann lee", score=0.93), plain("PERSON", "Ann  Lee", "ann lee", 0.95), plain("PERSON", "ANN LEE", score=0.90))
    (e,) = found.values()
    assert e.canonical_name == "Ann  Lee" and e.aliases == ["Ann  Lee", "ANN LEE", "ann lee"] and e.score == pytest.approx(0.926667)


def test_limits(spark):
    rows = [plain("PERSON", f"P{i} Smith") for i in range(8)]
    keyed = cut(r.keyed(mentions(spark, *rows)))
    with pytest.raises(ResourceLimitError, match="last-token:smith"):
        r.scored_pairs(keyed, CaseConfig(max_resolution_block_size=7))
    with pytest.raises(ResourceLimitError, match="budget"):
        r.scored_pairs(keyed, CaseConfig(max_resolution_candidates=27))
    assert r.scored_pairs(keyed, CaseConfig(max_resolution_candidates=28)).count() == 28
    hot = cut(r.keyed(mentions(spark, *[plain("PERSON", "Ann Lee")] * 300, plain("PERSON", "Anne Lee"))))
    assert r.scored_pairs(hot, CaseConfig(strict_limits=False)).count() == 1
    with pytest.raises(ConfigurationError):
        CaseConfig(review_threshold=0.95)


def test_name_functions(spark):
    df = spark.createDataFrame([("Mr John  Smith", ""), ("The Bank of Acme Inc", ""), ("STRAẞE ﬁne Ｘ", "")], "a string, b string")
    got = [x[0] for x in df.select(name_form(F.col("a"))).collect()]
    assert got == ["john smith", "the bank of acme inc", "strasse fine x"]
    assert df.select(aliases(F.lit("the bank of acme inc"), F.lit(True))).first()[0] == ["ba", "the bank of acme", "the bank of acme inc"]
    pairs = [("robert williams", "williams robert", 1.0), ("abc", "", 0.0), ("", "", 1.0), ("kitten", "sitting", 2 * 4 / 13)]
    df = spark.createDataFrame(pairs, "a string, b string, want double")
    assert all(x.got == pytest.approx(x.want) for x in df.select("want", token_sort_ratio(F.col("a"), F.col("b")).alias("got")).collect())


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (200, 200)]
    got = {x.node: x.root for x in components(spark.createDataFrame(links, "a int, b int")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {101: 100}


def claim(i, kind, predicate, parties, polarity="AFFIRMED", modality="ASSERTED", accepted=True, start=None, score=0.9):
    dates = [(start, start, start, "DAY", None, False, True, None)] if start else []
    return f"c{i}", kind, predicate, parties, polarity, modality, dates, score, accepted


def test_events_and_relationships(spark):
    pair = [("source", "m0", "e0", None), ("target", "m1", "e1", None)]
    actor = [("actor", "m0", "e0", None), ("object", "m1", None, None), ("description", None, None, "the deal")]
    rows = [
        claim(0, "RELATIONSHIP", "WORKS_FOR", pair), claim(1, "RELATIONSHIP", "WORKS_FOR", pair, "NEGATED"), claim(2, "RELATIONSHIP", "OFFICER_OF", pair, modality="POSSIBLE"), claim(3, "RELATIONSHIP", "KNOWS", pair, "NEGATED"),
        claim(4, "EVENT", "APPROVED", actor), claim(5, "EVENT", "APPROVED", actor, "NEGATED"), claim(6, "EVENT", "EMAIL_SENT", actor, modality="ALLEGED"), claim(7, "EVENT", "EMAIL_SENT", actor, accepted=False), claim(8, "EVENT", "EMAIL_SENT", [("sender", "m0", "e0", None)]),
    ]
    df = spark.createDataFrame(rows, CLAIM)
    happened = cut(r.events(df))
    assert sorted((e.type, e.title, e.participant_entity_ids) for e in happened.collect()) == [("COMMUNICATION", "Email Sent", ["e0"]), ("DECISION", "Approved: the deal", ["e0"])]
    edges = {x.type: x for x in r.relationships(df, happened).where("type <> 'PARTICIPATED_IN'").collect()}
    assert set(edges) == {"WORKS_FOR"} and edges["WORKS_FOR"].supporting_claim_ids == ["c0"] and edges["WORKS_FOR"].opposing_claim_ids == ["c1"]
    assert r.relationships(df, happened).where("type = 'PARTICIPATED_IN'").count() == 2


def test_claims_keep_the_order_of_participants(spark):
    df = spark.createDataFrame([claim(0, "EVENT", "PAID", [("actor", "m2", None, None), ("object", "m1", None, None), ("object", "m9", None, None), ("description", None, None, "x")])], CLAIM)
    links = spark.createDataFrame([("m1", "e1"), ("m2", "e2")], "mention_id string, entity_id string")
    (row,) = r.resolve_claims(df, links).collect()
    assert [p.entity_id for p in row.participants] == ["e2", "e1", None, None] and row.id == "c0"
    with pytest.raises(IntegrityError):
        r.check_claims(df, spark.createDataFrame([("m1",), ("m2",)], "id string"))


def event(i, title, *dates):
    return f"event_{i}", "OTHER", title, [f"c{i}"], [], [(s or "x", s, e, p, None, False, ok, None) for s, e, p, ok in dates], 0.9, True


EVENT = f"id string, type string, title string, claim_ids array<string>, participant_entity_ids array<string>, temporal {TEMPORAL}, score double, provisional boolean"


def test_timeline(spark):
    rows = [
        event(0, "exact", ("2024", "2024", "YEAR", True)),
        event(1, "interval", ("2023-02", "2023-03", "RANGE", True)),
        event(2, "competing", ("2025-01-01", "2025-01-01", "DAY", True), ("2022", None, "YEAR", True)),
        event(3, "odd", ("sometime", None, "DAY", True)),
        event(4, "b unresolved", (None, None, "UNRESOLVED", False)),
        event(5, "A missing"),
        event(6, "later", ("2024-12-31T23:00:00+14:00", None, "INSTANT", True)),
    ]
    line = views.Timeline(spark.createDataFrame(rows, EVENT))
    assert [x.title for x in line.dated.collect()] == ["competing", "interval", "exact", "later", "odd"]
    assert [x.title for x in line.undated.collect()] == ["A missing", "b unresolved"]
    assert [x.title for x in line.all.collect()] == ["competing", "interval", "exact", "later", "odd", "A missing", "b unresolved"] and len(line) == 5


@pytest.fixture(scope="module")
def graph(spark):
    nodes = spark.createDataFrame([("e1", "entity", ["Alice", "A. Smith"]), ("e2", "entity", ["Bob"]), ("v1", "event", ["Approval"]), ("e3", "entity", ["Alex"]), ("e4", "entity", ["Alex"]), ("e5", "entity", ["Loop"])], "id string, kind string, names array<string>")
    edges = spark.createDataFrame([("r1", "e1", "v1", "APPROVED"), ("r2", "v1", "e2", "NOTIFIED"), ("r3", "e1", "v1", "SIGNED"), ("r4", "e5", "e5", "SELF"), ("r5", "e1", "e3", "K"), ("r6", "e3", "e2", "K")], "id string, source_id string, target_id string, type string")
    return views.Graph(nodes, edges)


def test_graph(graph):
    assert [x.type for x in graph.find_path("A. Smith", "Bob")] == ["K", "K"] and [x.type for x in graph.find_path("Approval", "Bob")] == ["NOTIFIED"]
    assert [x.type for x in graph.find_path("Alice", "Approval")] == ["APPROVED"]
    assert graph.find_path("Bob", "Bob") == [] and graph.find_path("Bob", "Loop") is None
    assert [x.id for x in graph.neighbors("Alice").collect()] == ["e3", "v1"] and [x.id for x in graph.neighbors("Alice", "K").collect()] == ["e3"]
    assert [x.id for x in graph.neighbors("Loop").collect()] == ["e5"]
    assert [x.id for x in graph.relationships("Approval", "Alice").collect()] == ["r1", "r3"] and graph.relationships("Bob").count() == 2
    with pytest.raises(AmbiguousReferenceError):
        graph.resolve("Alex")
    with pytest.raises(KeyError):
        graph.resolve("Nobody")


def test_graph_checks(spark):
    nodes = spark.createDataFrame([("a", "entity", ["A"])], "id string, kind string, names array<string>")
    with pytest.raises(ValueError):
        views.Graph(nodes.union(nodes), spark.createDataFrame([], "id string, source_id string, target_id string, type string"))
    with pytest.raises(ValueError):
        views.Graph(nodes, spark.createDataFrame([("r", "a", "b", "T")], "id string, source_id string, target_id string, type string"))


@pytest.fixture(scope="module")
def tables(spark):
    dates = [("2024", "2024-01-01", "2024-12-31", "YEAR", None, False, True, None)]
    parts = [("actor", "m1", "entity_1", None)]
    claims = [("claim_1", "EVENT", "PAID", parts, ["evidence_1"], "AFFIRMED", "ASSERTED", dates, "x", "1", 0.92, True), ("claim_2", "EVENT", "PAID", parts, ["evidence_1"], "AFFIRMED", "ASSERTED", [], "x", "1", 0.7, False)]
    return {
        "entities": spark.createDataFrame([("entity_1", "PERSON", "Ann", ["Ann"], ["m1"], 0.9), ("entity_2", "PERSON", "Anne Lee", ["Anne Lee", "AL"], ["m2"], 0.8), ("entity_3", "OTHER", "X", ["X"], ["m3"], 0.8)], "id string, type string, canonical_name string, aliases array<string>, mention_ids array<string>, score double"),
        "claims": spark.createDataFrame(claims, f"id string, kind string, predicate string, participants {PARTS}, evidence_span_ids array<string>, polarity string, modality string, temporal {TEMPORAL}, extractor_name string, extractor_version string, score double, accepted boolean"),
        "mentions": spark.createDataFrame([("m1", "evidence_1", "PERSON", "Ann", "ann", "x", "1", 0.9, True)], "id string, evidence_span_id string, entity_type string, text string, normalized_text string, extractor_name string, extractor_version string, score double, accepted boolean"),
        "evidence_spans": spark.createDataFrame([("evidence_1", "doc_1")], "id string, document_id string"),
        "events": spark.createDataFrame([("event_1", "ACTION", "Filed", ["claim_1"], ["entity_1"], dates, 0.9, True), ("event_2", "ACTION", "Signed", ["claim_1"], ["entity_2"], dates, 0.8, True), ("event_3", "OTHER", "Other", ["claim_1"], [], [], 0.8, True)], EVENT),
        "relationships": spark.createDataFrame([("r1", "entity_1", "event_1", "PARTICIPATED_IN", ["claim_1"], [], 0.9), ("r2", "entity_2", "event_1", "PARTICIPATED_IN", ["claim_2"], [], 0.95)], "id string, source_id string, target_id string, type string, supporting_claim_ids array<string>, opposing_claim_ids array<string>, score double"),
        "review_items": spark.createDataFrame([("review_1", "claim_candidate", ["claim_2"], "x", 0.7, []), ("review_2", "entity_merge_candidate", ["m1", "m2"], "x", 0.7, [])], "id string, kind string, target_ids array<string>, reason string, score double, evidence_span_ids array<string>"),
    }


def ids(df):
    return sorted(x.id for x in df.select("id").collect())


def test_merge_and_unmerge(tables):
    book = rv.ReviewBook(tables)
    merge = book.merge_entities(["entity_1", "entity_2"])
    after = book.apply(merge)
    to = rv.merged_id(["entity_1", "entity_2"])
    one = after.tables["entities"].where(F.col("id") == to).first()
    assert one.canonical_name == "Anne Lee" and one.aliases == ["AL", "Ann"] and one.mention_ids == ["m1", "m2"] and one.score == 0.9
    (edge,) = after.tables["relationships"].collect()
    assert (edge.source_id, edge.supporting_claim_ids, edge.score) == (to, ["claim_1", "claim_2"], 0.95)
    assert {p.entity_id for c in after.tables["claims"].collect() for p in c.participants} == {to}
    assert ids(book.tables["entities"]) == ["entity_1", "entity_2", "entity_3"]  # the old snapshot stays
    undone = after.apply(after.unmerge_entity(to, merge.id))
    for name in ("entities", "claims", "events", "relationships"):
        assert sorted(map(str, undone.tables[name].collect())) == sorted(map(str, tables[name].collect())), name
    again = rv.ReviewBook(tables).replay(after.log)
    assert sorted(map(str, again.tables["entities"].collect())) == sorted(map(str, after.tables["entities"].collect()))
    with pytest.raises(ReviewDecisionError):
        book.apply(book.merge_entities(["entity_1", "entity_3"]))


def test_group_ungroup_and_rename(tables):
    book = rv.ReviewBook(tables)
    group = book.group_events(["event_1", "event_2"])
    after = book.apply(group)
    to = rv.grouped_id(["event_1", "event_2"])
    one = after.tables["events"].where(F.col("id") == to).first()
    assert one.title == "Filed / Signed" and not one.provisional and one.participant_entity_ids == ["entity_1", "entity_2"] and one.score == 0.9 and len(one.temporal) == 1
    assert {x.target_id for x in after.tables["relationships"].collect()} == {to}
    undone = after.apply(after.ungroup_event(to, group.id))
    assert ids(undone.tables["events"]) == ["event_1", "event_2", "event_3"]
    named = book.apply(book.set_canonical_name("entity_1", "Ann Lee")).tables["entities"].where("id = 'entity_1'").first()
    assert named.canonical_name == "Ann Lee" and named.aliases == ["Ann"]
    with pytest.raises(ReviewDecisionError):
        book.set_canonical_name("entity_1", " ")
    with pytest.raises(ReviewDecisionError):
        book.apply(book.group_events(["event_1", "event_3"]))


def test_acceptance_and_supersession(tables):
    book = rv.ReviewBook(tables)
    accept = book.accept("review_1")
    after = book.apply(accept)
    assert after.tables["events"].count() == 2 and ids(after.pending) == ["review_2"] and ids(book.pending) == ["review_1", "review_2"]
    with pytest.raises(ReviewDecisionError, match="say which one it replaces"):
        after.apply(after.reject("review_1"))
    back = after.apply(after.reject("review_1", supersedes=accept.id))
    assert back.tables["events"].count() == 1 and len(back.log) == 2
    for bad in ("review_2", "nothing"):
        with pytest.raises(ReviewDecisionError):
            book.apply(book.accept(bad))
    with pytest.raises(ReviewDecisionError):
        rv.effective([rv.replace(accept, reason="changed")])
    with pytest.raises(ReviewDecisionError):
        book.apply(book.accept("review_1", supersedes="review_nothing"))


@pytest.mark.parametrize("threshold", [0.9, 0.96, 0.98, 0.988])
def test_without_strict_limits_all_mentions_are_resolved(spark, threshold):
    """The same clusters as from all pairs: repeated names and identifiers, aliases, and two names that meet in one document only."""
    rows = [plain("PERSON", "Robert Williams", doc=d) for d in "abc"] + [plain("PERSON", "Robbert Williams", doc=d) for d in "zyc"]
    rows += [plain("OTHER", "x@example.com", "email:x@example.com")] * 3 + [plain("ORGANIZATION", x) for x in ("IBM", "IBM", "IBM Corporation", "IBM Corporation", "Acme Inc.", "Acme Inc.")]
    strict, _ = resolved(spark, *rows, config=CaseConfig(auto_merge_threshold=threshold))
    loose, keyed = resolved(spark, *rows, config=CaseConfig(auto_merge_threshold=threshold, strict_limits=False))
    assert set(loose) == set(strict)
    assert max(len(x) for x in loose) >= 3
