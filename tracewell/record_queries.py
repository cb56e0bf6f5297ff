"""Registered queries of loaders, review, evidence links, stored cases and seeded faults, each with its DuckDB SQL beside it.

Records are made from whole tables, so that what is expected follows from their columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell import oracles
from tracewell.functions.ids import stable_id
from tracewell.model import TEMPORAL, CaseConfig
from tracewell.operators import claims as c
from tracewell.operators import evidence as ev
from tracewell.operators import integrity, resolve, review
from tracewell.plans import corpus, views
from tracewell.plans.case import Case, Pipeline
from tracewell.plans.lineage import cut, new_folder, spread
from tracewell.queries import MERGED, OPEN, Query, _review_case, names, place_graph, table
from tracewell.sources import discover

QUALIFIERS = ("", "did not ", "never ", "may ", "might ", "could ", "allegedly ", "reportedly ")
WORK_QUALIFIERS = ("", "does not ", "did not ", "never ", "may ", "might ", "allegedly ")
NAME = "CASE {0} WHEN 'did not ' THEN 'NEGATED' WHEN 'does not ' THEN 'NEGATED' WHEN 'never ' THEN 'NEGATED' ELSE 'AFFIRMED' END AS polarity, CASE {0} WHEN 'may ' THEN 'POSSIBLE' WHEN 'might ' THEN 'POSSIBLE' WHEN 'could ' THEN 'POSSIBLE' WHEN 'allegedly ' THEN 'ALLEGED' WHEN 'reportedly ' THEN 'ALLEGED' ELSE 'ASSERTED' END AS modality"


def as_orders(rows: DataFrame, key: str) -> DataFrame:
    """Rows of another table in the form that the corpus is made of."""
    day = F.date_add(F.lit("2020-01-01").cast("date"), (F.col(key) % 1000).cast("int"))
    return rows.select(F.col(key).alias("o_orderkey"), F.col(key).alias("o_custkey"), day.alias("o_orderdate"))


def _as_orders(name: str, key: str) -> str:
    return f"orders AS (SELECT {key} AS o_orderkey, {key} AS o_custkey, DATE '2020-01-01' + CAST({key} % 1000 AS INTEGER) AS o_orderdate FROM {name}),"


# Claims of every verb and qualifier, several to a document


def claim_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three sentences a customer: an event of one of all verbs under one of all qualifiers, a meeting, and employment."""
    rows = corpus.with_names(spread(as_orders(table(spark, sf_dir, "customer"), "c_custkey"), "o_orderkey"))
    pick = lambda values, index: F.element_at(F.lit(list(values)), (index % len(values) + 1).cast("int"))
    k, verbs = F.col("doc_id"), list(c.PREDICATES)
    text = F.concat(
        "person", F.lit(" "), pick(QUALIFIERS, F.floor(k / len(verbs))), pick(verbs, k), F.lit(" the yearly ledger. "), "other", F.lit(" met with "), "person", F.lit(". "),
        "person", F.lit(" "), pick(WORK_QUALIFIERS, k), pick(("work", "worked", "works"), k), F.lit(" for "), "company", F.lit("."),
    )
    docs = corpus.documents(rows.select("doc_id", text.alias("text")), reference=None)
    found = cut(ev.extract_documents(docs)).select("doc_id", "normalized_text", F.explode("found_claims").alias("c"))
    surface = lambda p: F.coalesce(p["literal"], F.substring(F.col("normalized_text"), p["start"] + 1, p["end"] - p["start"]))
    return found.select("doc_id", "c.kind", "c.predicate", "c.polarity", "c.modality", F.array_join(F.transform("c.participants", lambda p: F.concat(p["role"], F.lit("="), surface(p))), "|").alias("parties"))


_FORMS = f"""
WITH {_as_orders("customer", "c_custkey")}{oracles.NAMED},
said AS (SELECT *, {oracles._list(QUALIFIERS)}[(doc_id // {len(c.PREDICATES)}) % {len(QUALIFIERS)} + 1] AS q, {oracles._list(c.PREDICATES.values())}[doc_id % {len(c.PREDICATES)} + 1] AS verb, {oracles._list(WORK_QUALIFIERS)}[doc_id % {len(WORK_QUALIFIERS)} + 1] AS w FROM named)
SELECT doc_id, 'EVENT' AS kind, verb AS predicate, {NAME.format("q")}, 'actor=' || person || '|description=the yearly ledger' AS parties FROM said
UNION ALL SELECT doc_id, 'EVENT', 'MET', 'AFFIRMED', 'ASSERTED', 'participant=' || other || '|participant=' || person FROM said
UNION ALL SELECT doc_id, 'RELATIONSHIP', 'WORKS_FOR', {NAME.format("w")}, 'source=' || person || '|target=' || company FROM said"""


# Files and loaders


def loaded_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of several suffixes, every tenth one a second time under another: what loads, as what, and what fails."""
    key, body = F.col("doc_id"), F.coalesce("text", F.lit(""))
    suffix = F.element_at(F.lit([".txt", ".MD", ".markdown", ".bin", ".txt"]), (key % 5 + 1).cast("int"))
    name = F.lpad(key.cast("string"), 12, "0")
    body = F.when(key % 5 == 1, F.concat(F.lit("# Title "), key.cast("string"), F.lit("\n\n"), body)).otherwise(body)
    paths = F.array(F.concat(F.lit("docs/"), name, suffix), F.when(key % 10 == 0, F.concat(F.lit("more/"), name, F.lit(".md"))))
    named = table(spark, sf_dir, "documents").select(F.explode(F.array_compact(paths)).alias("path"), body.alias("body"))
    files = named.select("path", F.octet_length("body").cast("long").alias("size_bytes"), F.col("body").cast("binary").alias("content"))
    loaded = discover.load(discover.by_content(discover.source_references(files)))
    headings = F.size(F.filter("segments", lambda s: s["field"] == "heading"))
    return loaded.select("content_sha256", "parser_name", "media_type", F.length("raw_text").alias("n_chars"), F.when(F.col("segments").isNotNull(), headings).alias("n_headings"), F.size("source_reference_ids").alias("n_sources"), F.size("warnings").alias("n_warnings"), F.col("failure.code").alias("failure"))


_LOADED = """
WITH d AS (SELECT doc_id, lpad(CAST(doc_id AS VARCHAR), 12, '0') AS name, CASE doc_id % 5 WHEN 1 THEN '# Title ' || CAST(doc_id AS VARCHAR) || chr(10) || chr(10) ELSE '' END || coalesce(text, '') AS body FROM documents),
files AS (SELECT 'docs/' || name || ['.txt', '.MD', '.markdown', '.bin', '.txt'][doc_id % 5 + 1] AS path, ['text', 'markdown', 'markdown', NULL, 'text'][doc_id % 5 + 1] AS loader, body FROM d UNION ALL SELECT 'more/' || name || '.md', 'markdown', body FROM d WHERE doc_id % 10 = 0),
g AS (SELECT body, arg_min(loader, (lower(path), path)) FILTER (loader IS NOT NULL) AS loader, count(*) AS n, count(DISTINCT loader) AS loaders, count(*) FILTER (loader IS NULL) AS without FROM files GROUP BY body)
SELECT sha256(body) AS content_sha256, loader AS parser_name, CASE loader WHEN 'text' THEN 'text/plain' WHEN 'markdown' THEN 'text/markdown' END AS media_type, CASE WHEN loader IS NOT NULL THEN CAST(length(body) AS INTEGER) END AS n_chars,
  CASE loader WHEN 'text' THEN 0 WHEN 'markdown' THEN CAST(len(regexp_extract_all(body, '(?m)^#{1,6}[ \t]+[^\n]')) AS INTEGER) END AS n_headings, CAST(n AS INTEGER) AS n_sources, CASE WHEN loaders > 1 THEN 1 ELSE 0 END + CASE WHEN without > 0 AND loaders > 0 THEN 1 ELSE 0 END AS n_warnings, CASE WHEN loader IS NULL THEN 'UNSUPPORTED_FORMAT' END AS failure FROM g"""


def mail_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mail files, one a supplier, with two recipients, a copy and a blind copy, read by the mail loader."""
    k = F.col("s_suppkey").cast("string")
    text = F.concat(
        F.lit("From: Seller <s"), k, F.lit("@left.example>\r\nTo: Ann Lee <a"), k, F.lit("@right.example>, b"), k, F.lit("@right.example\r\nCc: c"), k, F.lit("@right.example\r\nBcc: d"), k,
        F.lit("@right.example\r\nSubject: a note\r\n\r\nnothing but "), k, F.lit(" lines.\r\n"),
    )
    files = table(spark, sf_dir, "supplier").select(F.concat(F.lit("mail/"), k, F.lit(".eml")).alias("path"), F.octet_length(text).cast("long").alias("size_bytes"), text.cast("binary").alias("content"))
    docs = discover.documents(cut(discover.load(discover.by_content(discover.source_references(files)))))
    rows = cut(ev.extract_documents(docs)).select("normalized_text", F.explode("found_claims").alias("c"))
    surface = lambda p: F.substring(F.col("normalized_text"), p["start"] + 1, p["end"] - p["start"])
    return rows.select("c.kind", "c.predicate", surface(F.get("c.participants", F.lit(0))).alias("first"), surface(F.get("c.participants", F.lit(1))).alias("second"), F.col("c.score").alias("score"))


_MAIL = """
WITH p AS (SELECT 's' || s_suppkey || '@left.example' AS a, unnest(['a', 'b', 'c', 'd']) || s_suppkey || '@right.example' AS b FROM supplier)
SELECT 'RELATIONSHIP' AS kind, 'SENT' AS predicate, a AS first, b AS second, 0.995::DOUBLE AS score FROM p UNION ALL SELECT 'RELATIONSHIP', 'RECEIVED', b, a, 0.995 FROM p UNION ALL SELECT 'EVENT', 'EMAIL_SENT', a, b, 0.995 FROM p"""

#: Text nodes of the pages' markup; other markup needs a parser.
_HTML = """
WITH a AS (SELECT page_id, regexp_replace(coalesce(html, ''), '<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<template[^>]*>.*?</template>|<!--.*?-->|<[^>]*>', chr(10), 'gs') AS body FROM pages),
b AS (SELECT page_id, replace(replace(replace(replace(replace(replace(body, '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&') AS body FROM a)
SELECT page_id, array_to_string(list_filter(list_transform(string_split(body, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13))), lambda x: x <> ''), chr(10)) AS text FROM b"""


# Resolution


def merge_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of names that a person should look at."""
    found = resolve.merge_candidates(resolve.scored_pairs(cut(resolve.keyed(names(spark, sf_dir))), OPEN), OPEN)
    return found.select("kind", F.array_join("target_ids", "|").alias("targets"), "score")


_WORDS = "array_to_string(list_sort(string_split(lower({0}), ' ')), ' ')"
#: The longest common subsequence, a row of the table for each letter: a row's cells are made one after the other.
_PAIRS = f"""
WITH {oracles.NAMED}, n AS (SELECT DISTINCT 'PERSON' AS kind, person AS text FROM named UNION SELECT 'PERSON', other FROM named UNION SELECT 'ORGANIZATION', company FROM named),
k AS (SELECT kind, text, kind || ':' || text AS id, {_WORDS.format("text")} AS words, CASE kind WHEN 'PERSON' THEN split_part(lower(text), ' ', 2) ELSE split_part(lower(text), ' ', 1) END AS block FROM n),
p AS (SELECT l.id AS left_id, r.id AS right_id, l.kind AS entity_type, string_split(l.words, '') AS a, string_split(r.words, '') AS b FROM k l JOIN k r ON l.kind = r.kind AND l.block = r.block AND l.id < r.id),
f AS (SELECT *, list_reduce(list_transform(a, lambda x: list_transform(b, lambda y: CASE WHEN x = y THEN 1 ELSE 0 END)),
  lambda row, flags: list_reduce(list_transform(range(1, len(flags) + 1), lambda j: [flags[j], row[j], CASE WHEN j > 1 THEN row[j - 1] ELSE 0 END]), lambda made, e: list_append(made, CASE WHEN e[1] = 1 THEN e[3] + 1 ELSE greatest(e[2], made[-1]) END), [0])[2:],
  list_transform(b, lambda y: 0))[-1] AS common FROM p),
s AS (SELECT left_id, right_id, entity_type, CASE WHEN entity_type = 'ORGANIZATION' THEN 0.99::DOUBLE ELSE round(0.97::DOUBLE * (2.0::DOUBLE * common / (len(a) + len(b))), 6) END AS score FROM f)"""


# Time, graph and evidence


def undated_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events without a usable date: none at all, or one that isn't resolved."""
    when = F.struct(F.lit("someday").alias("original_text"), F.date_format("ts", "yyyy-MM-dd").alias("start"), F.lit(None).cast("string").alias("end"), F.lit("DAY").alias("precision"), F.lit(None).cast("string").alias("timezone"), F.lit(False).alias("is_relative"), (F.col("event_id") % 3 == 0).alias("resolved"), F.lit("evidence_0").alias("evidence_span_id"))
    rows = table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("id"), F.col("event_type").alias("title"), F.when(F.col("event_id") % 3 == 2, F.array().cast(f"array<{TEMPORAL}>")).otherwise(F.array(when)).alias("temporal"))
    return views.Timeline(rows).undated.select("id", "title", F.size("temporal").alias("n_dates"))


def graph_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations in a ring beside their regions: of equally short ways the first is taken."""
    places = place_graph(spark, sf_dir)
    nation = table(spark, sf_dir, "nation")
    node = lambda key: F.concat(F.lit("n:"), F.lpad(key.cast("string"), 8, "0"))
    ring = nation.select(node(F.col("n_nationkey")).alias("source_id"), node((F.col("n_nationkey") + 1) % 25).alias("target_id"), F.lit("NEXT_TO").alias("type"))
    edges = places.edges.select("source_id", "target_id", "type").where("type = 'PART_OF'").unionByName(ring)
    found = views.Graph(places.all_nodes.where("id not like 's:%'"), edges.select(resolve.edge_id().alias("id"), "*"))
    return found.paths_from("n:00000000").select("id", F.array_join("path", ">").alias("path"))


_TIES = f"""
WITH RECURSIVE link AS (SELECT 'n:' || {oracles._KEY.format("n_nationkey")} AS a, 'r:' || {oracles._KEY.format("n_regionkey")} AS b FROM nation UNION ALL SELECT 'n:' || {oracles._KEY.format("n_nationkey")}, 'n:' || {oracles._KEY.format("(n_nationkey + 1) % 25")} FROM nation),
way AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
walk AS (SELECT 'n:00000000' AS id, ['n:00000000'] AS path UNION ALL SELECT b, list_append(path, b) FROM walk JOIN way ON id = a WHERE len(path) < 6 AND NOT list_contains(path, b)),
ranked AS (SELECT id, path, row_number() OVER (PARTITION BY id ORDER BY len(path), path) AS rn FROM walk) SELECT id, array_to_string(path, '>') AS path FROM ranked WHERE rn = 1"""


def evidence_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence of mentions, claims, entities and relationships in its order.

    Each order is a mention and a claim with two spans, its own and its customer's; customers are entities, and edges that even orders
    support and odd ones oppose.
    """
    ident = lambda kind, key: F.concat(F.lit(f"{kind}_"), F.lpad(F.col(key).cast("string"), 8, "0"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    own, owner = ident("evidence", "o_orderkey"), ident("evidence_customer", "o_custkey")
    spans = o.select(own.alias("id")).unionByName(o.select(owner.alias("id")).distinct())
    mentions = o.select(ident("mention", "o_orderkey").alias("id"), own.alias("evidence_span_id"))
    claims = o.select(ident("claim", "o_orderkey").alias("id"), F.array(own, owner).alias("evidence_span_ids"))
    listed = lambda kind, keep: F.array_sort(F.collect_list(F.when(keep, ident(kind, "o_orderkey"))))
    even = F.col("o_orderkey") % 2 == 0
    per = o.groupBy("o_custkey").agg(listed("mention", F.lit(True)).alias("mention_ids"), listed("claim", even).alias("supporting_claim_ids"), listed("claim", ~even).alias("opposing_claim_ids"))
    edges = per.select(ident("relationship", "o_custkey").alias("id"), "supporting_claim_ids", "opposing_claim_ids")
    entities = per.select(ident("entity", "o_custkey").alias("id"), "mention_ids")
    out = None
    for kind, records in (("mention", mentions), ("claim", claims), ("entity", entities), ("relationship", edges)):
        part = views.evidence_of(records, kind, spans, claims, mentions).select("record_id", "evidence_span_id", F.array_join(F.col("place").cast("array<string>"), ".").alias("place"))
        out = part if out is None else out.unionByName(part)
    return out


_LINKS = f"""
WITH o AS (SELECT o_orderkey, o_custkey, 'evidence_' || {oracles._KEY.format("o_orderkey")} AS own, 'evidence_customer_' || {oracles._KEY.format("o_custkey")} AS owner, {oracles._KEY.format("o_orderkey")} AS k, {oracles._KEY.format("o_custkey")} AS cust FROM orders),
placed AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY k) - 1 AS nth, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey % 2, k) - 1 AS side FROM o)
SELECT 'mention_' || k AS record_id, own AS evidence_span_id, '0' AS place FROM o UNION ALL SELECT 'claim_' || k, own, '0' FROM o UNION ALL SELECT 'claim_' || k, owner, '1' FROM o
UNION ALL SELECT 'entity_' || cust, own, CAST(nth AS VARCHAR) FROM placed UNION ALL SELECT 'relationship_' || cust, own, CAST(side AS VARCHAR) || '.0' FROM placed UNION ALL SELECT DISTINCT 'relationship_' || cust, owner, '0.1' FROM placed"""


# Review


def _book(spark: SparkSession, sf_dir: str) -> review.ReviewBook:
    t = _review_case(spark, sf_dir)
    claims = t["claims"].withColumns({"polarity": F.lit("AFFIRMED"), "modality": F.lit("ASSERTED"), "score": F.lit(0.9), "temporal": F.array().cast("array<struct<start:string>>")})
    mentions = t["entities"].select(F.explode("mention_ids").alias("id"), F.lit(True).alias("accepted"))
    return review.ReviewBook(t | {"claims": claims, "mentions": mentions}, (), OPEN)


def _least(rows: DataFrame, condition: str) -> str:
    return rows.where(condition).agg(F.min("id")).first()[0]


def review_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pending claim accepted through its item, one accepted claim rejected: events are made again."""
    book = _book(spark, sf_dir)
    yes, no = _least(book.tables["review_items"], "true"), _least(book.tables["claims"], "accepted")
    out = book.apply([book.accept(yes), book.reject(no)]).tables["events"]
    return out.select(F.get("claim_ids", F.lit(0)).alias("claim"), "type", "title", F.size("participant_entity_ids").alias("n_people"))


def review_unmerge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three customers merged and parted again: names, edges and claims are what they were."""
    book = _book(spark, sf_dir)
    merge = book.merge_entities(MERGED)
    merged = book.apply(merge)
    t = merged.apply(merged.unmerge_entity(review.merged_id(MERGED), merge.id)).tables
    edges = t["relationships"].groupBy(F.col("source_id").alias("id")).agg(F.count("*").alias("n_edges"))
    said = t["claims"].select(F.explode("participants").alias("p")).groupBy(F.col("p.entity_id").alias("id")).agg(F.count("*").alias("n_claims"))
    rows = t["entities"].join(edges, "id", "left").join(said, "id", "left")
    return rows.select("id", "canonical_name", F.coalesce("n_edges", F.lit(0)).alias("n_edges"), F.coalesce("n_claims", F.lit(0)).alias("n_claims"))


def review_ungroup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first two events grouped and parted again."""
    book = _book(spark, sf_dir)
    first = [r.id for r in book.tables["events"].orderBy("id").limit(2).collect()]
    group = book.group_events(first)
    grouped = book.apply(group)
    t = grouped.apply(grouped.ungroup_event(review.grouped_id(first), group.id)).tables
    edges = t["relationships"].groupBy(F.col("target_id").alias("id")).agg(F.count("*").alias("n_edges"))
    return t["events"].join(edges, "id", "left").select("id", "title", "provisional", F.coalesce("n_edges", F.lit(0)).alias("n_edges"))


def review_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of a merge and a new name replayed over tables that no decision has changed."""
    book = _book(spark, sf_dir)
    merged = book.apply(book.merge_entities(MERGED))
    named = merged.apply(merged.set_canonical_name(review.merged_id(MERGED), "All Three"))
    t = _book(spark, sf_dir).replay(named.decisions).tables
    return t["entities"].select(F.when(F.col("id") == review.merged_id(MERGED), "merged").otherwise(F.col("id")).alias("id"), "canonical_name", F.size("mention_ids").alias("n_mentions"))


def review_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log of decisions as records, and which of them stand."""
    book = _book(spark, sf_dir)
    merge = book.merge_entities(MERGED)
    merged = book.apply(merge)
    parted = merged.apply(merged.unmerge_entity(review.merged_id(MERGED), merge.id))
    last = parted.apply(parted.set_canonical_name("entity_00000005", "Fifth Customer"))
    stands = [d.id for d in review.effective(last.decisions)]
    rows = review.log_frame(spark, last.decisions)
    return rows.select("seq", "action", F.size("target_ids").alias("n_targets"), F.col("supersedes").isNotNull().alias("replaces"), F.col("id").isin(stands).alias("stands"))


# Stored cases and seeded faults


def saved_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A case of one text a supplier, saved and loaded again; digests and integrity are checked on the way."""
    docs = corpus.corpus(as_orders(table(spark, sf_dir, "supplier"), "s_suppkey"))
    name = F.concat(F.lit("supplier-"), F.col("doc_id").cast("string"), F.lit(".txt"))
    docs = cut(docs.withColumns({"filename": name, "source_reference_ids": F.array(stable_id("src", name))}))
    sources = docs.select(F.get("source_reference_ids", F.lit(0)).alias("id"), F.col("filename").alias("path"), "filename", "media_type", F.octet_length("raw_text").cast("long").alias("size_bytes"), "content_sha256", F.lit("{}").alias("metadata"))
    case = Pipeline(spark, OPEN).build_documents(docs.drop("filename"), sources)
    again = Case.load(spark, case.save(new_folder(spark, "case")))
    return views.summary(again.tables, ("documents", "mentions", "claims", "entities", "events", "relationships"))


def seeded_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenth customer is missing, another tenth is there twice, and some review items have no target."""
    t = _review_case(spark, sf_dir)
    last = F.substring("id", -1, 1)
    people = t["entities"].where(last != "0")
    people = people.unionByName(people.where(last == "1"))
    items = t["review_items"].withColumn("target_ids", F.when(F.substring("id", -2, 2) == "01", F.array().cast("array<string>")).otherwise(F.col("target_ids")))
    found = integrity.violations(t | {"entities": people, "review_items": items})
    return found.groupBy("rule", "detail").agg(F.count("*").alias("n"))


_SEEDED = f"""
WITH {oracles._REVIEW}, bad AS (SELECT entity, count(*) AS n FROM o WHERE entity NOT IN (SELECT id FROM people WHERE right(id, 1) <> '0') GROUP BY 1)
SELECT 'entities: duplicate id' AS rule, '2' AS detail, count(*) AS n FROM people WHERE right(id, 1) = '1' HAVING count(*) > 0
UNION ALL SELECT unnest(['claims: unknown entity', 'events: unknown entity', 'relationships: unknown source node']), entity, n FROM bad
UNION ALL SELECT 'review_items: no targets', NULL, count(*) FROM o WHERE o_orderkey % 100 = 1 HAVING count(*) > 0"""

QUERIES: dict[str, Query] = {
    "claim_forms": claim_forms, "loaded_files": loaded_files, "mail_claims": mail_claims, "merge_candidates": merge_candidates, "undated_events": undated_events, "graph_ties": graph_ties, "evidence_links": evidence_links,
    "review_events": review_events, "review_unmerge": review_unmerge, "review_ungroup": review_ungroup, "review_replay": review_replay, "review_log": review_log, "saved_case": saved_case, "seeded_violations": seeded_violations,
}

_EDGES = "(SELECT count(*) FROM o WHERE o.entity = people.id)"
ORACLES: dict[str, str] = {
    "claim_forms": _FORMS,
    "loaded_files": _LOADED,
    "mail_claims": _MAIL,
    "html_text": _HTML,
    "pair_scores": _PAIRS + " SELECT left_id, right_id, entity_type, score FROM s",
    "merge_candidates": _PAIRS + f" SELECT 'entity_merge_candidate' AS kind, left_id || '|' || right_id AS targets, score FROM s WHERE score >= {CaseConfig.review_threshold} AND score < {CaseConfig.auto_merge_threshold}",
    "undated_events": "SELECT CAST(event_id AS VARCHAR) AS id, event_type AS title, CASE event_id % 3 WHEN 2 THEN 0 ELSE 1 END AS n_dates FROM events WHERE event_id % 3 <> 0",
    "graph_ties": _TIES,
    "evidence_links": _LINKS,
    "review_events": f"WITH {oracles._REVIEW} SELECT claim, 'TRANSACTION' AS type, 'Paid' AS title, 1 AS n_people FROM o WHERE (o_orderkey % 2 = 0 AND claim <> (SELECT min(claim) FROM o WHERE o_orderkey % 2 = 0)) OR claim = (SELECT min(claim) FROM o WHERE o_orderkey % 2 = 1)",
    "review_unmerge": f"WITH {oracles._REVIEW} SELECT id, c_name AS canonical_name, n AS n_edges, n AS n_claims FROM (SELECT id, c_name, {_EDGES} AS n FROM people)",
    "review_ungroup": f"WITH {oracles._REVIEW} SELECT event AS id, 'Order ' || CAST(o_orderkey AS VARCHAR) AS title, true AS provisional, 1 AS n_edges FROM o",
    "review_replay": f"WITH {oracles._REVIEW} SELECT CASE WHEN id IN {tuple(MERGED)} THEN 'merged' ELSE id END AS id, CASE WHEN id IN {tuple(MERGED)} THEN 'All Three' ELSE c_name END AS canonical_name, CAST(count(*) AS INTEGER) AS n_mentions FROM people GROUP BY 1, 2",
    "review_log": "SELECT * FROM (VALUES (0, 'MERGE_ENTITIES', 3, false, false), (1, 'UNMERGE_ENTITY', 1, true, true), (2, 'SET_CANONICAL_NAME', 1, false, true)) v(seq, action, n_targets, replaces, stands)",
    "saved_case": f"WITH {_as_orders('supplier', 's_suppkey')}" + oracles.ORACLES["case_summary"].lstrip().removeprefix("WITH"),
    "seeded_violations": _SEEDED,
}
