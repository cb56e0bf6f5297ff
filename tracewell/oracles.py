"""What the registered queries return, in DuckDB's SQL.

Results over the synthetic corpus are computed from the columns that its texts are made of, not from the texts: they check the rules
independently.
"""

from __future__ import annotations

from tracewell.plans.corpus import COMPANY, FIRST, LAST, SUFFIX, TEMPLATES


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


NAMED = f"""
named AS (SELECT o_orderkey AS doc_id, o_orderkey % {TEMPLATES} AS t, CAST(o_orderdate AS DATE) AS day,
  {_list(FIRST)}[o_custkey % {len(FIRST)} + 1] || ' ' || {_list(LAST)}[(o_custkey // {len(FIRST)}) % {len(LAST)} + 1] AS person,
  {_list(FIRST)}[(o_custkey + 3) % {len(FIRST)} + 1] || ' ' || {_list(LAST)}[(o_custkey // {len(FIRST)} + 1) % {len(LAST)} + 1] AS other,
  {_list(COMPANY)}[o_custkey % {len(COMPANY)} + 1] || ' ' || {_list(SUFFIX)}[(o_custkey // {len(COMPANY)}) % {len(SUFFIX)} + 1] AS company,
  CAST(o_orderkey + 100000 AS VARCHAR) AS number FROM orders),
dated AS (SELECT *, strftime(day, '%B %-d, %Y') AS us, strftime(day, '%B %Y') AS my, strftime(day, '%Y-%m-%d') AS iso FROM named)"""

#: doc_id, kind, start, surface, score, normalized (null: the surface in lower case)
MENTIONS = """
found AS (
  SELECT doc_id, 'PERSON' AS entity_type, CASE WHEN t = 0 THEN length('On ' || us || ', ') ELSE 0 END AS start, person AS surface, CASE WHEN t <= 2 THEN 0.90 WHEN t = 8 THEN 0.92 ELSE 0.93 END AS score, NULL AS norm FROM dated WHERE t IN (0, 1, 2, 5, 6, 8)
  UNION ALL SELECT doc_id, 'PERSON', length(person || ' met with '), other, 0.92, NULL FROM dated WHERE t = 8
  UNION ALL SELECT doc_id, 'PERSON', 0, person || ' was the', 0.93, NULL FROM dated WHERE t = 7
  UNION ALL SELECT doc_id, 'PERSON', 0, person, 0.70, NULL FROM dated WHERE t = 7
  UNION ALL SELECT doc_id, 'PERSON', 0, 'Dr. ' || person, 0.90, NULL FROM dated WHERE t = 12
  UNION ALL SELECT doc_id, 'PERSON', 4, person, 0.70, NULL FROM dated WHERE t = 12
  UNION ALL SELECT doc_id, 'LOCATION', length('Dr. ' || person || ' stayed in '), 'Berlin', 0.72, NULL FROM dated WHERE t = 12
  UNION ALL SELECT doc_id, 'LOCATION', length(person || ' did not approve Invoice #' || number || ' in '), strftime(day, '%B'), 0.72, NULL FROM dated WHERE t = 1
  UNION ALL SELECT doc_id, 'OTHER', length('On ' || us || ', ' || person || ' approved '), 'Contract #' || number, 0.98, 'contract:' || number FROM dated WHERE t = 0
  UNION ALL SELECT doc_id, 'OTHER', length(person || ' did not approve '), 'Invoice #' || number, 0.98, 'invoice:' || number FROM dated WHERE t = 1
  UNION ALL SELECT doc_id, 'OTHER', length(person || ' may approve '), 'Payment #' || number, 0.98, 'payment:' || number FROM dated WHERE t = 2
  UNION ALL SELECT doc_id, 'OTHER', length(company || ' paid '), 'Order #' || number, 0.98, 'order:' || number FROM dated WHERE t = 3
  UNION ALL SELECT doc_id, 'OTHER', length('write to '), 'user' || number || '@example.com', 0.995, 'email:user' || number || '@example.com' FROM dated WHERE t = 13
  UNION ALL SELECT doc_id, 'ORGANIZATION', length('On ' || us || ', ' || person || ' approved Contract #' || number || ' for '), company, 0.91, NULL FROM dated WHERE t = 0
  UNION ALL SELECT doc_id, 'ORGANIZATION', 0, company, 0.91, NULL FROM dated WHERE t = 3
  UNION ALL SELECT doc_id, 'ORGANIZATION', CASE t WHEN 0 THEN length('On ' || us || ', ' || person || ' approved Contract #' || number || ' for ') ELSE length(person) + length(CASE t WHEN 5 THEN ' works for ' WHEN 6 THEN ' did not work for ' ELSE ' was the president of ' END) END, company || '.', 0.78, NULL FROM dated WHERE t IN (0, 5, 6, 7) AND company LIKE '% Inc'
  UNION ALL SELECT doc_id, 'ORGANIZATION', length(person) + length(CASE t WHEN 5 THEN ' works for ' WHEN 6 THEN ' did not work for ' ELSE ' was the president of ' END), company, 0.94, NULL FROM dated WHERE t IN (5, 6, 7)),
mentioned AS (SELECT doc_id, entity_type, CAST(start AS INTEGER) AS start, surface, CAST(score AS DOUBLE) AS score, coalesce(norm, lower(surface)) AS normalized FROM found)"""

DATES = """
told AS (
  SELECT doc_id, CASE t WHEN 0 THEN 3 ELSE length(company || ' paid Order #' || number || ' on ') END AS place, us AS original, iso AS first, iso AS last, 'DAY' AS precision, false AS is_relative, 0.98 AS score FROM dated WHERE t IN (0, 3)
  UNION ALL SELECT doc_id, length(person || ' did not approve Invoice #' || number || ' in '), my, strftime(day, '%Y-%m-01'), strftime(last_day(day), '%Y-%m-%d'), 'MONTH', false, 0.98 FROM dated WHERE t = 1
  UNION ALL SELECT doc_id, length(person || ' may approve Payment #' || number || ' on '), iso, iso, iso, 'DAY', false, 0.98 FROM dated WHERE t = 2
  UNION ALL SELECT doc_id, length('the term ran from '), iso || ' to ' || strftime(day + 30, '%Y-%m-%d'), iso, strftime(day + 30, '%Y-%m-%d'), 'RANGE', false, 0.98 FROM dated WHERE t = 9
  UNION ALL SELECT doc_id, length('the entry of '), iso || ' 09:30', iso || 'T09:30:00', iso || 'T09:30:00', 'INSTANT', false, 0.98 FROM dated WHERE t = 10
  UNION ALL SELECT doc_id, length('the entry of ' || iso || ' 09:30 was kept for '), strftime(day, '%Y'), strftime(day, '%Y-01-01'), strftime(day, '%Y-12-31'), 'YEAR', false, 0.92 FROM dated WHERE t = 10
  UNION ALL SELECT doc_id, length('the filing happened '), 'yesterday', strftime(day - 1, '%Y-%m-%d'), strftime(day - 1, '%Y-%m-%d'), 'DAY', true, 0.98 FROM dated WHERE t = 11
  UNION ALL SELECT doc_id, length('the filing happened yesterday and '), 'two weeks ago', strftime(day - 14, '%Y-%m-%d'), strftime(day - 14, '%Y-%m-%d'), 'DAY', true, 0.98 FROM dated WHERE t = 11
  UNION ALL SELECT doc_id, length('write to user' || number || '@example.com '), 'today', iso, iso, 'DAY', true, 0.98 FROM dated WHERE t = 13)"""

CLAIMS = """
claimed AS (
  SELECT doc_id, t, 'EVENT' AS kind, 'APPROVED' AS predicate, CASE t WHEN 1 THEN 'NEGATED' ELSE 'AFFIRMED' END AS polarity, CASE t WHEN 2 THEN 'POSSIBLE' ELSE 'ASSERTED' END AS modality, 0.92 AS score, 1 AS n_dates,
    'actor=' || person || CASE t WHEN 0 THEN '|object=Contract #' || number || '|object=' || company || '|description=Contract #' || number || ' for ' || company
      WHEN 1 THEN '|object=Invoice #' || number || '|object=' || strftime(day, '%B') || '|description=Invoice #' || number || ' in ' || my
      ELSE '|object=Payment #' || number || '|description=Payment #' || number || ' on ' || iso END AS parties FROM dated WHERE t <= 2
  UNION ALL SELECT doc_id, t, 'EVENT', 'PAID', 'AFFIRMED', 'ASSERTED', 0.92, 1, 'actor=' || company || '|object=Order #' || number || '|description=Order #' || number || ' on ' || us FROM dated WHERE t = 3
  UNION ALL SELECT doc_id, t, 'RELATIONSHIP', 'WORKS_FOR', CASE t WHEN 6 THEN 'NEGATED' ELSE 'AFFIRMED' END, 'ASSERTED', 0.94, 0, 'source=' || person || '|target=' || company FROM dated WHERE t IN (5, 6)
  UNION ALL SELECT doc_id, t, 'RELATIONSHIP', 'OFFICER_OF', 'AFFIRMED', 'ASSERTED', 0.94, 0, 'source=' || person || ' was the|target=' || company FROM dated WHERE t = 7
  UNION ALL SELECT doc_id, t, 'EVENT', 'MET', 'AFFIRMED', 'ASSERTED', 0.94, 0, 'participant=' || person || '|participant=' || other FROM dated WHERE t = 8)"""

#: Accepted mentions by what they mean: an organisation by its name without suffix, others by their normalised form.
ENTITIES = """
meant AS (SELECT *, CASE WHEN entity_type = 'ORGANIZATION' THEN split_part(normalized, ' ', 1) ELSE normalized END AS key FROM mentioned WHERE score >= 0.90),
entity AS (SELECT entity_type AS type, key, arg_min(surface, (-len(string_split(surface, ' ')), -length(surface), lower(surface), surface)) AS canonical_name,
  array_to_string(list_sort(list_distinct(list(surface))), '|') AS aliases, count(*) AS n_mentions, round(CAST(sum(CAST(score AS DECIMAL(20, 6))) AS DOUBLE) / count(*), 6) AS score FROM meant GROUP BY entity_type, key)"""

EVENTS = """
happened AS (
  SELECT doc_id, 'DECISION' AS type, 'Approved: Contract #' || number || ' for ' || company AS title, 3 AS n_participants, iso AS first_day FROM dated WHERE t = 0
  UNION ALL SELECT doc_id, 'TRANSACTION', 'Paid: Order #' || number || ' on ' || us, 2, iso FROM dated WHERE t = 3
  UNION ALL SELECT doc_id, 'MEETING', 'Met', 2, NULL FROM dated WHERE t = 8)"""

EDGES = """
worked AS (SELECT CASE t WHEN 7 THEN person || ' was the' ELSE person END AS source, split_part(lower(company), ' ', 1) AS key, CASE t WHEN 7 THEN 'OFFICER_OF' ELSE 'WORKS_FOR' END AS type, count(*) FILTER (t <> 6) AS n_supporting, count(*) FILTER (t = 6) AS n_opposing FROM dated WHERE t IN (5, 6, 7) GROUP BY ALL),
edge AS (SELECT source, canonical_name AS target, worked.type, n_supporting, n_opposing, 0.94 AS score FROM worked JOIN entity ON entity.type = 'ORGANIZATION' AND entity.key = worked.key WHERE n_supporting > 0),
takes AS (
  SELECT person AS source, title AS target FROM dated JOIN happened USING (doc_id) WHERE t IN (0, 8)
  UNION ALL SELECT other, title FROM dated JOIN happened USING (doc_id) WHERE t = 8
  UNION ALL SELECT 'Contract #' || number, title FROM dated JOIN happened USING (doc_id) WHERE t = 0
  UNION ALL SELECT 'Order #' || number, title FROM dated JOIN happened USING (doc_id) WHERE t = 3
  UNION ALL SELECT e.canonical_name, title FROM dated JOIN happened USING (doc_id) JOIN entity e ON e.type = 'ORGANIZATION' AND e.key = split_part(lower(company), ' ', 1) WHERE t IN (0, 3))"""


def _with(*parts: str) -> str:
    return "WITH " + ",".join((NAMED, *parts))


_KEY = "lpad(CAST({0} AS VARCHAR), 8, '0')"
_REVIEW = f"""
o AS (SELECT o_orderkey, 'claim_' || {_KEY.format("o_orderkey")} AS claim, 'event_' || {_KEY.format("o_orderkey")} AS event, 'entity_' || {_KEY.format("o_custkey")} AS entity FROM orders),
people AS (SELECT 'entity_' || {_KEY.format("c_custkey")} AS id, c_name FROM customer)"""
_PLACES = f"""
node AS (SELECT 'r:' || {_KEY.format("r_regionkey")} AS id, r_name AS name FROM region UNION ALL SELECT 'n:' || {_KEY.format("n_nationkey")}, n_name FROM nation UNION ALL SELECT 's:' || {_KEY.format("s_suppkey")}, s_name FROM supplier),
link AS (SELECT 'n:' || {_KEY.format("n_nationkey")} AS source_id, 'r:' || {_KEY.format("n_regionkey")} AS target_id, 'PART_OF' AS type FROM nation UNION ALL SELECT 's:' || {_KEY.format("s_suppkey")}, 'n:' || {_KEY.format("s_nationkey")}, 'LOCATED_IN' FROM supplier)"""
_FILES = "files AS (SELECT 'docs/' || lpad(CAST(doc_id AS VARCHAR), 12, '0') || '.txt' AS path, octet_length(encode(coalesce(text, ''))) AS size, coalesce(text, '') AS body FROM documents)"
_ADDRESS = "([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,63})"

ORACLES: dict[str, str] = {
    "byte_dedup": f"WITH {_FILES} SELECT sha256(body) AS content_sha256, count(*) AS n_sources, min(path) AS path, 'text' AS loader FROM files GROUP BY 1",
    "source_budget": f"WITH {_FILES}, sums AS (SELECT path, size, sum(size) OVER (ORDER BY lower(path), path ROWS UNBOUNDED PRECEDING) AS total FROM files) SELECT path, CAST(size AS BIGINT) AS size, CASE WHEN total > 1000000 THEN 'over_bytes' WHEN size > 20000 THEN 'too_large' ELSE 'kept' END AS status FROM sums",
    "sentences": """
WITH d AS (SELECT doc_id, length(text) - length(regexp_replace(text, '^\\s+', '')) AS lead, regexp_replace(regexp_replace(text, '^\\s+', ''), '\\s+$', '') AS body FROM documents),
e AS (SELECT doc_id, lead + length(regexp_extract(body, '^[.!?]+')) AS lead, regexp_extract_all(body, '[^.!?]+[.!?]*') AS hits FROM d),
f AS (SELECT doc_id, lead, unnest(hits) AS hit, unnest(generate_series(1, len(hits))) AS i FROM e),
g AS (SELECT doc_id, i, hit, lead + sum(length(hit)) OVER (PARTITION BY doc_id ORDER BY i) - length(hit) + length(hit) - length(regexp_replace(hit, '^\\s+', '')) AS start, regexp_replace(regexp_replace(hit, '^\\s+', ''), '\\s+$', '') AS text FROM f)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS sentence, CAST(start AS INTEGER) AS start, CAST(start + length(text) AS INTEGER) AS stop, text FROM g WHERE text <> ''""",
    "paragraphs": """
WITH d AS (SELECT doc_id, string_split_regex(regexp_replace(text, '([^\\n]*\\n[^\\n]*\\n[^\\n]*)\\n', '\\1' || chr(10) || chr(10), 'g'), '\\n[ \\t]*\\n') AS parts FROM documents),
e AS (SELECT doc_id, unnest(parts) AS part, unnest(generate_series(1, len(parts))) AS i FROM d),
f AS (SELECT doc_id, i, regexp_replace(regexp_replace(part, '^\\s+', ''), '\\s+$', '') AS text FROM e)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS paragraph, sha256(text) AS sha256, CAST(length(text) AS INTEGER) AS n_chars FROM f WHERE text <> ''""",
    "newline_normalize": "SELECT doc_id, sha256(coalesce(text, '')) AS sha256, CAST(length(coalesce(text, '')) - length(replace(coalesce(text, ''), chr(10), '')) AS INTEGER) AS moved, CAST(2 * length(coalesce(text, '')) - length(replace(coalesce(text, ''), chr(10), '')) AS INTEGER) AS raw_length FROM documents",
    "sanitized_documents": "SELECT doc_id, sha256(coalesce(text, '')) AS content_sha256, 0 AS n_raw, 0 AS n_normalized, 0 AS n_segments FROM documents",
    "email_mentions": f"""
WITH d AS (SELECT doc_id, regexp_extract_all(text, '{_ADDRESS}', 1) AS hits, string_split_regex(text, '{_ADDRESS}') AS gaps FROM documents WHERE contains(text, '@')),
e AS (SELECT doc_id, hits, gaps, unnest(generate_series(1, len(hits))) AS i FROM d)
SELECT doc_id, CAST(list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS start, hits[i] AS surface, 'email:' || lower(hits[i]) AS normalized
FROM e WHERE NOT regexp_matches(gaps[i + 1], '^[\\w.-]') AND NOT regexp_matches(gaps[i], '[\\w.+-]$')""",
    "corpus_mentions": _with(MENTIONS) + " SELECT doc_id, entity_type, start, surface, score, normalized FROM mentioned",
    "temporals": _with(DATES) + " SELECT doc_id, CAST(place AS INTEGER) AS \"at\", original, first, last, precision, is_relative, true AS resolved, CAST(score AS DOUBLE) AS score FROM told",
    "claims": _with(CLAIMS) + " SELECT doc_id, kind, predicate, polarity, modality, CAST(score AS DOUBLE) AS score, n_dates, parties FROM claimed",
    "claims_summary": _with(CLAIMS) + " SELECT kind, predicate, polarity, modality, count(*) AS n FROM claimed GROUP BY ALL",
    "claims_email": f"""
WITH {NAMED}, mail AS (SELECT doc_id, iso, 'u' || lower(replace(person, ' ', '.')) || number || '@left.example' AS a, 'u' || lower(replace(other, ' ', '.')) || number || '@right.example' AS b FROM dated)
SELECT doc_id, 'SENT' AS predicate, 'RELATIONSHIP' AS kind, a AS first, b AS second, iso AS day FROM mail
UNION ALL SELECT doc_id, 'RECEIVED', 'RELATIONSHIP', b, a, iso FROM mail UNION ALL SELECT doc_id, 'EMAIL_SENT', 'EVENT', a, b, iso FROM mail""",
    "evidence_roundtrip": f"WITH {NAMED}, n AS (SELECT doc_id, [5, 5, 4, 4, 0, 3, 3, 4, 3, 1, 2, 2, 3, 2][t + 1] + CASE WHEN t IN (0, 5, 6, 7) AND company LIKE '% Inc' THEN 1 ELSE 0 END AS n_spans FROM dated) SELECT doc_id, CAST(n_spans AS BIGINT) AS n_spans, CAST(0 AS BIGINT) AS n_wrong FROM n WHERE n_spans > 0",
    "triage_bands": _with(MENTIONS) + " SELECT CASE WHEN score >= 0.90 THEN 'accepted' WHEN score >= 0.60 THEN 'mention_candidate' ELSE 'mention_candidate_deferred' END AS kind, count(*) AS n FROM mentioned GROUP BY 1",
    "blocking_pairs": f"""
WITH {NAMED}, n AS (SELECT DISTINCT 'PERSON' AS kind, person AS text FROM named UNION SELECT 'PERSON', other FROM named UNION SELECT 'ORGANIZATION', company FROM named),
k AS (SELECT kind, text, kind || ':' || text AS id, CASE kind WHEN 'PERSON' THEN split_part(lower(text), ' ', 2) ELSE split_part(lower(text), ' ', 1) END AS block FROM n)
SELECT l.id AS left_id, r.id AS right_id, CASE WHEN l.kind = 'ORGANIZATION' THEN 0.99 END AS exact_score FROM k l JOIN k r ON l.kind = r.kind AND l.block = r.block AND l.id < r.id""",
    "entities": _with(MENTIONS, ENTITIES) + " SELECT type, canonical_name, aliases, n_mentions, score FROM entity",
    "events": _with(EVENTS) + " SELECT type, title, n_participants, first_day, count(*) AS n FROM happened GROUP BY ALL",
    "relationships": _with(MENTIONS, ENTITIES, EVENTS, EDGES) + " SELECT source, target, type, n_supporting, n_opposing, CAST(score AS DOUBLE) AS score FROM edge",
    "participated_in": _with(MENTIONS, ENTITIES, EVENTS, EDGES) + " SELECT source, target, count(*) AS n FROM takes GROUP BY ALL",
    "timeline": _with(EVENTS) + " SELECT title, type, first_day || '-00' AS lower, first_day || '-23' AS upper FROM happened WHERE first_day IS NOT NULL ORDER BY lower, upper, title",
    "event_stream_timeline": """
WITH e AS (SELECT event_id, event_type, ts, CASE event_id % 3 WHEN 0 THEN strftime(ts, '%Y-%m-%d') WHEN 1 THEN strftime(ts, '%Y-%m') ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') END AS start FROM events),
p AS (SELECT *, date_part('year', ts) || ':' || date_part('month', ts) || ':' AS ym, date_part('day', ts) AS d, date_part('hour', ts) || ':' || date_part('minute', ts) || ':' || CAST(floor(date_part('second', ts)) AS INTEGER) || ':' || (date_part('microsecond', ts) % 1000000) AS clock FROM e)
SELECT event_id, event_type, start, ym || CASE event_id % 3 WHEN 0 THEN d || ':0:0:0:0' WHEN 1 THEN '1:0:0:0:0' ELSE d || ':' || clock END AS lower, ym || CASE event_id % 3 WHEN 0 THEN d || ':23:59:59:999999' WHEN 1 THEN '31:23:59:59:999999' ELSE d || ':' || clock END AS upper FROM p""",
    "evidence_lookup": f"""
WITH {NAMED} SELECT doc_id, person || ' approved Contract #' || number || ' for ' || company AS quote, CAST(length('On ' || us || ', ') AS INTEGER) AS raw_start, 0 AS paragraph FROM dated WHERE t = 0
UNION ALL SELECT doc_id, company || ' paid Order #' || number || ' on ' || us, 0, 0 FROM dated WHERE t = 3 UNION ALL SELECT doc_id, person || ' met with ' || other, 0, 0 FROM dated WHERE t = 8""",
    "event_sources": _with(EVENTS) + " SELECT title, 'order-' || CAST(doc_id AS VARCHAR) || '.txt' AS filenames FROM happened",
    "case_summary": _with(MENTIONS, CLAIMS, ENTITIES, EVENTS, EDGES) + """
 SELECT 'documents' AS collection, count(*) AS n FROM named UNION ALL SELECT 'mentions', count(*) FROM mentioned UNION ALL SELECT 'claims', count(*) FROM claimed UNION ALL SELECT 'entities', count(*) FROM entity
UNION ALL SELECT 'events', count(*) FROM happened UNION ALL SELECT 'relationships', (SELECT count(*) FROM edge) + (SELECT count(*) FROM takes)""",
    "integrity_violations": "SELECT 'orders: unknown customer' AS rule, CAST(o_orderkey AS VARCHAR) AS record, CAST(o_custkey AS VARCHAR) AS detail FROM orders WHERE o_custkey IS NOT NULL AND o_custkey NOT IN (SELECT c_custkey FROM customer)",
    "graph_nodes": f"WITH {_PLACES} SELECT id, name FROM node",
    "graph_neighbors": f"WITH {_PLACES}, here AS (SELECT id FROM node WHERE name = 'NATION_3'), near AS (SELECT target_id AS id FROM link WHERE source_id IN (SELECT id FROM here) UNION SELECT source_id FROM link WHERE target_id IN (SELECT id FROM here)) SELECT id, name FROM near JOIN node USING (id)",
    "graph_relationships": f"WITH {_PLACES}, here AS (SELECT id FROM node WHERE name = 'NATION_3') SELECT source_id, target_id, type FROM link WHERE source_id IN (SELECT id FROM here) OR target_id IN (SELECT id FROM here)",
    "graph_paths": f"""
WITH RECURSIVE {_PLACES}, way AS (SELECT source_id AS a, target_id AS b FROM link UNION ALL SELECT target_id, source_id FROM link),
walk AS (SELECT 's:00000000' AS id, ['s:00000000'] AS path UNION ALL SELECT b, list_append(path, b) FROM walk JOIN way ON id = a WHERE NOT list_contains(path, b)),
ranked AS (SELECT id, path, row_number() OVER (PARTITION BY id ORDER BY len(path), path) AS rn FROM walk) SELECT id, array_to_string(path, '>') AS path FROM ranked WHERE rn = 1""",
    "review_pending": f"WITH {_REVIEW}, items AS (SELECT 'review_' || claim AS id FROM o WHERE o_orderkey % 2 = 1) SELECT id, 'claim_candidate' AS kind FROM items WHERE id NOT IN (SELECT id FROM items ORDER BY id LIMIT 2)",
    "review_accept": f"WITH {_REVIEW} SELECT claim AS id, o_orderkey % 2 = 0 OR claim = (SELECT min(claim) FROM o WHERE o_orderkey % 2 = 1) AS accepted FROM o",
    "review_merge": f"""
WITH {_REVIEW}, m AS (SELECT CASE WHEN id IN ('entity_00000001', 'entity_00000002', 'entity_00000003') THEN 'merged' ELSE id END AS id, c_name FROM people),
n AS (SELECT CASE WHEN entity IN ('entity_00000001', 'entity_00000002', 'entity_00000003') THEN 'merged' ELSE entity END AS id, count(*) AS n_edges FROM o GROUP BY 1),
w AS (SELECT id, min(c_name) AS canonical_name, list_sort(list(c_name)) AS names FROM m GROUP BY id)
SELECT id, canonical_name, CASE WHEN id = 'merged' THEN array_to_string(names[2:], '|') ELSE canonical_name END AS aliases, CAST(len(names) AS INTEGER) AS n_mentions, coalesce(n_edges, 0) AS n_edges FROM w LEFT JOIN n USING (id)""",
    "review_group": f"""
WITH {_REVIEW}, r AS (SELECT *, row_number() OVER (ORDER BY event) AS rn FROM o)
SELECT event AS id, 'Order ' || CAST(o_orderkey AS VARCHAR) AS title, 1 AS n_claims, 1 AS n_people, true AS provisional FROM r WHERE rn > 2
UNION ALL SELECT 'grouped', array_to_string(list_sort(list('Order ' || CAST(o_orderkey AS VARCHAR))), ' / '), CAST(count(*) AS INTEGER), CAST(count(DISTINCT entity) AS INTEGER), false FROM r WHERE rn <= 2""",
    "review_rename": f"WITH {_REVIEW} SELECT id, CASE WHEN id = 'entity_00000005' THEN 'Fifth Customer' ELSE c_name END AS canonical_name, c_name AS aliases FROM people",
}
