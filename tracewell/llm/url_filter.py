"""URL filters: rules, and link-graph propagation where no rule speaks.  DataFrame functions only.

A rule is a host and a path prefix; it fits the host and its subdomains, and the longest fitting rule decides (of equally
long ones the one with the longer host, then a block).  A page that no rule fits is judged by its host: trust starts at
hosts in proportion to the share of their pages that rules allow and flows along links (personalised PageRank); distrust
starts in proportion to the share that rules block and flows against links, to whom links to such hosts.  A host is blocked
if its distrust is above its trust and at least ``THRESHOLD`` of what full blocking gives without any link.

Edges are counted links between different hosts.  All values are whole numbers (shares of ``UNIT``, divisions rounded down),
so results don't depend on the order of sums.  Rounds go on until nothing changes, and each is checkpointed.  Values never fall and are
bounded, so they settle; that they haven't after ``LIMIT`` rounds is an error.  Only who gives ``rounds`` gets the values after so many:
``ROUNDS`` is what the SQL unrolls, which is the whole result on graphs that settle by then.

A null URL, or one without ``://``, has an empty host and path; no rule with a host fits it and it is allowed.  Null html has no links.
Rows may repeat, other columns are never read (so their names can't clash), pages are read whole however long, and an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm.runtime import cut

UNIT, FOLLOW, ROUNDS, THRESHOLD = 10**9, 85, 8, 50
LIMIT = 2000
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: More rules than this are joined instead of written into the plan.
INLINE = 200
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = "(?s)^.*?://([^/?#]*)([^?#]*)"
_LINK = r"""(?i)href\s*+=\s*+["']?(?:https?:)?//([^/?#"'\s>]++)"""


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def _split(rule: str) -> tuple[str, str]:
    host, slash, path = rule.partition("/")
    return host, slash + path


def _ranked(rules) -> list[tuple[str, str]]:
    return sorted(set(rules), key=lambda r: (-len(r[1]), -len(_split(r[1])[0]), r[0] != "block", r[1]))


def with_rules(pages: DataFrame, rules=RULES) -> DataFrame:
    """Adds ``rule`` and ``ruled`` (its verdict) to rows with ``host`` and ``path``."""
    ranked = _ranked(rules)
    if len(ranked) <= INLINE:
        rule = verdict = F.lit(None).cast("string")
        for action, text in reversed(ranked):
            host, start = _split(text)
            fits = ((F.col("host") == host) | F.endswith(F.col("host"), F.lit("." + host))) & F.startswith(F.col("path"), F.lit(start))
            rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(action)).otherwise(verdict)
        return pages.withColumns({"rule": rule, "ruled": verdict})
    table = pages.sparkSession.createDataFrame([(i, *_split(text), text, action) for i, (action, text) in enumerate(ranked)], "rank int, rule_host string, rule_path string, rule string, ruled string")
    return join_rules(pages, table)


def join_rules(pages: DataFrame, table: DataFrame) -> DataFrame:
    """The same by joins, for any number of rules (``rank, rule_host, rule_path, rule, ruled``).

    Distinct hosts and paths are matched by the host's suffixes, so a hot host is matched once for each of its paths.
    """
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    places = pages.select("host", "path").distinct()
    fitting = places.select("host", "path", F.explode(suffixes).alias("rule_host")).join(table, "rule_host").where(F.startswith("path", "rule_path"))
    best = fitting.groupBy("host", "path").agg(F.min_by(F.struct("rule", "ruled"), "rank").alias("r")).select("host", "path", "r.rule", "r.ruled")
    return pages.join(best, ["host", "path"], "left")


def host_edges(pages: DataFrame, html: str = "html") -> DataFrame:
    """``src, dst, w``: how often pages of a host link to another.  ``pages``: host and html."""
    links = pages.where("host <> ''").select(F.col("host").alias("src"), F.explode(F.regexp_extract_all(F.col(html), F.lit(_LINK), F.lit(1))).alias("link"))
    return links.select("src", F.translate("link", _UPPER, _LOWER).alias("dst")).where("src <> dst").groupBy("src", "dst").agg(F.count("*").alias("w"))


def propagate(edges: DataFrame, seeds: DataFrame, rounds: int | None = None, follow: int = FOLLOW) -> DataFrame:
    """``host, trust, distrust``, settled or after ``rounds``.  ``seeds``: host, trust0, distrust0."""
    edges = cut(edges)
    out = edges.groupBy("src").agg(F.sum("w").alias("total"))
    into = edges.groupBy("dst").agg(F.sum("w").alias("total"))
    forth = edges.join(out, "src").select(F.col("src").alias("a"), F.col("dst").alias("b"), "w", "total", F.lit(True).alias("forth"))
    back = edges.join(into, "dst").select(F.col("dst").alias("a"), F.col("src").alias("b"), "w", "total", F.lit(False).alias("forth"))
    flows = cut(forth.unionByName(back))
    hosts = seeds.select("host").union(flows.select("b")).distinct()
    seeds = cut(hosts.join(seeds, "host", "left").select("host", F.coalesce("trust0", F.lit(0)).cast("decimal(38,0)").alias("trust0"), F.coalesce("distrust0", F.lit(0)).cast("decimal(38,0)").alias("distrust0")))
    rest = 100 - follow
    state = seeds.select("host", "trust0", "distrust0", F.expr(f"trust0 * {rest} div 100").alias("trust"), F.expr(f"distrust0 * {rest} div 100").alias("distrust"))
    mark = None
    for _ in range(LIMIT if rounds is None else rounds):
        sent = state.select("host", "trust", "distrust").join(flows, F.col("host") == F.col("a")).select(F.col("b").alias("host"), F.expr("cast(if(forth, trust, 0) as decimal(38,0)) * cast(w as decimal(20,0)) div cast(total as decimal(20,0))").alias("t"), F.expr("cast(if(forth, 0, distrust) as decimal(38,0)) * cast(w as decimal(20,0)) div cast(total as decimal(20,0))").alias("d"))
        got = sent.groupBy("host").agg(F.sum("t").alias("t"), F.sum("d").alias("d"))
        state = cut(seeds.join(got, "host", "left").select("host", "trust0", "distrust0", F.expr(f"(trust0 * {rest} + coalesce(t, 0) * {follow}) div 100").alias("trust"), F.expr(f"(distrust0 * {rest} + coalesce(d, 0) * {follow}) div 100").alias("distrust")))
        before, mark = mark, tuple(state.agg(F.sum("trust"), F.sum("distrust"), F.sum(F.xxhash64("host", "trust", "distrust").cast("decimal(38,0)"))).first())
        if mark == before:
            break
    else:
        if rounds is None:
            raise RuntimeError(f"trust and distrust haven't settled after {LIMIT} rounds")
    return state.select("host", "trust", "distrust")


def judge(pages: DataFrame, rules=RULES, key: str = "page_id", url: str = "url", html: str = "html", rounds: int | None = ROUNDS, threshold: int = THRESHOLD) -> DataFrame:
    """``key, host, path, rule, verdict`` of every row, with its host's ``trust`` and ``distrust``; settled if ``rounds`` is None."""
    named = pages.select(F.col(key), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    ruled = with_rules(named, rules)
    counts = ruled.where("host <> ''").groupBy("host").agg(F.count("*").alias("n"), F.count_if(F.col("ruled") == "allow").alias("na"), F.count_if(F.col("ruled") == "block").alias("nb"))
    seeds = counts.select("host", F.expr(f"na * {UNIT} div n").alias("trust0"), F.expr(f"nb * {UNIT} div n").alias("distrust0"))
    scores = propagate(host_edges(pages.select(host_of(F.col(url)).alias("host"), F.col(html).alias("html")), "html"), seeds, rounds)
    least = UNIT * (100 - FOLLOW) // 100 * threshold // 100
    blocked = (F.col("distrust") > F.col("trust")) & (F.col("distrust") >= least)
    verdict = F.coalesce("ruled", F.when(blocked, "block").otherwise("allow"))
    return ruled.join(scores, "host", "left").select(F.col(key), "host", "path", "rule", verdict.alias("verdict"), "trust", "distrust")


def oracle(rules=RULES, rounds: int = ROUNDS, threshold: int = THRESHOLD) -> str:
    """The same in DuckDB's SQL."""
    cases = []
    for action, text in _ranked(rules):
        host, start = _split(text)
        cases.append((f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{start}')", text, action))
    pick = lambda i: "CASE " + " ".join(f"WHEN {c[0]} THEN '{c[i]}'" for c in cases) + " END"
    rest = 100 - FOLLOW
    steps = "".join(
        f"""
, m{i} AS (SELECT b AS host, sum(CAST(CASE WHEN forth THEN trust ELSE 0 END AS HUGEINT) * w // total) AS t, sum(CAST(CASE WHEN forth THEN 0 ELSE distrust END AS HUGEINT) * w // total) AS d FROM s{i - 1} JOIN flows ON host = a GROUP BY b)
, s{i} AS (SELECT seeds.host, trust0, distrust0, CAST((trust0 * {rest} + coalesce(t, 0) * {FOLLOW}) // 100 AS HUGEINT) AS trust, CAST((distrust0 * {rest} + coalesce(d, 0) * {FOLLOW}) // 100 AS HUGEINT) AS distrust FROM seeds LEFT JOIN m{i} USING (host))"""
        for i in range(1, rounds + 1)
    )
    least = UNIT * rest // 100 * threshold // 100
    return f"""
WITH named AS (SELECT page_id, html, translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 1, 's'), ''), '{_UPPER}', '{_LOWER}') AS host, coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 2, 's'), '') AS path FROM pages)
, ruled AS (SELECT page_id, host, path, {pick(1)} AS rule, {pick(2)} AS ruled FROM named)
, links AS (SELECT host AS src, translate(unnest(regexp_extract_all(html, '(?i)href\\s*=\\s*["'']?(?:https?:)?//([^/?#"''\\s>]+)', 1)), '{_UPPER}', '{_LOWER}') AS dst FROM named WHERE host <> '')
, edges AS (SELECT src, dst, count(*) AS w FROM links WHERE src <> dst GROUP BY ALL)
, flows AS (SELECT src AS a, dst AS b, w, sum(w) OVER (PARTITION BY src) AS total, true AS forth FROM edges UNION ALL SELECT dst, src, w, sum(w) OVER (PARTITION BY dst), false FROM edges)
, counts AS (SELECT host, count(*) AS n, count(*) FILTER (ruled = 'allow') AS na, count(*) FILTER (ruled = 'block') AS nb FROM ruled WHERE host <> '' GROUP BY host)
, seeds AS (SELECT host, coalesce(na * {UNIT} // n, 0) AS trust0, coalesce(nb * {UNIT} // n, 0) AS distrust0 FROM (SELECT host FROM counts UNION SELECT b FROM flows) LEFT JOIN counts USING (host))
, s0 AS (SELECT host, trust0, distrust0, CAST(trust0 * {rest} // 100 AS HUGEINT) AS trust, CAST(distrust0 * {rest} // 100 AS HUGEINT) AS distrust FROM seeds){steps}
SELECT page_id, r.host, path, rule, coalesce(ruled, CASE WHEN distrust > trust AND distrust >= {least} THEN 'block' ELSE 'allow' END) AS verdict, CAST(trust AS BIGINT) AS trust, CAST(distrust AS BIGINT) AS distrust
FROM ruled r LEFT JOIN s{rounds} s ON r.host = s.host"""
