"""Operator 8, URL filters by rules and link-graph propagation [native: DataFrame and SQL functions only].

A url's host and path are compared with the rules; the longest that fits decides. Hosts of the other
pages are judged by propagation over host edges (links of pages to other hosts, counted by pair of
hosts before anything else is done): trust starts from pages that rules allow and flows along links
(personalised PageRank), distrust starts from pages that rules block and flows against them. Both are
kept in pages: y = seed + DAMPING * (share of y over edges), the unnormalised form. Hosts that are linked to but
have no pages here are seeded by the rules' verdicts on the different urls that link to them. A host is
blocked if its distrust less its trust is above THRESHOLD times its pages; without evidence it is allowed.

Each round joins the edges with one row per host and sums by host, and is written; a host's row is repeated over
SALTS, so that the edges of a hub are dealt over as many tasks. Rounds end when no host's values change by more
than TOLERANCE, after ROUNDS at the latest: by then what is missing is below DAMPING**ROUNDS / (1 - DAMPING), 0.0004 of all seeds.

Defined results: a null url or one without :// has empty host and path, fits no rule and is allowed; a
null html has no links; repeated rows count each time; an empty table gives no rows; other columns
are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import cut, read, written

#: (verdict, host, path)
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
DAMPING = 0.85
ROUNDS = 60
TOLERANCE = 0.01
SALTS = 8
THRESHOLD = 0.5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HREF = "[hH][rR][eE][fF][ \\t\\n\\r]*=[ \\t\\n\\r]*[\"']?([^\"' \\t\\n\\r>]+)"


def host_of(after: Column) -> Column:
    """Host of what follows ://, A-Z lower-cased."""
    return F.translate(F.regexp_extract(after, "^[^/?#]*", 0), _UPPER, _LOWER)


def split_url(url: Column) -> dict[str, Column]:
    """host and path of a url; both empty for null or without ://."""
    at = F.instr(url, "://")
    after = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    after = F.coalesce(after, F.lit(""))
    return {"host": host_of(after), "path": F.regexp_extract(after, "^[^/?#]*([^?#]*)", 1)}


def fits(rule_host: str, rule_path: str) -> Column:
    host, path = F.col("host"), F.col("path")
    return ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)


def apply_rules(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    """pages (with host and path) with rule and rule_verdict of the longest rule that fits; null where none does."""
    longest = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in reversed(longest):
        rule, verdict = F.when(fits(h, p), F.lit(h + p)).otherwise(rule), F.when(fits(h, p), F.lit(v)).otherwise(verdict)
    return pages.withColumns({"rule": rule, "rule_verdict": verdict})


def links(pages: DataFrame) -> DataFrame:
    """pages (host, html) to src, host, path, links: links from pages of one host to urls of other hosts, counted by url."""
    found = pages.where("host <> ''").select(F.col("host").alias("src"), F.explode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(HREF), 1)).alias("link"))
    after = F.when(F.col("link").startswith("//"), F.expr("substring(link, 3)")).when(F.col("link").rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), F.expr("substring(link, instr(link, '://') + 3)"))
    out = found.select("src", after.alias("after")).where("after is not null").select("src", host_of(F.col("after")).alias("host"), F.regexp_extract("after", "^[^/?#]*([^?#]*)", 1).alias("path"))
    return out.where("host <> '' and host <> src").groupBy("src", "host", "path").agg(F.count(F.lit(1)).alias("links"))


def propagate(edges: DataFrame, seeds: DataFrame, rounds: int = ROUNDS, damping: float = DAMPING, tolerance: float = TOLERANCE, salts: int = SALTS) -> DataFrame:
    """edges (src, dst, links) and seeds (host, trusted, blocked; one row per host) to host, trust, distrust."""
    state = seeds.select("host", F.col("trusted").cast("double").alias("trust"), F.col("blocked").cast("double").alias("distrust"))
    out_of = edges.groupBy(F.col("src").alias("host")).agg(F.sum("links").alias("all"))
    into = edges.groupBy(F.col("dst").alias("host")).agg(F.sum("links").alias("all"))
    salted = edges.withColumn("salt", F.pmod(F.xxhash64("src", "dst"), F.lit(salts)).cast("int"))
    edges = _beside(salted.withColumnRenamed("src", "host"), out_of, salts).select(F.col("host").alias("src"), "dst", "links", "salt", (F.col("links") / F.col("all")).alias("forth"))
    edges = written(_beside(edges.withColumnRenamed("dst", "host"), into, salts).select("src", F.col("host").alias("dst"), "salt", "forth", (F.col("links") / F.col("all")).alias("back")))
    if edges.isEmpty():
        return state
    linked = edges.select(F.col("src").alias("host")).union(edges.select(F.col("dst").alias("host"))).distinct()
    start = written(state.join(linked, "host", "full").select("host", F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust")))
    state = start
    for _ in range(rounds):
        forth = _beside(edges.withColumnRenamed("src", "host"), state, salts).select(F.col("dst").alias("host"), (F.col("forth") * F.col("trust")).alias("t"), F.lit(0.0).alias("b"))
        back = _beside(edges.withColumnRenamed("dst", "host"), state, salts).select(F.col("src").alias("host"), F.lit(0.0).alias("t"), (F.col("back") * F.col("distrust")).alias("b"))
        got = forth.union(back).groupBy("host").agg(F.sum("t").alias("t"), F.sum("b").alias("b"))
        new = start.join(got, "host", "left").select("host", *((F.col(x) + damping * F.coalesce(y, F.lit(0.0))).alias(x) for x, y in (("trust", "t"), ("distrust", "b"))))
        old = state.select("host", F.col("trust").alias("old_trust"), F.col("distrust").alias("old_distrust"))
        change = F.max(F.greatest(F.abs(F.col("trust") - F.col("old_trust")), F.abs(F.col("distrust") - F.col("old_distrust"))))
        seen = Observation()
        state = written(new.join(old, "host").observe(seen, change.alias("change")).drop("old_trust", "old_distrust"))
        if (seen.get.get("change") or 0.0) <= tolerance:
            break
    return state


def _beside(edges: DataFrame, hosts: DataFrame, salts: int) -> DataFrame:
    """edges (host, salt) with the row of their host, which is repeated for every salt."""
    return edges.join(hosts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), ["host", "salt"])


def judge_urls(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES, rounds: int = ROUNDS, damping: float = DAMPING, threshold: float = THRESHOLD) -> DataFrame:
    """page_id, host, path, rule, verdict, and the host's trust and distrust, for each row of pages (page_id, url, html)."""
    parsed = pages.select("page_id", "html", *(c.alias(k) for k, c in split_url(F.col("url")).items()))
    judged = cut(apply_rules(parsed.select("page_id", "host", "path"), rules))
    hosts = judged.where("host <> ''").groupBy("host").agg(F.count(F.lit(1)).alias("pages"), F.count_if(F.col("rule_verdict") == "allow").alias("trusted"), F.count_if(F.col("rule_verdict") == "block").alias("blocked"))
    hosts = cut(hosts)
    linked = cut(links(parsed.select("host", "html")))
    targets = apply_rules(linked.select("host", "path").distinct(), rules).join(hosts.select("host"), "host", "left_anti")
    uncrawled = targets.groupBy("host").agg(F.count_if(F.col("rule_verdict") == "allow").alias("trusted"), F.count_if(F.col("rule_verdict") == "block").alias("blocked"))
    edges = linked.groupBy("src", F.col("host").alias("dst")).agg(F.sum("links").alias("links"))
    spread = propagate(edges, hosts.select("host", "trusted", "blocked").unionByName(uncrawled), rounds, damping)
    verdicts = cut(hosts.select("host", "pages").join(spread, "host").select(F.col("host").alias("__host"), "trust", "distrust", (F.col("distrust") - F.col("trust") > threshold * F.col("pages")).alias("__bad")))
    out = judged.join(verdicts, F.col("host") == F.col("__host"), "left")
    verdict = F.coalesce("rule_verdict", F.when(F.col("__bad"), F.lit("block")).otherwise("allow"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))


def op8_link_graph_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(read(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def _oracle() -> str:
    lower = lambda x: f"translate({x}, '{_UPPER}', '{_LOWER}')"
    ordered = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    case = lambda value: "CASE " + " ".join(f"WHEN (host = '{r[1]}' OR ends_with(host, '.{r[1]}')) AND starts_with(path, '{r[2]}') THEN '{value(r)}'" for r in ordered) + " END"
    rounds = ", ".join(
        f"""r{k + 1} AS MATERIALIZED (SELECT s.host, s.trust + {DAMPING} * coalesce(t, 0) AS trust, s.distrust + {DAMPING} * coalesce(b, 0) AS distrust FROM r0 s LEFT JOIN (
          SELECT host, sum(t) AS t, sum(b) AS b FROM (SELECT dst AS host, forth * trust AS t, 0.0 AS b FROM e JOIN r{k} ON src = host UNION ALL SELECT src, 0.0, back * distrust FROM e JOIN r{k} ON dst = host) GROUP BY host) g USING (host))"""
        for k in range(ROUNDS)
    )
    href = HREF.replace("'", "''")
    return f"""
WITH a AS (SELECT page_id, coalesce(html, '') AS html, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS after FROM pages),
p AS (SELECT page_id, html, {lower("regexp_extract(after, '^[^/?#]*')")} AS host, regexp_extract(after, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
j AS (SELECT *, {case(lambda r: r[1] + r[2])} AS rule, {case(lambda r: r[0])} AS v FROM p),
l AS (SELECT host AS src, unnest(regexp_extract_all(html, '{href}', 1)) AS link FROM p WHERE host <> ''),
d AS (SELECT src, CASE WHEN starts_with(link, '//') THEN substr(link, 3) WHEN regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN substr(link, instr(link, '://') + 3) END AS after FROM l),
u AS (SELECT src, {lower("regexp_extract(after, '^[^/?#]*')")} AS host, regexp_extract(after, '^[^/?#]*([^?#]*)', 1) AS path FROM d WHERE after IS NOT NULL),
c AS (SELECT src, host AS dst, count(*) AS n FROM u WHERE host <> '' AND host <> src GROUP BY ALL),
e AS (SELECT src, dst, n / sum(n) OVER (PARTITION BY src) AS forth, n / sum(n) OVER (PARTITION BY dst) AS back FROM c),
h AS (SELECT host, count(*) AS pages, count(*) FILTER (v = 'allow') AS t, count(*) FILTER (v = 'block') AS b FROM j WHERE host <> '' GROUP BY host),
o AS (SELECT host, {case(lambda r: r[0])} AS v FROM (SELECT DISTINCT host, path FROM u WHERE host <> '' AND host <> src) WHERE host NOT IN (SELECT host FROM h)),
s AS (SELECT host, t, b FROM h UNION ALL SELECT host, count(*) FILTER (v = 'allow'), count(*) FILTER (v = 'block') FROM o GROUP BY host),
r0 AS (SELECT host, coalesce(t, 0)::DOUBLE AS trust, coalesce(b, 0)::DOUBLE AS distrust FROM s FULL JOIN (SELECT src AS host FROM c UNION SELECT dst FROM c) USING (host)),
{rounds}
SELECT page_id, j.host, path, rule, coalesce(v, CASE WHEN distrust - trust > {THRESHOLD} * pages THEN 'block' ELSE 'allow' END) AS verdict
FROM j LEFT JOIN h USING (host) LEFT JOIN r{ROUNDS} USING (host)
"""


ORACLE_SQL = _oracle()
