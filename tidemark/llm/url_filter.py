"""URL filters: host and path rules, and propagation of trust over links between hosts.

A page that a rule fits gets the verdict of the longest such rule.  For other
pages the host decides.  Hosts with pages allowed by a rule are seeds of trust,
hosts with blocked pages are seeds of distrust, each weighted by its pages.
Trust follows links (personalised PageRank); distrust follows them backwards, from
a host to the hosts that link to it.  Scores are passed on until no further host is
reached and, over ``TOGETHER`` rounds, all scores together change by less than
``TOLERANCE``.  A host is blocked if its share of distrust exceeds ``threshold`` times
its share of trust; a host that neither reaches is allowed.  Shares are of what is left
with hosts, so what dangling hosts lose is returned to the seeds.  Links without a host
lead to the page's own host.

Only DataFrame operations are used.  Links are summed per pair of hosts before
they are joined, so a host with very many pages is a few rows.  A hub, a host with links to
or from more than ``HUB`` others, has its links in several parts, each of which gets the
hub's score.

Defined cases: a null url or one without "://" has empty host and path; null html
has no links; a url without path fits no rule whose path is "/"; a url or html of any
length is read to its end; empty tables give empty results; repeated pages, also under one
page_id, are judged alike; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import LOWER, UPPER, discard, load, written

RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
DAMPING, THRESHOLD = 0.85, 1.0
#: Rounds between two tests of convergence, the change that ends them, and links of one part of a host.
TOGETHER, TOLERANCE, HUB = 4, 1e-6, 100_000
HREF = r"""[hH][rR][eE][fF][ \t]*=[ \t]*["']?"""
ABSOLUTE = HREF + r"""(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#"'\s>]+)"""


def url_host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def matched(host: Column, path: Column, rules, what: int) -> Column:
    """The text (0) or verdict (1) of the longest rule that fits."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r[0])):
        rule_host, slash, rest = rule[0].partition("/")
        fits = ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(slash + rest)
        out = F.when(fits, F.lit(rule[what])).otherwise(out)
    return out


def host_links(pages: DataFrame) -> DataFrame:
    """host, to, n: how often pages of host link to the host ``to``."""
    away = F.regexp_extract_all("html", F.lit(ABSOLUTE), 1)
    counted = pages.select("host", away.alias("away"), F.regexp_count("html", F.lit(HREF)).alias("all"))
    own = counted.select("host", F.col("host").alias("to"), (F.col("all") - F.size("away")).cast("long").alias("n")).where("n > 0")
    out = counted.select("host", F.explode("away").alias("to")).select("host", F.translate("to", UPPER, LOWER).alias("to"), F.lit(1).cast("long").alias("n"))
    return own.unionByName(out).groupBy("host", "to").agg(F.sum("n").alias("n"))


def propagate(seeds: DataFrame, links: DataFrame, damping: float = DAMPING) -> DataFrame:
    """seeds: host, allowed, blocked (pages) -> host, trust, distrust (shares)."""
    steps = links.select(F.lit(True).alias("good"), F.col("host").alias("src"), F.col("to").alias("dst"), "n").unionByName(links.select(F.lit(False).alias("good"), F.col("to").alias("src"), F.col("host").alias("dst"), "n"))
    degree = steps.groupBy("good", "src").agg(F.sum("n").alias("all"), F.ceil(F.count("*") / HUB).alias("parts"))
    part = F.pmod(F.xxhash64("dst"), F.col("parts")).alias("part")
    steps = written(steps.join(degree, ["good", "src"]).select("good", "src", part, "dst", (F.col("n") / F.col("all")).alias("w")), "steps")
    hubs = written(degree.where("parts > 1").select("good", F.col("src").alias("host"), "parts"), "hubs")
    divided = not hubs.isEmpty()
    total = seeds.agg(F.sum("allowed").alias("a"), F.sum("blocked").alias("b")).first()
    start = seeds.select(F.lit(True).alias("good"), "host", (F.col("allowed") / F.lit(float(total["a"] or 1))).alias("seed")).unionByName(seeds.select(F.lit(False).alias("good"), "host", (F.col("blocked") / F.lit(float(total["b"] or 1))).alias("seed"))).where("seed > 0")
    start = written(start, "seeds")

    def passed_on(state: DataFrame) -> DataFrame:
        parts = F.lit(1).cast("long")
        if divided:
            state, parts = state.join(hubs, ["good", "host"], "left"), F.coalesce("parts", F.lit(1).cast("long"))
        each = state.select("good", F.col("host").alias("src"), "score", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part"))
        moved = each.join(steps, ["good", "src", "part"]).select("good", F.col("dst").alias("host"), (F.lit(damping) * F.col("score") * F.col("w")).alias("gets"))
        back = start.select("good", "host", (F.lit(1 - damping) * F.col("seed")).alias("gets"))
        return back.unionByName(moved).groupBy("good", "host").agg(F.sum("gets").alias("score"))

    state = written(start.withColumnRenamed("seed", "score"), "scores")
    while True:
        new = state
        for _ in range(TOGETHER):
            new = passed_on(new)
        new = written(new, "scores")
        both = new.withColumn("sign", F.lit(1)).unionByName(state.withColumn("sign", F.lit(-1))).groupBy("good", "host").agg(F.sum(F.col("score") * F.col("sign")).alias("change"), F.sum("sign").alias("fresh"))
        moved = both.agg(F.sum(F.abs("change")).alias("change"), F.count_if(F.col("fresh") != 0).alias("fresh")).first()
        discard(state)
        state = new
        if not moved["fresh"] and (moved["change"] or 0.0) < TOLERANCE:
            break
    held = {r["good"]: r["held"] for r in state.groupBy("good").agg(F.sum("score").alias("held")).collect()}
    share = lambda good: F.sum(F.when(F.col("good") == good, F.col("score") / (held.get(good) or 1.0)).otherwise(0.0))
    return state.groupBy("host").agg(share(True).alias("trust"), share(False).alias("distrust"))


def judge(pages: DataFrame, rules=RULES, threshold: float = THRESHOLD, damping: float = DAMPING) -> DataFrame:
    """page_id, host, path, rule, verdict for every page (columns page_id, url, html)."""
    host, path = url_host(F.col("url")), url_path(F.col("url"))
    parsed = pages.select("page_id", host.alias("host"), path.alias("path"), "html")
    ruled = parsed.select("page_id", "host", "path", matched(F.col("host"), F.col("path"), rules, 0).alias("rule"), matched(F.col("host"), F.col("path"), rules, 1).alias("ruled"))
    seeds = ruled.groupBy("host").agg(F.count_if(F.col("ruled") == "allow").alias("allowed"), F.count_if(F.col("ruled") == "block").alias("blocked"))
    links = written(host_links(parsed.select("host", "html")), "host-links")
    scores = propagate(written(seeds, "host-seeds"), links, damping)
    bad = scores.where(F.col("distrust") > threshold * F.col("trust")).select(F.col("host").alias("bad_host"))
    judged = ruled.join(bad, (ruled["host"] == bad["bad_host"]) & ruled["ruled"].isNull(), "left")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("bad_host").isNotNull(), "block").otherwise("allow")).alias("verdict"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(load(spark, sf_dir, "pages"))


def _sql() -> str:
    """The same in SQL; a recursive query passes the scores on, a hundred rounds, which leaves less than the tolerance."""
    fits = lambda r: f"(host = '{r.partition('/')[0]}' OR host LIKE '%.{r.partition('/')[0]}') AND starts_with(path, '/{r.partition('/')[2]}')"
    longest = sorted(RULES, key=lambda r: -len(r[0]))
    case = lambda k: "CASE " + " ".join(f"WHEN {fits(r[0])} THEN '{r[k]}'" for r in longest) + " END"
    href, absolute = HREF.replace("'", "''"), ABSOLUTE.replace("'", "''")
    low = f"'{UPPER}', '{LOWER}'"
    return f"""
        WITH RECURSIVE p AS (SELECT page_id, html, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), {low}) AS host,
                          coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
        r AS (SELECT page_id, host, path, {case(0)} AS rule, {case(1)} AS ruled FROM p),
        c AS (SELECT host, regexp_extract_all(html, '{absolute}', 1) AS away, len(regexp_extract_all(html, '{href}')) AS n_all FROM p),
        link AS (SELECT host, dst, sum(n) AS n FROM (
            SELECT host, host AS dst, n_all - len(away) AS n FROM c WHERE n_all > len(away) UNION ALL
            SELECT host, translate(unnest(away), {low}), 1 FROM c) GROUP BY ALL),
        both_ways AS (SELECT true AS good, host AS src, dst, n FROM link UNION ALL SELECT false, dst, host, n FROM link),
        steps AS (SELECT good, src, dst, n / sum(n) OVER (PARTITION BY good, src) AS w FROM both_ways),
        seed AS (SELECT ruled = 'allow' AS good, host, count(*) / sum(count(*)) OVER (PARTITION BY ruled) AS seed FROM r WHERE ruled IS NOT NULL GROUP BY ruled, host),
        s AS (SELECT 0 AS k, good, host, seed AS score FROM seed UNION ALL
              SELECT k + 1, good, host, sum(part) FROM (
                  SELECT k, s.good, dst AS host, {DAMPING} * score * w AS part FROM s JOIN steps t ON s.good = t.good AND s.host = t.src UNION ALL
                  SELECT (SELECT max(k) FROM s), good, host, {1 - DAMPING!r} * seed FROM seed) WHERE k < 100 GROUP BY k, good, host),
        e AS (SELECT good, host, score / sum(score) OVER (PARTITION BY good) AS score FROM s WHERE k = (SELECT max(k) FROM s)),
        bad AS (SELECT host FROM e GROUP BY host HAVING sum(CASE WHEN good THEN 0 ELSE score END) > {THRESHOLD} * sum(CASE WHEN good THEN score ELSE 0 END))
        SELECT page_id, r.host, path, rule, coalesce(ruled, CASE WHEN bad.host IS NULL THEN 'allow' ELSE 'block' END) AS verdict
        FROM r LEFT JOIN bad ON r.host = bad.host"""


SQL = {"op7_url_filter": _sql()}
