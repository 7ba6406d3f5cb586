"""URL filtering by trust that spreads over the host link graph.

Personalised PageRank starts at trusted hosts and follows links forward; distrust starts at blocked
hosts and follows links backward, since a host that links to a blocked one is suspect itself. Rules on
single urls come first; for all other pages the host decides.

A host's score is (trust - distrust) / (trust + distrust), each weighted by the mass of its seeds, so it
says which of the two prevails and not how large either is: however many hosts share the mass, and
whatever seeds are added elsewhere, the score of a host stays the same. A host is allowed from
``THRESHOLD`` on. Mass that comes to a host without links ends there; to return it to the seeds would
multiply all scores of a kind by one factor.

Host edges are the links between pages of different hosts, summed per pair of hosts, and an edge both
ways between a host and its parent domain, which carries trust among the hosts of a site. A parent that
is a public suffix (``PUBLIC_SUFFIX``) is no site, and addresses of numbers have no parent. Seeds are
hosts on which a rule fits: with the share of their pages that are allowed or blocked.

Defined results: a null url, or one without ``://``, has an empty host and path, fits no rule and
takes the verdict ``block`` (there is no host to trust); null html has no links; very long urls and pages
are read whole; repeated rows get equal results each; ties need no order, as every host's score is a sum;
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._base import LOWER, UPPER, ascii_lower, durable, quoted

#: Verdict, host suffix and path prefix of each rule; the longest rule that fits a url decides.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
DAMPING = 0.85
ROUNDS = 12
THRESHOLD = 0.0
#: Scores are ratios of sums of doubles; equal ones may differ by that much.
TOLERANCE = 1e-9
CUT_EVERY = 4
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: Fixed: second-level labels under which country registries hand out names, and addresses of numbers.
PUBLIC_SUFFIX = r"^(ac|co|com|edu|go|gob|gov|gouv|ltd|me|mil|ne|net|nhs|nom|or|org|plc|sch)\.[a-z]{2}$"
_ADDRESS = r"^(\[.*\]|[0-9]+(\.[0-9]+){3})(:[0-9]*)?$"
_PARENT = r"^[^.]*\.(.*)$"
_LINK = r"""(?i)<a\b[^>]*?\bhref\s*=\s*["']?((?:https?:)?//[^"'\s>]+)"""


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def fitting_rule(host: Column, path: Column, rules=RULES) -> Column:
    """struct(verdict, rule) of the longest rule that fits; null if none does."""
    fits = []
    for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        at, slash, start = rule.partition("/")
        fits.append(((host == at) | host.endswith("." + at)) & path.startswith(slash + start))
        fits.append(F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule")))
    chosen = F.lit(None)
    for fit, rule in reversed(list(zip(fits[::2], fits[1::2], strict=True))):
        chosen = F.when(fit, rule).otherwise(chosen)
    return chosen


def judged_urls(pages: DataFrame, id_col: str, url_col: str, rules) -> DataFrame:
    urls = pages.select(quoted(id_col).alias("page_id"), host_of(quoted(url_col)).alias("host"), path_of(quoted(url_col)).alias("path"))
    return urls.withColumn("fit", fitting_rule(F.col("host"), F.col("path"), rules))


def host_edges(pages: DataFrame, hosts: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """src, dst, weight: one row for each pair of linked hosts, summed before and after the shuffle."""
    links = pages.select(host_of(quoted(url_col)).alias("src"), F.explode(F.regexp_extract_all(quoted(html_col), F.lit(_LINK), 1)).alias("link"))
    linked = links.select("src", host_of(F.when(F.col("link").startswith("//"), F.concat(F.lit("http:"), "link")).otherwise(F.col("link"))).alias("dst"))
    linked = linked.where("src <> '' AND dst <> '' AND src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("weight"))
    parent = hosts.where(F.col("host").like("%.%.%") & ~F.col("host").rlike(_ADDRESS)).select("host", F.regexp_extract("host", _PARENT, 1).alias("parent"))
    parent = parent.where((F.col("parent") != "") & ~F.col("parent").rlike(PUBLIC_SUFFIX))
    up = parent.select(F.col("host").alias("src"), F.col("parent").alias("dst"), F.lit(1.0).alias("weight"))
    down = parent.select(F.col("parent").alias("src"), F.col("host").alias("dst"), F.lit(1.0).alias("weight"))
    return linked.unionByName(up).unionByName(down).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def propagate(seeds: DataFrame, edges: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """host, score: personalised PageRank from ``seeds`` (host, seed) over ``edges`` (src, dst, weight).

    Edges are divided by their host's total once. Each round is a join with the scores and a partial
    sum per target, so a host with very many links in or out is never gathered in one task; every few
    rounds the scores are written to the shared folder.
    """
    out = edges.groupBy("src").agg(F.sum("weight").alias("out"))
    shares = durable(edges.join(out, "src").select("src", "dst", (F.col("weight") / F.col("out")).alias("share")))
    total = seeds.agg(F.sum("seed").alias("total"))
    start = durable(seeds.where("seed > 0").crossJoin(F.broadcast(total)).select("host", (F.col("seed") / F.col("total")).alias("seed")))  # total: one row
    score = start.select("host", F.col("seed").alias("score"))
    for k in range(rounds):
        moved = score.join(shares, F.col("host") == F.col("src")).select(F.col("dst").alias("host"), (F.col("score") * F.col("share") * damping).alias("score"))
        home = start.select("host", (F.col("seed") * (1 - damping)).alias("score"))
        score = moved.unionByName(home).groupBy("host").agg(F.sum("score").alias("score"))
        if k % CUT_EVERY == CUT_EVERY - 1:
            score = durable(score)
    return score


def judge_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", rules=RULES, trusted: DataFrame | None = None, blocked: DataFrame | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """page_id, host, path, rule, verdict, host_score.

    ``trusted`` and ``blocked`` (host) add seeds of weight 1. A host that neither trust nor distrust
    reaches has score 0; one that only one of them reaches has 1 or -1.
    """
    urls = judged_urls(pages, id_col, url_col, rules)
    share = lambda v: F.sum(F.when(F.col("fit.verdict") == v, 1.0).otherwise(0.0)) / F.count(F.lit(1))
    hosts = durable(urls.where("host <> ''").groupBy("host").agg(share("allow").alias("allow"), share("block").alias("block")))
    edges = durable(host_edges(pages, hosts, url_col, html_col))

    def seeds(share_col: str, more: DataFrame | None) -> DataFrame:
        own = hosts.select("host", F.col(share_col).alias("seed"))
        if more is not None:
            own = own.unionByName(more.select(ascii_lower(F.col("host")).alias("host"), F.lit(1.0).alias("seed")).distinct())
        return own.groupBy("host").agg(F.sum("seed").alias("seed"))

    backward = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    scored = hosts.select("host")
    for name, start, along in (("trust", seeds("allow", trusted), edges), ("distrust", seeds("block", blocked), backward)):
        mass = start.agg(F.sum("seed").alias("mass"))
        spread = propagate(start, along).crossJoin(F.broadcast(mass)).select("host", (F.col("score") * F.col("mass")).alias(name))  # mass: one row
        scored = scored.join(spread, "host", "left")
    trust, distrust = F.coalesce("trust", F.lit(0.0)), F.coalesce("distrust", F.lit(0.0))
    scored = durable(scored.select("host", F.when(trust + distrust > 0, (trust - distrust) / (trust + distrust)).otherwise(0.0).alias("host_score")))
    verdict = F.when(F.col("host_score") >= threshold - TOLERANCE, "allow").otherwise("block")
    return urls.join(scored, "host", "left").select(
        "page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", verdict).alias("verdict"), F.round("host_score", 9).alias("host_score")
    )


def _sql(rounds: int = ROUNDS, damping: float = DAMPING, threshold: float = THRESHOLD) -> str:
    """The production query in DuckDB, a CTE for each round."""
    low = f"translate({{}}, '{UPPER}', '{LOWER}')"
    host = low.format("coalesce(regexp_extract({0}, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '')")
    fits = []
    for verdict, rule in sorted(RULES, key=lambda r: (-len(r[1]), r[1])):
        at, slash, start = rule.partition("/")
        fits.append((f"(host = '{at}' OR ends_with(host, '.{at}')) AND starts_with(path, '{slash + start}')", rule, verdict))
    case = lambda k: "CASE " + " ".join(f"WHEN {f[0]} THEN '{f[k]}'" for f in fits) + " END"
    link = _LINK.replace("'", "''")
    parts = [f"""u AS (SELECT page_id, html, {host.format("url")} AS host, coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
    j AS (SELECT *, {case(1)} AS rule, {case(2)} AS fit FROM u),
    hosts AS (SELECT host, avg(coalesce(fit = 'allow', false)::INT) AS allow, avg(coalesce(fit = 'block', false)::INT) AS block FROM j WHERE host <> '' GROUP BY host),
    links AS (SELECT host AS src, unnest(regexp_extract_all(html, '{link}', 1)) AS link FROM u),
    parents AS (SELECT host, regexp_extract(host, '{_PARENT}', 1) AS parent FROM hosts WHERE host LIKE '%.%.%' AND NOT regexp_matches(host, '{_ADDRESS}') AND NOT regexp_matches(regexp_extract(host, '{_PARENT}', 1), '{PUBLIC_SUFFIX}')),
    raw AS (SELECT src, {host.format("CASE WHEN starts_with(link, '//') THEN 'http:' || link ELSE link END")} AS dst, 1.0 AS weight FROM links
            UNION ALL SELECT host, parent, 1.0 FROM parents UNION ALL SELECT parent, host, 1.0 FROM parents),
    edges AS (SELECT src, dst, sum(weight)::DOUBLE AS weight FROM raw WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY ALL)"""]
    for name, seed, src, dst in (("t", "allow", "src", "dst"), ("d", "block", "dst", "src")):
        parts.append(f"{name}_e AS (SELECT {src} AS a, {dst} AS b, weight / sum(weight) OVER (PARTITION BY {src}) AS share FROM edges)")
        parts.append(f"{name}_s AS (SELECT host, {seed} / (SELECT sum({seed}) FROM hosts) AS seed FROM hosts WHERE {seed} > 0)")
        parts.append(f"{name}0 AS (SELECT host, seed AS score FROM {name}_s)")
        for k in range(1, rounds + 1):
            parts.append(f"{name}{k} AS MATERIALIZED (SELECT host, sum(score) AS score FROM (SELECT b AS host, score * share * {damping} AS score FROM {name}{k - 1} JOIN {name}_e ON host = a UNION ALL SELECT host, seed * {1 - damping} FROM {name}_s) GROUP BY host)")
    parts.append(f"both_ways AS (SELECT h.host, coalesce(t.score * (SELECT sum(allow) FROM hosts), 0) AS t, coalesce(d.score * (SELECT sum(block) FROM hosts), 0) AS d FROM hosts h LEFT JOIN t{rounds} t USING (host) LEFT JOIN d{rounds} d USING (host))")
    parts.append("scored AS (SELECT host, CASE WHEN t + d > 0 THEN (t - d) / (t + d) ELSE 0.0 END AS host_score FROM both_ways)")
    return "WITH " + ",\n    ".join(parts) + f"\n    SELECT page_id, j.host, path, rule, coalesce(fit, CASE WHEN host_score >= {threshold - TOLERANCE} THEN 'allow' ELSE 'block' END) AS verdict, round(host_score, 9) AS host_score FROM j LEFT JOIN scored s ON j.host = s.host"


ORACLE = _sql()
