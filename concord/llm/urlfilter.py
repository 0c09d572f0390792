"""URL filter: rules first, then trust and distrust carried along links between hosts.

Hosts whose pages the rules allow are trusted seeds, hosts of whose pages they block more than half are blocked seeds.
Trust flows along links (personalised PageRank from the trusted seeds); distrust flows against them, since who links to
blocked hosts is suspect (the same on reversed edges, from the blocked seeds). A host is blocked if its distrust exceeds
`threshold` times its trust; its pages that no rule fits get that verdict, all others are allowed.

Edges are (host, host, number of links), summed before any shuffle. Both walks are one table with a `kind` column; a
round is a join on the host and a sum. Mass at hosts without links out is not carried back: for walks that restart at
the seeds this changes only the scale, which the final normalisation removes. The table of hosts is joined to the
pages as Spark sees fit; nothing is collected.

Defined cases: a null url or one without `://` has an empty host and path, fits no rule and is allowed; a null html
has no links; links within a host and relative links are no edges; repeated rows count as often as they occur; an
empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concord.llm.common import cut

#: (verdict, rule): host, then path, with the first slash between them. At most some hundred: each is an expression.
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LINK = r"""(?i)\bhref\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s<>]+)"""


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict; null if none does."""
    rule = verdict = F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: len(r[1])):
        own, _, rest = text.partition("/")
        fits = ((host == own) | host.endswith(f".{own}")) & path.startswith(f"/{rest}")
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def judged(pages: DataFrame, rules=RULES) -> DataFrame:
    """pages -> (page_id, host, path, rule, ruled)."""
    parts = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, ruled = rule_of(F.col("host"), F.col("path"), rules)
    return parts.withColumn("rule", rule).withColumn("ruled", ruled)


def host_edges(pages: DataFrame) -> DataFrame:
    """pages -> (src, dst, n): links from one host to another."""
    links = pages.select(host_of(F.col("url")).alias("src"), F.explode(F.regexp_extract_all(F.col("html"), F.lit(_LINK), F.lit(1))).alias("to"))
    dst = F.translate("to", _UPPER, _LOWER)
    return links.select("src", dst.alias("dst")).where("src <> '' and dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


def propagate(seeds: DataFrame, edges: DataFrame, damping: float = 0.85, rounds: int = 40) -> DataFrame:
    """seeds (kind, host, seed) and edges (src, dst, n) -> (kind, host, score), scores of a kind summing to 1.

    What rounds beyond the last would still move is damping ** rounds of the seeds' mass at most, 0.0015 of it. Every
    fifth round the scores are compared with those of five rounds before, and the walk ends if nothing moved.
    """
    steps = edges.select(F.lit("trust").alias("kind"), "src", "dst", "n").union(edges.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "n"))
    out = steps.groupBy("kind", "src").agg(F.sum("n").alias("all"))
    steps = cut(steps.join(out, ["kind", "src"]).select("kind", F.col("src").alias("host"), "dst", (F.col("n") / F.col("all") * damping).alias("p")), "steps")
    scores = start = cut(seeds.select("kind", "host", (F.col("seed") * (1 - damping)).alias("score")), "seeds")
    before = scores
    if not steps.isEmpty():
        for k in range(rounds):
            moved = scores.join(steps, ["kind", "host"]).select("kind", F.col("dst").alias("host"), (F.col("score") * F.col("p")).alias("score"))
            scores = moved.union(start).groupBy("kind", "host").agg(F.sum("score").alias("score"))
            if k % 5 == 4 or k == rounds - 1:
                scores = cut(scores, "scores")
                both = scores.select("kind", "host", "score").union(before.select("kind", "host", (-F.col("score")).alias("score")))
                moved, whole = both.groupBy("kind", "host").agg(F.sum("score").alias("d")).agg(F.sum(F.abs("d"))).first()[0], scores.agg(F.sum("score")).first()[0]
                if (moved or 0.0) <= 1e-15 * (whole or 0.0):
                    break
                before = scores
    total = scores.groupBy("kind").agg(F.sum("score").alias("all"))  # two rows
    return scores.join(F.broadcast(total), "kind").select("kind", "host", (F.col("score") / F.col("all")).alias("score"))


def filter_urls(pages: DataFrame, rules=RULES, threshold: float = 1.0) -> DataFrame:
    """pages (page_id, url, html) -> (page_id, host, path, rule, verdict, trust, distrust)."""
    rows = judged(pages, rules)
    hosts = cut(
        rows.where("host <> ''").groupBy("host").agg(F.count("*").alias("n"), F.sum((F.col("ruled") == "allow").cast("long")).alias("allowed"), F.sum((F.col("ruled") == "block").cast("long")).alias("blocked")),
        "hosts",
    )
    good = hosts.where("allowed > 0").select(F.lit("trust").alias("kind"), "host", F.col("allowed").cast("double").alias("seed"))
    bad = hosts.where("blocked * 2 > n").select(F.lit("distrust").alias("kind"), "host", F.col("blocked").cast("double").alias("seed"))
    scores = propagate(good.union(bad), host_edges(pages))
    by_host = scores.groupBy("host").agg(*[F.sum(F.when(F.col("kind") == k, F.col("score")).otherwise(0.0)).alias(k) for k in ("trust", "distrust")])
    by_host = cut(by_host, "host_scores")
    found = rows.join(by_host, "host", "left").withColumns({k: F.coalesce(k, F.lit(0.0)) for k in ("trust", "distrust")})
    other = F.when(F.col("distrust") > threshold * F.col("trust"), "block").otherwise("allow")
    return found.select("page_id", "host", "path", "rule", F.coalesce("ruled", other).alias("verdict"), "trust", "distrust")
