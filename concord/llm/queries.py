"""Queries of the training-data operators, one for each, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from concord.llm import align, ann, decontaminate, katz, langid, licenses, mixing, quality, runs, simhash, toxicity, urlfilter, warc
from concord.llm.common import read


def op1_adaptive_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(read(spark, sf_dir, "embeddings"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.filter_urls(read(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(read(spark, sf_dir, "pages"))


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op5_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score_documents(read(spark, sf_dir, "documents"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read(spark, sf_dir, "documents"))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"))


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.align(read(spark, sf_dir, "documents"))


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(read(spark, sf_dir, "documents"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.digest(runs.detect(runs.repeated(read(spark, sf_dir, "documents"))))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op")}


def _url_filter_sql(damping: float = 0.85, rounds: int = 40) -> str:
    """Rules by length, then both walks as a chain of sums, one for each round."""
    lower = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    rules = ", ".join(f"('{v}', '{r}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}')" for v, r in urlfilter.RULES)
    steps = "".join(
        f""",
s{k} AS (SELECT kind, host, sum(score) AS score FROM (SELECT s.kind, e.dst AS host, s.score * e.p AS score FROM s{k - 1} s JOIN steps e ON s.kind = e.kind AND s.host = e.src UNION ALL SELECT * FROM s0) GROUP BY kind, host)"""
        for k in range(1, rounds + 1)
    )
    return f"""WITH cutup AS (SELECT page_id, html, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, html, {lower.format("regexp_extract(rest, '^[^/?#]*')")} AS host, regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM cutup),
rules AS (SELECT * FROM (VALUES {rules}) AS t(verdict, rule, own, start)),
fits AS (SELECT DISTINCT p.host, p.path, arg_max(r.rule, length(r.rule)) AS rule, arg_max(r.verdict, length(r.rule)) AS ruled FROM (SELECT DISTINCT host, path FROM parts) p
  JOIN rules r ON (p.host = r.own OR ends_with(p.host, '.' || r.own)) AND starts_with(p.path, r.start) GROUP BY p.host, p.path),
judged AS (SELECT p.*, f.rule, f.ruled FROM parts p LEFT JOIN fits f ON p.host = f.host AND p.path = f.path),
hosts AS (SELECT host, count(*) AS n, count(*) FILTER (ruled = 'allow') AS allowed, count(*) FILTER (ruled = 'block') AS blocked FROM judged WHERE host <> '' GROUP BY host),
links AS (SELECT host AS src, {lower.format("dst")} AS dst, count(*) AS n FROM (SELECT host, unnest(regexp_extract_all(html, '(?i)\\bhref\\s*=\\s*["'']?\\s*(?:https?:)?//([^/?#"''\\s<>]+)', 1)) AS dst FROM parts) WHERE host <> '' AND dst <> '' AND host <> {lower.format("dst")} GROUP BY 1, 2),
both_ways AS (SELECT 'trust' AS kind, src, dst, n FROM links UNION ALL SELECT 'distrust', dst, src, n FROM links),
steps AS (SELECT kind, src, dst, n / sum(n) OVER (PARTITION BY kind, src) * {damping}::DOUBLE AS p FROM both_ways),
s0 AS (SELECT 'trust' AS kind, host, allowed * {1 - damping}::DOUBLE AS score FROM hosts WHERE allowed > 0 UNION ALL SELECT 'distrust', host, blocked * {1 - damping}::DOUBLE FROM hosts WHERE blocked * 2 > n){steps},
shares AS (SELECT kind, host, score / sum(score) OVER (PARTITION BY kind) AS score FROM s{rounds}),
by_host AS (SELECT host, coalesce(sum(score) FILTER (kind = 'trust'), 0) AS trust, coalesce(sum(score) FILTER (kind = 'distrust'), 0) AS distrust FROM shares GROUP BY host)
SELECT j.page_id, j.host, j.path, j.rule, coalesce(j.ruled, CASE WHEN b.distrust > b.trust THEN 'block' ELSE 'allow' END) AS verdict FROM judged j LEFT JOIN by_host b ON j.host = b.host"""


def _warc_sql() -> str:
    """The classes that the archives are to give back, from the pages alone; base32 by five bits of the hex digest."""
    digit = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, (5 * i) // 4 + 1, 2))::INT >> (3 - (5 * i) % 4)::INT) & 31) + 1, 1)"
    return f"""SELECT page_id, strlen(html)::BIGINT AS payload_bytes, list_aggregate(list_transform(range(32), lambda i: {digit}), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to, true AS verified
FROM (SELECT page_id, html, sha1(html) AS h, max(page_id) OVER (PARTITION BY html) AS last FROM (SELECT page_id, coalesce(html, '') AS html FROM pages))"""


def oracle_sql() -> dict[str, str]:
    """Trained models, hashes that SQL lacks and greedy rounding have none; tests/llm/ holds those against brute force."""
    return {"op2_url_filter": _url_filter_sql(), "op3_warc": _warc_sql()}
