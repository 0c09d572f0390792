"""Reports over stored scores: summaries, distributions, crosstabs, intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from concord.operators.score import severity

Z = 1.96
METRICS = ("mismatch_score", "ade_meters", "long_match", "lat_match")


def valid(results: DataFrame) -> DataFrame:
    """Scored rows; none if there is no score column."""
    return results.where("mismatch_score is not null") if "mismatch_score" in results.columns else results.where(F.lit(False))


def run_summary(results: DataFrame, timestamp: str | None = None) -> DataFrame:
    """Counts and means of a run; means are null without a valid row. timestamp: when it ended, if it is to be told."""
    names = dict(zip(METRICS, ("mean_mismatch", "mean_ade", "mean_long_match", "mean_lat_match")))
    scored = F.col("mismatch_score").isNotNull()
    out = results.agg(F.count("*").alias("total_clips"), F.count("mismatch_score").alias("valid"), *[F.avg(F.when(scored, F.col(c))).alias(n) for c, n in names.items()])
    return out.select(F.lit(timestamp).alias("timestamp"), "*") if timestamp else out


def with_percent(counts: DataFrame, n: str = "n") -> DataFrame:
    """counts with pct of their total. The total is an aggregate of a few classes, joined back as one row."""
    total = counts.agg(F.sum(n).alias("_all"))
    return counts.join(F.broadcast(total)).withColumn("pct", 100.0 * F.col(n) / F.col("_all")).drop("_all")


def type_distribution(results: DataFrame) -> DataFrame:
    return with_percent(valid(results).groupBy("mismatch_type").agg(F.count("*").alias("n"))).orderBy(F.desc("n"), "mismatch_type")


def class_histograms(results: DataFrame) -> DataFrame:
    """Counts of both intents and both executions in one pass: (axis, label, n)."""
    axes = ["long_intent", "lat_intent", "long_execution", "lat_execution"]
    return valid(results).unpivot([], axes, "axis", "label").groupBy("axis", "label").agg(F.count("*").alias("n")).orderBy("axis", F.desc("n"), "label")


def by_scenario(results: DataFrame) -> DataFrame:
    return valid(results).groupBy("scenario_type").agg(F.count("*").alias("n"), F.avg("mismatch_score").alias("mean_score"), F.avg("ade_meters").alias("mean_ade"))


def interval(mean: Column, sd: Column, n: Column, z: float = Z) -> tuple[Column, Column]:
    half = z * sd / F.sqrt(n)
    return mean - half, mean + half


def proportion_interval(p: Column, n: Column, z: float = Z) -> tuple[Column, Column]:
    half = z * F.sqrt(p * (1 - p) / n)
    return p - half, p + half


def mean_ci(results: DataFrame, metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """(metric, n, mean, sd, lo, hi): mean +- 1.96 standard errors."""
    long = valid(results).unpivot([], list(metrics), "metric", "value").where("value is not null")
    rows = long.groupBy("metric").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"))
    lo, hi = interval(F.col("mean"), F.col("sd"), F.col("n"))
    return rows.withColumns({"lo": lo, "hi": hi})


def severity_bands(results: DataFrame) -> DataFrame:
    """Bands by score alone with their share of all and its interval."""
    counts = with_percent(valid(results).groupBy(severity(F.col("mismatch_score")).alias("band")).agg(F.count("*").alias("n")))
    n = F.col("n") * 100.0 / F.col("pct")
    lo, hi = proportion_interval(F.col("pct") / 100, n)
    return counts.withColumns({"lo": 100 * lo, "hi": 100 * hi, "inconsistent": F.col("band") != "consistent"})


def axis_gap_ci(results: DataFrame) -> DataFrame:
    """Mean of long_match - lat_match over the same clips."""
    rows = valid(results).select((F.col("long_match") - F.col("lat_match")).alias("gap")).agg(F.count("gap").alias("n"), F.avg("gap").alias("mean"), F.stddev_samp("gap").alias("sd"))
    lo, hi = interval(F.col("mean"), F.col("sd"), F.col("n"))
    return rows.withColumns({"lo": lo, "hi": hi})


def severe_by_bucket(results: DataFrame) -> DataFrame:
    severe = (severity(F.col("mismatch_score")) == "severe").cast("double")
    return valid(results).groupBy("scenario_type").agg(F.count("*").alias("n"), (100 * F.avg(severe)).alias("severe_pct"))


def crosstab(results: DataFrame, axis: str) -> DataFrame:
    """Intent and execution pairs of an axis with their count and rank."""
    counts = valid(results).groupBy(F.col(f"{axis}_intent").alias("intent"), F.col(f"{axis}_execution").alias("execution")).agg(F.count("*").alias("n"))
    return counts.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "intent", "execution")).cast("long"))  # 30 rows at most


def mismatch_ade_corr(results: DataFrame) -> DataFrame:
    return valid(results).agg(F.corr("mismatch_score", "ade_meters").alias("corr"), F.count("ade_meters").alias("n"))


def ade_by_band(results: DataFrame) -> DataFrame:
    return valid(results).groupBy(severity(F.col("mismatch_score")).alias("band")).agg(F.count("*").alias("n"), F.avg("ade_meters").alias("mean_ade"))
