"""Scoring: compatibility of what a text intends with what a path does."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.functions import kinematics
from concord.functions.rules import CURRENT, LAT_COMPAT, LAT_EXECUTIONS, LONG_COMPAT, LONG_EXECUTIONS, UNSPECIFIED, RuleSet
from concord.functions.text import classify_text
from concord.operators.sampling import normalize_clips
from concord.sources.io import RESULTS

STORED_TEXT = 1000
BANDS = (0.3, 0.6)


def matrix(spark: SparkSession, axis: str) -> DataFrame:
    """(<axis>_intent, <axis>_execution, <axis>_compat): 16 or 25 rows."""
    cells, executions = (LONG_COMPAT, LONG_EXECUTIONS) if axis == "long" else (LAT_COMPAT, LAT_EXECUTIONS)
    rows = ", ".join(f"('{i}', '{e}', {float(v)}D)" for i, values in cells.items() for e, v in zip(executions, values))
    return spark.sql(f"select * from values {rows} as t({axis}_intent, {axis}_execution, {axis}_compat)")


def compatibility(df: DataFrame, axes: tuple[str, ...] = ("long", "lat")) -> DataFrame:
    """df with <axis>_compat, null where the intent is unspecified."""
    for axis in axes:
        df = df.join(F.broadcast(matrix(df.sparkSession, axis)), [f"{axis}_intent", f"{axis}_execution"], "left")
    return df


def combined(long: Column, lat: Column, weight: float = 0.5) -> Column:
    return F.when(long.isNotNull() & lat.isNotNull(), weight * long + (1 - weight) * lat).otherwise(F.coalesce(long, lat, F.lit(0.5)))


def mismatch_type(score: Column, specified: Column, bands: tuple[float, float] = BANDS) -> Column:
    return F.when(~specified, "unclassified_intent").when(score < bands[0], "consistent").when(score < bands[1], "partial_mismatch").otherwise("severe_mismatch")


def severity(score: Column, bands: tuple[float, float] = BANDS) -> Column:
    """The band by score alone."""
    return F.when(score < bands[0], "consistent").when(score < bands[1], "partial").otherwise("severe")


def score(df: DataFrame) -> DataFrame:
    """df (intents and executions) with long_match, lat_match, mismatch_score and mismatch_type."""
    df = compatibility(df)
    value = F.round(1.0 - combined(F.col("long_compat"), F.col("lat_compat")), 3)
    specified = (F.col("long_intent") != UNSPECIFIED) | (F.col("lat_intent") != UNSPECIFIED)
    df = df.withColumns({"mismatch_score": value, "long_match": F.coalesce("long_compat", F.lit(0.5)), "lat_match": F.coalesce("lat_compat", F.lit(0.5))})
    return df.withColumn("mismatch_type", mismatch_type(F.col("mismatch_score"), specified))


def _result(df: DataFrame, error: Column) -> DataFrame:
    own = {"cot_text": F.substring("cot_text", 1, STORED_TEXT), "lat_shift_m": F.col("total_lateral_shift"), "mean_speed_ms": F.col("mean_speed"), "error": error}
    failed = error.isNotNull()
    keep = {"clip_id", "t0_us", "scenario_type", "error"}
    value = lambda f: own.get(f.name, F.col(f.name))
    return df.select([(value(f) if f.name in keep else F.when(~failed, value(f))).cast(f.dataType).alias(f.name) for f in RESULTS])


def score_clips(clips: DataFrame, reasoning: DataFrame, predictions: DataFrame, truth: DataFrame, rules: RuleSet = CURRENT) -> DataFrame:
    """One result row for each clip; paths of fewer than two points, or none, count as standing still."""
    clips = normalize_clips(clips).select("clip_id", "t0_us", "scenario_type")
    predictions, truth = _of(clips, predictions, truth)
    paths = kinematics.compared(predictions, truth).select("clip_id", *kinematics.FEATURES, "ade_meters")
    rows = clips.join(paths, "clip_id", "left").na.fill(0.0, list(kinematics.FEATURES))
    return _result(_scored_rows(rows, reasoning, rules), F.lit(None).cast("string"))


def _of(clips: DataFrame, *tables: DataFrame) -> list[DataFrame]:
    """The tables' rows of these clips: paths of others are neither sorted nor aggregated. Clips are hashed, so that looking them up
    takes no sort of the waypoints either; as distinct ids, so that Spark leaves out left joins that give them only other columns."""
    ids = clips.select("clip_id").distinct().hint("shuffle_hash")
    return [t.join(ids, "clip_id", "left_semi") for t in tables]


def _scored_rows(rows: DataFrame, reasoning: DataFrame, rules: RuleSet) -> DataFrame:
    texts = rows.join(reasoning.select("clip_id", "cot_text"), "clip_id", "left")
    return score(classify_text(kinematics.classify_features(texts), "cot_text", rules))


def score_with_errors(clips: DataFrame, reasoning: DataFrame, predictions: DataFrame, truth: DataFrame, rules: RuleSet = CURRENT) -> DataFrame:
    """Results in which a clip whose inputs don't fit is an error row; the job goes on."""
    clips = normalize_clips(clips).select("clip_id", "t0_us", "scenario_type")
    predictions, truth = _of(clips, predictions, truth)
    rows = clips.join(kinematics.compared(predictions, truth), "clip_id", "left")
    gap = lambda n: (F.col(f"{n}_lo") != 0) | (F.col(f"{n}_hi") != F.col(n) - 1)
    error = (
        F.when(F.coalesce(F.col("np"), F.lit(0)) == 0, "missing prediction")
        .when(F.coalesce(F.col("ng"), F.lit(0)) == 0, "missing ground truth")
        .when(F.col("repeated") | gap("np") | gap("ng"), "steps not contiguous")
        .when(F.col("np") != F.col("ng"), "length mismatch")
    )
    return _result(_scored_rows(rows.na.fill(0.0, list(kinematics.FEATURES)), reasoning, rules), error)


def score_packed(arrivals: DataFrame, rules: RuleSet = CURRENT) -> DataFrame:
    """score_with_errors() of rows that hold their text and both paths: no join and no shuffle, so also on streams."""
    n = lambda c: F.coalesce(F.size(c), F.lit(0))
    error = (
        F.when(n("traj") <= 0, "missing prediction").when(n("truth") <= 0, "missing ground truth").when(n("traj") != n("truth"), "length mismatch")
    )
    rows = normalize_clips(arrivals).withColumns({"error": error, "ade_meters": kinematics.displacement_packed()})
    rows = kinematics.features_packed(rows, kept=("t0_us", "scenario_type", "cot_text", "ade_meters", "error")).na.fill(0.0, list(kinematics.FEATURES))
    return _result(score(classify_text(kinematics.classify_features(rows), "cot_text", rules)), F.col("error"))
