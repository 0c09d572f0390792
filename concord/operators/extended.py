"""Further analyses: curvature, parser ablation, strata, audit samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from concord.functions import kinematics
from concord.functions.rules import CURRENT, EXPANDED, STRICT, RuleSet
from concord.functions.text import classify_by_sets
from concord.operators.report import valid
from concord.operators.sampling import order_key
from concord.operators.score import score, severity

VARIANTS = {"strict": STRICT, "current": CURRENT, "expanded": EXPANDED}


def regime(speed: Column) -> Column:
    """Speed regimes [0, 5), [5, 15) and from 15 on, in m/s."""
    return F.when(speed < 5, "slow").when(speed < 15, "medium").otherwise("fast")


def curvature_lateral(way: DataFrame) -> DataFrame:
    """Lateral class by the raw shift and by the shift beyond the road's curve."""
    rows = kinematics.curvature(way)
    return rows.select("clip_id", "dy", "kappa", "residual", kinematics.lat_class(F.col("dy")).alias("raw_class"), kinematics.lat_class(F.col("residual")).alias("curve_class"))


def curvature_effect(results: DataFrame, way: DataFrame) -> DataFrame:
    """What the curve correction does to the severe rate, over all clips and over those that intend to hold the lane."""
    rows = valid(results).select("clip_id", "long_intent", "lat_intent", "long_execution")
    own = way.join(rows.select("clip_id").hint("shuffle_hash"), "clip_id", "left_semi")  # other paths are not sorted
    rows = rows.join(curvature_lateral(own).select("clip_id", "raw_class", "curve_class"), "clip_id")
    severe = lambda c: F.avg((severity(F.col(c)) == "severe").cast("double")) * 100
    raw = score(rows.withColumn("lat_execution", F.col("raw_class"))).select("clip_id", "lat_intent", "curve_class", "long_intent", "long_execution", F.col("mismatch_score").alias("raw_score"))
    both = score(raw.withColumn("lat_execution", F.col("curve_class")))
    groups = F.explode(F.when(F.col("lat_intent") == "hold_lane", F.array(F.lit("all"), F.lit("hold_lane"))).otherwise(F.array(F.lit("all")))).alias("group")
    out = both.select("raw_score", "mismatch_score", groups).groupBy("group").agg(F.count("*").alias("n"), severe("raw_score").alias("severe_raw"), severe("mismatch_score").alias("severe_curve"))
    drop = F.col("severe_raw") - F.col("severe_curve")
    return out.withColumn("drop_points", drop).withColumn("verdict", F.when(F.round(drop, 6) >= 10, "curvature_artifact").when(F.round(drop, 6) < 5, "not_curvature").otherwise("unclear"))


def parser_ablation(results: DataFrame, variants: dict[str, RuleSet] = VARIANTS) -> DataFrame:
    """The severe rate of the same paths under several rule sets, and the spread with its verdict."""
    rows = classify_by_sets(valid(results).select("clip_id", "cot_text", "long_execution", "lat_execution"), variants)
    kept, rates = list(rows.columns), []
    for name in variants:  # all in one pass over the texts
        judged = score(rows.withColumns({f"{axis}_intent": F.col(f"{name}_{axis}_intent") for axis in ("long", "lat")}))
        kept.append(f"severe_{name}")
        rows = judged.withColumn(kept[-1], (severity(F.col("mismatch_score")) == "severe").cast("double")).select(*kept)
        rates.append(F.struct(F.lit(name).alias("variant"), F.count("*").alias("n"), (100 * F.avg(kept[-1])).alias("severe_pct")))
    out = rows.agg(F.array(*rates).alias("rates")).select(F.inline("rates"))
    over = Window.partitionBy()  # one row a variant
    spread = F.max("severe_pct").over(over) - F.min("severe_pct").over(over)
    return out.withColumn("spread", spread).withColumn("verdict", F.when(F.round(spread, 6) > 5, "parser_sensitive").when(F.round(spread, 6) <= 2, "robust").otherwise("unclear"))


def ade_stratified(results: DataFrame) -> DataFrame:
    rows = valid(results).select("scenario_type", regime(F.col("mean_speed_ms")).alias("regime"), severity(F.col("mismatch_score")).alias("band"), "ade_meters")
    return rows.groupBy("scenario_type", "regime", "band").agg(F.count("*").alias("n"), F.avg("ade_meters").alias("mean_ade"))


def audit_slice(results: DataFrame, n: int = 100, seed: int = 7) -> DataFrame:
    """The n severe contradictions of hold_lane with the highest scores, each with a control from its stratum.

    Controls are clips that are not severe, ranked by hash within (scenario, regime), and matched by rank; a case whose
    stratum has too few controls stays without.
    """
    rows = valid(results).withColumns({"regime": regime(F.col("mean_speed_ms")), "severe": severity(F.col("mismatch_score")) == "severe"})
    cases = rows.where("severe and lat_intent = 'hold_lane'").orderBy(F.desc("mismatch_score"), "clip_id").limit(n)
    stratum = Window.partitionBy("scenario_type", "regime")
    cases = cases.withColumn("k", F.row_number().over(stratum.orderBy(F.desc("mismatch_score"), "clip_id")))
    ranked = rows.where("not severe").withColumn("k", F.row_number().over(stratum.orderBy(order_key(seed, "clip_id"), "clip_id"))).where(F.col("k") <= n)
    controls = ranked.select("scenario_type", "regime", "k", F.col("clip_id").alias("control_id"), F.col("mismatch_score").alias("control_score"))
    return cases.join(controls, ["scenario_type", "regime", "k"], "left").select("clip_id", "scenario_type", "regime", "mismatch_score", "lat_execution", "control_id", "control_score")
