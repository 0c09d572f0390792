"""Kinematics of paths: waypoints (clip_id, step, x, y, z) in, one row of features for each clip out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from concord.functions.rules import Thresholds

DT = 0.1
FEATURES = ("initial_speed", "final_speed", "mean_speed", "speed_change", "mean_acceleration", "total_lateral_shift", "max_lateral_deviation", "total_distance")


def step_speed(way: DataFrame, dt: float = DT) -> DataFrame:
    """way with the planar distance from the step before and the speed over it; null on the first step."""
    w = Window.partitionBy("clip_id").orderBy("step")
    return way.withColumn("distance", F.sqrt(F.pow(F.col("x") - F.lag("x").over(w), 2.0) + F.pow(F.col("y") - F.lag("y").over(w), 2.0))).withColumn("speed", F.col("distance") / dt)


def step_acceleration(way: DataFrame, dt: float = DT) -> DataFrame:
    w = Window.partitionBy("clip_id").orderBy("step")
    fast = step_speed(way, dt)
    return fast.withColumn("acceleration", (F.col("speed") - F.lag("speed").over(w)) / dt)


def _path_aggregates(own: Column | None = None) -> list[Column]:
    """What the features of a path are made of, over rows with y, distance and speed; of rows that are `own` only.

    Extremes of the lateral course stand for its deviations: the largest |y - y0| is that of the largest or smallest y.
    """
    of = lambda c: F.col(c) if own is None else F.when(own, F.col(c))
    moved = F.when(F.col("speed").isNotNull(), of("step"))  # only rows with a speed take part in min_by and max_by
    return [
        F.count("*" if own is None else F.when(own, 1)).alias("n_steps"),
        F.min_by("speed", moved).alias("initial_speed"),
        F.max_by("speed", moved).alias("final_speed"),
        F.avg("speed").alias("mean_speed"),
        F.min_by("y", of("step")).alias("y_first"),
        F.max_by("y", of("step")).alias("y_last"),
        F.min(of("y")).alias("y_least"),
        F.max(of("y")).alias("y_most"),
        F.sum("distance").alias("total_distance"),
    ]


def _with_features(paths: DataFrame, dt: float, *kept: str) -> DataFrame:
    """n_steps and FEATURES from _path_aggregates."""
    change = F.col("final_speed") - F.col("initial_speed")
    deviation = F.greatest(F.col("y_most") - F.col("y_first"), F.col("y_first") - F.col("y_least"))
    mean = F.when(F.col("n_steps") > 2, change / ((F.col("n_steps") - 2) * F.lit(dt))).otherwise(0.0)
    n = F.coalesce("n_steps", F.lit(0)).cast("long")
    out = paths.withColumns({"n_steps": n, "speed_change": change, "mean_acceleration": mean, "total_lateral_shift": F.col("y_last") - F.col("y_first"), "max_lateral_deviation": deviation})
    short = F.col("n_steps") < 2
    return out.select("clip_id", "n_steps", *[F.when(short, 0.0).otherwise(F.col(c)).alias(c) for c in FEATURES], *kept)


def features(way: DataFrame, clips: DataFrame | None = None, dt: float = DT) -> DataFrame:
    """clip_id, n_steps and FEATURES.

    The mean acceleration telescopes to the change of speed over (n - 2) steps, so one lag is enough, and window,
    aggregation and joins on clip_id share one partitioning. Clips with fewer than two waypoints, and those of `clips`
    without any, get zeros.
    """
    out = step_speed(way, dt).groupBy("clip_id").agg(*_path_aggregates())
    if clips is not None:
        out = clips.select("clip_id").distinct().join(out, "clip_id", "left")
    return _with_features(out, dt)


def _above(value: Column, limit: float) -> Column:
    """value > limit, false for NaN."""
    return ~F.isnan(value) & (value > limit)


def long_class(final_speed: Column, acceleration: Column, t: Thresholds = Thresholds()) -> Column:
    stopped = ~F.isnan(final_speed) & (final_speed < t.stopped)
    return F.when(stopped, "stopped").when(_above(acceleration, t.acceleration), "accelerating").when(_above(-acceleration, t.acceleration), "decelerating").otherwise("constant_speed")


def lat_class(shift: Column, t: Thresholds = Thresholds()) -> Column:
    side = lambda left, right: F.when(shift > 0, left).otherwise(right)
    return F.when(_above(F.abs(shift), t.lane_change), side("lane_change_left", "lane_change_right")).when(_above(F.abs(shift), t.shift), side("shift_left", "shift_right")).otherwise("straight")


def classify_features(feats: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    return feats.withColumns({"long_execution": long_class(F.col("final_speed"), F.col("mean_acceleration"), t), "lat_execution": lat_class(F.col("total_lateral_shift"), t)})


def classify_trajectories(way: DataFrame, clips: DataFrame | None = None, dt: float = DT, t: Thresholds = Thresholds()) -> DataFrame:
    return classify_features(features(way, clips, dt), t)


def pack(way: DataFrame) -> DataFrame:
    """Waypoints -> (clip_id, traj: array<struct<x, y, z>> in step order). A path is bounded (64 steps)."""
    rows = F.sort_array(F.collect_list(F.struct("step", "x", "y", "z")))
    return way.groupBy("clip_id").agg(rows.alias("rows")).select("clip_id", F.transform("rows", lambda r: F.struct(r["x"].alias("x"), r["y"].alias("y"), r["z"].alias("z"))).alias("traj"))


def unpack(packed: DataFrame) -> DataFrame:
    return packed.select("clip_id", F.posexplode("traj").alias("step", "p")).select("clip_id", "step", "p.x", "p.y", "p.z")


def features_packed(packed: DataFrame, dt: float = DT, kept: tuple[str, ...] = ()) -> DataFrame:
    """features() of packed paths, with columns that are kept: no shuffle, as each row holds its path."""
    n = F.coalesce(F.size("traj"), F.lit(0))
    gap = lambda a, b: F.sqrt(F.pow(b["x"] - a["x"], 2.0) + F.pow(b["y"] - a["y"], 2.0))
    tail = F.slice("traj", F.lit(2), F.greatest(F.size("traj") - 1, F.lit(0)))
    rows = packed.withColumn("n_steps", n.cast("long")).withColumn("d", F.when(F.col("n_steps") >= 2, F.zip_with(F.slice("traj", F.lit(1), F.size("traj") - 1), tail, gap)))
    at = lambda c, i: F.get(F.col(c), i)
    y0 = at("traj", F.lit(0))["y"]
    total = F.aggregate("d", F.lit(0.0), lambda a, x: a + x)
    rows = rows.withColumns({"initial_speed": at("d", F.lit(0)) / dt, "final_speed": at("d", F.size("d") - 1) / dt, "total_distance": total})
    rows = rows.withColumns(
        {
            "mean_speed": F.col("total_distance") / dt / (F.col("n_steps") - 1),
            "speed_change": F.col("final_speed") - F.col("initial_speed"),
            "total_lateral_shift": at("traj", F.size("traj") - 1)["y"] - y0,
            "max_lateral_deviation": F.array_max(F.transform("traj", lambda p: F.abs(p["y"] - y0))),
        }
    )
    rows = rows.withColumn("mean_acceleration", F.when(F.col("n_steps") > 2, F.col("speed_change") / ((F.col("n_steps") - 2) * F.lit(dt))).otherwise(0.0))
    return rows.select("clip_id", "n_steps", *[F.when(F.col("n_steps") < 2, 0.0).otherwise(F.col(c)).alias(c) for c in FEATURES], *kept)


def displacement_packed(a: str = "traj", b: str = "truth") -> Column:
    """Mean planar distance of two packed paths of the same length; null for others and for empty ones."""
    gap = F.zip_with(a, b, lambda p, q: F.sqrt(F.pow(p["x"] - q["x"], 2.0) + F.pow(p["y"] - q["y"], 2.0)))
    total = F.aggregate(gap, F.lit(0.0), lambda s, x: s + x)
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), total / F.size(a))


def paths_together(pred: DataFrame, truth: DataFrame, dt: float = DT) -> DataFrame:
    """features() of the predictions, ade_meters and n_joined, from each clip's two paths side by side.

    Tables that are bucketed by clip_id (io.write_bucketed) are read bucket by bucket, sorted, joined and aggregated where they
    lie: no row is shuffled. The truth's path is one row (a path is bounded, 64 steps), since a join by clip and step would be shuffled.
    Points that are there twice count once; a step that the truth has twice stands for its first point by x, y; steps that only
    one side has are left out of the error.
    """
    order = ("step", "x", "y", "z")
    w = Window.partitionBy("clip_id").orderBy(*order)
    before = {f"{c}_before": F.lag(c).over(w) for c in order}
    again = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"{c}_before")) for c in order])
    distance = F.sqrt(F.pow(F.col("x") - F.col("x_before"), 2.0) + F.pow(F.col("y") - F.col("y_before"), 2.0))
    own = pred.select("clip_id", *order).withColumns(before).where(~again).withColumn("distance", distance).withColumn("speed", F.col("distance") / dt)
    other = truth.groupBy("clip_id").agg(F.sort_array(F.collect_list(F.struct("step", "x", "y"))).alias("t"))
    other = other.select("clip_id", *[F.col(f"t.{c}").alias(f"t_{c}") for c in ("step", "x", "y")])
    both = own.join(other.hint("merge"), "clip_id", "left").withColumn("at", F.array_position("t_step", F.col("step")).cast("int") - 1)
    gap = lambda c: F.col(c) - F.get(f"t_{c}", F.when(F.col("at") >= 0, F.col("at")))
    out = both.withColumn("error", F.sqrt(F.pow(gap("x"), 2.0) + F.pow(gap("y"), 2.0))).groupBy("clip_id").agg(*_path_aggregates(), F.avg("error").alias("ade_meters"), F.count("error").alias("n_joined"))
    return _with_features(out, dt, "ade_meters", "n_joined")


def displacement_error(pred: DataFrame, truth: DataFrame) -> DataFrame:
    """Mean planar distance of prediction to ground truth: (clip_id, ade_meters, n_joined) of clips that have a common step."""
    rows, _ = _stacked(pred, truth)
    pairs = rows.groupBy("clip_id").agg(F.avg("error").alias("ade_meters"), F.count(F.when(F.col("met"), 1)).alias("n_joined"))
    return pairs.where("n_joined > 0")


_SIDES = (("p", 0), ("g", 1))
_SPANS = [f"n{name}{end}" for name, _ in _SIDES for end in ("", "_lo", "_hi")]


def _stacked(pred: DataFrame, truth: DataFrame) -> tuple[DataFrame, WindowSpec]:
    """Both tables' rows in one order by step: prediction (side 0) before truth (side 1), each with what it meets.

    met: a row of the truth right after one of the prediction with its step; error: their distance; again: a step that
    its side has twice. Such a step is one pair, the prediction's largest point (by x, then y) with the truth's smallest.
    With waypoints partitioned by clip_id neither table is shuffled again, one sort serves both, and no side can be
    taken for small enough to broadcast.
    """
    side = lambda df, n: df.select("clip_id", "step", F.lit(n).alias("side"), "x", "y")
    w = Window.partitionBy("clip_id").orderBy("step", "side", "x", "y")
    before = {f"{c}_before": F.lag(c).over(w) for c in ("step", "side", "x", "y")}
    rows = side(pred, 0).unionByName(side(truth, 1)).withColumns(before)
    same = F.col("step") == F.col("step_before")
    met = same & (F.col("side") > F.col("side_before"))
    error = F.sqrt(F.pow(F.col("x") - F.col("x_before"), 2.0) + F.pow(F.col("y") - F.col("y_before"), 2.0))
    return rows.withColumns({"met": met, "error": F.when(met, error), "again": same & (F.col("side") == F.col("side_before"))}), w


def _pair_aggregates() -> list[Column]:
    """ade_meters, n_joined, repeated, and for each side (p, g) its rows n, first step lo and last step hi."""
    spans = []
    for name, n in _SIDES:
        step = F.when(F.col("side") == n, F.col("step"))
        spans += [F.count(step).alias(f"n{name}"), F.min(step).alias(f"n{name}_lo"), F.max(step).alias(f"n{name}_hi")]
    return [F.avg("error").alias("ade_meters"), F.count(F.when(F.col("met"), 1)).alias("n_joined"), F.coalesce(F.max("again"), F.lit(False)).alias("repeated"), *spans]


def compared(pred: DataFrame, truth: DataFrame, dt: float = DT) -> DataFrame:
    """features() of the predictions and their error to the truth, in one pass over both tables: clip_id, n_steps,
    FEATURES, ade_meters, n_joined, repeated (a side has a step twice), and the spans of both sides."""
    rows, w = _stacked(pred, truth)
    own = F.col("side") == 0
    last = F.last(F.when(own, F.struct("x", "y")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("own_before", last)
    distance = F.sqrt(F.pow(F.col("x") - F.col("own_before.x"), 2.0) + F.pow(F.col("y") - F.col("own_before.y"), 2.0))
    rows = rows.withColumn("distance", F.when(own, distance)).withColumn("speed", F.col("distance") / dt)
    out = rows.groupBy("clip_id").agg(*_path_aggregates(own), *_pair_aggregates())
    return _with_features(out, dt, "ade_meters", "n_joined", "repeated", *_SPANS)


def curvature(way: DataFrame) -> DataFrame:
    """Lateral shift beyond a circular arc with the path's own mean curvature: (clip_id, dy, kappa, residual).

    Headings give the curvature; what a vehicle that just follows the road would have moved sideways is taken off.
    Paths of fewer than three points, or that do not move, keep their raw shift.
    """
    w = Window.partitionBy("clip_id").orderBy("step")
    dx, dy = F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w)
    rows = way.withColumns({"s": F.sqrt(F.pow(dx, 2.0) + F.pow(dy, 2.0)), "theta": F.atan2(dy, dx)})
    turn = F.col("theta") - F.lag("theta").over(w)
    full = 2 * 3.141592653589793
    rows = rows.withColumn("turn", turn - full * F.floor((turn + full / 2) / full))
    moved = F.when(F.col("s").isNotNull(), F.col("step"))
    agg = rows.groupBy("clip_id").agg(
        F.count("*").alias("n"), F.sum("s").alias("S"), F.sum("turn").alias("turned"), F.min_by("s", moved).alias("s1"), F.max_by("s", moved).alias("s2"), F.min_by("theta", moved).alias("th"), (F.max_by("y", "step") - F.min_by("y", "step")).alias("dy")
    )
    kappa = F.col("turned") / F.nullif(F.col("S") - (F.col("s1") + F.col("s2")) / 2, F.lit(0.0))
    agg = agg.withColumn("kappa", F.when((F.col("n") < 3) | (F.col("S") < 1e-6), 0.0).otherwise(F.coalesce(kappa, F.lit(0.0))))
    start = F.col("th") - F.col("kappa") * F.col("s1") / 2
    arc = F.when(F.abs("kappa") < 1e-9, F.col("S") * F.sin(start)).otherwise((F.cos(start) - F.cos(start + F.col("kappa") * F.col("S"))) / F.when(F.abs("kappa") < 1e-9, 1.0).otherwise(F.col("kappa")))
    return agg.select("clip_id", "dy", "kappa", F.when((F.col("n") < 3) | (F.col("S") < 1e-6), F.col("dy")).otherwise(F.col("dy") - arc).alias("residual"))
