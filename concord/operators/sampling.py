"""Drawing clips: eligibility, strata, quotas, scenarios. Draws are ranks by a seeded hash, so they can be repeated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from concord.functions.rules import EGO_MAX_US, EGO_MIN_US, HOUR_BUCKETS, SCENARIO_HOURS, T0_DEFAULT, T0_HIGH, T0_LOW


def order_key(seed: int, *cols: str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in cols]))


def draw_t0(seed: int = 99, low: int = T0_LOW, high: int = T0_HIGH) -> Column:
    """Start times over [low, high), one for each clip_id and seed."""
    return (F.lit(low) + F.conv(F.substring(order_key(seed, "clip_id"), 1, 8), 16, 10).cast("long") % (high - low)).cast("long")


def hour_bucket(hour: Column) -> Column:
    out = F.when(hour.isNull(), None)
    for name, lo, hi in HOUR_BUCKETS:
        out = out.when((hour >= lo) & (hour < hi), name)
    return out


def clip_metadata(index: DataFrame, metadata: DataFrame) -> DataFrame:
    """index with its metadata where there is some; columns that clash are an error, as they are when merging by hand."""
    clash = (set(index.columns) & set(metadata.columns)) - {"clip_id"}
    if clash:
        raise ValueError(f"columns in both tables: {sorted(clash)}")
    return index.join(metadata, "clip_id", "left")


def eligible(clips: DataFrame, split: str = "test") -> DataFrame:
    return clips.where((F.col("split") == split) & F.col("clip_is_valid"))


def coverage(ego: DataFrame) -> DataFrame:
    return ego.groupBy("clip_id").agg(F.min("ts_us").alias("ego_min"), F.max("ts_us").alias("ego_max"))


def safe_window(covered: DataFrame, low: int = EGO_MIN_US, high: int = EGO_MAX_US) -> DataFrame:
    return covered.where((F.col("ego_max") >= high) & (F.col("ego_min") <= low))


#: Up to so many rows of a stratum Spark's own limit on ranks cuts down partitions before they are shuffled.
RANKED = 1000


def near_first(df: DataFrame, n: int, seed: int, stratum: str, *salt: str) -> DataFrame:
    """Rows of each stratum that hold its first n by hash, and few more (an eighth, about), however many there are in all.

    Hashes are counted in bins, eight to a doubling, so that the bins near the first are as fine as any n needs: a table of strata
    x 481 counts at most, added up in each task before it is shuffled. The bin that the n-th falls into is the cut, exact
    for any hashes; only rows up to it go on. Strata are few and fixed (hours, or one): their cuts are broadcast.
    """
    rank = F.conv(F.substring(order_key(seed, "clip_id", *salt), 1, 15), 16, 10).cast("long")
    rows = df.withColumn("_bin", F.floor(8 * F.log2(rank.cast("double") + 1)))
    upto = F.sum("_n").over(Window.partitionBy(stratum).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1))
    bins = rows.groupBy(stratum, "_bin").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(upto, F.lit(0)))
    cuts = bins.where(F.col("_before") < n).groupBy(F.col(stratum).alias("_stratum")).agg(F.max("_bin").alias("_cut"))
    near = rows.join(F.broadcast(cuts), (F.col(stratum) == F.col("_stratum")) & (F.col("_bin") <= F.col("_cut")))
    return near.select(*df.columns)


def _first(df: DataFrame, n: int, seed: int, stratum: str | None = None, *salt: str) -> DataFrame:
    """The first n rows of each stratum by hash."""
    order = [order_key(seed, "clip_id", *salt), F.col("clip_id")]
    if n > RANKED:
        if stratum is None:
            return near_first(df.withColumn("_all", F.lit(0)), n, seed, "_all", *salt).drop("_all").orderBy(*order).limit(n)
        df = near_first(df, n, seed, stratum, *salt)
    elif stratum is None:
        return df.orderBy(*order).limit(n)
    rank = F.row_number().over(Window.partitionBy(stratum).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def eval_rows(df: DataFrame, seed: int) -> DataFrame:
    """(clip_id, t0_us, hour_bucket, country) of drawn clips."""
    country = F.coalesce("country", F.lit("unknown")) if "country" in df.columns else F.lit("unknown")
    return df.select("clip_id", draw_t0(seed).alias("t0_us"), "hour_bucket", country.alias("country"))


def stratified_sample(clips: DataFrame, n: int = 2000, seed: int = 99) -> DataFrame:
    """n // 5 clips of each hour bucket, or all where there are fewer; clips without a bucket are left out."""
    rows = clips.withColumn("hour_bucket", hour_bucket(F.col("hour_of_day"))).where("hour_bucket is not null")
    return eval_rows(_first(rows, n // len(HOUR_BUCKETS), seed, "hour_bucket"), seed)


def simple_sample(clips: DataFrame, n: int = 2000, seed: int = 99) -> DataFrame:
    """Without hours: one stratum called `all`."""
    return eval_rows(_first(clips.withColumn("hour_bucket", F.lit("all")), n, seed), seed)


def stratified_candidates(clips: DataFrame, n: int = 2000, oversample: int = 3, seed: int = 99, strict: bool = True) -> DataFrame:
    """max(1, n * oversample // 5) candidates of each bucket, n * oversample together at most.

    strict: a bucket with fewer clips is an error (one count over at most five buckets decides it).
    """
    each = max(1, n * oversample // len(HOUR_BUCKETS))
    rows = clips.withColumn("hour_bucket", hour_bucket(F.col("hour_of_day"))).where("hour_bucket is not null")
    if strict:
        small = rows.groupBy("hour_bucket").count().where(F.col("count") < each).orderBy("hour_bucket").collect()
        if small:
            raise ValueError(f"buckets with fewer than {each} clips: {[(r[0], r[1]) for r in small]}")
    drawn = _first(rows, each, seed, "hour_bucket")
    return drawn if each * len(HOUR_BUCKETS) <= n * oversample else _first(drawn, n * oversample, seed + 1)


def quota_fill(candidates: DataFrame, ego: DataFrame, n: int = 2000, seed: int = 99, validate: bool = True) -> DataFrame:
    """n // 5 of each bucket among the candidates whose ego-motion covers the window; fewer if they run out."""
    if validate:
        candidates = candidates.join(safe_window(coverage(ego)).select("clip_id"), "clip_id", "left_semi")
    return eval_rows(_first(candidates, n // len(HOUR_BUCKETS), seed + 2, "hour_bucket"), seed)


def in_scenario(name: str, hour: Column) -> Column:
    hours = SCENARIO_HOURS.get(name)
    return F.lit(True) if hours is None else F.coalesce(hour.isin(*hours), F.lit(False))


def scenario_sample(clips: DataFrame, scenarios: list[str], n: int, seed: int = 42) -> DataFrame:
    """n // k clips of each scenario, drawn apart; a clip may come up for several."""
    parts = [_first(clips.where(in_scenario(s, F.col("hour_of_day"))).select("clip_id", F.lit(s).alias("scenario")), n // len(scenarios), seed, None, "scenario") for s in scenarios]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def shuffled(clips: DataFrame, seed: int = 99) -> DataFrame:
    """clips with `ord`, their place in a random order; later batches read on from it."""
    rank = F.conv(F.substring(order_key(seed, "clip_id"), 1, 15), 16, 10).cast("long")
    return clips.withColumn("ord", rank)


def normalize_clips(clips: DataFrame) -> DataFrame:
    """clip_id, t0_us (5,100,000 where there is none) and scenario_type, from whichever of its columns there is."""
    t0 = F.coalesce(F.col("t0_us").cast("long"), F.lit(T0_DEFAULT).cast("long")) if "t0_us" in clips.columns else F.lit(T0_DEFAULT).cast("long")
    source = next((c for c in ("hour_bucket", "scenario_type") if c in clips.columns), None)
    return clips.withColumns({"t0_us": t0, "scenario_type": F.col(source) if source else F.lit("unknown")})


def limit_clips(clips: DataFrame, n: int | None) -> DataFrame:
    """The first n clips in order; no limit for 0 or None."""
    return clips.orderBy("ord", "clip_id").limit(n) if n else clips


def eval_set_profile(clips: DataFrame) -> DataFrame:
    us = lambda f: (f("t0_us") / 1e6)
    return clips.groupBy("hour_bucket").agg(F.count("*").alias("n"), us(F.min).alias("t0_min_s"), us(F.max).alias("t0_max_s"))
