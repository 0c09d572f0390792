"""The study's tables, derived from the order tables with closed formulas (so that SQL can derive the same)."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from concord.functions import kinematics
from concord.operators import sampling

# The texts of the fixture, by number; the last is null.
PHRASES = (
    "Nudge to the left to increase clearance from the construction cones.",
    "Stop for the pedestrian crossing ahead.",
    "Slow down and stay in the current lane.",
    "Accelerate to merge into the left lane.",
    "Proceed through the intersection.",
    "Come to a full stop at the red light.",
    "Keep a safe distance and hold the lane.",
    "Yield and adapt speed for the left-hand curve.",
    "Move to the left lane.",
    "Change to the right lane and speed up.",
    "Emergency brake, brake hard.",
    "Do not stop, continue and keep speed.",
    "Resume speed and turn right.",
    "Shift slightly to the right, then maintain speed.",
    "Split to the right at the fork and decelerate.",
    "Maintain following distance in the same lane.",
    "The car stopped earlier.",
    "Clear weather, dry road.",
    "Steer right around the right curve and coast.",
    "Cruise and follow the road.",
    "Lane change to the left, accelerating.",
    "STOP now. Stop. Then accelerate.",
    "",
    None,
)
SEED = 99
#: Event ids of a block.
BLOCK = 65_536
#: Waypoints of a clip, and how many of a table a task takes.
STEPS = 64
PATH_ROWS = 2_000_000


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def orders(self) -> DataFrame:
        return self.read("orders").select(F.concat(F.lit("c"), F.col("o_orderkey").cast("string")).alias("clip_id"), F.col("o_orderkey").alias("ok"), F.col("o_custkey").alias("ck"), "o_orderdate", "o_orderpriority")

    def index(self) -> DataFrame:
        k = F.col("ok") % 10
        return self.orders().select("clip_id", F.when(k < 3, "test").when(k == 3, "val").otherwise("train").alias("split"), (F.col("ok") % 13 != 0).alias("clip_is_valid"))

    def metadata(self) -> DataFrame:
        customer, nation = self.read("customer"), self.read("nation")
        named = customer.join(nation, customer["c_nationkey"] == nation["n_nationkey"]).select("c_custkey", F.col("n_name").alias("country"))
        rows = self.orders().where("ok % 17 <> 0").join(named, F.col("ck") == F.col("c_custkey"))
        return rows.select("clip_id", "country", F.month("o_orderdate").alias("month"), ((F.col("ok") * 7 + F.col("ck")) % 25).cast("int").alias("hour_of_day"), F.col("o_orderpriority").alias("platform_class"))

    def egomotion(self) -> DataFrame:
        i = F.explode(F.sequence(F.lit(0).cast("long"), 19 + F.col("ok") % 3)).alias("i")
        return self.orders().select("clip_id", "ok", i).select("clip_id", ((F.col("ok") % 4) * 150000 + F.col("i") * 1000000).alias("ts_us"))

    def reasoning(self) -> DataFrame:
        bank = F.array(*[F.lit(p) if p is not None else F.lit(None).cast("string") for p in PHRASES])
        return self.orders().select("clip_id", F.get(bank, ((F.col("ok") * 5 + F.col("ck")) % 24).cast("int")).alias("cot_text"))

    @cached_property
    def parts(self) -> int:
        """Tasks that waypoints are dealt to, in proportion to their number: Spark, left to itself, goes by the bytes that it shuffles, which are
        orders before they become 64 rows each. Not fewer than its own, so that the other side of a join follows."""
        return max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-self.orders().count() * STEPS // PATH_ROWS))

    def _steps(self, orders: DataFrame | None = None) -> DataFrame:
        """(clip, step): orders are dealt and sorted by clip first, so that their 64 steps need no shuffle afterwards, and sorts meet them in order."""
        rows = (self.orders() if orders is None else orders).select("clip_id", "ok", "ck")
        return rows.repartition(self.parts, "clip_id").sortWithinPartitions("clip_id").select("clip_id", "ok", "ck", F.explode(F.sequence(F.lit(0), F.lit(STEPS - 1))).alias("step"))

    @staticmethod
    def _xy() -> tuple[Column, Column]:
        t = F.col("step") * F.lit(0.1)
        x = (F.col("ck") % 8) * F.lit(2.0) * t + F.lit(0.5) * ((F.col("ok") % 7 - 3) * F.lit(0.21)) * t * t
        y = (F.col("ok") % 11 - 5) * F.lit(0.4) * (F.col("step") / F.lit(63.0))
        return x, y

    def predictions(self, errors: bool = False) -> DataFrame:
        x, y = self._xy()
        rows = self._steps().where("ok % 103 <> 0") if errors else self._steps()
        return rows.select("clip_id", "step", x.alias("x"), y.alias("y"), F.lit(0.0).alias("z"))

    def ground_truth(self, errors: bool = False) -> DataFrame:
        x, y = self._xy()
        rows = self._steps().where("not (ok % 101 = 0 and step = 63)") if errors else self._steps()
        return rows.select("clip_id", "step", (x + (F.col("ok") % 4) * F.lit(0.02) * F.col("step")).alias("x"), (y - (F.col("ok") % 5) * F.lit(0.01) * F.col("step")).alias("y"), F.lit(0.0).alias("z"))

    def arcs(self) -> DataFrame:
        """Paths on circles, half of them with a change of lane."""
        u = F.lit(60.0) * F.col("step") / F.lit(63.0)
        k = F.col("ok") % 4
        radius = F.when(k == 0, 30.0).when(k == 1, 50.0).when(k == 2, 200.0).otherwise(-50.0)
        lane = F.when(F.floor(F.col("ok") / 4) % 2 == 1, F.lit(3.5) * (F.lit(0.5) - F.lit(0.5) * F.cos(F.pi() * u / F.lit(60.0)))).otherwise(0.0)
        rows = self._steps().select("clip_id", "step", u.alias("u"), radius.alias("r"), lane.alias("c")).withColumn("h", F.col("u") / F.col("r"))
        return rows.select("clip_id", "step", (F.col("r") * F.sin("h") - F.col("c") * F.sin("h")).alias("x"), (F.col("r") * (1 - F.cos("h")) + F.col("c") * F.cos("h")).alias("y"), F.lit(0.0).alias("z"))

    def event_paths(self) -> DataFrame:
        """Ragged paths from the running sums of events; a clip is a user's events in a block of ids, so that none is long
        without bound however busy a user is."""
        block = F.floor(F.col("event_id") / BLOCK)
        w = Window.partitionBy("user_id", "block").orderBy("ts", "event_id")
        rows = self.read("events").withColumn("block", block).withColumn("step", F.row_number().over(w) - 1)
        rows = rows.withColumns({"x": F.sum(F.col("value") / 100).over(w), "y": F.sum((F.col("event_id") % 3 - 1) * F.lit(0.11)).over(w)})
        clip = F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("-"), F.col("block").cast("string"))
        return rows.select(clip.alias("clip_id"), F.col("step").cast("int").alias("step"), "x", "y", F.lit(0.0).alias("z"))

    def arrivals(self) -> DataFrame:
        """The events' paths as clips that arrive with a text and a truth; some without a path, some with a truth cut short."""
        user, block = F.substring_index(F.substring("clip_id", 2, 40), "-", 1).cast("long"), F.substring_index("clip_id", "-", -1).cast("long")
        packed = kinematics.pack(self.event_paths().withColumn("x", F.col("x") * 1.013)).withColumns({"user": user, "block": block})
        bank = F.array(*[F.lit(p) if p is not None else F.lit(None).cast("string") for p in PHRASES])
        truth = F.transform("traj", lambda p, i: F.struct((p["x"] + i * F.lit(0.02)).alias("x"), (p["y"] - i * F.lit(0.01)).alias("y"), p["z"].alias("z")))
        short = F.when(F.col("user") % 11 == 0, F.slice(truth, F.lit(1), F.size("traj") - 1)).otherwise(truth)
        return packed.select(
            "clip_id",
            (F.lit(2_000_000) + F.col("user") * 1000).cast("long").alias("t0_us"),
            F.concat(F.lit("s"), F.col("user") % 5).alias("scenario_type"),
            F.get(bank, ((F.col("user") * 5 + F.col("block")) % 24).cast("int")).alias("cot_text"),
            F.when(F.col("user") % 13 != 0, F.col("traj")).alias("traj"),
            short.alias("truth"),
            F.timestamp_seconds(F.lit(1_700_000_000) + F.col("user")).alias("arrived"),
        )

    def packed_paths(self) -> DataFrame:
        """Packed paths from embeddings: the vector as the lateral course."""
        point = lambda v, i: F.struct((i * F.lit(0.1) * (2 + F.col("label"))).alias("x"), (v.cast("double") * 4).alias("y"), F.lit(0.0).alias("z"))
        return self.read("embeddings").select(F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("clip_id"), F.transform("embedding", point).alias("traj"))

    def indexed(self) -> DataFrame:
        return sampling.clip_metadata(self.index(), self.metadata())

    def clips(self) -> DataFrame:
        """The eval set: eligible clips with their bucket, start time and order."""
        rows = sampling.eligible(self.indexed()).withColumn("hour_bucket", sampling.hour_bucket(F.col("hour_of_day")))
        return rows.select("clip_id", sampling.draw_t0(SEED).alias("t0_us"), "hour_bucket", "country", F.substring("clip_id", 2, 20).cast("long").alias("ord"))

    def done(self) -> DataFrame:
        return self.clips().where("ord % 3 = 0").select("clip_id")

    def paths(self) -> DataFrame:
        return self.read("documents").select(F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("path"))
