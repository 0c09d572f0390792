"""Schemas, readers and sinks of the study's tables."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_d = {"s": T.StringType(), "l": T.LongType(), "i": T.IntegerType(), "d": T.DoubleType(), "b": T.BooleanType()}


def _schema(text: str) -> T.StructType:
    return T.StructType([T.StructField(n, _d[k]) for n, k in (x.split(":") for x in text.split())])


CLIP_INDEX = _schema("clip_id:s split:s clip_is_valid:b")
METADATA = _schema("clip_id:s country:s month:i hour_of_day:i platform_class:s")
EGOMOTION = _schema("clip_id:s ts_us:l")
EVAL_CLIPS = _schema("clip_id:s t0_us:l hour_bucket:s country:s ord:l")
WAYPOINTS = _schema("clip_id:s step:i x:d y:d z:d")
POINTS = T.ArrayType(_schema("x:d y:d z:d"))
#: Clips that arrive with their text and both paths.
ARRIVALS = T.StructType([*_schema("clip_id:s t0_us:l scenario_type:s cot_text:s").fields, T.StructField("traj", POINTS), T.StructField("truth", POINTS), T.StructField("arrived", T.TimestampType())])
RESULTS = _schema(
    "clip_id:s t0_us:l scenario_type:s cot_text:s long_intent:s lat_intent:s long_execution:s lat_execution:s "
    "long_match:d lat_match:d mismatch_score:d mismatch_type:s confidence:d ade_meters:d lat_shift_m:d mean_speed_ms:d error:s"
)


def read_parquet(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    return (spark.read.schema(schema) if schema else spark.read).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, in whatever store it names."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p))


_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, a temporary folder if driver and executors are one process."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        master, app = spark.sparkContext.master, spark.sparkContext.applicationId
        if master.partition("[")[0] != "local":
            raise RuntimeError(f"spark.checkpoint.dir is unset: on {master} stored tables need a folder that all executors share")
        if app not in _own_dirs:
            _own_dirs[app] = tempfile.mkdtemp(prefix="concord-")
        shared = _own_dirs[app]
    return shared.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def rename_once(spark: SparkSession, source: str, target: str) -> bool:
    """Move a file or folder in one step; False, with the source removed, if the target is there already."""
    path, conf = spark._jvm.org.apache.hadoop.fs.Path, spark._jsc.hadoopConfiguration()
    fs = path(target).getFileSystem(conf)
    none = spark.sparkContext._gateway.new_array(getattr(spark._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf).rename(path(source), path(target), none)
    except Exception as e:
        fs.delete(path(source), True)
        if "FileAlreadyExists" not in str(e):
            raise
        return False
    return True


def stored(df: DataFrame, name: str = "scores") -> DataFrame:
    """df written to the folder that driver and executors share, and read back.

    Classified texts are stored before anything filters on them: the filter would otherwise be pushed below the
    classification and evaluate every pattern again.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def read_results(spark: SparkSession, path: str, csv: bool = False) -> DataFrame:
    """Stored results, typed; an empty table if there are none yet. CSV may hold texts with line ends and quotes; it
    knows no empty texts: they read as null."""
    if not exists(spark, path):
        return spark.createDataFrame([], RESULTS)
    reader = spark.read.schema(RESULTS)
    return reader.option("header", True).option("multiLine", True).option("escape", '"').csv(path) if csv else reader.parquet(path)


def append_results(df: DataFrame, path: str, csv: bool = False) -> None:
    rows = df.select([F.col(f.name).cast(f.dataType) for f in RESULTS])
    if csv:
        rows.write.mode("append").option("header", True).option("escape", '"').csv(path)
    else:
        rows.write.mode("append").parquet(path)


#: What a stored row must be, by the reason for which it is turned away otherwise.
CHECKS = {
    "no clip": "clip_id is null",
    "score out of range": "not coalesce(mismatch_score between 0 and 1, true)",
    "match out of range": "not coalesce(long_match between 0 and 1 and lat_match between 0 and 1, true)",
    "score of an error": "error is not null and mismatch_score is not null",
}


def checked_results(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Results from CSV that others may have written: the rows that are sound, and (line, file, reason) of the others.

    Lines that don't fit the schema are kept whole as they stand (`malformed`); rows that fit it are held against CHECKS.
    """
    corrupt = T.StructType([*RESULTS.fields, T.StructField("_corrupt", T.StringType())])
    reader = spark.read.schema(corrupt).option("header", True).option("multiLine", True).option("escape", '"').option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt")
    reason = F.when(F.col("_corrupt").isNotNull(), "malformed")
    for name, broken in CHECKS.items():
        reason = reason.when(F.expr(broken), name)
    rows = reader.csv(path).withColumns({"reason": reason, "file": F.input_file_name()})
    line = F.coalesce("_corrupt", F.to_csv(F.struct(*RESULTS.fieldNames())))
    return rows.where("reason is null").select(*RESULTS.fieldNames()), rows.where("reason is not null").select(line.alias("line"), "file", "reason")


def quarantine(rejected: DataFrame, path: str) -> None:
    """Rejected lines are added to a table, a folder for each reason."""
    rejected.write.mode("append").partitionBy("reason").parquet(path)


def write_run(df: DataFrame, path: str, run: str, timestamp: str) -> None:
    """A run's rows over those it had, other runs' left as they are; then the pointer to the last complete run is set to it."""
    df.withColumn("run", F.lit(run)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run").parquet(path)
    set_latest(df.sparkSession, path, run, timestamp)


def set_latest(spark: SparkSession, path: str, run: str, timestamp: str) -> None:
    """Point to a run as the last complete one, by a rename over the pointer before."""
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    fs = hadoop.Path(path).getFileSystem(conf)
    draft = hadoop.Path(f"{path}/_latest-{uuid.uuid4().hex}")
    out = fs.create(draft, True)
    out.write(bytearray(json.dumps({"run": run, "timestamp": timestamp}).encode()))
    out.close()
    rename = getattr(hadoop, "Options$Rename")
    over = spark.sparkContext._gateway.new_array(rename, 1)
    over[0] = rename.OVERWRITE
    hadoop.FileContext.getFileContext(fs.getUri(), conf).rename(draft, hadoop.Path(f"{path}/_latest.json"), over)


def latest_run(spark: SparkSession, path: str) -> tuple[DataFrame, dict] | None:
    """The rows of the last complete run, and which it is (run, timestamp); None before the first."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_latest.json")
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    try:
        which = json.loads(bytes(stream.readAllBytes()))
    finally:
        stream.close()
    return spark.read.option("basePath", path).parquet(f"{path}/run={which['run']}").drop("run"), which


def write_bucketed(df: DataFrame, table: str, path: str, buckets: int) -> None:
    """Waypoints as a table with a file for each bucket of clips, sorted: later windows, aggregations and joins by clip find their rows
    together. Tables that are to be joined take the same number of buckets (or multiples)."""
    rows = df.repartition(buckets, "clip_id").write.mode("overwrite").option("path", path)
    rows.bucketBy(buckets, "clip_id").sortBy("clip_id", "step").format("parquet").saveAsTable(table)


def write_checkpoint(df: DataFrame, path: str, run: str | None = None) -> None:
    """The rows so far, over those of the same run; each run has a folder of its own."""
    df.write.mode("overwrite").parquet(f"{path}/run={run}" if run else path)


def write_eval_set(clips: DataFrame, path: str) -> None:
    clips.write.mode("overwrite").parquet(path)


def write_rescored(rescored: DataFrame, columns: list[str], path: str) -> None:
    """Rescored rows in the column order of their input."""
    rescored.select(*columns).write.mode("overwrite").parquet(path)


def write_summary(summary: DataFrame, path: str) -> None:
    """One row of JSON that keeps its nulls."""
    summary.coalesce(1).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def eval_set(spark: SparkSession, paths: list[str], example: tuple = ("example", 5_100_000, "example", "unknown", 0)) -> DataFrame:
    """The first of the files that exists, else one example clip."""
    for path in paths:
        if exists(spark, path):
            return spark.read.parquet(path)
    return spark.createDataFrame([example], EVAL_CLIPS)


def profile(df: DataFrame) -> tuple[int, list[str]]:
    return df.count(), df.columns


def path_inventory(paths: DataFrame) -> DataFrame:
    """Files by the first segment of their path, in order."""
    return paths.groupBy(F.split("path", "/")[0].alias("top")).agg(F.count("*").alias("n_files")).orderBy("top")


def manifest(selection: DataFrame, sensors: list[str]) -> DataFrame:
    """One row: the chosen clips with their scenarios, and the sensors (a download request: as long as its sample)."""
    rows = F.sort_array(F.collect_list(F.struct("clip_id", "scenario")))
    return selection.agg(rows.alias("clips")).withColumn("sensors", F.array(*[F.lit(s) for s in sensors]))
