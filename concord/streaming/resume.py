"""Resumable scoring: batch after batch until nothing remains, or as a stream of newly arriving clips."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from concord.operators.score import score_packed, score_with_errors
from concord.sources.io import ARRIVALS, EVAL_CLIPS, stored
from concord.sources.log import BatchLog

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def done_ids(results: DataFrame, retry_errors: bool = False) -> DataFrame:
    """Clips that have a row already; with retry_errors those that failed are open again."""
    rows = results.where("error is null") if retry_errors else results
    return rows.select("clip_id").distinct()


#: Up to so many clips Spark's limit takes from an order, all of them in one task.
AT_ONCE = 10_000


def _first(clips: DataFrame, n: int) -> DataFrame:
    """The first n clips in order, however many: they are dealt by ranges of the order and counted, whole ranges are taken as they lie,
    and only the range that holds the n-th is sorted."""
    if n <= AT_ONCE:
        return clips.orderBy("ord", "clip_id").limit(n)
    dealt = stored(clips.repartitionByRange("ord", "clip_id").withColumn("_range", F.spark_partition_id()), "ranges")
    before, last = 0, None
    for r in dealt.groupBy("_range").count().orderBy("_range").collect():  # one row a partition
        if before + r["count"] > n:
            last = r["_range"]
            break
        before += r["count"]
    if last is None:
        return dealt.drop("_range")
    whole = dealt.where(F.col("_range") < last)
    return whole.union(dealt.where(F.col("_range") == last).orderBy("ord", "clip_id").limit(n - before)).drop("_range")


def next_batch(clips: DataFrame, done: DataFrame, n: int = 400) -> DataFrame:
    """The first n open clips in order."""
    open_clips = clips.join(done.select("clip_id").distinct(), "clip_id", "left_anti")
    return _first(open_clips, n)


def next_after(clips: DataFrame, mark: dict | None, n: int = 400) -> DataFrame:
    """The first n clips in order beyond those up to mark: no id of what is done is read."""
    if mark is not None and mark["ord"] is not None:
        after = (F.col("ord") > mark["ord"]) | ((F.col("ord") == mark["ord"]) & (F.col("clip_id") > mark["clip_id"]))
        clips = clips.where(after)
    return _first(clips, n)


def progress(clips: DataFrame, done: DataFrame, n: int = 400) -> DataFrame:
    """total, done, remaining and the size of the next batch, in one pass."""
    marked = clips.join(done.select("clip_id", F.lit(True).alias("d")).distinct(), "clip_id", "left")
    rows = marked.agg(F.count("*").alias("total"), F.count("d").alias("done"))
    left = F.col("total") - F.col("done")
    return rows.withColumns({"remaining": left, "this_batch": F.least(left, F.lit(n).cast("long")), "after": left - F.least(left, F.lit(n).cast("long"))})


def run_batch(
    spark: SparkSession, clips: DataFrame, reasoning: DataFrame, predictions: DataFrame, truth: DataFrame, out: str, n: int = 400, retry_errors: bool = False, retry_before: int | None = None
) -> int:
    """Score the next n clips as one batch of the log at out; the number of clips scored.

    Clips are taken in order beyond the mark that the last record has. Only where none are left there, those that have no row yet
    (clips that came late, before the mark) are looked for by their ids, and with retry_errors those whose newest row
    is an error, of batches before retry_before if that is set.
    """
    log = BatchLog(spark, out)
    last = log.last()
    batch = next_after(clips, last, n).persist()
    try:
        count = batch.count()
        if not count and last is not None:
            batch.unpersist()
            done = log.read().withColumn("error", F.when(F.col("batch") < retry_before, F.col("error"))) if retry_before is not None else log.read()
            batch = next_batch(clips, done_ids(done, retry_errors), n).persist()
            count = batch.count()
        if count:
            number = last["batch"] + 1 if last else 0
            top = batch.agg(F.max(F.struct("ord", "clip_id")).alias("m")).first()["m"]
            mark = max((top["ord"], top["clip_id"]), (last["ord"], last["clip_id"]) if last else (top["ord"], top["clip_id"]))
            log.write(score_with_errors(batch, reasoning, predictions, truth), number)
            log.commit(number, rows=count, ord=mark[0], clip_id=mark[1])
    finally:
        batch.unpersist()
    return count


def run_until_done(
    spark: SparkSession, clips: DataFrame, reasoning: DataFrame, predictions: DataFrame, truth: DataFrame, out: str, n: int = 400, retry_errors: bool = False, most: int | None = None
) -> list[int]:
    """Batch after batch until nothing remains, or `most` batches; their sizes. With retry_errors, clips that had failed before this run are
    tried once more in it. Killed at any point, it is simply called again."""
    last = BatchLog(spark, out).last()
    before = last["batch"] + 1 if last else 0
    sizes: list[int] = []
    while most is None or len(sizes) < most:
        size = run_batch(spark, clips, reasoning, predictions, truth, out, n, retry_errors, before if retry_errors else None)
        if not size:
            break
        sizes.append(size)
    return sizes


@contextmanager
def _rocksdb(spark: SparkSession):
    """Streams that are started here keep their keys in RocksDB, on disk, not in the executors' heaps."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


def stream(spark: SparkSession, clips_dir: str, reasoning: DataFrame, predictions: DataFrame, truth: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Score clips from files that appear in clips_dir, as batches of the log at out; each clip is taken once, also over restarts.

    Clips seen are keyed state of the stream, dealt by clip: results are never read again. A micro-batch that is run again after a
    failure writes over its own folder. Texts and paths are joined from their tables; where they come with the
    clips, `stream_packed` reads nothing else.
    """
    arriving = spark.readStream.schema(EVAL_CLIPS).parquet(clips_dir).dropDuplicates(["clip_id"])

    def score(batch: DataFrame, number: int) -> None:
        log = BatchLog(batch.sparkSession, out)
        log.write(score_with_errors(batch, reasoning, predictions, truth), number)
        log.commit(number)

    with _rocksdb(spark):
        return arriving.writeStream.foreachBatch(score).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_packed(spark: SparkSession, source: str, out: str, checkpoint: str, files: int | None = None, remember: str | None = None) -> StreamingQuery:
    """Score clips that arrive with their text and paths (ARRIVALS), a row each; out is a table that Spark's file sink keeps.

    A micro-batch reads its files and the state of its own clips, nothing else, so that its time doesn't grow with
    what is done. A clip that is delivered again is dropped: for good, or with `remember` (such as "30 days") as long
    after it `arrived`, which bounds the state. files: read by a micro-batch at most.
    """
    reader = spark.readStream.schema(ARRIVALS)
    arriving = (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(source)
    new = arriving.withWatermark("arrived", remember).dropDuplicatesWithinWatermark(["clip_id"]) if remember else arriving.dropDuplicates(["clip_id"])
    with _rocksdb(spark):
        return score_packed(new).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
