"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where that is unset, a temporary one in local mode."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not master.partition("[")[0] == "local":
        raise RuntimeError(f"spark.checkpoint.dir is unset: on {master} tables between stages need a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = tempfile.mkdtemp(prefix="concord-")
    return _own_dirs[app]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str, into: list[str] | None = None, by: str | None = None) -> DataFrame:
    """Write df as a table in the shared folder, partitioned `by` a column, and read it back: later stages start from
    there, not from its lineage.

    The shuffle files of the write are released as soon as it is done; a lost executor costs nothing, as the table
    is in shared storage. Its path is added to `into`, for tables that `discard` removes once nothing reads them.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    conf = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(conf, None)
    spark.conf.set(conf, "true")
    try:
        (df.write.partitionBy(by) if by else df.write).parquet(path)
    finally:
        if before is None:
            spark.conf.unset(conf)
        else:
            spark.conf.set(conf, before)
    if into is not None:
        into.append(path)
    return spark.read.schema(df.schema).parquet(path).select(df.columns)


def discard(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    paths.clear()


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def held_out(doc_id, modulus: int, remainder: int):
    """crc32(doc_id as text) mod modulus = remainder; a null doc_id counts as held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == remainder, F.lit(True))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that df has not, whatever their case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def thinned(share: float, *keys: str) -> Column:
    """Whether a row is among the `share` of all that a hash of its keys picks, however small the share."""
    return F.lit(True) if share >= 1 else F.shiftrightunsigned(F.xxhash64(*keys, F.lit("fit")), 1) < max(1, int(share * 2**63))


def runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Batches sorted by key, regrouped: each table holds one or more whole keys, never part of one."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        k = batch.column(key).to_numpy(zero_copy_only=False)
        last = int(np.searchsorted(k, k[-1])) if k.dtype != object else next(i for i in range(len(k)) if k[i] == k[-1])
        if last:  # everything before the last key is whole
            yield pa.Table.from_batches([*rest, batch.slice(0, last)])
            rest = [batch.slice(last)]
        elif rest and rest[-1].column(key)[-1] != batch.column(key)[0]:
            yield pa.Table.from_batches(rest)
            rest = [batch]
        else:
            rest.append(batch)
    if rest:
        yield pa.Table.from_batches(rest)


def bounds(key: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal values in a sorted array, with its length as the last entry."""
    if not len(key):
        return np.zeros(1, dtype=np.int64)
    return np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]])


def by_key(df: DataFrame, key: str, fn: Callable, schema: str) -> DataFrame:
    """fn over whole keys: repartitioned and sorted by key, read batch by batch (a cheap grouped map for small groups)."""
    n = partitions(df.sparkSession)
    return df.repartition(n, key).sortWithinPartitions(key).mapInArrow(fn, schema)
