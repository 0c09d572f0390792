"""Results in numbered batches with a log: a batch counts from the moment its record is in the log, and not before.

A batch is written to a folder of its own and then recorded by one rename that fails if the record is there already. A run
that is killed before the record leaves a folder that no reader looks at and that the next run writes over; one that
is killed after it has lost nothing. So no batch is lost, none counts twice, and no reader sees half of one.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from concord.sources.io import RESULTS, rename_once


class BatchLog:
    def __init__(self, spark: SparkSession, path: str, schema: T.StructType = RESULTS) -> None:
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self._conf, self._jvm = spark._jsc.hadoopConfiguration(), spark._jvm

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/_log/{name}")

    def _files(self):
        return self._at("x").getFileSystem(self._conf)

    def records(self) -> list[int]:
        """Numbers of the recorded batches, in order."""
        fs, folder = self._files(), self._at("x").getParent()
        if not fs.exists(folder):
            return []
        return sorted(int(s.getPath().getName()[:-5]) for s in fs.listStatus(folder) if s.getPath().getName().endswith(".json"))

    def record(self, batch: int) -> dict:
        stream = self._files().open(self._at(f"{batch:012d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def last(self) -> dict | None:
        """The newest record."""
        known = self.records()
        return self.record(known[-1]) if known else None

    def write(self, rows: DataFrame, batch: int) -> None:
        """The batch's rows, over what a run that was killed may have left of it."""
        rows.select([F.col(f.name).cast(f.dataType) for f in self.schema]).write.mode("overwrite").parquet(f"{self.path}/batch={batch}")

    def commit(self, batch: int, **facts) -> bool:
        """Record the batch; False if it was recorded before."""
        fs, name = self._files(), f"{batch:012d}.json"
        draft = self._at(f".{name}.{uuid.uuid4().hex}")
        out = fs.create(draft, True)
        out.write(bytearray(json.dumps({"batch": batch, **facts}).encode()))
        out.close()
        return rename_once(self.spark, draft.toString(), self._at(name).toString())

    def read(self) -> DataFrame:
        """Rows of the recorded batches, with their batch."""
        known = self.records()
        schema = T.StructType([*self.schema.fields, T.StructField("batch", T.LongType())])
        if not known:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).option("basePath", self.path).parquet(self.path)
        gaps = len(known) != known[-1] - known[0] + 1
        return rows.where(F.col("batch").isin(known) if gaps else F.col("batch").between(known[0], known[-1]))

    def newest(self, key: str = "clip_id") -> DataFrame:
        """The row of its last batch for each key: where a clip was scored again, the later row counts."""
        row = F.max_by(F.struct(*[f.name for f in self.schema]), "batch")
        return self.read().groupBy(key).agg(row.alias("row")).select("row.*")
