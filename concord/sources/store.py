"""Derived tables that are kept by what they were made of: the same inputs under the same rules are computed once."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from concord.functions.rules import fingerprint
from concord.sources.io import rename_once, shared_dir


class Store:
    """Tables in a folder that driver and executors share, named by a fingerprint of inputs and rules.

    An input counts as the same if its query is, over files of the same paths, lengths and times. A table appears by one rename
    when it is whole; of two that make the same one at a time, the second takes the first's.
    """

    def __init__(self, spark: SparkSession, path: str | None = None) -> None:
        self.spark, self.path = spark, (path or f"{shared_dir(spark)}/store").rstrip("/")
        self._path, self._conf = spark._jvm.org.apache.hadoop.fs.Path, spark._jsc.hadoopConfiguration()

    def _fs(self):
        return self._path(self.path).getFileSystem(self._conf)

    def files(self, inputs: list[DataFrame]) -> list[tuple[str, int, int]]:
        """Path, length and time of every file that the inputs read."""
        names = sorted({name for df in inputs for name in df.inputFiles()})
        if not names:
            return []
        fs, found = self._path(names[0]).getFileSystem(self._conf), []
        for name in names:
            status = fs.getFileStatus(self._path(name))
            found.append((name, status.getLen(), status.getModificationTime()))
        return found

    def name(self, kind: str, inputs: list[DataFrame], rules: str) -> str:
        return f"{kind}-{fingerprint(kind, rules, [df.semanticHash() for df in inputs], self.files(inputs))}"

    def get(self, kind: str, inputs: list[DataFrame], rules: str, make: Callable[[], DataFrame]) -> DataFrame:
        """The table of that kind for these inputs and rules (a fingerprint): as it is kept, or made now and kept."""
        target = f"{self.path}/{self.name(kind, inputs, rules)}"
        if not self._fs().exists(self._path(target)):
            draft = f"{self.path}/.draft-{uuid.uuid4().hex}"
            make().write.parquet(draft)
            rename_once(self.spark, draft, target)
        return self.spark.read.parquet(target)

    def kept(self) -> dict[str, int]:
        """Names of the tables kept, with the time (ms) at which each was made."""
        fs, folder = self._fs(), self._path(self.path)
        if not fs.exists(folder):
            return {}
        return {s.getPath().getName(): s.getModificationTime() for s in fs.listStatus(folder)}

    def expire(self, seconds: float) -> list[str]:
        """Remove tables, and drafts that were given up, made longer ago than that; their names. Not for those still being read."""
        fs, limit, gone = self._fs(), (time.time() - seconds) * 1000, []
        for name, made in sorted(self.kept().items()):
            if made <= limit:
                fs.delete(self._path(f"{self.path}/{name}"), True)
                gone.append(name)
        return gone
