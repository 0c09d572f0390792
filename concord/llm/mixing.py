"""Mixing sources to target weights by entropy balancing.

Every document gets the rate w that keeps the mixture closest, in relative entropy weighted by tokens, to taking
each document once, under one token constraint a source: sum of w * size over its documents = target. The dual of
that problem is convex and its solution tilts rates exponentially, w = exp(multiplier of its source). Gradient and
Hessian are token sums over the documents; as a document has one source, all documents of a source have one rate, the
Hessian is diagonal, and the sums over the documents are the source's size times that rate. So documents are summed once,
and Newton's iterations run for all sources side by side, in the table of sources.

The sources are a table like any other (their number has no bound): ranked by ranges, joined back to the documents, by
broadcast only if they are few. The driver sees totals.

Rates are then rounded into whole copies. Within buckets of a source (a hash of doc_id, about `bucket` documents each,
so that a large source is many tasks) documents go from the longest to the shortest; each takes the whole number of
copies next to its rate that brings the words taken so far closest to the words due so far, so that the error of a
bucket is at most about its shortest documents. Nothing is random: reruns agree.

Defined cases: a null text or one without words has size 0 and takes 0; a null source is a source of its own, last
in order; a source of size 0 has target 0; no document takes more than `cap` copies; repeated rows each take their
own copies; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from concord.llm.common import bounds, by_key, cut, discard, partitions, runs

WEIGHTS = (5.0, 2.0, 1.0)
CAP = 3.0
#: Sources that are broadcast at most (some 100 bytes each); beyond, they are joined by a shuffle.
MAX_BROADCAST = 50_000


def ranked(sources: DataFrame, into: list[str] | None = None) -> DataFrame:
    """sources (s, ...) with `rank`: their place by code point from 0, null last; each range is sorted on its own."""
    null = F.col("s").isNull()
    ranges = sources.repartitionByRange(partitions(sources.sparkSession), null, "s").withColumn("range", F.spark_partition_id())
    ranges = cut(ranges, "ranges", into)
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    starts = ranges.groupBy("range").agg(F.count("*").alias("in_range")).select("range", F.coalesce(F.sum("in_range").over(before), F.lit(0)).alias("start"))
    place = F.row_number().over(Window.partitionBy("range").orderBy(null, "s")) - 1
    return ranges.join(F.broadcast(starts), "range").withColumn("rank", (F.col("start") + place).cast("long")).drop("range", "start")


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP, into: list[str] | None = None) -> DataFrame:
    """sources (s, z: size, rank) with `target`: shares of the total by weight, the excess over cap * z going to the others.

    A source is full once its weight times the common share per weight exceeds cap * z. The share only grows as full
    sources leave their excess to the others, so it settles; each round is one sum over the sources.
    """
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    sources = cut(sources.withColumn("weight", weight), "weighed", into)
    full = lambda share: F.col("weight") * F.lit(share) > F.col("z") * cap
    share, known = -1.0, -1
    while True:
        free = ~full(share)
        total, left, held, n = sources.agg(
            F.coalesce(F.sum("z"), F.lit(0)), F.coalesce(F.sum(F.when(~free, F.col("z") * cap)), F.lit(0.0)), F.coalesce(F.sum(F.when(free, F.col("weight"))), F.lit(0.0)), F.count(F.when(~free, 1))
        ).first()
        if n == known:
            break
        known = n
        share = (total - left) / held if held else float("inf")
    return sources.withColumn("target", F.when(full(share), F.col("z") * cap).otherwise(F.col("weight") * F.lit(share))).drop("weight")


def multiplier(size: Column, target: Column, steps: int = 60) -> Column:
    """Newton's method on the dual for a source: gradient size * exp(l) - target, Hessian size * exp(l), from l = 0.

    A step is kept within 1, the reach of the quadratic model; from there on the number of right digits doubles.
    """

    def step(held: Column, _: Column) -> Column:
        mass = size * F.exp(held)
        return held + F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (target - mass) / mass))

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.lit(0.0), step)


def copies_of(size: np.ndarray, rate: np.ndarray, cap: float) -> np.ndarray:
    """Whole copies for documents in order, feeding each one's rounding error to the next."""
    out = np.zeros(len(size), dtype=np.int64)
    due = taken = 0.0
    for i, (n, w) in enumerate(zip(size.tolist(), rate.tolist())):
        if not n:
            continue
        due += w * n
        low = math.floor(w + 1e-9)
        best = round((due - taken) / n)
        out[i] = max(low, min(best, low + (w > low + 1e-9), int(cap)))
        taken += out[i] * n
    return out


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP, bucket: int = 2000) -> DataFrame:
    """documents -> (doc_id, size, source_size, target, taken, source, rate, copies)."""
    passing: list[str] = []
    size = F.coalesce(F.regexp_count(F.col("text"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    sized = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("s"), size.alias("size")), "sizes", passing)
    sums = cut(sized.groupBy("s").agg(F.sum("size").alias("z"), F.count("*").alias("n")), "sources", passing)
    due = targets(ranked(sums, passing), weights, cap, passing)
    rate = F.when(F.col("target") > 0, F.least(F.lit(float(cap)), F.exp(multiplier(F.col("z").cast("double"), F.col("target"))))).otherwise(0.0)
    parts = F.greatest(F.lit(1), F.ceil(F.col("n") / bucket)).cast("int")
    table = cut(due.select(F.col("s").alias("t"), F.col("z").alias("source_size"), "target", rate.alias("rate"), parts.alias("parts")), "rates", passing)
    if table.count() <= MAX_BROADCAST:
        table = F.broadcast(table)
    salted = sized.join(table, F.col("s").eqNullSafe(F.col("t"))).drop("t")
    order = F.xxhash64("doc_id", F.lit("order"))
    keyed = salted.withColumn("g", F.xxhash64("s", F.pmod(F.xxhash64("doc_id", F.lit("part")), F.col("parts")))).withColumn("o", order)
    schema = "doc_id long, size long, source_size long, target double, taken long, source string, rate double, copies long"

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, "g"):
            g, n, o, w = (t.column(c).to_numpy() for c in ("g", "size", "o", "rate"))
            copies = np.zeros(len(g), dtype=np.int64)
            cuts = bounds(g)
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                at = lo + np.lexsort((o[lo:hi], -n[lo:hi]))
                copies[at] = copies_of(n[at], w[at], cap)
            cols = [t.column(c).combine_chunks() for c in ("doc_id", "size", "source_size", "target")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(copies * n), t.column("s").combine_chunks(), t.column("rate").combine_chunks(), pa.array(copies)], ["doc_id", "size", "source_size", "target", "taken", "source", "rate", "copies"])

    out = cut(by_key(keyed, "g", deal, schema), "mixture")
    discard(docs.sparkSession, passing)
    return out
