"""Nearest neighbours by inner product: an inverted file whose lists are scanned by adaptive dimensions.

Largest inner product becomes smallest distance by one more coordinate, sqrt(M^2 - |x|^2) for the candidates (M: the
largest norm) and 0 for the queries. A k-means on a bounded sample gives the lists; every vector is put in its nearest.
A query visits the nearest lists. Within a list, vectors are rotated by a random orthogonal matrix and read in blocks of
columns: after a block, the distance so far times D / d estimates the whole distance, and a candidate is abandoned if
the estimate lies above the query's 20th best by more than `1 + epsilon / sqrt(d)` allows (Gao and Long, 2023). What
survives all blocks is measured on the original vectors in double precision. A query first visits the nearest lists that
hold enough vectors for an answer; its 20th best there is the threshold that it carries to all the others.

A list of many vectors is dealt into chunks, and its queries into parts, by hash; each (list, chunk, part) is one small
group, whatever the skew. A group returns at most k rows for each query. The centroids and the table of lists are
parameters of the index, of bounded size; nothing else is broadcast or collected.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components take no part, nor do those of
another length than the most frequent; equal scores rank by vec_id; rows that repeat a vec_id and its vector are one
(with other vectors each counts and each is a query of its own, and none answers a query of its own vec_id); with fewer
than k candidates all are returned; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from concord.llm.common import bounds, by_key, cut, discard, runs, thinned

#: Rows that the centroids are fitted on at most, chosen by a hash of vec_id.
SAMPLE = 20_000
MAX_LISTS = 4096
BLOCKS = 4


def usable(table: DataFrame) -> DataFrame:
    """(vec_id, v: array<double>) of the vectors that take part, without repeats."""
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).where("vec_id is not null and size(v) > 0")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.where(fine)
    usual = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("v") == (usual["n"] if usual else 0)).dropDuplicates(["vec_id", "v"])


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def k_means(x: np.ndarray, k: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centers = x[rng.choice(len(x), size=min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = nearest(x, centers, 1)[:, 0]
        count = np.bincount(near, minlength=len(centers))
        total = np.zeros_like(centers)
        np.add.at(total, near, x)
        centers = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centers)
    return centers


def nearest(x: np.ndarray, centers: np.ndarray, n: int) -> np.ndarray:
    d = (centers**2).sum(axis=1)[None, :] - 2 * x @ centers.T
    if n == 1:
        return d.argmin(axis=1)[:, None]
    n = min(n, len(centers))
    part = np.argpartition(d, n - 1, axis=1)[:, :n]
    return np.take_along_axis(part, np.argsort(np.take_along_axis(d, part, axis=1), axis=1, kind="stable"), axis=1)


class Index:
    """The bounded parameters: centroids of the lifted vectors, the largest norm, the rotation."""

    def __init__(self, sample: np.ndarray, norm: float, lists: int, epsilon: float) -> None:
        self.norm, self.epsilon = norm, epsilon
        self.centers = k_means(self.lifted(sample), lists)
        d = self.centers.shape[1]
        self.share = 1.0
        self.rotation = np.linalg.qr(np.random.default_rng(3).normal(size=(d, d)))[0]

    def lifted(self, x: np.ndarray) -> np.ndarray:
        return np.hstack([x, np.sqrt(np.maximum(self.norm**2 - (x**2).sum(axis=1), 0.0))[:, None]])

    def scaled(self, q: np.ndarray) -> np.ndarray:
        """Queries of norm M: the ranking stays, and distances to lifted candidates become comparable."""
        return self.as_query(q * (self.norm / np.maximum(np.sqrt((q**2).sum(axis=1)), 1e-300))[:, None])

    def calibrate(self, sample: np.ndarray, k: int, recall: float, asked: int = 256) -> None:
        """The least share of lists that holds `recall` of the k nearest, measured on the sample against brute force."""
        q = sample[:: max(1, len(sample) // asked)][:asked]
        inner = q @ sample.T
        k = min(k + 1, len(sample))
        top = np.argpartition(-inner, k - 1, axis=1)[:, :k]
        visit = np.argsort(nearest(self.scaled(q), self.centers, len(self.centers)), axis=1)  # when a query comes to a list
        home = nearest(self.lifted(sample), self.centers, 1)[:, 0]
        turns = np.sort(np.take_along_axis(visit, home[top], axis=1).ravel())
        self.share = (turns[min(len(turns) - 1, int(np.ceil(recall * len(turns))))] + 1) / len(self.centers)

    @staticmethod
    def as_query(q: np.ndarray) -> np.ndarray:
        return np.hstack([q, np.zeros((len(q), 1))])

    def scan(self, q: np.ndarray, own: np.ndarray, least: np.ndarray, c: np.ndarray, ids: np.ndarray, k: int, batch: int = 256) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query its best (scores, ids) among the candidates, abandoning by partial distances.

        least: the score of the query's k-th best so far, from other lists; -inf if it has fewer.
        """
        order = np.argsort(ids, kind="stable")
        c, ids = c[order], ids[order]
        scale = self.norm / np.maximum(np.sqrt((q**2).sum(axis=1)), 1e-300)
        rq, rc = self.scaled(q) @ self.rotation, self.lifted(c) @ self.rotation
        d = rq.shape[1]
        cuts = np.unique(np.linspace(0, d, BLOCKS + 1).astype(int))
        limit = 2 * self.norm**2 - 2 * np.maximum(least, -1e300) * scale  # |q'|^2 + |c'|^2 - 2 q'c', with both norms M
        floor = limit * (1 + 1e-9) + 1e-9
        limit = np.where(least > -np.inf, floor, np.inf)
        best = [(np.zeros(0), np.zeros(0, dtype=np.int64)) for _ in range(len(q))]
        for lo in range(0, len(c), batch):
            part = rc[lo : lo + batch]
            a, b = rq[:, : cuts[1]], part[:, : cuts[1]]
            far = (a**2).sum(axis=1)[:, None] + (b**2).sum(axis=1)[None, :] - 2 * a @ b.T
            bound = lambda n: limit * (n / d) * (1 + self.epsilon / np.sqrt(n)) ** 2 if n < d else limit  # noqa: B023, E731
            i, j = np.nonzero(far <= bound(cuts[1])[:, None])
            so_far = far[i, j]
            for m in range(1, len(cuts) - 1):
                if not len(i):
                    break
                so_far = so_far + ((rq[i, cuts[m] : cuts[m + 1]] - part[j, cuts[m] : cuts[m + 1]]) ** 2).sum(axis=1)
                keep = so_far <= bound(cuts[m + 1])[i] * (1 + 1e-9) + 1e-9
                i, j, so_far = i[keep], j[keep], so_far[keep]
            other = ids[lo + j] != own[i]
            i, j, so_far = i[other], j[other], so_far[other]
            if not len(i):
                continue
            score = (q[i] * c[lo + j]).sum(axis=1)  # row by row the same sum, so that equal vectors score equally
            starts = np.searchsorted(i, np.arange(len(q) + 1))
            for n in np.flatnonzero(np.diff(starts)).tolist():
                s = np.concatenate([best[n][0], score[starts[n] : starts[n + 1]]])
                t = np.concatenate([best[n][1], ids[lo + j[starts[n] : starts[n + 1]]]])
                top = np.lexsort((t, -s))[:k]
                best[n] = s[top], t[top]
                if len(top) == k:
                    limit[n] = min(limit[n], 2 * self.norm**2 - 2 * s[top[-1]] * scale[n])
        return best


def build(vectors: DataFrame, k: int, recall: float, lists: int | None = None, epsilon: float = 2.1) -> Index | None:
    n, norm = vectors.agg(F.count("*"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).first()
    if not n:
        return None
    share = min(1.0, SAMPLE / n)
    sample = vectors.where(thinned(share, "vec_id"))
    x = matrix(sample.select("v").orderBy("vec_id").limit(2 * SAMPLE).toArrow().column("v"))
    index = Index(x, float(np.sqrt(norm)), lists or int(min(MAX_LISTS, max(1, n**0.5 / 2))), epsilon)
    index.calibrate(x, k, recall)
    return index


def search(table: DataFrame, queries: DataFrame | None = None, k: int = 20, recall: float = 0.95, probes: float | None = None, chunk: int = 1024, part: int = 1024) -> DataFrame:
    """table (vec_id, embedding) -> (query_id, rank, vec_id, score).

    queries: rows of the table that are asked; by default those whose vec_id is divisible by 20. probes: the share of
    the lists that a query visits (at least as many as hold k + 1 vectors); by default the least that reaches `recall`
    on the sample, so that data with structure pays for few lists.
    """
    spark = table.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    passing: list[str] = []
    vectors = cut(usable(table), "vectors", passing)
    asked = vectors.where("vec_id % 20 = 0") if queries is None else usable(queries)
    index = build(vectors, k, recall)
    if index is None:
        return spark.createDataFrame([], schema)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near = nearest(index.lifted(matrix(batch.column("v"))), index.centers, 1)[:, 0]
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(near.astype(np.int32))], ["vec_id", "v", "list"])

    placed = cut(vectors.mapInArrow(assign, "vec_id long, v array<double>, list int"), "lists", passing)
    size = np.zeros(len(index.centers), dtype=np.int64)
    for row in placed.groupBy("list").count().collect():  # one row a list
        size[row["list"]] = row["count"]
    visits = max(1, int(np.ceil((index.share if probes is None else probes) * len(size))))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            near = nearest(index.scaled(matrix(batch.column("v"))), index.centers, len(size))
            held = np.cumsum(size[near], axis=1)
            enough = np.where(held[:, -1] >= k + 1, (held >= k + 1).argmax(axis=1) + 1, len(size))
            last = np.maximum(enough, visits)
            some = lambda i, lo, hi: near[i, lo:hi][size[near[i, lo:hi]] > 0].astype(np.int32)  # noqa: B023, E731
            kind = pa.list_(pa.int32())
            parts = [pa.array([some(i, 0, enough[i]) for i in range(len(near))], kind), pa.array([some(i, enough[i], last[i]) for i in range(len(near))], kind)]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), batch.column("q"), *parts], ["vec_id", "v", "q", "first", "others"])

    routed = cut(asked.withColumn("q", F.xxhash64("v")).mapInArrow(route, "vec_id long, v array<double>, q long, first array<int>, others array<int>"), "routes", passing)
    order = Window.partitionBy("query_id", "q").orderBy(F.desc("score"), "vec_id")
    best = lambda found: found.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k)
    begun = cut(best(_scanned(placed, routed.withColumn("least", F.lit(float("-inf"))), "first", size, index, k, chunk, part)), "begun", passing)
    least = begun.groupBy(F.col("query_id").alias("vec_id"), "q").agg(F.when(F.count("*") == k, F.min("score")).otherwise(float("-inf")).alias("least"))
    carried = cut(routed.where("size(others) > 0").join(least, ["vec_id", "q"], "left").fillna(float("-inf"), ["least"]), "carried", passing)
    found = _scanned(placed, carried, "others", size, index, k, chunk, part)
    out = cut(best(begun.drop("rank").union(found)).select("query_id", "rank", "vec_id", "score"), "neighbours")
    discard(spark, passing)
    return out


def _scanned(placed: DataFrame, asks: DataFrame, lists: str, size: np.ndarray, index: Index, k: int, chunk: int, part: int) -> DataFrame:
    """placed (vec_id, v, list) and asks (vec_id, v, q, least, lists) -> (query_id, q, vec_id, score): at most k of each group."""
    spark = placed.sparkSession
    visited = np.zeros(len(size), dtype=np.int64)
    for row in asks.select(F.explode(lists).alias("list")).groupBy("list").count().collect():  # one row a list
        visited[row["list"]] = row["count"]
    plan = [(i, max(1, -(-int(s) // chunk)), max(1, -(-int(q) // part))) for i, (s, q) in enumerate(zip(size, visited)) if q]
    plan_df = F.broadcast(spark.createDataFrame(plan, "list int, chunks int, parts int"))  # one row a list
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    dealt = lambda n: F.pmod(F.xxhash64("vec_id", F.lit(n)), F.col(n)).cast("int")
    group = F.xxhash64("list", "chunk", "part").alias("g")
    none = [F.lit(None).cast("long").alias("q"), F.lit(None).cast("double").alias("least")]
    held = placed.join(plan_df, "list").withColumn("chunk", dealt("chunks")).withColumn("part", each("parts")).select(group, F.lit(False).alias("asks"), "vec_id", "v", *none)
    asked = asks.select("vec_id", "v", "q", "least", F.explode(lists).alias("list")).join(plan_df, "list").withColumn("part", dealt("parts")).withColumn("chunk", each("chunks"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, "g"):
            g, ids, asking = t.column("g").to_numpy(), t.column("vec_id").to_numpy(), t.column("asks").to_numpy().astype(bool)
            q, least = t.column("q").fill_null(0).to_numpy(), t.column("least").fill_null(0.0).to_numpy()
            v, out = matrix(t.column("v")), []
            cuts = bounds(g)
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                a, c = lo + np.flatnonzero(asking[lo:hi]), lo + np.flatnonzero(~asking[lo:hi])
                if len(a) and len(c):
                    for n, (s, i) in zip(a.tolist(), index.scan(v[a], ids[a], least[a], v[c], ids[c], k)):
                        out.append((np.full(len(s), ids[n]), np.full(len(s), q[n]), i, s))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], ["query_id", "q", "vec_id", "score"])

    rows = held.union(asked.select(group, F.lit(True).alias("asks"), "vec_id", "v", "q", "least"))
    return by_key(rows, "g", scan, "query_id long, q long, vec_id long, score double")
