"""SimHash near-duplicates, linked through BK-trees.

A fingerprint has a bit set where over half of the text's shingle hashes (XXH64, seed 42) have it set. Fingerprints
within a Hamming radius are linked, and documents get the component of their fingerprint.

Candidates meet in shards. For an exact search the 64 bits are cut into blocks: two fingerprints within the radius
differ in at most `radius` blocks, so they agree on all the others, and every choice of agreeing blocks is a shard
key (pigeonhole; no link is lost). Each shard's tree is a BK-tree: a child hangs under the integer Hamming distance
to its parent, and a search follows only edges within distance +- radius. Trees and their queries are sent to the
tasks by a shuffle, not by a broadcast, since the number of distinct fingerprints grows with the corpus. A shard of
more than `chunk` members is dealt into chunks (see `search`), so that no group has to fit one task. A task returns a
spanning forest of the links it found, never all pairs. `copy_groups` has its own shards, and trees with leaves.

Defined cases: a null or blank text has fingerprint zero and is linked like any other; equal texts share a
fingerprint; repeated rows give repeated rows; an empty table gives an empty table; columns other than doc_id and
text are ignored; rows with a null doc_id are fingerprinted and linked but never name a component.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concord.llm.common import bounds, by_key, cut, fresh, runs
from concord.llm.components import components

SEED = 42
_MIX = np.uint64(0x9E3779B97F4A7C15)
_BYTE = np.random.default_rng(11).integers(0, 1 << 64, size=256, dtype=np.uint64)
#: Shingles at most that are sent to all tasks as frequent ones.
MAX_FREQUENT = 100_000


def shingle_hashes(words: list[bytes], size: int) -> np.ndarray:
    """XXH64 of each run of `size` words joined by a space; of the whole sequence if it has fewer."""
    if not words:
        return np.zeros(0, dtype=np.uint64)
    size = min(size, len(words))
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - size + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, ends[size - 1 :].tolist())), dtype=np.uint64, count=len(starts))


def fingerprint_of(hashes: np.ndarray) -> int:
    """Bit i is set if it is set in over half of the hashes; zero without hashes."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 8192):
        part = hashes[at : at + 8192].astype("<u8")
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        for lo in range(0, len(bits), 255):  # sums that fit a byte
            ones += bits[lo : lo + 255].sum(axis=0, dtype=np.uint8)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def _powers(n: int, held: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of _MIX and of its inverse modulo 2^64."""
    if len(held[0]) < n:
        for k, base in enumerate((int(_MIX), pow(int(_MIX), -1, 1 << 64))):
            steps = np.full(2 * n, base, dtype=np.uint64)
            steps[0] = 1
            held[k] = np.cumprod(steps)
    return held[0][:n], held[1][:n]


def rolling_hashes(words: list[bytes], size: int, held: list[np.ndarray]) -> np.ndarray:
    """Other numbers than `shingle_hashes`, cheaper: polynomials of a shingle's bytes modulo 2^64, mixed, as differences of running sums."""
    out, size = [np.zeros(0, dtype=np.uint64)], min(size, len(words))
    for lo in range(0, len(words) - size + 1 if words else 0, 20_000):
        data = np.frombuffer(b" ".join(words[lo : lo + 20_000 + size - 1]), dtype=np.uint8)
        power, inverse = _powers(len(data) + 1, held)
        upto = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(_BYTE[data] * power[: len(data)], dtype=np.uint64)])
        space = np.flatnonzero(data == 32)
        starts, ends = np.concatenate([[0], space + 1]), np.append(space, len(data))[size - 1 :]
        starts = starts[: len(ends)]
        x = (upto[ends] - upto[starts]) * inverse[starts]
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        out.append(x ^ (x >> np.uint64(31)))
    return np.concatenate(out)


class BKTree:
    """Children keyed by the integer Hamming distance to their parent."""

    def __init__(self) -> None:
        self.root: tuple | None = None

    def add(self, value: int, item: int) -> None:
        if self.root is None:
            self.root = (value, [item], {})
            return
        node = self.root
        while True:
            d = (node[0] ^ value).bit_count()
            if not d:
                node[1].append(item)
                return
            child = node[2].get(d)
            if child is None:
                node[2][d] = (value, [item], {})
                return
            node = child

    def within(self, value: int, radius: int) -> list[int]:
        found: list[int] = []
        stack = [self.root] if self.root else []
        while stack:
            held, items, children = stack.pop()
            d = (held ^ value).bit_count()
            if d <= radius:
                found += items
            for edge, child in children.items():
                if d - radius <= edge <= d + radius:
                    stack.append(child)
        return found


class LeafTree:
    """A BK-tree whose nodes are leaves of up to `most` fingerprints, compared at once, until they are full: for a radius at which single nodes cut off little."""

    def __init__(self, most: int = 1024) -> None:
        self.most, self.n = most, 0
        self.value, self.item = np.zeros(8, dtype=np.uint64), np.zeros(8, dtype=np.int64)
        self.children: dict[int, LeafTree] = {}

    def add(self, value: int, item: int) -> None:
        at = self
        while at.children:
            d = (int(at.value[0]) ^ value).bit_count()
            at = at.children.setdefault(d, LeafTree(at.most))
        if at.n == len(at.value):
            at.value, at.item = np.resize(at.value, 2 * at.n), np.resize(at.item, 2 * at.n)
        at.value[at.n], at.item[at.n] = value, item
        at.n += 1
        if at.n > at.most and (at.value[: at.n] != at.value[0]).any():
            for v, i in zip(at.value[: at.n].tolist(), at.item[: at.n].tolist()):
                at.children.setdefault((int(at.value[0]) ^ v).bit_count(), LeafTree(at.most)).add(v, i)

    def within(self, value: int, radius: int) -> np.ndarray:
        if not self.children:
            return self.item[: self.n][np.bitwise_count(self.value[: self.n] ^ np.uint64(value)) <= radius]
        d = (int(self.value[0]) ^ value).bit_count()
        return np.concatenate([np.zeros(0, dtype=np.int64), *[x.within(value, radius) for edge, x in self.children.items() if d - radius <= edge <= d + radius]])


def fingerprints(docs: DataFrame, size: int) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, fp: long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [fingerprint_of(shingle_hashes((t or b"").lower().split(), size)) for t in batch.column("text").to_pylist()]
            fp = np.array(out, dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp)], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, fp long")


def shard_keys(fp, radius: int, blocks: int):
    """One key for each choice of blocks - radius blocks: fingerprints within the radius share at least one."""
    width = [64 // blocks + (i < 64 % blocks) for i in range(blocks)]
    start = [sum(width[:i]) for i in range(blocks)]
    part = [F.shiftrightunsigned(fp, s).bitwiseAND(F.lit((1 << w) - 1)) for s, w in zip(start, width)]
    return F.array(*[F.xxhash64(F.lit(n), *[part[i] for i in chosen]) for n, chosen in enumerate(combinations(range(blocks), blocks - radius))])


def blocks_for(n: int, radius: int) -> int:
    """Fewest blocks for which a shard of evenly spread fingerprints has some 256 members at most."""
    blocks = radius + 1
    while n >> (64 * (blocks - radius) // blocks) > 256 and blocks < radius + 4:
        blocks += 1
    return blocks


def deal(rows: DataFrame, key: str, chunk: int) -> DataFrame:
    """rows with a shard key -> those of shards of two or more, with c: the number of chunks of their shard."""
    sizes = rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")
    return rows.join(sizes, key).withColumn("c", F.ceil(F.col("n") / chunk).cast("int")).drop("n")


def search(dealt: DataFrame, key: str, by: str, chunk: int, scan: Callable[[DataFrame], DataFrame], narrow: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Edges (a, b) that connect what is linked within a shard; scan takes rows with a group `g` and links within groups.

    A shard of one chunk is one group. A larger one is dealt into chunks twice, by two hashes: that joins the bulk of a
    group of copies, whatever its size, in one pass. Then only the members outside the shard's most frequent component
    are left to be searched against all; a pair within that component needs no further look. So no link is lost, and a
    group of n copies costs in proportion to n, not to its square.

    Of each row scan gets the component so far, `label`, and whether the group's other rows are to be searched for its
    links, `asks`. narrow takes the rows (key, by, fp, label) of shards that hold several components and deals them into
    shards of its own, in which all that may be linked still meet: a shard of many that have no link has no bulk.
    """
    part = lambda salt, n: F.pmod(F.xxhash64(F.col(by), F.lit(salt)), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    one = dealt.where("c = 1").withColumn("g", F.xxhash64(key))
    large = dealt.where("c > 1")
    twice = large.withColumn("deal", F.explode(F.array(F.lit(0), F.lit(1))))
    twice = twice.withColumn("g", F.xxhash64(key, "deal", F.when(F.col("deal") == 0, part("first", "c")).otherwise(part("second", "c")))).drop("deal")
    found = cut(scan(one.unionByName(twice).drop("c", key).withColumn("label", F.col(by)).withColumn("asks", F.lit(True))), "links")
    if large.isEmpty():
        return found
    labels = components(found)
    marked = cut(large.join(labels, F.col(by) == F.col("node"), "left").withColumn("label", F.coalesce("label", by)).drop("node", "c"), "marked")
    if narrow is not None:
        several = marked.groupBy(key).agg(F.min("label").alias("least"), F.max("label").alias("most")).where("least <> most").select(key)
        marked = cut(narrow(marked.join(several, key)), "narrowed")
    sizes = marked.groupBy(key, "label").agg(F.count("*").alias("m"))
    bulk = sizes.groupBy(key).agg(F.max_by("label", F.struct("m", "label")).alias("bulk"), F.sum("m").alias("n"), (F.sum("m") - F.max("m")).alias("r")).where("r > 0")
    chunks = lambda n: F.ceil(F.col(n) / chunk).cast("int")
    open_rows = marked.join(bulk.withColumn("rc", chunks("r")).withColumn("c", chunks("n")).drop("r", "n"), key).withColumn("asks", F.expr("label <> bulk"))
    rest = open_rows.where("asks").withColumn("i", part("rest", "rc")).withColumn("j", each("c"))
    every = open_rows.where("not asks or c > 1").withColumn("asks", F.lit(False)).withColumn("j", part("all", "c")).withColumn("i", each("rc"))
    pairs = rest.unionByName(every).withColumn("g", F.xxhash64(key, "i", "j", F.lit("rest")))
    return found.union(scan(pairs.drop("c", "rc", "i", "j", "bulk", key)))


def links_in(fps: list[int], radius: int, linked=None, labels: list[int] | None = None, asks: list[bool] | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links among fps: (i, j) index pairs. linked(i, js) is asked only across two trees, and tells which.

    Those of one label are one tree from the start. With `asks`, links between two that don't ask are not looked for.
    """
    tree, out = BKTree() if linked is None else LeafTree(), []
    root = np.arange(len(fps)) if labels is None else np.unique(labels, return_inverse=True)[1]
    for i in sorted(range(len(fps)), key=asks.__getitem__) if asks else range(len(fps)):
        if (asks is None or asks[i]) and len(near := tree.within(fps[i], radius)):
            near, step = np.asarray(near), 8
            while len(near := near[root[near] != root[i]]):
                part, near, step = near[:step], near[step:], 8 * step
                for j in (part if linked is None else part[linked(i, part)]).tolist():
                    if root[j] != root[i]:
                        root[root == root[j]] = root[i]
                        out.append((i, j))
        tree.add(fps[i], i)
    return out


class Overlaps:
    """Sizes of what two sets of a group have in common, counted over the elements that several of its sets have."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.size, self.of, self.bits = np.array([len(x) for x in sets]), -1, None
        if len(sets) < 8:
            self.sets = sets
            return
        _, at, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shared = n > 1
        held = shared[at]
        upto = np.concatenate([[0], np.cumsum(held)])[np.concatenate([[0], np.cumsum(self.size)])]
        ids, most = (np.cumsum(shared) - 1)[at[held]], int(shared.sum())
        self.sets = [ids[a:b] for a, b in zip(upto[:-1].tolist(), upto[1:].tolist())]
        self.mark = np.zeros(most, dtype=bool)
        if len(sets) > 32 and most <= 8192:  # few enough for a bit each
            bits = np.zeros((len(sets), -(-most // 64) * 64), dtype=bool)
            bits[np.repeat(np.arange(len(sets)), np.diff(upto)), ids] = True
            self.bits = np.packbits(bits, axis=1).view(np.uint64)

    def both(self, i: int, js: np.ndarray) -> np.ndarray:
        if self.bits is not None:
            return np.bitwise_count(self.bits[js] & self.bits[i]).sum(axis=1, dtype=np.int64)
        if len(self.sets) < 8:
            return np.array([len(np.intersect1d(self.sets[i], self.sets[j], assume_unique=True)) for j in js.tolist()])
        if self.of != i:
            if self.of >= 0:
                self.mark[self.sets[self.of]] = False
            self.mark[self.sets[i]] = True
            self.of = i
        return np.array([np.count_nonzero(self.mark[self.sets[j]]) for j in js.tolist()])


def fingerprint_links(distinct: DataFrame, radius: int, blocks: int, chunk: int = 1024) -> DataFrame:
    """distinct(fp) -> edges (a, b) that connect all fingerprints within the radius of each other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, "g"):
            g, fp = table.column("g").to_numpy(), table.column("fp").to_numpy()
            cuts, a, b = bounds(g), [], []
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                if hi - lo > 1:
                    own = fp[lo:hi].view(np.uint64).tolist()
                    for i, j in links_in(own, radius):
                        a.append(lo + i)
                        b.append(lo + j)
            yield pa.RecordBatch.from_arrays([pa.array(fp[a] if a else fp[:0]), pa.array(fp[b] if b else fp[:0])], ["a", "b"])

    rows = distinct.select("fp", F.explode(shard_keys(F.col("fp"), radius, blocks)).alias("key"))
    return search(cut(deal(rows, "key", chunk), "shards"), "key", "fp", chunk, lambda groups: by_key(groups.select("g", "fp"), "g", run, "a long, b long"))


def near_duplicates(docs: DataFrame, size: int = 4, radius: int = 4, chunk: int = 1024) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, fingerprint, component_id); see the module's text for the cases."""
    prints = cut(fingerprints(docs, size), "fingerprints")
    distinct = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    edges = fingerprint_links(distinct, radius, blocks_for(distinct.count(), radius), chunk)
    labels = components(edges)
    named = distinct.join(labels, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("label", "fp").alias("label"))
    least = cut(named.groupBy("label").agg(F.min("first").alias("component_id")), "least")  # a table, so that a large component's rows can be split in the join
    table = named.join(least, "label").select("fp", "component_id")
    return prints.join(table, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def by_rare_shingles(rows: DataFrame, sets: DataFrame, similarity: float, frequent: int) -> DataFrame:
    """rows(key, same, fp, label) in shards of their own, in which every two of a shard that may be similar still meet.

    Two sets of a Jaccard similarity of t or more have a shingle in common among the first n - ceil(t n) + 1 of each, by
    any order of all shingles: the first that they share has ceil(t n) - 1 others behind it. The order here puts those that
    some `frequent` of the sets have last, the most frequent at the very end, so that a line that very many texts share is
    among the first of a text that has hardly anything else only. All of a set's first shingles that aren't frequent are
    keys; sets with a frequent one among the first also stay with each other, by the shard they are in. That loses no
    link whichever shingles count as frequent; counts below two in an Arrow batch aren't looked at for it.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, n = np.unique(np.frombuffer(b"".join(batch.column("sh").to_pylist()), dtype=np.uint32), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found[n > 1].astype(np.int64)), pa.array(n[n > 1].astype(np.int64))], ["shingle", "n"])

    members = cut(rows.select("same", "fp", "label").distinct().join(sets, "same"), "members")
    counts = members.select("sh").mapInArrow(count, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    top = counts.where(F.col("n") >= frequent).orderBy(F.desc("n"), "shingle").limit(MAX_FREQUENT).toPandas().sort_values("shingle")
    known, often = top["shingle"].to_numpy(dtype=np.uint32), top["n"].to_numpy(dtype=np.int64)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            row, keys, late = [], [], []
            for i, held in enumerate(batch.column("sh").to_pylist()):
                x = np.frombuffer(held, dtype=np.uint32)
                n = len(x) - int(np.ceil(similarity * len(x) - 1e-6)) + 1 if len(x) else 0
                at = np.searchsorted(known, x)
                at[at == len(known)] = 0
                rank = np.where(known[at] == x, often[at], 0) if len(known) else np.zeros(len(x), dtype=np.int64)
                own = x[rank == 0][:n].astype(np.int64)
                if len(own) < n:
                    own = np.append(own, -1)
                row.append(np.full(len(own), i))
                keys.append(own)
                late.append(own < 0)
            at = pa.array(np.concatenate(row))
            taken = [batch.column(c).take(at) for c in ("same", "fp", "label")]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), *taken, pa.array(np.concatenate(late))], ["key", "same", "fp", "label", "late"])

    dealt = cut(members.mapInArrow(first, "key long, same long, fp long, label long, late boolean"), "first")
    late = rows.join(dealt.where("late").select("same"), "same").withColumn("key", F.xxhash64("key", F.lit("late")))
    return dealt.where("not late").drop("late").unionByName(late.select("key", "same", "fp", "label"))


def same_of(words: list[bytes]) -> int:
    return xxhash.xxh64_intdigest(b" ".join(words), SEED)


def near_copies(docs: DataFrame, size: int = 5, similarity: float = 0.8, radius: int = 28, shards: int = 6, chunk: int = 512) -> DataFrame:
    """Which documents repeat an earlier one: docs(doc_id, text) -> (doc_id, component_id); see `copy_groups`."""
    return copy_groups(docs, size, similarity, radius, shards, chunk).select("doc_id", "component_id")


def copy_groups(docs: DataFrame, size: int = 5, similarity: float = 0.8, radius: int = 28, shards: int = 6, chunk: int = 512) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, same, component_id, component_same): each row's id and text, and those of its group.

    Two texts are linked if the Jaccard similarity of their sets of `size`-word shingles is `similarity` or more.
    SimHash fingerprints of these sets (a repeated shingle counts once, unlike in `fingerprints`) within `radius` are the
    candidates, met in shards keyed by one of `shards` min-hashes of the shingles; every pair that would join two groups
    is verified on the whole shingle sets, made once, with the sketches. Texts whose words are all the same are one class
    from the start. Large shards of texts that share a line, but aren't linked, are dealt anew by `by_rare_shingles`.

    What is lost: a pair at exactly 0.8 shares none of the shards with probability 0.2 ** shards, 0.00006 here. A bit
    differs between two such sets with probability 0.19 at most (4 shingles against 5; some 0.15 in large sets), so over
    28 of 64 differ with probability 1.1e-6 at most, whatever the sizes.
    """
    mixers = np.random.default_rng(7).integers(1, 1 << 63, size=(shards, 2), dtype=np.uint64) | np.uint64(1)
    signed = lambda x: pa.array(np.array(x, dtype=np.uint64).view(np.int64))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nameless: set[int] = set()  # texts without doc_id whose set this task has written
        powers = [np.zeros(0, dtype=np.uint64)] * 2
        for batch in batches:
            same, fps, mins, sets = [], [], [], []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                words = (text or b"").lower().split()
                h = np.unique(rolling_hashes(words, size, powers))
                fps.append(fingerprint_of(h))
                same.append(same_of(words))
                x = h * mixers[:, :1]
                mins.append(((x ^ (x >> np.uint64(29))) * mixers[:, 1:]).min(axis=1).view(np.int64).tolist() if len(h) else [0] * shards)
                if doc is None and same[-1] in nameless:
                    sets.append(None)
                    continue
                if doc is None:
                    nameless.add(same[-1])
                upper = (h >> np.uint64(32)).astype(np.uint32)
                sets.append(upper[np.append(True, upper[1:] != upper[:-1])[: len(upper)]].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), signed(same), signed(fps), pa.array(mins, pa.list_(pa.int64())), pa.array(sets, pa.binary())], ["doc_id", "same", "fp", "mins", "sh"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, "g"):
            g, fp, same, label = (table.column(c).to_numpy() for c in ("g", "fp", "same", "label"))
            held, asks = table.column("sh").to_pylist(), table.column("asks").to_pylist()
            cuts, a, b = bounds(g), [], []
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                if hi - lo < 2:
                    continue
                common = Overlaps([np.frombuffer(x, dtype=np.uint32) for x in held[lo:hi]])

                def linked(i: int, js: np.ndarray, common: Overlaps = common) -> np.ndarray:
                    both = common.both(i, js)
                    return both >= similarity * (common.size[i] + common.size[js] - both)

                for i, j in links_in(fp[lo:hi].view(np.uint64).tolist(), radius, linked, label[lo:hi].tolist(), asks[lo:hi]):
                    a.append(same[lo + i])
                    b.append(same[lo + j])
            yield pa.RecordBatch.from_arrays([pa.array(np.array(a, dtype=np.int64)), pa.array(np.array(b, dtype=np.int64))], ["a", "b"])

    kept = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"))
    prints = cut(kept.mapInArrow(sketch, "doc_id long, same long, fp long, mins array<long>, sh binary"), "sketches")
    classes = cut(prints.groupBy("same").agg(F.min("doc_id").alias("first"), F.min(F.struct("fp", "mins")).alias("s")), "classes")
    keyed = classes.select("same", "first", "s.fp", F.posexplode("s.mins").alias("n", "min"))
    dealt = cut(deal(keyed.select("same", "first", "fp", F.xxhash64("n", "min").alias("key")), "key", chunk), "shards")
    members = dealt.select(F.col("same").alias("member"), "first").distinct()
    held = prints.where("sh is not null").select("doc_id", "same", "sh")
    one = (F.col("same") == F.col("member")) & F.col("doc_id").eqNullSafe(F.col("first"))  # a text may have no doc_id at all
    sets = cut(held.join(members, one).dropDuplicates(["same"]).select("same", "sh"), "sets")
    scan = lambda groups: by_key(groups.join(sets, "same").select("g", "fp", "same", "label", "asks", "sh"), "g", run, "a long, b long")
    narrow = lambda rows: by_rare_shingles(rows, sets, similarity, max(2, chunk // 8))
    edges = search(dealt.drop("first"), "key", "same", chunk, scan, narrow)
    labels = components(edges)
    named = classes.join(labels, F.col("same") == F.col("node"), "left").select("same", "first", F.coalesce("label", "same").alias("label"))
    named_first = F.when(F.col("first").isNotNull(), F.struct("first", "same"))
    least = cut(named.groupBy("label").agg(F.min(named_first).alias("least")), "least")  # a table, so that a large component's rows can be split in the join
    table = named.join(least, "label").select("same", F.col("least.first").alias("component_id"), F.col("least.same").alias("component_same"))
    return prints.select("doc_id", "same").join(table, "same").select("doc_id", "same", "component_id", "component_same")


def _same(text):
    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        out = np.array([same_of((t or b"").lower().split()) for t in texts], dtype=np.uint64)
        return pd.Series(out.view(np.int64))

    return of(text.cast("binary"))


def drop_near_copies(docs: DataFrame, size: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs without the near copies: of each group the row with the smallest doc_id stays, once, with its own columns.

    Rows with a null doc_id stay, as they can't be told apart. Rows are told apart by doc_id and words: of those that
    repeat both one stays, the first by all its columns as JSON, and different texts under one doc_id are judged each.
    """
    groups = cut(copy_groups(docs, size, similarity).where("doc_id is not null"), "groups")
    same, of_id, of_text = fresh(docs, "same", "of_id", "of_text")
    own = [F.col("doc_id").alias(of_id), F.col("same").alias(of_text)]
    gone = groups.where("doc_id <> component_id or same <> component_same").select(*own).distinct()
    marked = docs.withColumn(same, _same(F.col("text")))
    here = (F.col("doc_id").cast("long") == F.col(of_id)) & (F.col(same) == F.col(of_text))
    kept = marked.join(gone, here, "left_anti")
    twice = groups.groupBy("doc_id", "same").agg(F.count("*").alias("n")).where("n > 1").select(*own)
    if twice.isEmpty():
        return kept.drop(same)
    again = kept.join(twice, here, "left_semi")
    whole = F.struct(*[again[c] for c in docs.columns])
    again = again.groupBy(F.col("doc_id").cast("long"), same).agg(F.min_by(whole, F.to_json(whole)).alias("row")).select("row.*")
    single = kept.join(twice, here, "left_anti").drop(same)
    return single.unionByName(again)
