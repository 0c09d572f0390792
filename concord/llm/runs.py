"""Periodic runs of words: maximal stretches with a smallest period q, in which the period is repeated several times.

Every run holds a Lyndon root: from some place on, its longest Lyndon word, under the order of the words or under
the reversed order, is one period long. The longest Lyndon words come from the first phase of Baier's suffix sorter,
which groups suffixes by just that word: groups are taken from the largest down, and each extends the words of the nearest
smaller suffixes to its left (`lyndon`). A root that is repeated is extended to both sides as far as words a period
apart are the same, which makes the run.

A run of exponent k repeats each of its words k times, and the distances to a word's next occurrence k - 1 times. Only
stretches of a text in which that is so are sorted (`_candidates`); no run is outside them. Whole texts are worked on, each in
the task that holds it, in memory proportional to its length.

Defined cases: a null text has no words, no runs and an empty collapsed text; an empty one likewise; repeated rows and null
doc_ids stay as they are; runs that overlap are all told, by start, then period; bytes that are no UTF-8 stay as they are; further columns are left out; an empty table gives an empty one.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A run has at least so many words, and so many periods.
LEAST, EXPONENT = 6, 4
FOUND = "doc_id long, runs array<struct<start: long, length: long, period: long>>, collapsed binary"
#: Words that are looked at together, from several texts; a longer text is looked at by itself.
AT_ONCE = 500_000


def lyndon(x: list[int], classes: int) -> tuple[list[int], list[int]]:
    """Length of the longest Lyndon word from each place of x, and its group, the same for the same word; class 0 separates
    texts, and x[0] is 0.

    Groups by first word at the start, later by longest Lyndon word; `below` chains them in order. When a group is taken,
    its suffixes are greater than all not yet taken, so for each the nearest place to the left not taken is the suffix
    whose word it extends: once, or as often as members follow each other. Those extended more often form higher groups.
    """
    members: list[list[int]] = [[] for _ in range(classes)]
    for i, c in enumerate(x):
        members[c].append(i)
    group, length = list(x), [1] * len(x)
    left = list(range(len(x)))  # itself while not taken, else a place before it
    below, above = list(range(-1, classes - 1)), list(range(1, classes + 1))
    g = classes - 1
    while g > 0:
        own = [i for i in members[g] if group[i] == g]
        if own:
            for i in own:
                left[i] = i - 1
            n, times = length[own[0]], {}
            for i in own:
                j = i - 1
                while left[j] != j:
                    left[j] = j = left[left[j]]
                times[j] = times.get(j, 0) + 1
            by_times: dict[int, list[int]] = {}
            for j, k in times.items():
                if x[j]:
                    by_times.setdefault(k, []).append(j)
            for k in sorted(by_times, reverse=True):
                made: dict[int, int] = {}
                for j in by_times[k]:
                    old = group[j]
                    new = made.get(old)
                    if new is None:
                        new = made[old] = len(members)
                        members.append([])
                        below.append(old)
                        above.append(above[old])
                        below[above[old]] = new  # there is one: group g is above all that are extended
                        above[old] = new
                    members[new].append(j)
                    group[j] = new
                    length[j] += k * n
        members[g] = []
        g = below[g]
    return length, group


def _common(w: np.ndarray, i: int, j: int, step: int) -> int:
    """How many words from i and j on (step 1) or backwards (step -1) are the same; i < j."""
    most, done, n = (len(w) - j if step > 0 else i + 1), 0, 16
    while done < most:
        n = min(n, most - done)
        a, b = (w[i + done : i + done + n], w[j + done : j + done + n]) if step > 0 else (w[i - done - n + 1 : i - done + 1][::-1], w[j - done - n + 1 : j - done + 1][::-1])
        differ = np.flatnonzero(a != b)
        if len(differ):
            return done + int(differ[0])
        done, n = done + n, 2 * n
    return done


def _roots(length: np.ndarray, group: np.ndarray, exponent: int) -> np.ndarray:
    """Places whose root is followed by itself as often as in a run of that exponent it must be, the first of each chain."""
    n = len(length)
    place = np.arange(n)
    good = length > 0
    for k in range(1, exponent - 1):
        at = place + k * length
        good &= (at < n) & (group[np.minimum(at, n - 1)] == group)
    before = place - length
    again = (before >= 0) & (group[np.maximum(before, 0)] == group) & good[np.maximum(before, 0)]
    return np.flatnonzero(good & ~again)


def _sorted_runs(x: np.ndarray, least: int, exponent: int) -> set[tuple[int, int, int]]:
    """(start, length, period) of the runs of x that have that many words and periods; 0 separates texts, and x[0] is 0."""
    top, found = int(x.max()), set()
    for order in (x, np.where(x > 0, top + 1 - x, 0)):
        length, group = map(np.array, lyndon(order.tolist(), top + 1))
        length[x == 0] = 0
        for i in _roots(length, group, exponent).tolist():
            p = int(length[i])
            start, stop = i - _common(x, i - 1, i + p - 1, -1), i + p + _common(x, i, i + p, 1)
            if stop - start >= max(least, exponent * p):
                found.add((start, stop - start, p))
    return found


def _stretches(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and stops of the stretches of true places."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8)))
    return edge[::2], edge[1::2]


def _places(starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of stretches, and the stretch of each."""
    n = stops - starts
    label = np.repeat(np.arange(len(n)), n)
    return np.arange(len(label)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts, n), label


def _candidates(w: np.ndarray, least: int, exponent: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and stops of disjoint stretches of w (0 separates texts) that hold all its runs, whole.

    A run's words occur `exponent` times within it, so it lies in a stretch of words that do so within the stretch. All but its last q
    words have their next occurrence in the run, and so have that word and distance exponent - 1 times; those last q are
    at most a (exponent - 1)th of the others, by which what is left is lengthened again.
    """
    mask = w > 0
    for _ in range(3):
        starts, stops = _stretches(mask)
        keep = stops - starts >= least
        at, label = _places(starts[keep], stops[keep])
        _, key, n = np.unique(label * (int(w.max(initial=0)) + 1) + w[at], return_inverse=True, return_counts=True)
        few = n[key] < exponent
        mask = np.zeros(len(w), bool)
        mask[at[~few]] = True
        if not few.any():
            break
    starts, stops = _stretches(mask)
    keep = stops - starts >= least
    starts, stops = starts[keep], stops[keep]
    at, label = _places(starts, stops)
    if not len(at):
        return at, at
    key = label * (int(w.max()) + 1) + w[at]
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    after = np.zeros(len(at), np.int64)
    after[order[:-1][same]] = (order[1:] - order[:-1])[same]
    _, key = np.unique(key, return_inverse=True)
    _, key, n = np.unique(key * (int(after.max()) + 1) + after, return_inverse=True, return_counts=True)
    core = np.zeros(len(w), bool)
    core[at[(after > 0) & (n[key] >= exponent - 1)]] = True
    stop_of = np.zeros(len(w), np.int64)
    stop_of[at] = stops[label]
    starts, stops = _stretches(core)
    keep = stops - starts >= min(max(least, exponent * q) - q for q in range(1, least + 1))
    starts, stops = starts[keep], stops[keep]
    out = np.zeros(len(w) + 1, np.int64)
    np.add.at(out, starts, 1)
    np.add.at(out, np.minimum(stops + (stops - starts) // (exponent - 1), stop_of[starts]), -1)
    return _stretches(np.cumsum(out[:-1]) > 0)


def find(w: np.ndarray, least: int = LEAST, exponent: int = EXPONENT) -> list[tuple[int, int, int]]:
    """(start, length, period), sorted, of all runs of w (numbers from 1; 0 separates texts)."""
    starts, stops = _candidates(w, least, exponent)
    if not len(starts):
        return []
    at, label = _places(starts, stops)
    x = np.zeros(len(at) + len(starts) + 1, np.int64)  # a separator before each stretch
    place = np.arange(len(at)) + label + 1
    x[place] = np.unique(w[at], return_inverse=True)[1] + 1
    back = np.zeros(len(x), np.int64)
    back[place] = at
    return sorted((int(back[s]), n, p) for s, n, p in _sorted_runs(x, least, exponent))


def _found(docs: list[int | None], texts: list[bytes | None], least: int, exponent: int) -> pa.RecordBatch:
    number: defaultdict[bytes, int] = defaultdict()
    number.default_factory = lambda: len(number) + 1
    words = [(t or b"").split() for t in texts]
    first = np.cumsum([0, *[len(x) + 1 for x in words]])  # of each text; a separator after it
    w = np.zeros(first[-1], np.int64)
    for x, at in zip(words, first.tolist()):
        w[at : at + len(x)] = np.fromiter(map(number.__getitem__, x), np.int64, len(x))
    runs = np.array(find(w, least, exponent), np.int64).reshape(-1, 3)
    doc = np.searchsorted(first, runs[:, 0], "right") - 1
    gone = np.zeros(len(w) + 1, np.int64)
    np.add.at(gone, runs[:, 0] + runs[:, 2], 1)
    np.add.at(gone, runs[:, 0] + runs[:, 1], -1)
    kept = np.cumsum(gone) == 0
    some = np.zeros(len(words), bool)
    some[doc] = True
    joined = [b" ".join(compress(x, kept[at : at + len(x)].tolist()) if s else x) for x, at, s in zip(words, first.tolist(), some.tolist())]
    upto = np.searchsorted(doc, np.arange(len(words) + 1)).astype(np.int32)
    fields = pa.StructArray.from_arrays([pa.array(c) for c in (runs[:, 0] - first[doc], runs[:, 1], runs[:, 2])], ["start", "length", "period"])
    return pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.ListArray.from_arrays(pa.array(upto), fields), pa.array(joined, pa.binary())], ["doc_id", "runs", "collapsed"])


def detect(docs: DataFrame, least: int = LEAST, exponent: int = EXPONENT, at_once: int = AT_ONCE) -> DataFrame:
    """documents -> (doc_id, runs, collapsed): runs of at least `least` words and `exponent` (2 or more) periods, and the
    text's words, joined by single spaces, without those that any run holds after its first period."""

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, size = [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids.append(doc_id)
                texts.append(text.as_py())
                size += len(texts[-1] or b"") // 6
                if size >= at_once:
                    yield _found(ids, texts, least, exponent)
                    ids, texts, size = [], [], 0
        if ids:
            yield _found(ids, texts, least, exponent)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(fn, FOUND).withColumn("collapsed", F.col("collapsed").cast("string"))


def repeated(docs: DataFrame) -> DataFrame:
    """doc_id and text of documents, a tenth of which (by a hash of doc_id) repeat a stretch of their words from some word on."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    rows = docs.select("doc_id", "text", F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))).alias("words"), F.floor(h / 10).alias("g"))
    rows = rows.withColumn("n", F.size("words")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    rows = rows.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    word = lambda i: F.get("words", F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")).cast("int"))
    made = F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), F.col("n").cast("long") - 1), word), " ")
    return rows.select("doc_id", F.when(F.col("n") > 0, made).otherwise(F.col("text")).alias("text"))


def digest(found: DataFrame) -> DataFrame:
    """detect() -> a row of numbers and digests for each document: its longest run, all runs, the collapsed text."""
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    told = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")])), "\n")
    rows = found.withColumn("longest", longest).select("doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("longest.start")).alias("start"), F.col("longest.length").alias("length"), (-F.col("longest.period")).alias("period"), "runs", "collapsed")
    exponent = F.floor(1000 * F.col("length") / F.col("period"))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return rows.select("doc_id", "n_runs", "start", "length", "period", exponent.alias("exponent_milli"), sha(F.when(F.col("n_runs") > 0, F.concat(told, F.lit("\n"))).otherwise("")).alias("runs_sha256"), sha(F.col("collapsed")).alias("collapsed_sha256"))
