"""Benchmark decontamination by CGK embeddings.

The CGK random walk (Chakraborty, Goldenberg, Koucky, 2016) reads a string with a pointer: at every step it writes the
symbol under the pointer, and moves on by the random bit that the step has for that symbol. Strings at a small edit
distance, walked with the same bits, soon write the same symbols again, so edit distance becomes Hamming distance.
Here the symbols are words. An item of n words may have `slack` = tolerance * n edits. A near copy shares a first word
with it, at one of the item's first slack + 1 places, as all before it are edited; so item-sized embeddings are made
from each of these places, and the item-sized windows of a document from each of its words. Bit sampling finds windows
whose embeddings are near in Hamming distance: each walk is sampled a few times, at the first and `SAMPLES` more steps, and a
window is a candidate where all these symbols agree. As many walks are taken as reach `RECALL` on edited copies of a
bounded sample of the items, made at the full tolerance, and `SPARE` more. An exact edit distance on the window that
the item would fill decides.

Windows without as many words of the items of their size as the distance needs are left out before they are walked,
which loses nothing. Items are grouped by size, a third apart.

A benchmark of any size is looked for in parts of about `MAX_ITEM_WORDS` words, one pass after the other with what has
been found so far written to a table: driver and workers hold one part at a time.

A document is contaminated if some part of it is within edit distance `tolerance` * (words of the item) of an item.

Defined cases: words are runs of letters or digits, lower-cased; items without words take no part; items equal in
words count as one, under the smallest item_id; null and empty texts have no windows; repeated rows are judged alike;
extra columns are kept by `remove` and ignored by `matches`; an empty benchmark rejects nothing.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concord.llm.common import cut, discard, fresh

_WORD = re.compile(r"[^\W_]+")
#: Words of items that are looked for together, about.
MAX_ITEM_WORDS = 200_000
#: Walks at most, samplings of each, the recall to reach, walks beyond that, and edited copies on which it is measured
WALKS, SAMPLINGS, RECALL, SPARE, COPIES = 24, 8, 0.995, 2, 400
#: Steps of a sampling besides the first
SAMPLES = 3
_ODD = np.uint64(0x9E3779B97F4A7C15)
#: Windows that are walked together.
BLOCK = 1 << 17


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def distances_within(item: list[int], windows: np.ndarray) -> np.ndarray:
    """For each row of windows the least edit distance of item to any part of it (Sellers)."""
    a, steps = np.array(item, dtype=windows.dtype), np.arange(len(item) + 1, dtype=np.int32)
    column = np.tile(steps, (len(windows), 1))
    best = column[:, -1].copy()
    change = np.zeros_like(column)
    for symbol in windows.T:
        change[:, 1:] = np.minimum(column[:, :-1] + (a != symbol[:, None]), column[:, 1:] + 1)
        column = np.minimum.accumulate(change - steps, axis=1) + steps  # an insertion after any earlier cell
        np.minimum(best, column[:, -1], out=best)
    return best


def distance_within(item: list[int], text: list[int]) -> int:
    """Least edit distance of item to any part of text."""
    return int(distances_within(item, np.array([text], dtype=np.int64).reshape(1, -1))[0])


class Size:
    """Items of about one size: the samples of their embeddings from each of their first slack + 1 places."""

    def __init__(self, items: list[tuple[int, list[int]]], tolerance: float, symbols: int, rng: np.random.Generator) -> None:
        self.stop = symbols - 1
        least, most = min(len(w) for _, w in items), max(len(w) for _, w in items)
        self.reach = most + int(tolerance * most)
        self.needed = least - int(tolerance * least)
        ids, at, owner, offset = [], [], [], []
        for n, words in items:
            own = int(tolerance * len(words)) + 1
            at += range(len(ids), len(ids) + own)
            owner += [n] * own
            offset += range(own)
            ids += [*words, self.stop]
        self.owner, self.offset = np.array(owner, dtype=np.int64), np.array(offset, dtype=np.int64)
        ids, at = np.array(ids, dtype=np.int32), np.array(at, dtype=np.int64)
        self.inside, self.begins = np.zeros(symbols, dtype=bool), np.zeros(symbols, dtype=bool)
        self.inside[ids], self.begins[ids[at]], self.inside[self.stop] = True, True, False
        steps = 2 * self.needed  # a walk moves on at every other step
        self.walks = []
        for _ in range(WALKS):
            bits = rng.integers(0, 2, size=(steps, symbols), dtype=np.int8)
            bits[:, self.stop] = 0  # a walk stays at the end of its text
            # Steps are spread, so that they show different words; the first sampling is within every embedding, however short.
            chosen = [[(k + 1) * (self.needed - 1) // SAMPLES for k in range(SAMPLES)], *((np.arange(SAMPLES) + rng.random((SAMPLINGS - 1, SAMPLES))) * steps / SAMPLES).astype(int).tolist()]
            tables = []
            for key, within in self._samples(bits, chosen, ids, at):
                order = np.argsort(key[within], kind="stable")
                key = key[within][order]
                maybe = np.zeros(1 << (16 * len(at)).bit_length(), dtype=bool)  # most windows end here
                maybe[key & np.uint64(len(maybe) - 1)] = True
                tables.append((maybe, key, within[order]))
            self.walks.append((bits, chosen, tables))

    def _samples(self, bits: np.ndarray, chosen: list[list[int]], ids: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each sampling a hash of what the walks from `at` write at its steps and first, and which of them are within their text."""
        wanted = {t for steps in chosen for t in steps}
        written, p = {}, at.astype(np.int32)
        for t in range(max(wanted) + 1):
            symbol = ids[p]
            if t in wanted:
                written[t] = symbol
            p = p + bits[t][symbol]
        for steps in chosen:
            key = ids[at].astype(np.uint64)
            for t in steps:
                key = (key ^ (key >> np.uint64(29))) * _ODD + written[t].astype(np.uint64)
            yield key, np.flatnonzero(written[max(steps)] != self.stop)

    def windows(self, ids: np.ndarray) -> np.ndarray:
        """Starts of windows that begin as an embedding does and have as many words of items as the distance needs."""
        starts = np.flatnonzero(self.begins[ids])
        if len(starts):
            upto = np.concatenate([[0], np.cumsum(self.inside[ids], dtype=np.int64)])
            starts = starts[upto[np.minimum(starts + self.reach, len(ids))] - upto[starts] >= self.needed]
        return starts

    def met(self, ids: np.ndarray, starts: np.ndarray, walks: range | list[int]) -> tuple[np.ndarray, np.ndarray]:
        """(which of the starts, which of the embeddings) that agree in some sampling of the walks, each pair once."""
        found = []
        for k in walks:
            bits, chosen, tables = self.walks[k]
            for (key, _), (maybe, keys, entries) in zip(self._samples(bits, chosen, ids, starts), tables):
                hit = np.flatnonzero(maybe[key & np.uint64(len(maybe) - 1)])
                lo, hi = np.searchsorted(keys, key[hit]), np.searchsorted(keys, key[hit], side="right")
                hit, lo, n = hit[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
                if len(hit):
                    rank = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    found.append(np.unique(np.repeat(hit, n) * len(self.owner) + entries[np.repeat(lo, n) + rank]))
        pairs = np.unique(np.concatenate(found)) if found else np.zeros(0, dtype=np.int64)
        return pairs // len(self.owner), pairs % len(self.owner)

    def candidates(self, ids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(place in ids, item, its place in the item) where an embedding was met; ids has a stop after each text."""
        starts = self.windows(ids)
        for at in range(0, len(starts), BLOCK):
            own = starts[at : at + BLOCK]
            which, entry = self.met(ids, own, range(len(self.walks)))
            yield own[which], self.owner[entry], self.offset[entry]

    def settle(self, items: list[tuple[int, list[int]]], tolerance: float, rng: np.random.Generator) -> None:
        """Keeps as many walks as reach the recall on edited copies of a sample of the items, and some to spare."""
        copies = []
        for n, words in (items[i] for i in np.linspace(0, len(items) - 1, COPIES // 4).astype(int).tolist()):
            for _ in range(4):
                copies.append((n, _edited(words, int(tolerance * len(words)), rng)))
        first = np.full(len(copies), len(self.walks))
        for c, (n, words) in enumerate(copies):
            ids = np.array([*words, self.stop], dtype=np.int32)
            starts = np.flatnonzero(self.begins[ids])
            for k in range(len(self.walks)):
                if (self.owner[self.met(ids, starts, [k])[1]] == n).any():
                    first[c] = k
                    break
        reached = [k + 1 for k in range(len(self.walks)) if (first <= k).mean() >= RECALL]
        self.walks = self.walks[: (reached[0] if reached else len(self.walks)) + SPARE]


def _edited(words: list[int], edits: int, rng: np.random.Generator) -> list[int]:
    """A copy with words replaced, added or left out at random; what comes in is in no item."""
    out = list(words)
    for kind in rng.integers(0, 3, size=edits).tolist():
        at = int(rng.integers(0, len(out) + (kind == 1))) if out else 0
        out[at : at + (kind != 1)] = [] if kind == 2 else [0]
    return out


class Finder:
    def __init__(self, items: list[tuple[int, list[str]]], tolerance: float, seed: int = 11) -> None:
        if not 0 <= tolerance < 1:
            raise ValueError(f"tolerance {tolerance}: a share of an item's words, below 1")
        self.tolerance = tolerance
        self.ids: dict[str, int] = {}
        for _, words in items:
            for w in words:
                self.ids.setdefault(w, len(self.ids) + 1)  # 0: in no item
        self.stop = len(self.ids) + 1
        self.items = {i: [self.ids[w] for w in words] for i, words in items}
        self.names = list(self.items)
        rng = np.random.default_rng(seed)
        groups: dict[int, list[tuple[int, list[int]]]] = {}
        for n, words in enumerate(self.items.values()):
            groups.setdefault(int(math.log(len(words), 4 / 3) + 1e-9), []).append((n, words))
        self.sizes = []
        for _, own in sorted(groups.items()):
            size = Size(own, tolerance, self.stop + 1, rng)
            size.settle(own, tolerance, rng)
            self.sizes.append(size)

    def find(self, texts: list[str | None]) -> list[list[int]]:
        """Items that each text holds."""
        found: list[set[int]] = [set() for _ in texts]
        get, parts, owner = self.ids.get, [], []
        for n, text in enumerate(texts):
            words = words_of(text)
            if words:
                own = list(map(get, words, repeat(0)))
                parts.append(np.array([*own, self.stop], dtype=np.int32))
                owner.append(n)
        if not parts:
            return [[] for _ in texts]
        ids = np.concatenate(parts)
        ends = np.cumsum([len(x) for x in parts])
        hits = [hit for size in self.sizes for hit in size.candidates(ids)]
        if not hits:
            return [[] for _ in texts]
        start, number, offset = (np.concatenate(x) for x in zip(*hits))
        order = np.argsort(number, kind="stable")
        cuts = np.searchsorted(number[order], np.arange(len(self.names) + 1))
        for k in np.flatnonzero(np.diff(cuts)).tolist():
            item, own = self.names[k], order[cuts[k] : cuts[k + 1]]
            words = self.items[item]
            slack = int(self.tolerance * len(words))
            # By where the item would start: the same place may be met through several embeddings.
            at, before = start[own], offset[own]
            doc = np.searchsorted(ends, at, side="right")
            lo = np.maximum(at - before - slack, np.where(doc > 0, ends[doc - 1], 0))
            lo, first = np.unique(lo, return_index=True)
            doc = doc[first]
            reach = np.minimum(lo[:, None] + np.arange(len(words) + 2 * slack), len(ids) - 1)
            window = ids[reach]
            window = np.where(np.maximum.accumulate(window == self.stop, axis=1), self.stop, window)
            enough = np.isin(window, words).sum(axis=1) >= len(words) - slack  # as many shared words as the distance needs
            doc, window = doc[enough], window[enough]
            # From the first window of each document on, in growing blocks, without documents that are found already.
            queue, block = np.argsort(np.arange(len(doc)) - np.searchsorted(doc, doc), kind="stable"), 64
            while len(queue):
                now, queue = queue[:block], queue[block:]
                held = np.unique(doc[now[distances_within(words, window[now]) <= slack]])
                for n in held.tolist():
                    found[owner[n]].add(item)
                queue, block = queue[~np.isin(doc[queue], held)], min(2 * block, 2048)
        return [sorted(x) for x in found]


def parts(benchmark: DataFrame) -> list[DataFrame]:
    """The different items, (item, words), in parts of about `MAX_ITEM_WORDS` words each."""

    @F.pandas_udf("array<string>")
    def cut_up(texts: pd.Series) -> pd.Series:
        return pd.Series([words_of(t) for t in texts], dtype=object)

    rows = benchmark.select(F.col("item_id").cast("long").alias("item"), cut_up(F.col("text").cast("string")).alias("words")).where("item is not null and size(words) > 0")
    items = cut(rows.groupBy("words").agg(F.min("item").alias("item")), "items")
    n = -(-items.agg(F.coalesce(F.sum(F.size("words")), F.lit(0))).first()[0] // MAX_ITEM_WORDS)
    return [items.where(F.pmod(F.xxhash64("item"), F.lit(n)) == k).orderBy("item") for k in range(n)]


def _found_by(part: DataFrame, tolerance: float, text) -> Column:
    found = Finder([(r["item"], list(r["words"])) for r in part.collect()], tolerance)

    @F.pandas_udf("array<long>")
    def of(texts: pd.Series) -> pd.Series:
        out: list[list[int]] = []
        for at in range(0, len(texts), 1000):
            out += found.find(list(texts[at : at + 1000]))
        return pd.Series(out, dtype=object)

    return of(text)


def _with_items(docs: DataFrame, text: str, benchmark: DataFrame, tolerance: float, name: str) -> DataFrame:
    """docs with the items that each holds; more parts than one are looked for pass by pass."""
    own = parts(benchmark)
    if not own:
        return docs.withColumn(name, F.array().cast("array<long>"))
    docs = docs.withColumn(name, _found_by(own[0], tolerance, F.col(text)))
    passed: list[str] = []
    for part in own[1:]:
        made: list[str] = []
        docs = cut(docs, "matched", made).withColumn(name, F.concat(name, _found_by(part, tolerance, F.col(text))))
        if len(passed) > 1:
            discard(docs.sparkSession, [passed.pop(0)])
        passed += made
    return docs.withColumn(name, F.array_sort(name)) if len(own) > 1 else docs


def matches(docs: DataFrame, benchmark: DataFrame, tolerance: float = 0.2) -> DataFrame:
    """documents -> (doc_id, n_items, items, contaminated), one row for each document."""
    rows = _with_items(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), "text", benchmark, tolerance, "items")
    return rows.select("doc_id", F.size("items").cast("long").alias("n_items"), "items", (F.size("items") > 0).alias("contaminated"))


def remove(docs: DataFrame, benchmark: DataFrame, tolerance: float = 0.2) -> DataFrame:
    """The documents that hold no item, with their own columns."""
    (name,) = fresh(docs, "held")
    return _with_items(docs, "text", benchmark, tolerance, name).where(F.size(name) == 0).drop(name)
