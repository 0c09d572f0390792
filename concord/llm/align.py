"""Alignment of the tokens of two tokenizers over the bytes of the same texts.

A text is cut into units before each single space or line end between characters that are no white space. No token of
either crosses such a place (the byte-level tokenizer cuts there first; no piece of the other has a space after anything
else or a line end in it, which loading checks), so a unit's tokens, groups and links are those that the whole text has
there, and each distinct unit is encoded once by a worker. Within a unit the spans that the libraries give (character offsets of one, byte
spans of the other's proto) are the cuts; where they are too coarse, because a token ends inside a character or a
character is spelled in byte tokens, the tokens' decoded bytes say where each ends.

Texts become chunks: their units by number, and the chunk's distinct pairs of linked ids with counts. The chunks' pairs
are summed over the corpus, each pair's count and whether it is the highest of its B id goes back to the chunks that
have the pair, and only then are documents summed up. No row stands for a single link.

Defined cases: texts that are null or empty, that are no UTF-8, or whose A or B tokens don't spell a space and the text
have no tokens: counts 0 and ''. Repeated rows count as often as they are there; a null doc_id stays; further columns
are left out; an empty table gives an empty one.
"""

from __future__ import annotations

import functools
import hashlib
import os
import re
import uuid
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concord.llm.common import cut

BYTE_BPE, PIECE_BPE = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
#: Bytes of text of a chunk (one text may be longer), units that a worker remembers (twice as many for a while), and the longest that it does.
CHUNK_BYTES, REMEMBERED, LONGEST = 8_000_000, 200_000, 256
#: Bytes of text whose units are looked up together.
LOOKED_UP = 500_000
#: A pair of ids as one number: a * _BASE + b.
_BASE = 1 << 24
_LINE, _SPACE, _RUN = re.compile(r"(?<=\S)\n(?=\S)"), re.compile(r"(?<=\S) (?=\S)"), re.compile(r"\s(?:\s|$)")
_COUNTS = ("n_a", "n_b", "n_groups", "n_links")
CHUNK = f"chunk long, pair array<long>, n array<long>, docs array<long>, {', '.join(f'{c} array<long>' for c in _COUNTS)}, sha array<string>, body binary"
RESULT = f"doc_id long, {', '.join(f'{c} long' for c in _COUNTS)}, n_best long, count_sum long, groups_sha256 string"


def _byte_letters() -> dict[str, int]:
    """The letters by which a byte-level vocabulary writes bytes: printable ones themselves, the others from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Tokenizers:
    """Both tokenizers and the bytes of their tokens."""

    def __init__(self, byte_bpe: str, piece_bpe: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks share the cores already
        import sentencepiece
        import tokenizers

        self.a = tokenizers.Tokenizer.from_file(byte_bpe)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_bpe)
        letters = _byte_letters()
        vocabulary = self.a.get_vocab()
        self.bytes_a = [b""] * (1 + max(vocabulary.values()))
        for t, i in vocabulary.items():
            self.bytes_a[i] = bytes(map(letters.__getitem__, t)) if all(c in letters for c in t) else t.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.by_unit = not any(re.search("[^▁]▁|\n", p) for p in pieces)
        self.sizes_a, self.sizes_b = (np.array([len(x) for x in own], np.int64) for own in (self.bytes_a, self.bytes_b))
        self.told = [f"{i}{sign}" for i in range(max(len(pieces), len(self.bytes_a))) for sign in ",|;"]
        self.known: dict[str, Unit | None] = {}
        self.older: dict[str, Unit | None] = {}
        self.same: dict[tuple, tuple] = {}

    def units(self, text: str) -> list[str]:
        """The units of a space and the text; all of it as one where pieces may cross."""
        if not self.by_unit:
            return [f" {text}"]
        text, out, begin = f" {text}", [], ""
        plain = not _RUN.search(text)
        for line in text.split("\n") if plain else _LINE.split(text):
            first, *rest = (line[1:].split(" ") if not begin else line.split(" ")) if plain else _SPACE.split(line)
            out.append((begin or " " * plain) + first)
            out += [f" {x}" for x in rest]
            begin = "\n"
        return out

    def forget(self) -> None:
        """Give up what is remembered: nothing more will be encoded for a while."""
        self.known, self.older = {}, {}

    def learn(self, units: set[str]) -> dict[str, Unit | None]:
        """Each unit's alignment; None where its tokens don't spell it. Those met last are remembered, in two generations."""
        out, new, known, older = {}, [], self.known, self.older
        for u in units:
            if u in known:
                out[u] = known[u]
            elif u in older:
                out[u] = known[u] = older[u]
            else:
                new.append(u)
        learned = dict(zip(new, self.aligned(new)))
        out |= learned
        known.update(learned if all(len(u) <= LONGEST for u in new) else {u: x for u, x in learned.items() if len(u) <= LONGEST})
        if len(known) > REMEMBERED:
            self.known, self.older = {}, known
        return out

    def aligned(self, units: list[str]) -> list[Unit | None]:
        """Units are encoded as one text, as far as each may stand before another and the tokens spell it; else in halves."""
        if not units:
            return []
        text = "".join(units)
        if len(units) > 1 and (not self.by_unit or _RUN.search(text)):
            odd = {u: self.aligned([u])[0] for u in units if not self.by_unit or not _joins(u)}
            rest = [u for u in units if u not in odd]
            if odd:
                learned = dict(zip(rest, self.aligned(rest))) | odd
                return [learned[u] for u in units]
        ahead = int(text[0] == " ")  # B puts a space before its text
        a, b = self.a.encode(text, add_special_tokens=False), self.b.encode(text[ahead:], return_type="offset_mapping")
        ids_a, ids_b = a.ids, b["ids"] if ahead else b["ids"][1:]
        raw = text.encode()
        if b"".join(map(self.bytes_a.__getitem__, ids_a)) != raw or b"".join(map(self.bytes_b.__getitem__, ids_b)) != raw:
            half = len(units) // 2
            return self.aligned(units[:half]) + self.aligned(units[half:]) if half else [None]
        upto = np.flatnonzero(np.append((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80, True))  # where characters begin
        spans_a = upto[_flat(a.offsets).reshape(-1, 2)]
        spans_b = _flat(b["offsets"]).reshape(-1, 2) if ahead else _flat(b["offsets"][1:]).reshape(-1, 2)
        spans_b = upto[spans_b + ahead]
        spans_b[0, 0] = 0
        sizes = np.cumsum([len(u) for u in units])
        ids_a, ids_b = np.array(ids_a, np.int64), np.array(ids_b, np.int64)
        return self.linked(ids_a, ends(spans_a, self.sizes_a[ids_a]), ids_b, ends(spans_b, self.sizes_b[ids_b]), upto[sizes])

    def linked(self, ids_a: np.ndarray, ends_a: np.ndarray, ids_b: np.ndarray, ends_b: np.ndarray, last: np.ndarray) -> list[Unit]:
        """Units from the ids and ends of their tokens, laid one after another: last is where each ends.

        Between two neighbouring ends, of whichever list, one token of each lies: that is a link. Ends of both close groups.
        """
        every = np.union1d(ends_a, ends_b)
        at_a, at_b = np.searchsorted(ends_a, every), np.searchsorted(ends_b, every)
        pairs = (ids_a[at_a] * _BASE + ids_b[at_b]).astype(np.int64).tobytes()
        both = every[(ends_a[at_a] == every) & (ends_b[at_b] == every)]
        n_a, n_b, groups, links = (np.diff(np.searchsorted(x, last, "right"), prepend=0).tolist() for x in (ends_a, ends_b, both, every))
        # tokens by group, A's before B's, each with the sign that follows it
        group = np.concatenate([np.searchsorted(both, ends_a), np.searchsorted(both, ends_b)])
        side = np.repeat([0, 1], [len(ids_a), len(ids_b)])
        order = np.argsort(2 * group + side, kind="stable")
        closes = np.concatenate([both[group[: len(ids_a)]] == ends_a, both[group[len(ids_a) :]] == ends_b])
        told = (np.concatenate([ids_a, ids_b]) * 3 + np.where(closes, 1 + side, 0))[order].tolist()
        words, out, same, at, lo = list(map(self.told.__getitem__, told)), [], self.same, 0, 0
        for counts in zip(n_a, n_b, groups, links):
            stop, hi = at + counts[0] + counts[1], lo + 8 * counts[3]
            out.append(("".join(words[at:stop])[:-1], same.setdefault(counts, counts), pairs[lo:hi]))
            at, lo = stop, hi
        return out


def _joins(unit: str) -> bool:
    """Whether another unit may follow it."""
    return not unit[-1].isspace() and (unit[0] == "\n" or unit[0] == " ") and not unit[1].isspace()


def _flat(spans: list[tuple[int, int]]) -> np.ndarray:
    return np.fromiter(chain.from_iterable(spans), np.int64, 2 * len(spans))


def ends(spans: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Where tokens of n bytes end. A span as long as its token's bytes is the token: its end is a cut. From there to the next
    such span the tokens' own bytes are counted."""
    fits, counted = spans[:, 1] - spans[:, 0] == n, np.cumsum(n)
    cut = np.maximum.accumulate(np.where(fits, np.arange(len(n)), -1))
    return counted + np.where(cut >= 0, spans[cut, 1] - counted[cut], 0)


#: One unit: text of its groups; numbers of A tokens, B tokens, groups and links; pairs of linked ids, repeated as often as linked.
Unit = tuple[str, tuple[int, int, int, int], bytes]
_NONE: Unit = ("", (0, 0, 0, 0), b"")


@functools.lru_cache(maxsize=4)
def loaded(byte_bpe: str, piece_bpe: str) -> Tokenizers:
    return Tokenizers(byte_bpe, piece_bpe)


class _Chunk:
    """Texts by their units' numbers. Units are looked up for some texts at a time."""

    def __init__(self, tools: Tokenizers) -> None:
        self.tools, self.bytes, self.waiting, self.held = tools, 0, [], 0
        self.number, self.told, self.counts, self.links, self.bad = {}, [], [], [], set()
        self.docs, self.rows, self.sha = [], [], []

    def add(self, doc_id: int | None, text: str | None, size: int) -> None:
        self.waiting.append((doc_id, self.tools.units(text) if text else []))
        self.bytes, self.held = self.bytes + size, self.held + size
        if self.held >= LOOKED_UP:
            self.look_up()

    def look_up(self) -> None:
        number = self.number
        learned = self.tools.learn({u for _, units in self.waiting for u in units if u not in number})
        first = len(number)
        if None in learned.values():
            self.bad.update(k for k, made in enumerate(learned.values(), first) if made is None)
        number.update(zip(learned, range(first, first + len(learned))))
        whole = [made or _NONE for made in learned.values()]
        self.told += [x[0] for x in whole]
        self.counts += [x[1] for x in whole]
        self.links += [x[2] for x in whole]
        for doc_id, units in self.waiting:
            row = list(map(number.__getitem__, units))
            if self.bad and not self.bad.isdisjoint(row):
                row = []
            self.docs.append(doc_id)
            self.sha.append(hashlib.sha256(";".join(map(self.told.__getitem__, row)).encode()).hexdigest() if row else "")
            self.rows.append(np.array(row, np.int32))
        self.waiting, self.held = [], 0

    def record(self) -> dict:
        """The body holds, compressed, the documents' lengths in units and their units, the units' lengths in links, and those by the
        pair's place in `pair`."""
        self.look_up()
        rows, sizes = np.concatenate(self.rows), np.array([len(r) for r in self.rows], np.int32)
        used = np.bincount(rows, minlength=len(self.links))
        links = [x if k else b"" for x, k in zip(self.links, used.tolist())]
        lengths = np.array([len(x) // 8 for x in links], np.int32)
        pair, at = np.unique(np.frombuffer(b"".join(links), np.int64), return_inverse=True)
        n = np.bincount(at, weights=np.repeat(used, lengths), minlength=len(pair)).astype(np.int64)
        parts = [sizes, rows, lengths, at.astype(np.int32)]
        body = b"".join([np.array([len(p) for p in parts], np.int64).tobytes(), *[p.tobytes() for p in parts]])
        counts = np.array(self.counts, np.int64).reshape(-1, 4).T
        return {"chunk": uuid.uuid4().int >> 65, "pair": pair, "n": n, "docs": self.docs, "sha": self.sha, "body": zstandard.compress(body, 1)} | {c: _sums(x[rows], sizes) for c, x in zip(_COUNTS, counts)}


def _unpacked(body: bytes) -> list[np.ndarray]:
    raw = zstandard.decompress(body)
    sizes, at, out = np.frombuffer(raw, np.int64, 4), 32, []
    for n in sizes:
        out.append(np.frombuffer(raw, np.int32, int(n), at))
        at += 4 * int(n)
    return out


def _sums(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sums of consecutive stretches of values, of the given lengths."""
    upto = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    stop = np.cumsum(lengths, dtype=np.int64)
    return upto[stop] - upto[stop - lengths]


def chunks(docs: DataFrame, byte_bpe: str, piece_bpe: str, chunk_bytes: int) -> DataFrame:
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = loaded(byte_bpe, piece_bpe)
        chunk = _Chunk(tools)
        for batch in batches:
            for doc_id, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = raw.as_py()
                try:
                    text = raw.decode() if raw else None
                except UnicodeDecodeError:
                    text = None
                chunk.add(doc_id, text, len(raw or b""))
                if chunk.bytes >= chunk_bytes:
                    yield _batch(chunk.record())
                    chunk = _Chunk(tools)
        if chunk.waiting or chunk.docs:
            yield _batch(chunk.record())

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(encode, CHUNK)


def _batch(record: dict) -> pa.RecordBatch:
    ints = pa.list_(pa.int64())
    kinds = {"chunk": pa.int64(), "sha": pa.list_(pa.string()), "body": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array([v], kinds.get(k, ints)) for k, v in record.items()], list(record)).select([c.split()[0] for c in CHUNK.split(", ")])


def align(docs: DataFrame, byte_bpe: str = BYTE_BPE, piece_bpe: str = PIECE_BPE, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """documents -> per row doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    made = cut(chunks(docs, byte_bpe, piece_bpe, chunk_bytes), "aligned")
    asked = made.select("chunk", F.posexplode(F.arrays_zip("pair", "n")).alias("at", "p")).select("chunk", "at", "p.pair", "p.n")
    answers = asked.select("chunk", "at", "pair").join(pair_counts(made), "pair").groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("at", "count", "best"))).alias("answer"))

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded(byte_bpe, piece_bpe).forget()
        for batch in batches:
            for row in range(batch.num_rows):
                one = batch.slice(row, 1)
                col = lambda c: one.column(c)[0]  # noqa: B023, E731
                lengths, units, links, at = _unpacked(col("body").as_py())
                counts = np.array(col("count").values.to_numpy(), np.int64) if len(at) else np.zeros(0, np.int64)
                best = col("best").values.to_numpy(zero_copy_only=False).astype(np.int64) if len(at) else counts
                by_doc = [_sums(_sums(v[at], links)[units], lengths) for v in (best, counts)]
                yield pa.RecordBatch.from_arrays([col("docs").values, *[col(c).values for c in _COUNTS], *map(pa.array, by_doc), col("sha").values], [c.split()[0] for c in RESULT.split(", ")])

    rows = made.drop("pair", "n").join(answers, "chunk", "left").withColumns({"count": F.col("answer.count"), "best": F.col("answer.best")}).drop("answer", "chunk")
    return rows.mapInArrow(summed, RESULT)


def pair_counts(made: DataFrame) -> DataFrame:
    """(pair, count, best): links of the corpus for each pair of ids, and whether no other pair of its B id has more.

    The highest counts are a row for each B id, at most as many as its vocabulary has (32,000 of 16 bytes): broadcast.
    """
    pairs = made.select(F.explode(F.arrays_zip("pair", "n")).alias("p")).groupBy(F.col("p.pair").alias("pair")).agg(F.sum("p.n").alias("count"))
    pairs = cut(pairs, "pairs").withColumn("b", F.col("pair") % _BASE)
    highest = pairs.groupBy("b").agg(F.max("count").alias("highest"))
    return pairs.join(F.broadcast(highest), "b").select("pair", "count", (F.col("count") == F.col("highest")).alias("best"))


def pairs(docs: DataFrame, byte_bpe: str = BYTE_BPE, piece_bpe: str = PIECE_BPE, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The corpus's map between vocabularies: a_id, b_id, the links between them, and whether they are the most of b_id."""
    rows = pair_counts(cut(chunks(docs, byte_bpe, piece_bpe, chunk_bytes), "aligned"))
    return rows.select(F.floor(F.col("pair") / _BASE).alias("a_id"), (F.col("pair") % _BASE).alias("b_id"), "count", "best")

