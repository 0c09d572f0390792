"""Katz backoff trigram model: trained on a part of the corpus, it scores every document.

P(w | v u) = d(c) * c(v u w) / c(v u) for trigrams seen in training, and a(v u) * P(w | u) for all others; P(w | u) backs
off in the same way to P(w) = d(c) * c(w) / N, and what that leaves is the unknown word's. d is the Good-Turing discount
of counts up to 5 (Katz, 1987), of each order; every n-gram is kept, those seen once too. a(h) makes each distribution
sum to 1 exactly: what the seen successors of h leave, over what the lower order leaves for the words not among them.
Texts begin with two start symbols and end with an end symbol.

How it runs. `encode` turns texts into chunks of numbers, once: a chunk is some documents, their distinct words and
their tokens as places in that list. Then, order by order, chunks ask and buckets answer. A chunk sends its distinct
n-grams with their training counts, packed, one row to a bucket; the bucket sums them over all chunks, keeps the totals
as its part of the model, and sends each chunk the totals of what it asked for. So a task sees whole contexts and can
normalise them, and a chunk then knows all counts of its own tokens and evaluates the recursion for each. Where an
n-gram is unseen, the answer also has what its context's weight is made of.

* Buckets hold whole contexts, of `BUCKET` tokens' n-grams at most: their number grows with the corpus. Contexts that
  occur more often than `hot` are spread over all buckets by n-gram; their sums are few rows, added up by Spark. There
  are never more than `MAX_HOT` of them, which are sent to all tasks, as `hot` grows with the corpus from 2 * 10^11
  tokens on: at 10^13 a context that isn't hot has 5 million n-grams at most.
* A frequent word or n-gram is asked for by every chunk. Where there are more than `FAN` chunks, the asks of some `FAN`
  are merged before they meet a bucket, and the bucket's answer is passed on to each of them: no group has more rows
  than `FAN` or there are such merged ones.
* Each order is asked for in `SLICES` turns, each for a part of the buckets, and chunks meet their answers in `TURNS`
  turns, each for a part of the chunks, which bounds the disk that shuffles take.

The model is a table of each order in the shared folder, partitioned by bucket: `words` and `grams` read them as rows.

Words are known by 64 bits that are linear in their bytes, with a random odd factor for each position (of two words
that differ, the sums agree with probability 2^-57 at most, about 2^-62 as a rule), contexts by 64 bits, an n-gram by its context and 32 more bits (40
if the context occurs 65,536 times or more), which only have to tell the successors of one context apart.

Defined cases: a null or blank text is the end token alone; a null doc_id is held out; repeated rows are scored each
(and counted each, if in training); very long texts are read whole; without training rows every word is unknown, of
probability 1; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from concord.llm.common import cut, discard, held_out

START, END = np.uint64(0x5BD1E9955BD1E995), np.uint64(0xC2B2AE3D27D4EB4F)
_LOW = np.uint64((1 << 38) - 1)
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
#: Counts up to this one are discounted.
TOP = 5
#: Tokens of a chunk, about (a longer document is a chunk of its own).
CHUNK = 750_000
#: Tokens whose n-grams one bucket holds, about, and buckets at least.
BUCKET, MIN_BUCKETS = 1_000_000, 24
#: Turns in which an order's n-grams are asked for, and in which chunks meet the answers.
SLICES, TURNS = {2: 2, 3: 8}, 4
#: Contexts that are sent to all tasks at most (some 60 bytes each), and the least count that makes one hot.
MAX_HOT, LEAST_HOT = 2_000_000, 100_000
#: Chunks, about, whose asks meet in one group.
FAN = 4096
#: What is left for other words counts as this much at least, where rounding or undiscounted counts leave nothing.
FLOOR = 1e-12


def pair_key(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    x = (first * _A) ^ (second + (first >> np.uint64(31)))
    x = (x ^ (x >> np.uint64(32))) * _B
    return x ^ (x >> np.uint64(29))


_zip, _unzip = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def pack(x: np.ndarray) -> bytes:
    """Unsigned integers in the fewest bytes that hold them, by byte planes: compressed, but for planes without a pattern."""
    top = int(x.max()) if len(x) else 0
    size = next(n for n in (1, 2, 4, 8) if top < 1 << 8 * n)
    planes = np.ascontiguousarray(x.astype(f"<u{size}").view(np.uint8).reshape(len(x), size).T)
    plain = [len(x) >= 512 and int(np.bincount(p[:2048]).max()) < min(len(x), 2048) // 64 for p in planes]
    held = [p.tobytes() for p, raw in zip(planes, plain) if raw]
    rest = _zip.compress(b"".join(p.tobytes() for p, raw in zip(planes, plain) if not raw))
    return b"".join([bytes([size, sum(1 << i for i, raw in enumerate(plain) if raw)]), len(x).to_bytes(8, "little"), *held, rest])


def unpack(data: bytes) -> np.ndarray:
    size, plain, n = data[0], data[1], int.from_bytes(data[2:10], "little")
    out, at = np.empty((n, size), dtype=np.uint8), 10
    for i in range(size):
        if plain >> i & 1:
            out[:, i] = np.frombuffer(data, dtype=np.uint8, count=n, offset=at)
            at += n
    rest = np.frombuffer(_unzip.decompress(data[at:]), dtype=np.uint8).reshape(-1, n) if n else np.zeros((size, 0), dtype=np.uint8)
    for own, i in enumerate(i for i in range(size) if not plain >> i & 1):
        out[:, i] = rest[own]
    return out.reshape(-1).view(f"<u{size}").astype(np.int64 if size < 8 else np.uint64)


def order_of(key: np.ndarray) -> np.ndarray:
    """A stable argsort of 64-bit keys: their upper bits are sorted with their places as the lower ones, if these tell them apart."""
    if not len(key):
        return np.zeros(0, dtype=np.int64)
    mask = np.uint64((1 << max(1, (len(key) - 1).bit_length())) - 1)
    s = np.sort((key & ~mask) | np.arange(len(key), dtype=np.uint64))
    by = (s & mask).astype(np.int64)
    k = key[by]
    if ((k[1:] != k[:-1]) & ((s[1:] ^ s[:-1]) <= mask)).any():
        return np.argsort(key, kind="stable")
    return by


def pack_keys(x: np.ndarray) -> bytes:
    """64-bit keys by their differences (modulo 2^64, so in any order); sorted ones are small."""
    return pack(np.diff(x, prepend=np.uint64(0)))


def unpack_keys(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data).astype(np.uint64), dtype=np.uint64)


def pack_floats(x: np.ndarray, kind=np.float64) -> bytes:
    x = x.astype(kind)
    return pack(x.view(f"<u{x.itemsize}"))


def unpack_floats(data: bytes, kind=np.float64) -> np.ndarray:
    return unpack(data).astype(f"<u{np.dtype(kind).itemsize}").view(kind).astype(np.float64)


def bucket_of(route: np.ndarray, n: int) -> np.ndarray:
    """Ranges of the upper 26 bits: keys in order are in the order of their buckets."""
    return ((route >> np.uint64(38)) * np.uint64(n) >> np.uint64(26)).astype(np.int64)


def first_key(bucket: int, n: int) -> int:
    """The least key of a bucket."""
    return -(-(bucket << 26) // n) << 38


def in_turn(route: np.ndarray, turn: tuple[int, int], n: int) -> np.ndarray:
    """Whether keys are of the buckets of turn k of m, a range of all."""
    k, m = turn
    lo, hi = first_key(k * n // m, n), first_key((k + 1) * n // m, n)
    return (route >= np.uint64(lo)) & (route <= np.uint64(hi - 1)) if hi > lo else np.zeros(len(route), dtype=bool)


def _runs(x: np.ndarray) -> np.ndarray:
    """Where each run of equal values starts."""
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, dtype=np.int64)


def _lengths(starts: np.ndarray, n: int) -> np.ndarray:
    return np.diff(np.append(starts, n))


def _summed(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(x, starts) if len(starts) else x[:0]


# Texts to chunks.

_CHUNK = "chunk long, tokens long, words binary, tok binary, len binary, doc array<long>, out array<boolean>"


#: Bytes of text that are hashed at once, about (a word is never cut).
WINDOW = 1 << 22
_LETTER = np.array([ord(chr(b).lower()) + 1 if b < 128 else b + 1 for b in range(256)], dtype=np.uint64)
_SPACE, _BREAK = np.isin(np.arange(256), list(b" \t\n\v\f\r")), re.compile(rb"[ \t\n\v\f\r]")


def _multipliers(at: np.ndarray) -> np.ndarray:
    """An odd random multiplier for each position in a word."""
    x = (at.astype(np.uint64) + np.uint64(1)) * _A
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))) | np.uint64(1)


_FIRST = _multipliers(np.arange(256))


def _word_hashes(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hash, start) of each word: a multilinear hash of its bytes, A-Z as a-z, mixed so that all bits depend on all."""
    data = np.frombuffer(text, dtype=np.uint8)
    inner = np.flatnonzero(~_SPACE[data])
    if not len(inner):
        return np.zeros(0, dtype=np.uint64), inner
    first = np.flatnonzero(np.diff(inner, prepend=-2) > 1)
    starts, size = inner[first], _lengths(first, len(inner))
    at = np.arange(len(inner)) - np.repeat(first, size)
    factor = _FIRST[at] if size.max() <= len(_FIRST) else _multipliers(at)
    x = np.add.reduceat(_LETTER[data[inner]] * factor, first)
    x = (x ^ (x >> np.uint64(32))) * _B
    return x ^ (x >> np.uint64(29)), starts


def _windows(text: bytes) -> Iterator[bytes]:
    """A text in pieces of about WINDOW bytes that end with a word."""
    lo = 0
    while len(text) - lo > WINDOW:
        found = _BREAK.search(text, lo + WINDOW)
        hi = found.start() if found else len(text)
        yield text[lo:hi]
        lo = hi
    yield text[lo:]


def _token_hashes(texts: list[bytes]) -> list[np.ndarray]:
    """For each text the hashes of two start symbols, its words and an end symbol; short texts are hashed together."""
    out, lo = [], 0
    while lo < len(texts):
        hi, size = lo + 1, len(texts[lo])
        while hi < len(texts) and size + len(texts[hi]) <= WINDOW:
            size += len(texts[hi])
            hi += 1
        if hi == lo + 1:
            out.append(np.concatenate([[START, START], *[_word_hashes(w)[0] for w in _windows(texts[lo])], [END]]).astype(np.uint64))
        else:
            ends = np.cumsum([len(t) + 1 for t in texts[lo:hi]])
            words, starts = _word_hashes(b"\n".join(texts[lo:hi]))
            upto = np.searchsorted(starts, ends)
            out += [np.concatenate([(START, START), words[a:b], (END,)]) for a, b in zip([0, *upto[:-1].tolist()], upto.tolist())]
        lo = hi
    return out


def _encoded(limit: int):
    def row(chunk: int, parts: list[np.ndarray], records: list[tuple]) -> pa.RecordBatch:
        tokens = np.concatenate(parts)
        order = order_of(tokens)
        held = tokens[order]
        starts = _runs(held)
        tokens = np.empty(len(held), dtype=np.int64)
        tokens[order] = np.repeat(np.arange(len(starts)), _lengths(starts, len(held)))
        lengths = np.array([n for _, _, n in records], dtype=np.int64)
        cols = [[chunk], [int(lengths.sum())], [pack_keys(held[starts])], [pack(tokens)], [pack(lengths)]]
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
        arrays = [pa.array(c, k) for c, k in zip(cols, kinds)]
        arrays += [pa.array([[d for d, _, _ in records]], pa.list_(pa.int64())), pa.array([[o for _, o, _ in records]], pa.list_(pa.bool_()))]
        return pa.RecordBatch.from_arrays(arrays, ["chunk", "tokens", "words", "tok", "len", "doc", "out"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        parts, records, tokens = [], [], 0
        for batch in batches:
            docs, outs = (batch.column(c).to_pylist() for c in ("doc_id", "out"))
            for lo in range(0, batch.num_rows, 256):
                texts = [t or b"" for t in batch.column("text").slice(lo, 256).to_pylist()]
                for own, doc, out in zip(_token_hashes(texts), docs[lo:], outs[lo:]):
                    parts.append(own)
                    records.append((doc, out, len(own) - 2))
                    tokens += len(own)
                    if tokens >= limit:
                        yield row(chunk, parts, records)
                        parts, records, tokens, chunk = [], [], 0, chunk + 1
        if records:
            yield row(chunk, parts, records)

    return run


class Chunk:
    """A row of the table of chunks: for each token its word w, the words v and u before it, and whether it is trained on."""

    def __init__(self, row: dict) -> None:
        self.row = row
        self.words, tok, self.length = unpack_keys(row["words"]), unpack(row["tok"]), unpack(row["len"])
        starts = np.cumsum(self.length + 2) - self.length - 2
        inner = np.ones(len(tok), dtype=bool)
        inner[starts] = inner[starts + 1] = False
        at = np.flatnonzero(inner)
        self.v, self.u, self.w = tok[at - 2], tok[at - 1], tok[at]
        self.first = np.cumsum(self.length) - self.length  # each document's first token
        self.trained = np.repeat(~np.array(row["out"], dtype=bool), self.length).astype(np.int64)
        self.c1 = unpack(row["c1"]) if row.get("c1") else None
        self.c2 = unpack(row["c2"]) if row.get("c2") else None

    def histories(self, docs: int) -> np.ndarray:
        """How often each word of the list is a history: as often as it occurs, the start symbol once a text."""
        return np.where(self.words == START, docs, self.c1)


class Stage:
    """What tasks need to know once an order is counted: documents, tokens and words of the training part, the number of
    buckets, the limit for hot contexts, discounts by order, and the hot contexts' parts by order."""

    def __init__(self, buckets: int, hot: int) -> None:
        self.buckets, self.hot = buckets, hot
        self.fans = 1
        self.n = self.v = self.docs = 0
        self.unknown = 1.0
        self.d: dict[int, np.ndarray] = {}
        self.hot_parts: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def seen(self, order: int, c: np.ndarray, of: np.ndarray | float) -> np.ndarray:
        """The discounted probability of what was seen c times."""
        ratio = np.concatenate([[0.0], self.d[order], [1.0]])
        return ratio[np.minimum(c, TOP + 1)] * c / np.maximum(of, 1)

    def alpha(self, order: int, counts: np.ndarray, low: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Backoff weights from the contexts' numbers of successors seen 1 .. TOP times, their lower-order sum and count."""
        lost = (1 - self.d[order]) * np.arange(1, TOP + 1)
        left = (counts * lost).sum(axis=-1) / np.maximum(h, 1)
        return np.where(h > 0, np.maximum(left, FLOOR) / np.maximum(1 - low, FLOOR), 1.0)


class Entries:
    """A chunk's distinct n-grams of an order, in the order in which they are sent: by route, which gives the bucket."""

    def __init__(self, c: Chunk, order: int, stage: Stage, turn: tuple[int, int] = (0, 1)) -> None:
        hist = c.histories(stage.docs)
        if order == 2:
            ctx, h = c.words[c.u], hist[c.u]
        else:
            ctx = pair_key(c.words[c.v], c.words[c.u])
            h = np.empty(len(ctx), dtype=np.int64)
            h[1:] = c.c2[:-1]
            h[c.first] = stage.docs
        self.token_h, n = h, len(ctx)
        # Where its bucket is known by the context alone, an n-gram of another turn needn't be made.
        whole = turn[1] == 1
        spread = h >= stage.hot
        own = np.arange(n) if whole else np.flatnonzero(in_turn(ctx, turn, stage.buckets) | spread)
        if not whole:
            ctx, spread = ctx[own], spread[own]
        t = pair_key(ctx, c.words[c.w[own]])
        route = np.where(spread, t, ctx)
        if not whole and spread.any():
            mine = in_turn(route, turn, stage.buckets)
            own, ctx, t, route = own[mine], ctx[mine], t[mine], route[mine]
        # In order of route, and within a route by n-gram, as far as 64 bits go; what this leaves apart is sent twice, which
        # does no harm. Ties go by the place in the text, in as many bits in each turn, so that all turns have one order.
        bits = np.uint64(max(1, (n - 1).bit_length()))
        key = (route >> np.uint64(38) << np.uint64(38)) | ((t & _LOW) >> bits << bits) | np.arange(len(t), dtype=np.uint64)
        key.sort()
        by = (key & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
        del key
        s = t[by]
        starts = _runs(s)
        if whole:
            self.of_token = np.empty(n, dtype=np.int32)  # for each token its n-gram's place
            self.of_token[by] = np.repeat(np.arange(len(starts), dtype=np.int32), _lengths(starts, n))
        self.count = _summed(c.trained[own[by]], starts)
        first = by[starts]
        pick = own[first]  # places in the text
        self.ctx, self.h = ctx[first], h[pick]
        self.aux = c.c1[c.w[pick]] if order == 2 else c.c2[pick]
        self.t = np.where(self.h < 1 << 16, t[first] >> np.uint64(32), t[first] >> np.uint64(24))
        self.g = None if order == 2 else hist[c.u[pick]]
        self.bucket = bucket_of(route[first], stage.buckets)


_ASK = "bucket long, chunk long, ctx binary, run binary, t binary, count binary, aux binary, h binary, g binary"


def _ask_words(stage: Stage):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                c = Chunk(row)
                count = np.bincount(c.w[c.trained > 0], minlength=len(c.words))
                bucket = bucket_of(c.words, stage.buckets)
                cuts = np.append(_runs(bucket), len(bucket))
                parts = [slice(a, b) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
                cols = [[int(bucket[p.start]) for p in parts], [row["chunk"]] * len(parts), [pack_keys(c.words[p]) for p in parts], [pack(count[p]) for p in parts]]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(cols, (pa.int64(), pa.int64(), pa.binary(), pa.binary()))], ["bucket", "chunk", "ctx", "count"])

    return run


def _ask(order: int, stage: Stage, turn: tuple[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                e = Entries(Chunk(row), order, stage, turn)
                cuts = np.append(_runs(e.bucket), len(e.bucket))
                cols: list[list] = [[] for _ in range(9)]
                for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                    starts = a + _runs(e.ctx[a:b])
                    g = b"" if e.g is None else pack(e.g[starts])
                    packed = (pack_keys(e.ctx[starts]), pack(_lengths(starts, b)), pack(e.t[a:b]), pack(e.count[a:b]), pack(e.aux[a:b]), pack(e.h[starts]), g)
                    for col, x in zip(cols, (int(e.bucket[a]), row["chunk"], *packed)):
                        col.append(x)
                kinds = [pa.int64(), pa.int64(), *[pa.binary()] * 7]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(cols, kinds)], ["bucket", "chunk", "ctx", "run", "t", "count", "aux", "h", "g"])

    return run


# Buckets: what 0 answers to chunks, 1 the model, 2 parts of hot contexts, 3 counts of counts.

_TOLD = "what int, bucket long, chunk long, a binary, b binary, c binary, d binary, e binary, k long, " + ", ".join(f"n{r} long" for r in range(1, TOP + 2)) + ", low double"
_NAMES = [x.split()[0] for x in _TOLD.split(", ")]
_KINDS = [pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 5, pa.int64(), *[pa.int64()] * (TOP + 1), pa.float64()]


def _told(rows: list[dict]) -> pa.Table:
    return pa.table({n: pa.array([r.get(n) for r in rows], k) for n, k in zip(_NAMES, _KINDS)})


def _counts_of(total: np.ndarray) -> dict[str, int]:
    return {f"n{r}": int((total == r).sum()) for r in range(1, TOP + 2)}


def _answer_words(key: tuple, table: pa.Table) -> pa.Table:
    """A bucket's words: totals to the chunks, the model's words, their number (n6 + 1 .. kept in k), and counts of counts."""
    bucket = key[0].as_py()
    asks = table.sort_by("chunk").to_pylist()
    keys = [unpack_keys(r["ctx"]) for r in asks]
    word, where = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(where, weights=np.concatenate([unpack(r["count"]) for r in asks]).astype(float), minlength=len(word)).astype(np.int64)
    rows, at = [], 0
    for r, own in zip(asks, keys):
        rows.append({"what": 0, "bucket": bucket, "chunk": r["chunk"], "a": pack(total[where[at : at + len(own)]])})
        at += len(own)
    seen = total > 0
    end = int(total[word == END].sum())
    rows.append({"what": 1, "bucket": bucket, "a": pack_keys(word[seen]), "d": pack(total[seen])})
    rows.append({"what": 3, "bucket": bucket, "chunk": int(total.sum()), "k": int(seen.sum()), "low": float(end), **_counts_of(total)})
    return _told(rows)


def _answer(order: int, stage: Stage):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        bucket = key[0].as_py()
        asks = table.sort_by("chunk").to_pylist()
        run_of = [unpack(r["run"]) for r in asks]
        over = lambda name, read: np.concatenate([np.repeat(read(r[name]), n) for r, n in zip(asks, run_of)])
        each = lambda name: np.concatenate([unpack(r[name]) for r in asks])
        ctx, t = over("ctx", unpack_keys), each("t").astype(np.uint64)
        ident = pair_key(ctx, t)
        by = order_of(ident)
        starts = _runs(ident[by])
        total = _summed(each("count")[by], starts)
        where = np.empty(len(by), dtype=np.int64)
        where[by] = np.repeat(np.arange(len(starts)), _lengths(starts, len(by)))
        pick = by[starts]
        del ident, by, starts
        of = float(max(stage.n, 1)) if order == 2 else over("g", unpack)[pick]
        low, h = stage.seen(order - 1, each("aux")[pick], of), over("h", unpack)[pick]
        # Contexts: the seen n-grams by context; unseen ones are of no account.
        seen = np.flatnonzero(total > 0)
        # The bucket's own contexts are a range of all; within it they are told apart by lower bits.
        low_end, bits = np.uint64(first_key(bucket, stage.buckets)), np.uint64(stage.buckets.bit_length() - 1)
        within = lambda x: (x - low_end) << bits
        seen = seen[order_of(within(ctx[pick[seen]]))]
        own_ctx, own_total = ctx[pick[seen]], total[seen]
        at = _runs(own_ctx)
        heads, size = own_ctx[at], _lengths(at, len(own_ctx))
        parts = np.stack([_summed((own_total == r).astype(np.int64), at) for r in range(1, TOP + 1)], axis=1) if len(at) else np.zeros((0, TOP), dtype=np.int64)
        lows = _summed(low[seen], at)
        hot = h[seen][at] >= stage.hot if len(at) else np.zeros(0, dtype=bool)
        rows, lo = [], 0
        for r, n in zip(asks, run_of):
            hi = lo + int(n.sum())
            own = total[where[lo:hi]]
            row = {"what": 0, "bucket": bucket, "chunk": r["chunk"], "a": pack(own)}
            if (own == 0).any():
                asked = ctx[lo:hi][own == 0]
                found = np.minimum(np.searchsorted(within(heads), within(asked)), max(len(heads) - 1, 0))
                hit = heads[found] == asked if len(heads) else np.zeros(len(asked), dtype=bool)
                got = np.where(hit[:, None], parts[found], 0) if len(heads) else np.zeros((len(asked), TOP), dtype=np.int64)
                row |= {"b": pack(got.T.ravel()), "c": pack_floats(np.where(hit, lows[found], 0.0) if len(heads) else np.zeros(len(asked)))}
            rows.append(row)
            lo = hi
        rows.append({"what": 1, "bucket": bucket, "a": pack_keys(heads), "b": pack(size), "c": pack(t[pick[seen]]), "d": pack(own_total), "e": pack_floats(np.where(hot, np.nan, 1 - lows), np.float32)})
        for i in np.flatnonzero(hot).tolist():
            rows.append({"what": 2, "k": int(heads[i].view(np.int64)), "low": float(lows[i]), **{f"n{r}": int(parts[i, r - 1]) for r in range(1, TOP + 1)}})
        rows.append({"what": 3, "bucket": bucket, **_counts_of(total)})
        return _told(rows)

    return run


# Many chunks: asks of one bucket are merged, and the answer is passed on.

_ASK_WORDS = "bucket long, chunk long, ctx binary, count binary"


def _side_by_side(asks: list[dict], order: int) -> tuple[list[int], np.ndarray, np.ndarray, np.ndarray]:
    """How many entries each ask has, for each entry its place among the distinct ones, one entry of each, and its context."""
    keys = [unpack_keys(r["ctx"]) for r in asks]
    if order == 1:
        ctx = np.concatenate(keys)
        _, pick, where = np.unique(ctx, return_index=True, return_inverse=True)
        return [len(k) for k in keys], where, pick, ctx
    run_of = [unpack(r["run"]) for r in asks]
    ctx = np.concatenate([np.repeat(k, n) for k, n in zip(keys, run_of)])
    t = np.concatenate([unpack(r["t"]) for r in asks]).astype(np.uint64)
    by = np.lexsort((t, ctx))
    new = np.append(True, (ctx[by][1:] != ctx[by][:-1]) | (t[by][1:] != t[by][:-1]))
    where = np.empty(len(by), dtype=np.int64)
    where[by] = np.cumsum(new) - 1
    return [int(n.sum()) for n in run_of], where, by[new], ctx


def _merged(order: int):
    """The asks of many chunks to a bucket as one."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        asks = table.sort_by("chunk").to_pylist()
        _, where, pick, ctx = _side_by_side(asks, order)
        each = lambda name: np.concatenate([unpack(r[name]) for r in asks])
        count = np.zeros(len(pick), dtype=np.int64)
        np.add.at(count, where, each("count").astype(np.int64))
        row = {"bucket": key[0].as_py(), "chunk": key[1].as_py(), "count": pack(count)}
        if order == 1:
            row["ctx"] = pack_keys(ctx[pick])
        else:
            starts = _runs(ctx[pick])
            over = lambda name: np.concatenate([np.repeat(unpack(r[name]), unpack(r["run"])) for r in asks])[pick[starts]]
            row |= {"ctx": pack_keys(ctx[pick[starts]]), "run": pack(_lengths(starts, len(pick))), "t": pack(each("t")[pick]), "aux": pack(each("aux")[pick])}
            row |= {"h": pack(over("h")), "g": b"" if order == 2 else pack(over("g"))}
        names = [x.split()[0] for x in (_ASK_WORDS if order == 1 else _ASK).split(", ")]
        return pa.table({n: pa.array([row[n]], pa.int64() if n in ("bucket", "chunk") else pa.binary()) for n in names})

    return run


def _passed_on(order: int):
    """Each chunk's part of the answer to merged asks."""

    def run(key: tuple, table: pa.Table, told: pa.Table) -> pa.Table:
        asks, (answer,) = table.sort_by("chunk").to_pylist(), told.to_pylist()
        sizes, where, _, _ = _side_by_side(asks, order)
        total = unpack(answer["a"])
        unseen = np.cumsum(total == 0) - 1
        parts, lows = (unpack(answer["b"]).reshape(TOP, -1), unpack_floats(answer["c"])) if answer["b"] else (None, None)
        rows, lo = [], 0
        for r, n in zip(asks, sizes):
            at = where[lo : lo + n]
            row = {"what": 0, "bucket": key[0].as_py(), "chunk": r["chunk"], "a": pack(total[at])}
            miss = unseen[at[total[at] == 0]]
            if len(miss) and parts is not None:
                row |= {"b": pack(parts[:, miss].ravel()), "c": pack_floats(lows[miss])}
            rows.append(row)
            lo += n
        return _told(rows)

    return run


def _told_of(asks: DataFrame, order: int, stage: Stage, answer, into: list[str]) -> DataFrame:
    """The table of answers to asks, at paths `into`, partitioned by `what`."""
    name = f"order_{order}"
    if stage.fans == 1:
        return cut(asks.groupBy("bucket").applyInArrow(answer, _TOLD), name, into, by="what")
    spark, passing = asks.sparkSession, []
    asks = cut(asks.withColumn("fan", F.pmod(F.xxhash64("chunk"), F.lit(stage.fans))), "asks", passing)
    own = asks.groupBy("bucket", "fan")
    merged = own.applyInArrow(_merged(order), _ASK_WORDS if order == 1 else _ASK)
    told = cut(merged.groupBy("bucket").applyInArrow(answer, _TOLD), name, into, by="what")
    answers = told.where("what = 0").withColumnRenamed("chunk", "fan").groupBy("bucket", "fan")
    passed = cut(own.cogroup(answers).applyInArrow(_passed_on(order), _TOLD), name, into, by="what")
    discard(spark, passing)
    return told.where("what <> 0").unionByName(passed)


# Chunks, once answered.


def _answers(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Totals in the order of the chunk's entries; parts and lower-order sums of the contexts of those that are unseen."""
    rows = table.sort_by("bucket").to_pylist()
    total = np.concatenate([unpack(r["a"]) for r in rows]) if rows else np.zeros(0, dtype=np.int64)
    parts = [unpack(r["b"]).reshape(TOP, -1).T for r in rows if r["b"]]
    lows = [unpack_floats(r["c"]) for r in rows if r["c"]]
    return total, np.concatenate(parts) if parts else np.zeros((0, TOP), dtype=np.int64), np.concatenate(lows) if lows else np.zeros(0)


def _weights(order: int, stage: Stage, e: Entries, total: np.ndarray, parts: np.ndarray, lows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(tokens whose n-gram is unseen, log10 of their contexts' backoff weights)."""
    miss = np.flatnonzero(total == 0)
    h, ctx = e.h[miss], e.ctx[miss]
    keys, hot_parts, hot_lows = stage.hot_parts[order]
    hot = h >= stage.hot
    if hot.any():
        at = np.searchsorted(keys, ctx[hot])
        parts, lows = parts.copy(), lows.copy()
        parts[hot], lows[hot] = hot_parts[at], hot_lows[at]
    weight = np.zeros(len(total))
    weight[miss] = np.log10(stage.alpha(order, parts, lows, h))
    tokens = np.flatnonzero(total[e.of_token] == 0)
    return tokens, weight[e.of_token[tokens]]


def _with_words(stage: Stage):
    def run(key: tuple, chunks: pa.Table, told: pa.Table) -> pa.Table:
        total, _, _ = _answers(told)
        return chunks.append_column("c1", pa.array([pack(total)], pa.binary()))

    return run


def _low(stage: Stage, c: Chunk, e: Entries, total: np.ndarray, parts: np.ndarray, lows: np.ndarray) -> np.ndarray:
    """For each token whose pair is unseen the log10 of a(u) * P(w)."""
    tokens, weight = _weights(2, stage, e, total, parts, lows)
    count = c.c1[c.w[tokens]]
    return weight + np.log10(np.where(count > 0, stage.seen(1, count, max(stage.n, 1)), stage.unknown))


def _with_pairs(stage: Stage):
    def run(key: tuple, chunks: pa.Table, told: pa.Table) -> pa.Table:
        c = Chunk(chunks.to_pylist()[0])
        e = Entries(c, 2, stage)
        answers = _answers(told)
        low = _low(stage, c, e, *answers)
        return chunks.append_column("c2", pa.array([pack(answers[0][e.of_token])], pa.binary())).append_column("b1", pa.array([pack_floats(low)], pa.binary()))

    return run


def _scored(stage: Stage):
    def run(key: tuple, chunks: pa.Table, told: pa.Table) -> pa.Table:
        c = Chunk(chunks.to_pylist()[0])
        del chunks
        e = Entries(c, 3, stage)
        total, parts, lows = _answers(told)
        c3 = total[e.of_token]
        with np.errstate(divide="ignore"):
            score = np.log10(stage.seen(3, c3, e.token_h))
            pair = np.log10(stage.seen(2, c.c2, c.histories(stage.docs)[c.u]))
        pair[c.c2 == 0] = unpack_floats(c.row["b1"])
        tokens, weight = _weights(3, stage, e, total, parts, lows)
        score[tokens] = weight + pair[tokens]
        count = c.c1[c.w]
        base = np.log10(count + 1.0) - np.log10(float(stage.n + stage.v + 1))
        by_doc = lambda x: _summed(x, c.first)
        return pa.table(
            {
                "doc_id": pa.array(c.row["doc"], pa.int64()), "held_out": pa.array(c.row["out"], pa.bool_()), "n_tokens": pa.array(c.length.astype(np.int64)),
                "n_known": pa.array(by_doc((count > 0).astype(np.int64))), "base_score": pa.array(by_doc(base)), "score": pa.array(by_doc(score)),
            }
        )

    return run


# The job.


def discounts(of: dict[int, int]) -> list[float]:
    """Good-Turing discount ratios d(1) .. d(TOP) from the count of counts; absolute 1/2 where they can't be had."""
    n = [0] + [of.get(r, 0) for r in range(1, TOP + 2)]
    out = []
    for r in range(1, TOP + 1):
        d = 0.0
        if n[1] and n[r]:
            far = (TOP + 1) * n[TOP + 1] / n[1]
            d = ((r + 1) * n[r + 1] / (r * n[r]) - far) / (1 - far) if far < 1 else 0.0
        out.append(d if 0.0 < d < 1.0 else 1 - 0.5 / r)
    return out


class Model:
    """The three tables, with what the recursion needs besides."""

    def __init__(self, stage: Stage, tables: dict[int, DataFrame]) -> None:
        self.stage, self.tables = stage, tables

    def words(self) -> DataFrame:
        """(word, c, p): words of the training part by their hash, with counts and probabilities."""
        stage = self.stage

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for r in batch.to_pylist():
                    word, c = unpack_keys(r["a"]), unpack(r["d"])
                    yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(c), pa.array(stage.seen(1, c, stage.n))], ["word", "c", "p"])

        return self.tables[1].select("a", "d").mapInArrow(run, "word long, c long, p double")

    def grams(self, order: int) -> DataFrame:
        """(context, gram, c): n-grams of an order with the 40 bits that tell a context's successors apart."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for r in batch.to_pylist():
                    ctx = np.repeat(unpack_keys(r["a"]), unpack(r["b"]))
                    yield pa.RecordBatch.from_arrays([pa.array(ctx.view(np.int64)), pa.array(unpack(r["c"]).astype(np.int64)), pa.array(unpack(r["d"]).astype(np.int64))], ["context", "gram", "c"])

        return self.tables[order].select("a", "b", "c", "d").mapInArrow(run, "context long, gram long, c long")

    def contexts(self, order: int) -> DataFrame:
        """(context, c, alpha): how often each context of an order occurs, and its backoff weight."""
        stage, (keys, hot_parts, hot_lows) = self.stage, self.stage.hot_parts[order]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for r in batch.to_pylist():
                    ctx, size, c, low = unpack_keys(r["a"]), unpack(r["b"]), unpack(r["d"]), 1 - unpack_floats(r["e"], np.float32)
                    at = np.cumsum(size) - size
                    parts = np.stack([_summed((c == k).astype(np.int64), at) for k in range(1, TOP + 1)], axis=1) if len(at) else np.zeros((0, TOP))
                    h = _summed(c, at)
                    here = ~np.isnan(low)
                    a = stage.alpha(order, parts[here], low[here], h[here])
                    yield pa.RecordBatch.from_arrays([pa.array(ctx[here].view(np.int64)), pa.array(h[here].astype(np.int64)), pa.array(a)], ["context", "c", "alpha"])

        spread = self.tables[order].select("a", "b", "d", "e").mapInArrow(run, "context long, c long, alpha double")
        if not len(keys):
            return spread
        hot = spread.sparkSession.createDataFrame([(int(k), p.tolist(), float(x)) for k, p, x in zip(keys.view(np.int64), hot_parts, hot_lows)], "context long, parts array<long>, low double")
        counts = self.grams(order).groupBy("context").agg(F.sum("c").alias("c")).join(F.broadcast(hot), "context")
        lost = F.lit(0.0)
        for r in range(1, TOP + 1):
            lost = lost + F.col("parts")[r - 1] * float(r * (1 - stage.d[order][r - 1]))
        left = F.greatest(lost / F.col("c"), F.lit(FLOOR)) / F.greatest(1 - F.col("low"), F.lit(FLOOR))
        return spread.union(counts.select("context", "c", left))


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for other in tables[1:]:
        out = out.union(other)
    return out


def _join(chunks: DataFrame, told: list[DataFrame], run, schema: str, name: str, into: list[str] | None = None) -> DataFrame:
    """Each chunk with the answers to it, in turns."""
    answers = _union(told).where("what = 0").select("chunk", "bucket", "a", "b", "c")
    out = []
    for k in range(TURNS):
        mine = F.pmod(F.xxhash64("chunk"), F.lit(TURNS)) == k
        out.append(cut(chunks.where(mine).groupBy("chunk").cogroup(answers.where(mine).groupBy("chunk")).applyInArrow(run, schema), name, into))
    return _union(out)


def _stats(told: list[DataFrame]) -> dict:
    names = ["chunk", "k", "low", *[f"n{r}" for r in range(1, TOP + 2)]]
    out = dict.fromkeys(names, 0)
    for table in told:
        for name, x in table.where("what = 3").agg(*[F.sum(n).alias(n) for n in names]).first().asDict().items():
            out[name] += x or 0
    return out


def _count(chunks: DataFrame, order: int, stage: Stage, into: list[str]) -> list[DataFrame]:
    """An order's tables of answers, one for each turn, at paths `into`; its discounts and hot contexts go to the stage."""
    told = []
    for k in range(SLICES[order]):
        asks = chunks.mapInArrow(_ask(order, stage, (k, SLICES[order])), _ASK)
        told.append(_told_of(asks, order, stage, _answer(order, stage), into))
    stage.d[order] = np.array(discounts({r: _stats(told)[f"n{r}"] for r in range(1, TOP + 2)}))
    parts = _union(told).where("what = 2")
    names = [*[f"n{r}" for r in range(1, TOP + 1)], "low"]
    hot = parts.groupBy("k").agg(*[F.sum(n).alias(n) for n in names]).toArrow()  # MAX_HOT rows at most
    k, *counts, low = (hot.column(n).to_numpy() for n in ["k", *names])
    by = np.argsort(k.view(np.uint64))
    stage.hot_parts[order] = k.view(np.uint64)[by], np.stack(counts, axis=1)[by], low[by]
    return told


def train_and_score(docs: DataFrame, modulus: int = 7, remainder: int = 2, hot: int | None = None, chunk: int = CHUNK) -> tuple[DataFrame, Model]:
    """documents -> (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), and the model.

    Rows whose crc32(doc_id as text) mod `modulus` is `remainder` are scored but not learned from.
    """
    spark, passing = docs.sparkSession, []
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), held_out(F.col("doc_id"), modulus, remainder).alias("out"))
    chunks = cut(rows.mapInArrow(_encoded(chunk), _CHUNK), "chunks", passing)
    tokens, n_chunks = chunks.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.count("*")).first()
    stage = Stage(max(MIN_BUCKETS, tokens // BUCKET), hot or max(LEAST_HOT, tokens // MAX_HOT))
    stage.fans = max(1, -(-n_chunks // FAN))

    asks = chunks.mapInArrow(_ask_words(stage), _ASK_WORDS)
    paths: list[str] = []
    words = _told_of(asks, 1, stage, _answer_words, paths)
    found = _stats([words])
    stage.n, stage.v, stage.docs = found["chunk"], found["k"], int(found["low"])
    stage.d[1] = np.array(discounts({r: found[f"n{r}"] for r in range(1, TOP + 2)}))
    # What all words leave: what the discounts take from those seen up to TOP times.
    lost = sum(r * (1 - stage.d[1][r - 1]) * found[f"n{r}"] for r in range(1, TOP + 1))
    stage.unknown = max(lost / stage.n, FLOOR) if stage.n else 1.0

    def answered() -> None:
        """What has been told to the chunks goes; the model stays."""
        discard(spark, [*passed, *[f"{p}/what=0" for p in paths]])
        paths.clear()

    passed, passing = passing, []
    chunks = _join(chunks, [words], _with_words(stage), f"{_CHUNK}, c1 binary", "chunks", passing)
    answered()
    pairs = _count(chunks, 2, stage, paths)
    passed, passing = passing, []
    chunks = _join(chunks, pairs, _with_pairs(stage), f"{_CHUNK}, c1 binary, c2 binary, b1 binary", "chunks", passing)
    answered()
    triples = _count(chunks, 3, stage, paths)
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    scores = _join(chunks, triples, _scored(stage), schema, "scores")
    passed = passing
    answered()
    scores = scores.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(stage.n).cast("long").alias("train_tokens"), "base_score", "score")
    tables = {order: _union(told).where("what = 1") for order, told in ((1, [words]), (2, pairs), (3, triples))}
    return scores, Model(stage, tables)


def score_documents(docs: DataFrame) -> DataFrame:
    return train_and_score(docs)[0]
