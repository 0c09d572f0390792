"""Language of texts by multinomial naive Bayes over hashed character n-grams.

A text is lower-cased; what is no letter or mark becomes a single space; n-grams of 1 to 4 characters are hashed into
buckets. Each language has a multinomial over the buckets, smoothed; the matrix of log-probabilities (buckets x
languages, of a fixed size at most) is broadcast, and batches are scored as sparse rows: the distinct buckets of each
text with their counts, times the matrix. n-grams that overlap aren't independent, so that the sums are divided by
the number of orders before they are made a probability.

Defined cases: a text that is null or has no letter, or of which nothing was learned, is `und` with score 0; of equal
languages the first by code point wins; repeated rows are learned from as often as they are there; rows with a null
doc_id aren't learned from and count as held out; very long texts are read whole, in blocks; bytes that are no
UTF-8 read as U+FFFD; further columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concord.llm.common import held_out

ORDERS, BUCKETS, ALPHA = (1, 2, 3, 4), 1 << 15, 0.05
#: Rows learned from for each language at most (about; thinned by a hash), and languages, those with most rows first.
MAX_ROWS, MAX_LANGS = 10_000, 128
#: Characters that are hashed at a time.
BLOCK = 1 << 20
UNKNOWN = "und"
_STEP = np.uint64(0x9E3779B97F4A7C15)


@functools.lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point: its own number if it is a letter or mark, else that of a space."""
    out = np.full(0x110000, 32, np.uint32)
    kept = [c for c in range(0x110000) if unicodedata.category(chr(c))[0] in "LM"]
    out[kept] = kept
    return out


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def _points(text: str) -> np.ndarray:
    """A space, the text's words in lower case with single spaces between them, a space."""
    raw = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    raw = _letters()[raw]
    gap = raw == 32
    return raw[~(gap & np.concatenate([[False], gap[:-1]]))]


def _buckets(points: np.ndarray, orders: tuple[int, ...], buckets: int) -> np.ndarray:
    """Buckets of the n-grams that begin at each place, order by order."""
    shift, out = np.uint64(64 - buckets.bit_length() + 1), []
    points, rolled = points.astype(np.uint64), np.zeros(len(points), np.uint64)
    for n in range(1, max(orders) + 1):
        if len(points) < n:
            break
        rolled = (rolled[: len(points) - n + 1] + points[n - 1 :] + np.uint64(n)) * _STEP
        rolled ^= rolled >> np.uint64(29)
        if n in orders:
            out.append((rolled * _STEP) >> shift)
    return np.concatenate(out).astype(np.int64) if out else np.zeros(0, np.int64)


def counted(text: str, orders: tuple[int, ...] = ORDERS, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """The distinct buckets of a text and how often each is hit."""
    points, reach = _points(text), max(orders) - 1
    total: np.ndarray | None = None
    for at in range(0, max(1, len(points)), BLOCK):
        block = points[at : at + BLOCK + reach]
        hit = _buckets(block, orders, buckets)
        if at + BLOCK < len(points):  # n-grams that begin in the next block are left to it
            hit = hit[np.concatenate([np.arange(max(0, len(block) - n + 1)) < BLOCK for n in range(1, max(orders) + 1) if n in orders])]
        if total is None and at + BLOCK >= len(points) and len(hit) < buckets // 4:
            return np.unique(hit, return_counts=True)
        counts = np.bincount(hit, minlength=buckets)
        total = counts if total is None else total + counts
    found = np.flatnonzero(total)
    return found, total[found]


class NaiveBayes:
    def __init__(self, langs: list[str], rows: np.ndarray, counts: np.ndarray, orders: tuple[int, ...] = ORDERS, alpha: float = ALPHA) -> None:
        """counts: buckets x languages, as is the matrix."""
        self.langs, self.orders, self.buckets = np.array(langs, dtype=object), orders, len(counts)
        self.matrix = np.log((counts + alpha) / (counts.sum(axis=0) + alpha * len(counts))).astype(np.float32)
        self.prior = np.log(rows / rows.sum())

    def score(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """The language of each text and its probability."""
        own = [k for k, t in enumerate(texts) if t and len(self.langs) and has_letter(t)]
        lang, p = [UNKNOWN] * len(texts), np.zeros(len(texts))
        for k in own:
            at, n = counted(texts[k], self.orders, self.buckets)
            logs = n @ self.matrix[at].astype(np.float64) / len(self.orders) + self.prior
            best = int(np.argmax(logs))
            lang[k], p[k] = self.langs[best], 1 / np.exp(logs - logs[best]).sum()
        return lang, p


def learned_rows(docs: DataFrame, modulus: int = 3, remainder: int = 1, max_rows: int = MAX_ROWS, max_langs: int = MAX_LANGS) -> tuple[DataFrame, list[str], list[int]]:
    """(lang, text) of rows to learn from, thinned by a hash for each language; the languages by code point; their rows before that."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), modulus, remainder))
    rows = rows.select(F.col("lang").cast("string").alias("lang"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    known = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(max_langs).collect()
    known = sorted((r["lang"], r["n"]) for r in known)
    part = F.shiftrightunsigned(F.xxhash64("doc_id", "lang", F.lit("fit")), 1)
    keep = F.lit(False)
    for lang, n in known:
        own = F.col("lang") == lang
        keep = keep | (own if n <= max_rows else own & (part < int(max_rows / n * 2**63)))
    return rows.where(keep).select("lang", "text"), [x for x, _ in known], [n for _, n in known]


def fit(docs: DataFrame, modulus: int = 3, remainder: int = 1, max_rows: int = MAX_ROWS, max_langs: int = MAX_LANGS, buckets: int = BUCKETS) -> NaiveBayes:
    rows, langs, n = learned_rows(docs, modulus, remainder, max_rows, max_langs)
    place = {lang: k for k, lang in enumerate(langs)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
                raw = text.as_py()
                if raw:
                    k = place[lang]
                    at, c = counted(raw.decode(errors="replace"), buckets=buckets)
                    sums.setdefault(k, np.zeros(buckets, np.int64))[at] += c
        for k, total in sums.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at * len(langs) + k), pa.array(total[at])], ["at", "n"])

    counts = np.zeros(buckets * len(langs), np.int64)
    if langs:  # at most BUCKETS x MAX_LANGS sums of 16 bytes
        got = rows.mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
        counts[got.column("at").to_numpy()] = got.column("n").to_numpy()
    return NaiveBayes(langs, np.array(n, dtype=float), counts.reshape(buckets, len(langs)))


def identify(docs: DataFrame, modulus: int = 3, remainder: int = 1, max_rows: int = MAX_ROWS) -> DataFrame:
    """documents -> (doc_id, held_out, lang_pred, score)."""
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(fit(docs, modulus, remainder, max_rows))

    @F.pandas_udf("lang_pred string, score double")
    def of(texts: pd.Series) -> pd.DataFrame:
        lang, p = model.value.score([t.decode(errors="replace") if t else None for t in texts])
        return pd.DataFrame({"lang_pred": pd.Series(lang, dtype=object), "score": p})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id"), modulus, remainder).alias("held_out"), of(F.col("text").cast("binary")).alias("p"))
    return rows.select("doc_id", "held_out", "p.lang_pred", "p.score")
