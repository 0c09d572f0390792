import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from concord.llm import runs

DOCS = "doc_id long, text string, start string, runs int"


def brute_lyndon(x):
    """The longest stretch from each place whose every rotation, and so every suffix, is greater."""
    return [max((k for k in range(1, len(x) - i + 1) if all(x[i : i + k] < x[j : i + k] for j in range(i + 1, i + k))), default=1) for i in range(len(x))]


def brute_runs(w, least=6, exponent=4):
    """By definition: every stretch of a smallest period that no neighbour extends."""
    out, n = set(), len(w)
    for p in range(1, n // exponent + 1):
        i = 0
        while i + p < n:
            if w[i] != w[i + p]:
                i += 1
                continue
            j = i
            while j + p < n and w[j] == w[j + p]:
                j += 1
            length = j + p - i
            if length >= max(least, exponent * p) and not any(all(w[k] == w[k + q] for k in range(i, i + length - q)) for q in range(1, p)):
                out.add((i, length, p))
            i = j
    return sorted(out)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.integers(1, 3), max_size=14), min_size=1, max_size=3), st.booleans())
def test_lyndon_words_by_grouping(parts, many):
    parts = [[(c * 7) % 5 + 1 if many else c for c in x] for x in parts]
    x = [0] + [c for part in parts for c in (*part, 0)]
    classes = max(x) + 1
    got, group = runs.lyndon(x, classes)
    at = 1
    for part in parts:
        assert got[at : at + len(part)] == brute_lyndon(part)
        at += len(part) + 1
    words = [tuple(x[i : i + n]) for i, n in enumerate(got)]
    assert all((words[i] == words[j]) == (group[i] == group[j]) for i in range(1, len(x)) for j in range(1, len(x)) if x[i] and x[j])


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.lists(st.integers(1, 3), max_size=12), st.tuples(st.lists(st.integers(1, 4), min_size=1, max_size=5), st.integers(1, 7)).map(lambda t: t[0] * t[1])), max_size=6), st.sampled_from([(6, 4), (4, 2), (2, 2), (9, 3), (1, 4)]))
def test_runs_against_definition(parts, rule):
    w = [c for part in parts for c in part]
    got = runs.find(np.array([*w, 0, *w, 0], dtype=np.int64), *rule)
    want = brute_runs(w, *rule)
    assert got == want + [(s + len(w) + 1, n, p) for s, n, p in want]


def changed(doc_id, text):
    """The words of the contract, written out."""
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(w)
    if doc_id is None:
        return w
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


def expected(doc_id, text):
    w = changed(doc_id, text)
    found = brute_runs(w)
    gone = {i for s, n, p in found for i in range(s + p, s + n)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    four = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(found), *four, sha("".join(f"{s},{n},{p}\n" for s, n, p in found)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_query_against_brute_force(spark):
    rng = random.Random(3)
    texts = [None, "", " \n\t ", "a", "a a a a a a", "a a a a a", "a b a b a b a b", "a b " * 3 + "a", "\x0b ".join(["é", "世界"] * 6), "x " * 50 + "y", "a\x1cb a\x1cb " * 5]
    docs = [(i, rng.choice(texts)) for i in range(200)]
    docs += [(200 + i, " ".join(rng.choice(["u", "v", "w"]) for _ in range(rng.randrange(40))) + " " + " ".join(["p", "q", "r"][: rng.randrange(1, 4)] * rng.randrange(8))) for i in range(300)]
    docs += [(None, "z z z z z z"), (7, "k k k k k k"), (7, "k k k k k k")]
    df = spark.createDataFrame([(i, t, "clash", 3) for i, t in docs], DOCS).repartition(3)
    got = runs.digest(runs.detect(runs.repeated(df)))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert [k for _, k in got.dtypes] == ["bigint"] * 6 + ["string"] * 2
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(str(expected(*d)) for d in docs)
    small = runs.digest(runs.detect(runs.repeated(df), at_once=20))
    assert sorted(map(tuple, small.collect()), key=str) == sorted(map(tuple, got.collect()), key=str)
    assert runs.digest(runs.detect(runs.repeated(df.limit(0)))).collect() == []


def test_given_documents_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("length(text) < 6000")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = {r["doc_id"]: tuple(r) for r in runs.digest(runs.detect(runs.repeated(docs))).collect()}
    assert len(got) == len(rows) and any(r[1] for r in got.values())
    for doc_id, text in rows:
        assert got[doc_id] == expected(doc_id, text)


@pytest.mark.parametrize("kind", ["one word", "two words", "fibonacci", "nested", "random"])
def test_long_texts_take_linear_time(kind):
    n = 300_000
    if kind == "fibonacci":
        a, b = [1], [1, 2]
        while len(b) < n:
            a, b = b, b + a
        w = b[:n]
    elif kind == "nested":
        w = [1]
        for k in range(2, 10):
            w = (w * 4 + [k]) if len(w) * 4 < n else w
    else:
        w = [1] * n if kind == "one word" else [1, 2] * (n // 2) if kind == "two words" else random.Random(1).choices(range(1, 4), k=n)
    began = time.process_time()
    got = runs.find(np.array([*w, 0], dtype=np.int64))
    assert time.process_time() - began < 20
    if kind in ("one word", "two words"):
        assert got == [(0, n, 1 if kind == "one word" else 2)]


def test_collapsed_text_keeps_one_period(spark):
    df = spark.createDataFrame([(1, "so  on and on and on and on and\non then")], "doc_id long, text string")
    row = runs.detect(df).collect()[0]
    assert [tuple(r) for r in row["runs"]] == [(1, 9, 2)] and row["collapsed"] == "so on and then"
