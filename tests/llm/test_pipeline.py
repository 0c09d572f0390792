import re
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest

from concord.llm import decontaminate, quality, toxicity
from tests.llm.test_mixing import by_hand


def jaccard(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def good(rows, labels):
    """Which texts the discriminant keeps, from class moments by numpy and densities by definition."""
    from zlib import crc32

    known = {r["doc_id"]: r["quality"] for r in labels if r["doc_id"] is not None and r["quality"] in (0, 1)}
    x = {r["doc_id"]: np.array(quality.statistics((r["text"] or "").encode())) for r in rows}
    fit = [(x[i], y) for i, y in known.items() if i in x and crc32(str(i).encode()) % 5]
    d, share, logs = len(quality.NAMES), (sum(y for _, y in fit) + 1) / (len(fit) + 2), {}
    parts = {k: np.array([v for v, y in fit if y == k]) for k in (0, 1)}
    cov = {k: np.cov(p.T, bias=True) for k, p in parts.items()}
    pooled = sum(len(parts[k]) * cov[k] for k in (0, 1)) / len(fit)
    for k in (0, 1):
        w = max(0.1, d / (len(parts[k]) + d))
        c = (1 - w) * cov[k] + w * np.diag(np.maximum(np.diag(pooled), 1e-3)) + 1e-3 * np.eye(d)
        mean, inverse, det = parts[k].mean(axis=0), np.linalg.inv(c), np.linalg.slogdet(c)[1]
        logs[k] = {i: -0.5 * (v - mean) @ inverse @ (v - mean) - 0.5 * det for i, v in x.items()}
    return {i for i in x if 1 / (1 + np.exp(-np.clip(logs[1][i] - logs[0][i] + np.log(share / (1 - share)), -500, 500))) >= 0.3}


def near_groups(rows):
    """The first of each group of texts that are linked by Jaccard similarities of 0.8 or more."""
    sets = {}
    for r in rows:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", (r["text"] or "").lower()) if x]
        sets[r["doc_id"]] = {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    want, seen = set(), set()
    for i in sorted(sets):
        if i in seen:
            continue
        want.add(i)
        stack = [i]
        while stack:
            x = stack.pop()
            if x not in seen:
                seen.add(x)
                stack += [y for y in sets if y not in seen and jaccard(sets[x], sets[y]) >= 0.8]
    return want


def uncontaminated(rows, bench):
    items = {tuple(decontaminate.words_of(r["text"])) for r in bench} - {()}
    out = set()
    for r in rows:
        words = decontaminate.words_of(r["text"])
        held = Counter(words)
        for item in items:
            slack = int(0.2 * len(item))
            if sum(min(n, held[w]) for w, n in Counter(item).items()) < len(item) - slack:
                continue  # too few of its words are there at all
            if decontaminate.distance_within([hash(w) for w in item], [hash(w) for w in words]) <= slack:
                break
        else:
            out.add(r["doc_id"])
    return out


def test_stages_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    labels, bench = spark.read.parquet(f"{sf_dir}/labels.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality classifier", "toxicity", "simhash near-dedup", "benchmark decontamination", "source mixing"]
    held = docs
    for name, stage in corpus_pipeline.STAGES:
        before = [r.asDict() for r in held.collect()]
        out = stage(spark, held, sf_dir)
        after = [r.asDict() for r in out.collect()]
        if name == names[-1]:
            sizes = Counter()
            for r in before:
                sizes[r["source"]] += len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
            assert {r["source"]: r["target"] for r in after} == pytest.approx(by_hand(dict(sizes)))
            assert sorted(r["doc_id"] for r in after) == sorted(r["doc_id"] for r in before)
            break
        assert out.columns == columns
        ids = {r["doc_id"] for r in after}
        if name == names[0]:
            want = good(before, labels.collect())
        elif name == names[1]:
            model = toxicity.fit(held, labels)
            want = {r["doc_id"] for r in before if model.score([r["text"]])[0] < 0.5}
        elif name == names[2]:
            want = near_groups(before)
        else:
            want = uncontaminated(before, bench.collect())
        assert ids == want, name
        held = spark.createDataFrame(out.collect(), docs.schema)


CLASHES = ("same", "of_id", "of_text", "component_id", "_id", "_gone", "Same", "y", "fp", "size", "g", "label", "item", "words", "t", "rank", "copies")


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES], ids=[n for n, _ in corpus_pipeline.STAGES])
def test_odd_rows(spark, sf_dir, stage):
    """Nulls in any column, empty, repeated and very long texts, clashing names, an empty table."""
    names = [n for n in CLASHES if n != "Same"]
    schema = "doc_id long, text string, lang string, source string, n_chars int, " + ", ".join(f"{n} string" for n in names)
    extra = tuple("x" for _ in names)
    text = "the quiet river ran past the old mill and the people of the town went there every day in summer"
    rows = [
        (1, text, "en", "a", 5, *extra), (1, text, "en", "a", 5, *extra), (1, "one two three four five six seven", None, None, None, *extra), (None, text, None, None, None, *extra), (None, None, None, None, None, *[None] * len(names)),
        (2, None, "en", "a", 0, *extra), (3, "", "en", None, 0, *extra), (4, " \n ", "en", "a", 3, *extra), (5, "word " * 200_000 + "end", "en", "b", None, *extra), (6, text + " again", "de", "b", 7, *extra),
    ]
    df = spark.createDataFrame(rows, schema)
    out = stage(spark, df, sf_dir)
    got = [tuple(r) for r in out.collect()]
    if out.columns == df.columns:
        assert set(got) <= set(rows) and len(got) <= len(rows)
        assert all(Counter(got)[r] <= Counter(rows)[r] for r in set(got))
    else:
        assert len(got) == len(rows) and {"doc_id", "taken"} <= set(out.columns)
    assert stage(spark, spark.createDataFrame([], schema), sf_dir).collect() == []


def test_near_dedup_keeps_other_texts_of_an_id(spark, sf_dir):
    stage = dict(corpus_pipeline.STAGES)["simhash near-dedup"]
    rows = [(1, "alpha beta gamma delta epsilon zeta", "x"), (1, "one two three four five six", "a"), (1, "one two three four five six", "b"), (2, "Alpha beta gamma delta epsilon zeta", "y"), (3, None, "z"), (4, "", "w")]
    got = [tuple(r) for r in stage(spark, spark.createDataFrame(rows, "doc_id long, text string, same string"), sf_dir).collect()]
    assert sorted(got, key=str) == sorted([rows[0], rows[1], rows[4]], key=str)


def test_run(spark, sf_dir):
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    assert rows and {"doc_id", "taken", "target", "copies"} <= set(rows[0].asDict())
