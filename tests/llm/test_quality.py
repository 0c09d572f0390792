import numpy as np
import pytest

from concord.llm import quality

DOCS = "doc_id long, text string, lang string, source string, quality string, y int"
LABELS = "doc_id long, quality int, toxic int"


def test_discriminant_is_the_gaussian_log_ratio():
    rng = np.random.default_rng(0)
    x = [rng.normal(size=(400, 3)) @ np.diag([1, 2, 0.5]), rng.normal(size=(900, 3)) + [2, 0, 1]]
    d = 3
    sums = [(len(a), a.sum(axis=0), a.T @ a) for a in x]
    model = quality.Discriminant(*[np.array([s[i] for s in sums], dtype=float) for i in range(3)], shrinkage=0.1, floor=1e-3)
    pooled = sum(len(a) * np.cov(a.T, bias=True) for a in x) / sum(map(len, x))
    points = rng.normal(size=(20, 3)) * 2
    logs = []
    for a in x:
        w = max(0.1, d / (len(a) + d))
        c = (1 - w) * np.cov(a.T, bias=True) + w * np.diag(np.diag(pooled)) + 1e-3 * np.eye(d)
        diff = points - a.mean(axis=0)
        logs.append(-0.5 * np.einsum("ij,jk,ik->i", diff, np.linalg.inv(c), diff) - 0.5 * np.linalg.slogdet(c)[1])
    share = 901 / 1302
    want = 1 / (1 + np.exp(-(logs[1] - logs[0] + np.log(share / (1 - share)))))
    assert np.allclose(model.score(points), want, atol=1e-9)


def test_statistics_of_odd_texts():
    for text in (None, b"", b" \n\t", b"a", "Ä ß".encode(), b"x" * 200_000, b"a b " * 100_000, bytes(range(256))):
        s = quality.statistics(text)
        assert len(s) == len(quality.NAMES) and np.isfinite(s).all()


def test_held_out_accuracy(spark, sf_dir):
    sf_dir = sf_dir.replace("sf0.001", "sf0.01")
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.classify(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) >= 0.95
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_only_text_decides(spark):
    texts = ["good words here and there"] * 3 + ["BAD!! BAD!!"] * 3
    docs = [(i, t, "en", "s", "x", i) for i, t in enumerate(texts * 10)]
    labels = [(i, int(i % 6 < 3), 0) for i in range(60)]
    got = quality.classify(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)).collect()
    assert {(r["doc_id"] % 6 < 3, r["predicted"]) for r in got} == {(True, 1), (False, 0)}
    other = [(i + 1000, t, None, None, None, None) for i, t in enumerate(texts)]
    both = spark.createDataFrame(docs + other, DOCS)
    score = {r["doc_id"]: r["score"] for r in quality.classify(both, spark.createDataFrame(labels, LABELS)).collect()}
    assert all(score[1000 + i] == score[i] for i in range(6))
    kept = quality.keep_good(both, spark.createDataFrame(labels, LABELS))
    assert kept.columns == both.columns
    assert {r["doc_id"] % 6 for r in kept.where("doc_id < 60").collect()} == {0, 1, 2}


def test_nulls_and_empty(spark):
    docs = [(None, None, None, None, None, None), (1, "", None, None, None, None), (1, "", None, None, None, None), (2, "a b", None, None, None, None)]
    df = spark.createDataFrame(docs, DOCS)
    for labels in ([], [(1, 1, 0), (1, 0, 0), (None, 1, 1), (2, None, None), (3, 7, 7)]):
        got = quality.classify(df, spark.createDataFrame(labels, LABELS)).collect()
        assert len(got) == 4 and all(0 <= r["score"] <= 1 for r in got)
    assert [r["held_out"] for r in got if r["doc_id"] is None] == [True]
    assert quality.classify(spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)).collect() == []
    assert quality.fit(df, spark.createDataFrame([], LABELS)).share == pytest.approx(0.5)
