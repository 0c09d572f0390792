import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from concord.llm import mixing

DOCS = "doc_id long, text string, source string, size int, target double"


def by_hand(sizes, weights=mixing.WEIGHTS, cap=mixing.CAP):
    order = sorted(s for s in sizes if s is not None) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    full: set = set()
    while True:
        left = sum(sizes.values()) - sum(cap * sizes[s] for s in full)
        share = left / sum(weight[s] for s in order if s not in full) if len(full) < len(order) else 0.0
        more = {s for s in order if s not in full and weight[s] * share > cap * sizes[s]}
        if not more:
            return {s: float(cap * sizes[s]) if s in full else weight[s] * share for s in order}
        full |= more


def test_targets_by_hand():
    assert by_hand({"a": 100, "b": 100, "c": 100}) == pytest.approx({"a": 187.5, "b": 75.0, "c": 37.5})
    got = by_hand({"a": 10, "b": 500, None: 490})
    assert got["a"] == 30 and got["b"] == pytest.approx(970 * 2 / 3) and got[None] == pytest.approx(970 / 3)


def test_targets_are_shared_and_capped(spark):
    rng = np.random.default_rng(1)
    for sizes in [{"a": 100, "b": 100, "c": 100}, {"a": 0, "b": 10}, {None: 5}, {}, {f"s{i:02}": int(rng.integers(0, 1000)) for i in range(40)} | {"é": 7, "": 900, "\U0001f600": 3, "\uffee": 20, None: 60}]:
        table = mixing.ranked(spark.createDataFrame(list(sizes.items()), "s string, z long"))
        rows = mixing.targets(table).collect()
        want = by_hand(sizes)
        order = sorted(s for s in sizes if s is not None) + [None] * (None in sizes)
        assert {r["s"]: r["rank"] for r in rows} == {s: i for i, s in enumerate(order)}
        assert {r["s"]: r["target"] for r in rows} == pytest.approx(want)
        assert all(r["target"] <= 3 * r["z"] + 1e-9 for r in rows)


def rows():
    rng = np.random.default_rng(2)
    out = []
    for i in range(3000):
        source = ["hot", "b", "c", "é", None][0 if i % 3 == 0 else int(rng.integers(0, 5))]
        out.append((i, "w " * int(rng.integers(0, 60)), source, 1, 1.0))
    return out + [(5000, None, "b", 1, 1.0), (5001, "x " * 50_000, "long", 1, 1.0), (5002, "a\u00a0b c", "lone", 1, 1.0)]


def test_mixture(spark):
    data = rows()
    df = spark.createDataFrame(data, DOCS)
    got = mixing.mix(df, bucket=200).collect()
    assert len(got) == len(data)
    size = {i: len([w for w in (t or "").replace("\n", " ").split(" ") if w]) for i, t, *_ in data}
    sums = defaultdict(int)
    for i, _, s, *_ in data:
        sums[s] += size[i]
    due = by_hand(dict(sums))
    taken = defaultdict(int)
    for r in got:
        assert r["size"] == size[r["doc_id"]] and r["source_size"] == sums[r["source"]]
        assert r["target"] == pytest.approx(due[r["source"]])
        assert r["taken"] == r["copies"] * r["size"] <= 3 * r["size"]
        rate = due[r["source"]] / sums[r["source"]]
        assert r["rate"] == pytest.approx(rate, rel=1e-6)
        assert not r["size"] or math.floor(rate + 1e-6) <= r["copies"] <= math.ceil(rate - 1e-6)
        taken[r["source"]] += r["taken"]
    for s, t in due.items():
        own = [size[i] for i, _, x, *_ in data if x == s]
        assert abs(taken[s] - t) <= (0.5 * own[0] if len(own) == 1 else max(60, 0.005 * t))
    again = mixing.mix(df.repartition(7), bucket=200).collect()
    key = lambda x: sorted((r["doc_id"], r["taken"]) for r in x)
    assert key(got) == key(again)


def test_multipliers_solve_the_dual(spark):
    data = [(40.0, 4.0), (5.0, 14.9), (7.0, 7.0), (1e9, 1.0), (3.0, 9.0)]
    got = spark.createDataFrame(data, "z double, target double").select("z", "target", mixing.multiplier(F.col("z"), F.col("target")).alias("l")).collect()
    assert [r["z"] * math.exp(r["l"]) for r in got] == pytest.approx([r["target"] for r in got], rel=1e-12)


def test_many_sources_are_joined_by_a_shuffle(spark, monkeypatch):
    df = spark.createDataFrame([(i, "a b c", f"s{i % 40}", 1, 1.0) for i in range(400)], DOCS)
    want = {r["doc_id"]: r["taken"] for r in mixing.mix(df).collect()}
    monkeypatch.setattr(mixing, "MAX_BROADCAST", 3)
    assert {r["doc_id"]: r["taken"] for r in mixing.mix(df).collect()} == want


def test_repeats_nulls_and_empty(spark):
    data = [(1, "a b c", "s", None, None)] * 2 + [(None, "a b", None, None, None), (2, None, None, None, None)]
    got = mixing.mix(spark.createDataFrame(data, DOCS)).collect()
    assert len(got) == 4 and sum(r["taken"] > 0 for r in got if r["doc_id"] == 1) >= 1
    assert mixing.mix(spark.createDataFrame([], DOCS)).collect() == []
    assert {r["taken"] for r in mixing.mix(spark.createDataFrame([(1, "", "s", 1, 1.0)], DOCS)).collect()} == {0}
