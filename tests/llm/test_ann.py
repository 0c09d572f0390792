import numpy as np

from concord.llm import ann

VECTORS = "vec_id long, embedding array<float>, label int, score string"


def exact(ids, x, k=20):
    out = {}
    for n, i in enumerate(ids):
        if i % 20 == 0:
            s = (x * x[n]).sum(axis=1)
            own = np.flatnonzero(ids != i)
            top = own[np.lexsort((ids[own], -s[own]))][:k]
            out[int(i)] = [(int(ids[t]), s[t]) for t in top]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    return out


def data(n, seed=1, d=16):
    rng = np.random.default_rng(seed)
    x = (rng.normal(size=(n, d)) * rng.uniform(0.5, 2, size=(n, 1))).astype(np.float32)
    x[: n // 3] = x[0]  # a third is one vector
    return np.arange(n), x


def test_recall_and_exact_scores(spark):
    ids, x = data(1500)
    rows = [(int(i), v.tolist(), 0, "s") for i, v in zip(ids, x)]
    got = found(ann.search(spark.createDataFrame(rows, VECTORS), chunk=128, part=32))
    want = exact(ids, x.astype(float))
    assert got.keys() == want.keys()
    hits = 0
    for q, top in want.items():
        assert len(got[q]) == 20
        assert got[q] == sorted(got[q], key=lambda r: (-r[1], r[0]))
        at = dict(top)
        hits += sum(i in at for i, _ in got[q])
        n = int(np.flatnonzero(ids == q)[0])
        for i, s in got[q]:
            assert s == (x[i].astype(float) * x[n].astype(float)).sum()
    assert hits / (20 * len(want)) >= 0.9


def test_all_lists_and_no_abandoning_is_exact(spark):
    ids, x = data(400, seed=3)
    rows = [(int(i), v.tolist(), 0, "s") for i, v in zip(ids, x)]
    got = found(ann.search(spark.createDataFrame(rows, VECTORS), probes=1.0, chunk=64))
    want = exact(ids, x.astype(float))
    assert sum(a == b for q in want for a, b in zip([i for i, _ in got[q]], [i for i, _ in want[q]])) >= 0.97 * sum(map(len, want.values()))


def test_odd_vectors(spark):
    bad = [(20, None), (40, []), (60, [0.0, 0.0]), (80, [1.0, None]), (100, [float("nan"), 1.0]), (120, [float("inf"), 1.0]), (140, [1.0, 2.0, 3.0]), (None, [1.0, 1.0])]
    good = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 1.0]), (3, [2.0, 0.0]), (3, [2.0, 0.0])]
    df = spark.createDataFrame([(i, v, None, None) for i, v in bad + good], VECTORS)
    rows = [(r["query_id"], r["vec_id"], r["score"]) for r in ann.search(df).orderBy("query_id", "rank").collect()]
    assert rows == [(0, 1, 2.0), (0, 3, 2.0), (0, 2, 0.0)]
    assert ann.search(spark.createDataFrame([], VECTORS)).collect() == []
    assert ann.search(spark.createDataFrame([(i, None, 1, "s") for i in range(3)], VECTORS)).collect() == []


def test_vectors_that_share_an_id_are_queries_of_their_own(spark):
    rows = [(20, [1.0, 0.0]), (20, [0.0, 1.0]), *[(i, [float(i % 7), float(i % 5)]) for i in range(100, 160) if i % 20]]
    df = spark.createDataFrame([(i, v, None, None) for i, v in rows], VECTORS)
    got = [(r["rank"], r["vec_id"], r["score"]) for r in ann.search(df, probes=1.0).where("query_id = 20").collect()]
    assert len(got) == 40 and 20 not in {i for _, i, _ in got}
    others = [(i, v) for i, v in rows if i != 20]
    want = [(n + 1, i, s) for axis in (0, 1) for n, (s, i) in enumerate(sorted(((v[axis], i) for i, v in others), key=lambda r: (-r[0], r[1]))[:20])]
    assert sorted(got) == sorted(want)


def test_recall_on_the_tables_vectors(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.1')}/embeddings.parquet")
    rows = ann.usable(table).orderBy("vec_id").collect()
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["v"] for r in rows])
    want, got = exact(ids, x), found(ann.search(table))
    recall = np.mean([len({i for i, _ in got[q]} & {i for i, _ in top}) / len(top) for q, top in want.items()])
    print("recall", len(ids), recall)
    assert recall >= 0.9
