import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from concord.llm import components, simhash

DOCS = "doc_id long, text string, source string, label int"


def slow_fingerprint(text, size):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(ids, linked):
    """Smallest id reachable, by flooding."""
    label = {}
    for i in sorted(range(len(ids)), key=lambda i: ids[i]):
        if i in label:
            continue
        stack = [i]
        while stack:
            x = stack.pop()
            if x in label:
                continue
            label[x] = ids[i]
            stack += [y for y in range(len(ids)) if y not in label and linked(x, y)]
    return [label[i] for i in range(len(ids))]


def corpus():
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for k in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([60, 120, 300]))]
        for _ in range(rng.choice([1, 2, 6])):
            text = list(base)
            for _ in range(rng.choice([0, 1, 2, 5])):
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
            rows.append(" ".join(text))
    rows += ["", None, " \t\n", "Ä one", "one", "ONE", "x " * 30000, "Straße ÄÖ a B c D"]
    return [(7 * i + 3, t, None if i % 5 else "s", i) for i, t in enumerate(rows)]


def test_near_duplicates_as_brute_force(spark):
    rows = corpus()
    got = {r["doc_id"]: r for r in simhash.near_duplicates(spark.createDataFrame(rows, DOCS), chunk=4).collect()}
    prints = [slow_fingerprint(t, 4) for _, t, _, _ in rows]
    ids = [r[0] for r in rows]
    want = slow_components(ids, lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 4)
    assert len(got) == len(rows)
    for i, fp, c in zip(ids, prints, want):
        assert got[i]["fingerprint"] == f"{fp:016x}"
        assert got[i]["component_id"] == c


@pytest.mark.parametrize("blocks", [5, 6, 7])
def test_shards_lose_no_link(spark, blocks):
    rng = random.Random(blocks)
    base = [rng.getrandbits(64) for _ in range(30)]
    fps = set(base)
    for b in base:
        for flips in range(1, 7):
            x = b
            for bit in rng.sample(range(64), flips):
                x ^= 1 << bit
            fps.add(x)
    fps = sorted(fps)
    signed = [int(np.uint64(f).astype(np.int64)) for f in fps]
    edges = simhash.fingerprint_links(spark.createDataFrame([(f,) for f in signed], "fp long"), 4, blocks, chunk=16)
    label = {r["node"]: r["label"] for r in components.components(edges).collect()}
    want = slow_components(signed, lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 4)
    got = [label.get(s, s) for s in signed]
    classes = lambda x: {frozenset(i for i, v in enumerate(x) if v == c) for c in set(x)}
    assert classes(got) == classes(want)


def test_bk_tree_against_scan():
    rng = random.Random(1)
    values = [rng.getrandbits(64) for _ in range(300)]
    values += [v ^ (1 << rng.randrange(64)) for v in values[:100]]
    tree = simhash.BKTree()
    for i, v in enumerate(values):
        tree.add(v, i)
    for q in values[:50]:
        for radius in (0, 2, 4, 12):
            assert sorted(tree.within(q, radius)) == [i for i, v in enumerate(values) if (v ^ q).bit_count() <= radius]


def jaccard(a, b, size=5):
    sets = []
    for t in (a, b):
        w = (t or "").lower().split()
        sets.append({" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    both = len(sets[0] & sets[1])
    return both / (len(sets[0]) + len(sets[1]) - both) if sets[0] or sets[1] else 1.0


def test_near_copies_as_brute_force(spark):
    rows = corpus()
    texts, ids = [r[1] for r in rows], [r[0] for r in rows]
    want = dict(zip(ids, slow_components(ids, lambda a, b: jaccard(texts[a], texts[b]) >= 0.8)))
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_copies(spark.createDataFrame(rows, DOCS), chunk=4).collect()}
    assert got == want
    kept = simhash.drop_near_copies(spark.createDataFrame(rows, DOCS))
    assert kept.columns == ["doc_id", "text", "source", "label"]
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want.values()))


def test_repeated_rows_nulls_and_empty(spark):
    rows = [(1, "a b c d e", "s", 1), (1, "a b c d e", "s", 1), (None, "a b c d e", "s", 1), (2, "f g h i j", None, None)]
    docs = spark.createDataFrame(rows, DOCS)
    got = sorted((r["doc_id"] or -1, r["component_id"]) for r in simhash.near_duplicates(docs).collect())
    assert got == [(-1, 1), (1, 1), (1, 1), (2, 2)]
    assert sorted(r["doc_id"] or -1 for r in simhash.drop_near_copies(docs).collect()) == [-1, 1, 2]
    empty = spark.createDataFrame([], DOCS)
    assert simhash.near_duplicates(empty).collect() == []
    assert simhash.drop_near_copies(empty).collect() == []


def test_components_of_a_long_path(spark):
    n = 200
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1001), (5, 5)], "a long, b long")
    got = {r["node"]: r["label"] for r in components.components(edges).collect()}
    assert got == {**{i: 0 for i in range(n + 1)}, 1000: 1000, 1001: 1000}


def test_near_copies_with_repeated_passages_and_few_shingles(spark):
    rng = random.Random(8)
    words = lambda k: [f"w{rng.randrange(10**6)}" for _ in range(k)]
    rows = []
    for _ in range(4):  # each with an own passage, many times
        shared = words(2000)
        rows += [" ".join(shared + words(14) * 50) for _ in range(2)]
        line = words(12)
        rows += [" ".join(line + shared[::-1]), " ".join(line * 300 + shared[::-1])]
    for _ in range(200):  # four shingles of five, of which one more makes 0.8
        short = words(9)
        rows += [" ".join(short), " ".join(short[:-1])]
    docs = spark.createDataFrame([(i, t, None, 0) for i, t in enumerate(rows)], DOCS)
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_copies(docs).collect()}
    pairs = [(i, i + 1) for i in range(0, len(rows), 2)]
    assert all(jaccard(rows[i], rows[j]) >= 0.8 for i, j in pairs)
    assert all(got[i] == got[j] == i for i, j in pairs[:8])
    assert sum(got[j] == i for i, j in pairs[8:]) >= 198  # 0.0016 share no shard


def test_different_texts_under_one_or_no_doc_id(spark):
    rng = random.Random(2)
    base, other, lone = ([f"w{rng.randrange(10**6)}" for _ in range(100)] for _ in range(3))
    middle = base[:93]  # links base to far
    far = base[14:93]
    assert jaccard(" ".join(base), " ".join(far)) < 0.8 <= min(jaccard(" ".join(base), " ".join(middle)), jaccard(" ".join(middle), " ".join(far)))
    rows = [(1, base, "a"), (None, middle, "b"), (3, far, "c"), (5, base, "d"), (5, other, "e"), (5, lone, "f"), (5, lone, "g")]
    docs = spark.createDataFrame([(i, " ".join(t), s, 0) for i, t, s in rows], DOCS)
    got = sorted(r["source"] for r in simhash.drop_near_copies(docs).collect())
    assert got in (["a", "b", "e", "f"], ["a", "b", "e", "g"])


def test_texts_that_share_a_line_are_not_all_compared(spark, monkeypatch):
    rng = random.Random(12)
    words = lambda k: [f"w{rng.randrange(10**6)}" for _ in range(k)]
    line, rows = words(14), []
    rows += [line + words(30) for _ in range(1500)]
    for _ in range(60):  # near copies among them
        own = words(30)
        rows += [line + own, line + own[:-1] + words(1)]
    rows += [line + words(1 + i % 2) for i in range(60)]  # hardly anything but the line: linked with one word more, not with two
    texts = [" ".join(r) for r in rows]
    sets = [{" ".join(r[i : i + 5]) for i in range(len(r) - 4)} for r in rows]
    ids = list(range(len(rows)))
    similar = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    want = dict(zip(ids, slow_components(ids, similar)))
    compared, by_key = [], simhash.by_key

    def counted(groups, key, fn, schema):
        asking = F.sum(F.col("asks").cast("long")) if "asks" in groups.columns else F.count("*")
        compared.append(groups.groupBy(key).agg((F.count("*") * asking).alias("n")).agg(F.sum("n")).first()[0] or 0)
        return by_key(groups, key, fn, schema)

    monkeypatch.setattr(simhash, "by_key", counted)
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_copies(spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string"), chunk=16).collect()}
    assert got == want
    assert len(compared) == 2 and compared[1] < 60 * len(rows)


def test_leaf_tree_against_scan():
    rng = random.Random(2)
    values = [rng.getrandbits(64) for _ in range(300)]
    values += [v ^ (1 << rng.randrange(64)) for v in values[:100]] + values[:50] + [7] * 40
    for most in (1, 8, 1024):
        tree = simhash.LeafTree(most)
        for i, v in enumerate(values):
            tree.add(v, i)
        for q in values[:40]:
            for radius in (0, 4, 28):
                assert sorted(tree.within(q, radius).tolist()) == [i for i, v in enumerate(values) if (v ^ q).bit_count() <= radius]


@pytest.mark.parametrize("n", [3, 20, 100])
def test_links_by_labels_and_asks(n):
    rng = random.Random(n)
    base = [rng.sample(range(1 << 32), 30) for _ in range(4)]
    sets = [np.unique(np.array([v if rng.random() > 0.06 else rng.randrange(1 << 32) for v in base[i % 4]], dtype=np.uint32)) for i in range(n)]
    fps = [0xABCDEF << (8 * (i % 4)) for i in range(n)]
    labels, asks = [rng.randrange(2 * n) for _ in range(n)], [rng.random() < 0.5 for _ in range(n)]
    both = lambda i, j: len(set(sets[i].tolist()) & set(sets[j].tolist()))
    similar = lambda i, j: both(i, j) >= 0.8 * (len(sets[i]) + len(sets[j]) - both(i, j)) and (fps[i] ^ fps[j]).bit_count() <= 28
    common = simhash.Overlaps(sets)
    assert all(common.both(i, np.array([j])).tolist() == [both(i, j)] for i in range(n) for j in range(n) if i != j)
    edges = simhash.links_in(fps, 28, lambda i, js: common.both(i, js) >= 0.8 * (common.size[i] + common.size[js] - common.both(i, js)), labels, asks)
    held = {*edges, *((j, i) for i, j in edges)}
    own = lambda i, j: labels[i] == labels[j]
    assert slow_components(list(range(n)), lambda i, j: own(i, j) or (i, j) in held) == slow_components(list(range(n)), lambda i, j: own(i, j) or (asks[i] or asks[j]) and similar(i, j))


def test_rolling_hashes_are_those_of_each_shingle():
    words = [b"w%d" % (i % 977) for i in range(45_000)]
    got = simhash.rolling_hashes(words, 5, held := [np.zeros(0, dtype=np.uint64)] * 2)
    assert len(got) == 44_996 and len(np.unique(got)) == 977
    assert all(got[i] == simhash.rolling_hashes(words[i : i + 5], 5, held)[0] for i in (0, 1, 19_999, 20_000, 44_995))
    assert simhash.rolling_hashes([], 5, held).tolist() == [] and len(simhash.rolling_hashes([b"a", b"b"], 5, held)) == 1
