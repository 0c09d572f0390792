import random

import pytest

from concord.llm import decontaminate

DOCS = "doc_id long, text string, items string, source string"
ITEMS = "item_id long, text string"


def slow_distance(item, text):
    """Least edit distance of item to any part of text."""
    above = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        row = [i]
        for j, b in enumerate(text, 1):
            row.append(min(above[j - 1] + (a != b), above[j] + 1, row[-1] + 1))
        above = row
    return min(above)


def made(seed, edit, n=60):
    """Items, and documents of which half hold an edited item."""
    rng = random.Random(seed)
    vocabulary = [f"v{int(rng.paretovariate(0.6))}" for _ in range(3000)]
    pick = lambda k: [rng.choice(vocabulary) for _ in range(k)]
    items = [(i, pick(rng.choice([3, 8, 18, 40, 59]))) for i in range(40)]
    docs = []
    for d in range(n):
        text = pick(rng.randrange(0, 200))
        if d % 2:
            own = list(rng.choice(items)[1])
            for _ in range(int(edit * len(own))):
                at = rng.randrange(len(own))
                kind = rng.randrange(3)
                if kind == 0:
                    own[at] = rng.choice(vocabulary)
                elif kind == 1:
                    own.insert(at, rng.choice(vocabulary))
                else:
                    del own[at]
            at = rng.randrange(len(text) + 1)
            text[at:at] = own
        docs.append((d, text))
    return items, docs


@pytest.mark.parametrize("edit, least", [(0.0, 1.0), (0.1, 0.95), (0.2, 0.8)])
def test_recall_and_precision_against_brute_force(edit, least):
    hits = wanted = 0
    for seed in range(3):
        items, docs = made(seed, edit)
        finder = decontaminate.Finder(items, 0.2)
        found = finder.find([" ".join(t) for _, t in docs])
        for (_, text), got in zip(docs, found):
            want = {i for i, w in items if slow_distance(w, text) <= int(0.2 * len(w))}
            assert set(got) <= want
            hits += len(set(got) & want)
            wanted += len(want)
    assert hits >= least * wanted > 0


def test_distance_within():
    rng = random.Random(0)
    for _ in range(200):
        a, b = [rng.randrange(4) for _ in range(rng.randrange(1, 9))], [rng.randrange(4) for _ in range(rng.randrange(0, 12))]
        assert decontaminate.distance_within(a, b) == slow_distance(a, b)


def test_planted_passages(spark, sf_dir):
    docs, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    items = [(r["item_id"], decontaminate.words_of(r["text"])) for r in bench.collect()]
    want = {}
    for r in docs.collect():
        words = decontaminate.words_of(r["text"])
        joined = f" {' '.join(words)} "
        want[r["doc_id"]] = any(f" {' '.join(w)} " in joined for _, w in items if w)
    got = {r["doc_id"]: r["contaminated"] for r in decontaminate.matches(docs, bench).collect()}
    assert got.keys() == want.keys()
    assert all(got[d] for d, held in want.items() if held)
    assert sum(got.values()) <= sum(want.values()) + 0.01 * len(want)
    kept = decontaminate.remove(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(d for d, held in got.items() if not held)


def test_nulls_repeats_long_texts_and_empty(spark):
    item = "the quick brown fox jumps over the lazy dog and then it sleeps until the next long morning comes"
    docs = [(1, None, None, None), (2, "", None, None), (None, item.upper(), None, None), (3, "x " * 100_000 + item, None, None), (3, "x " * 100_000 + item, None, None), (4, "the quick brown fox", None, None)]
    df = spark.createDataFrame(docs, DOCS)
    bench = spark.createDataFrame([(7, item), (5, item + "!"), (None, "the quick"), (8, None), (9, " .,")], ITEMS)
    got = sorted((r["doc_id"] or 0, r["items"]) for r in decontaminate.matches(df, bench).collect())
    assert got == [(0, [5]), (1, []), (2, []), (3, [5]), (3, [5]), (4, [])]
    assert decontaminate.remove(df, spark.createDataFrame([], ITEMS)).count() == 6
    assert decontaminate.matches(spark.createDataFrame([], DOCS), bench).collect() == []


def test_whole_recall_wherever_the_edits_are():
    rng = random.Random(5)
    fresh = iter(range(10**6))
    own = lambda k: [f"w{rng.randrange(400)}" for _ in range(k)]
    noise = lambda k: [f"n{next(fresh)}" for _ in range(k)]
    items = [(n, own(n)) for n in (3, 4, 5, 6, 9, 10, 15, 16, 20, 33, 64, 100)]
    finder = decontaminate.Finder(items, 0.2)
    for n, words in items:
        slack = int(0.2 * n)
        at = sorted(rng.sample(range(n), slack))
        copies = {
            "head cut": words[slack:], "head replaced": noise(slack) + words[slack:], "tail cut": words[: n - slack],
            "middle cut": words[: n // 2] + words[n // 2 + slack :], "spread": [noise(1)[0] if i in at else w for i, w in enumerate(words)],
            "added": [x for i, w in enumerate(words) for x in ([*noise(1), w] if i in at else [w])],
        }
        for name, copy in copies.items():
            for text in (copy, noise(30) + copy, copy + noise(30), noise(7) + copy + noise(50)):
                assert n in finder.find([" ".join(text)])[0], (n, name)
    one_more = noise(1) + words[21:]
    assert slow_distance(words, one_more) == 21 and finder.find([" ".join(one_more)]) == [[]]


@pytest.mark.parametrize("edit", [0.1, 0.2])
def test_same_as_brute_force(edit):
    for seed in range(3, 6):
        items, docs = made(seed, edit)
        got = decontaminate.Finder(items, 0.2).find([" ".join(t) for _, t in docs])
        assert [set(g) for g in got] == [{i for i, w in items if slow_distance(w, t) <= int(0.2 * len(w))} for _, t in docs]


def test_parts_find_the_same(spark, monkeypatch):
    items, docs = made(9, 0.1, n=20)
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items], ITEMS)
    df = spark.createDataFrame([(d, " ".join(t), "x", "y") for d, t in docs], DOCS)
    whole = sorted((r["doc_id"], r["items"]) for r in decontaminate.matches(df, bench).collect())
    monkeypatch.setattr(decontaminate, "MAX_ITEM_WORDS", 400)
    assert len(decontaminate.parts(bench)) > 2
    assert sorted((r["doc_id"], r["items"]) for r in decontaminate.matches(df, bench).collect()) == whole
    kept = decontaminate.remove(df, bench)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == [d for d, held in whole if not held]
