import math
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.accumulators import AccumulatorParam

from concord.llm import katz, queries



@pytest.fixture(autouse=True)
def few_buckets(monkeypatch):
    monkeypatch.setattr(katz, "MIN_BUCKETS", 6)


DOCS = "doc_id long, text string, n_tokens int, c string"


def rows(n=150, seed=3):
    rng = random.Random(seed)
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(5000)]
    out = []
    for i in range(n):
        at = rng.randrange(4800)
        out.append((i, " ".join(words[at : at + rng.randrange(1, 90)]) + rng.choice(["", "\n", " Ä"]), 1, "c"))
    return out + [(9000, None, None, None), (9001, "", 1, "c"), (9001, " \t", 1, "c"), (None, "W1 w2", 1, "c"), (9002, "never seen words", 1, "c"), (9003, "W1 w1 " * 20000, 1, "c")]


class Slow:
    """The model by its definition: counts by order, and the recursion."""

    def __init__(self, texts):
        self.c = {1: Counter(), 2: Counter(), 3: Counter()}
        self.of = {1: Counter(), 2: Counter(), 3: Counter()}
        for t in texts:
            w = ["<s>", "<s>", *t, "</s>"]
            for i in range(2, len(w)):
                for k in (1, 2, 3):
                    self.c[k][tuple(w[i - k + 1 : i + 1])] += 1
                    self.of[k][tuple(w[i - k + 1 : i])] += 1
        self.words = [w for (w,) in self.c[1]]
        self.n, self.v = sum(self.c[1].values()), len(self.words)
        self.d = {k: katz.discounts({r: sum(x == r for x in self.c[k].values()) for r in range(1, 7)}) for k in self.c}
        self.after = {k: defaultdict(list) for k in self.c}
        for k in (2, 3):
            for gram in self.c[k]:
                self.after[k][gram[:-1]].append(gram[-1])
        self.unknown = max(1e-12, 1 - sum(self.seen((w,)) for w in self.words)) if self.n else 1.0
        self.kept = {}

    def seen(self, gram):
        k = len(gram)
        c = self.c[k][gram]
        return (self.d[k][c - 1] if c <= 5 else 1) * c / self.of[k][gram[:-1]]

    def p(self, gram):
        if self.c[len(gram)].get(gram):
            return self.seen(gram)
        return self.unknown if len(gram) == 1 else self.alpha(gram[:-1]) * self.p(gram[1:])

    def alpha(self, h):
        if h not in self.kept:
            own = self.after[len(h) + 1].get(h, [])
            left = 1 - sum(self.seen((*h, w)) for w in own)
            self.kept[h] = max(1e-12, left) / max(1e-12, 1 - sum(self.p((*h[1:], w)) for w in own)) if own else 1.0
        return self.kept[h]

    def score(self, text):
        w = ["<s>", "<s>", *text, "</s>"]
        return sum(math.log10(self.p(tuple(w[i - 2 : i + 1]))) for i in range(2, len(w)))

    def base(self, text):
        return sum(math.log10((self.c[1].get((b,), 0) + 1) / (self.n + self.v + 1)) for b in [*text, "</s>"])


class Most(AccumulatorParam):
    def zero(self, value):
        return 0

    def addInPlace(self, a, b):
        return max(a, b)


def counting(make, sizes):
    """make's function over a group, which also tells the group's number of rows."""

    def made(*args):
        run = make(*args)

        def of(key, table):
            sizes.add(table.num_rows)
            return run(key, table)

        return of

    return made


def tokens(text):
    return ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in (text or "").split()]


def out(i):
    return i is None or zlib.crc32(str(i).encode()) % 7 == 2


def same(got, data, slow):
    by = defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r)
    assert sum(map(len, by.values())) == len(data)
    for i, t, *_ in data:
        w = tokens(t)
        r = next(r for r in by[i] if r["n_tokens"] == len(w) + 1)
        assert r["held_out"] == out(i) and r["train_tokens"] == slow.n
        assert r["n_known"] == sum((b,) in slow.c[1] for b in [*w, "</s>"])
        assert r["base_score"] == pytest.approx(slow.base(w), rel=1e-9)
        assert r["score"] == pytest.approx(slow.score(w), rel=1e-9)


@pytest.mark.parametrize("hot,chunk", [(None, katz.CHUNK), (20, 700), (1, 3000)])
def test_scores_as_brute_force(spark, hot, chunk):
    """Also with contexts spread over the buckets, and with many chunks."""
    data = rows()
    slow = Slow([tokens(t) for i, t, *_ in data if not out(i)])
    assert min(slow.c[2].values()) == min(slow.c[3].values()) == 1
    scores, _ = katz.train_and_score(spark.createDataFrame(data, DOCS).repartition(5), hot=hot, chunk=chunk)
    same(scores.collect(), data, slow)


def test_a_word_of_every_chunk_is_asked_for_by_few_rows(spark, monkeypatch):
    """Chunks of which each asks for the same words and n-grams: their asks are merged, and no group has more than FAN or the merged ones."""
    monkeypatch.setattr(katz, "FAN", 4)
    monkeypatch.setattr(katz, "MIN_BUCKETS", 2)
    sizes = spark.sparkContext.accumulator(0, Most())
    for name in ("_merged", "_answer"):
        monkeypatch.setattr(katz, name, counting(getattr(katz, name), sizes))
    rng = random.Random(5)
    data = [(i, "the same words in every one of them " * 3 + " ".join(f"w{rng.randrange(60)}" for _ in range(30)), 1, "c") for i in range(40)]
    slow = Slow([tokens(t) for i, t, *_ in data if not out(i)])
    scores, model = katz.train_and_score(spark.createDataFrame(data, DOCS).repartition(4), hot=20, chunk=100)
    same(scores.collect(), data, slow)
    assert sorted(r["c"] for r in model.grams(3).collect()) == sorted(slow.c[3].values())
    assert 4 <= sizes.value <= 16  # some 20 chunks in fans of about four


def test_query_scores_whole_table(spark, tmp_path):
    data = rows(80, 4)
    spark.createDataFrame(data, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    same(queries.op5_katz_backoff(spark, str(tmp_path)).collect(), data, Slow([tokens(t) for i, t, *_ in data if not out(i)]))


@pytest.mark.parametrize("hot", [None, 20])
def test_stored_weights_normalise_every_history(spark, hot):
    """The tables hold each n-gram once, and each context's weight; with it every distribution sums to 1."""
    data = rows()
    slow = Slow([tokens(t) for i, t, *_ in data if not out(i)])
    _, model = katz.train_and_score(spark.createDataFrame(data, DOCS), hot=hot)
    assert sorted(r["c"] for r in model.words().collect()) == sorted(slow.c[1].values())
    assert model.stage.unknown == pytest.approx(slow.unknown, abs=1e-12)
    for k in (2, 3):
        assert sorted(r["c"] for r in model.grams(k).collect()) == sorted(slow.c[k].values())
        stored = sorted((r["c"], r["alpha"]) for r in model.contexts(k).collect())
        want = sorted((slow.of[k][h], slow.alpha(h)) for h in slow.after[k])
        assert [c for c, _ in stored] == [c for c, _ in want]
        assert [a for _, a in stored] == pytest.approx([a for _, a in want], rel=1e-6)
    for h in [*slow.after[2], *slow.after[3]]:  # all histories: seen words by their discounts, the others by what is left
        k = len(h) + 1
        own = slow.after[k][h]
        high, low = sum(slow.seen((*h, w)) for w in own), sum(slow.p((*h[1:], w)) for w in own)
        if 1 - low > 1e-6:
            assert high + slow.alpha(h) * (1 - low) == pytest.approx(1, abs=1e-9)
        else:  # the lower order leaves next to nothing, too little for a difference
            assert sum(slow.p((*h, w)) for w in slow.words) + slow.p((*h, "no such word")) == pytest.approx(1, abs=1e-9)
    for h in list(slow.after[2])[:20] + list(slow.after[3])[:20]:
        assert sum(slow.p((*h, w)) for w in slow.words) + slow.p((*h, "no such word")) == pytest.approx(1, abs=1e-9)


def test_empty_and_untrained(spark):
    assert katz.score_documents(spark.createDataFrame([], DOCS)).collect() == []
    lone = [(i, "a b", 1, "c") for i in range(50) if out(i)][:2]
    for r in katz.score_documents(spark.createDataFrame(lone, DOCS)).collect():
        assert (r["score"], r["base_score"], r["train_tokens"], r["n_known"]) == (0.0, 0.0, 0, 0)


def test_encoder_tells_words_apart(monkeypatch):
    """Any bytes, long words and texts of many windows: as split and lower-cased by hand, one hash a word."""
    monkeypatch.setattr(katz, "WINDOW", 50)
    rng = random.Random(1)
    texts = [bytes(rng.choice(b"aAbZ \n\t\x0b\x0c\r\x1c\xc3\x84\xa0") for _ in range(rng.choice([0, 3, 40, 300, 2000]))) for _ in range(300)]
    texts += [b"", b" ", b"x" * 700 + b" " + b"X" * 700]
    of = {}
    for text, got in zip(texts, katz._token_hashes(texts)):
        words = text.lower().split()
        assert got[0] == got[1] == katz.START and got[-1] == katz.END and len(got) == len(words) + 3
        assert all(of.setdefault(w, h) == h for w, h in zip(words, got[2:-1].tolist()))
    assert len(set(of.values())) == len(of)
