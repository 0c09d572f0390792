import math
import zlib
from collections import Counter

import numpy as np
import pytest

from concord.llm import langid

DOCS = "doc_id long, text string, lang string, lang_pred string, score string"


def grams(text):
    """All n-grams of a text, one by one."""
    import unicodedata

    kept = "".join(c if unicodedata.category(c)[0] in "LM" else " " for c in text.lower())
    words = f" {' '.join(kept.split(' '))} "
    while "  " in words:
        words = words.replace("  ", " ")
    return [words[i : i + n] for n in langid.ORDERS for i in range(len(words) - n + 1)]


def bucket(gram):
    h = 0
    for n, c in enumerate(gram, 1):
        h = (h + ord(c) + n) * int(langid._STEP) % 2**64
        h ^= h >> 29
    return (h * int(langid._STEP) % 2**64) >> 49


@pytest.mark.parametrize("text", ["a", "Äb c", "x  1 y\n\nZ.", "हिन्दी में", "👍 ok 世界", "aa" * 50])
def test_buckets_against_brute_force(text, monkeypatch):
    want = Counter(map(bucket, grams(text)))
    for block in (1 << 20, 7, 5):
        monkeypatch.setattr(langid, "BLOCK", block)
        at, n = langid.counted(text)
        assert dict(zip(at.tolist(), n.tolist())) == want


def test_against_brute_force(spark):
    """The whole query against naive Bayes written out over the same hashed n-grams."""
    texts = {"en": ["the cat sat on the mat", "this is that", "where there is"], "de": ["die katze und der hund", "das ist nicht", "wo ist der"], "fr": ["le chat est sur la table", "je ne sais pas", "où est la"]}
    docs = [(i, texts[lang][(i // 3) % 3] + " " * (i % 4) + str(i), lang, "x", "y") for i, lang in enumerate(["en", "de", "fr"] * 20)]
    docs += [(100, None, "en", None, None), (101, "", "de", None, None), (102, "123 . !", "fr", None, None), (103, "der the", None, None, None), (None, "le le le", "en", None, None), (3, docs[3][1], "en", "x", "y"), (104, "dog der", "", None, None)]
    got = langid.identify(spark.createDataFrame(docs, DOCS))
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"]
    held = lambda i: i is None or zlib.crc32(str(i).encode()) % 3 == 1
    learned = [(d[1] or "", d[2]) for d in docs if d[2] is not None and not held(d[0])]
    langs = sorted({x for _, x in learned})
    rows = Counter(x for _, x in learned)
    counts = {x: Counter(b for t, y in learned if y == x and t for b in map(bucket, grams(t))) for x in langs}
    want = []
    for d in docs:
        if not d[1] or not any(c.isalpha() for c in d[1]):
            want.append((d[0], held(d[0]), "und", 0.0))
            continue
        logs = []
        for x in langs:
            total = sum(counts[x].values()) + langid.ALPHA * langid.BUCKETS
            logs.append(sum(math.log((counts[x][b] + langid.ALPHA) / total) for b in map(bucket, grams(d[1]))) / len(langid.ORDERS) + math.log(rows[x] / len(learned)))
        best = max(range(len(langs)), key=logs.__getitem__)
        want.append((d[0], held(d[0]), langs[best], 1 / sum(math.exp(v - logs[best]) for v in logs)))
    key = lambda r: (r[0] is None, r[0] or 0)
    for a, b in zip(sorted(map(tuple, got.collect()), key=key), sorted(want, key=key)):
        assert a[:3] == b[:3] and a[3] == pytest.approx(b[3], abs=1e-5)


def test_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/documents.parquet")
    rows = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang_pred <> 'und'").collect()
    right = np.array([r["lang_pred"] == r["lang"] for r in rows])
    assert len(rows) > 200 and right.mean() >= 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_rows_of_a_language_are_thinned_and_rare_ones_kept(spark):
    docs = spark.range(3000).selectExpr("id doc_id", "'the words of it' text", "if(id % 300 = 0, 'rare', 'often') lang")
    rows, langs, n = langid.learned_rows(docs, max_rows=200)
    kept = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    assert langs == ["often", "rare"] and n[1] == kept["rare"] and 120 < kept["often"] < 280
    assert langid.learned_rows(docs, max_langs=1)[1] == ["often"]


def test_nothing_learned_and_long_texts(spark):
    docs = [(1, "words here", None, None, None), (2, "é" * 3_000_000, None, None, None)]
    got = langid.identify(spark.createDataFrame(docs, DOCS)).collect()
    assert {(r["lang_pred"], r["score"]) for r in got} == {("und", 0.0)}
    got = langid.identify(spark.createDataFrame([*docs, *[(i, "das wort" if i % 2 else "the word", "de" if i % 2 else "en", None, None) for i in range(3, 40)]], DOCS)).collect()
    assert all(r["lang_pred"] in ("de", "en") for r in got)
    assert langid.identify(spark.createDataFrame([], DOCS)).collect() == []
    odd = spark.sql("select 1L doc_id, cast(x'61ff62' as string) text, 'de' lang union all select 2L, 'ab', 'de'")
    assert len(langid.identify(odd).collect()) == 2
