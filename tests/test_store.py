import time

import pytest

from concord.functions import text
from concord.functions.rules import CURRENT, STRICT, fingerprint
from concord.operators import rescore
from concord.operators.dictionary import TextDictionary
from concord.plans import queries
from concord.plans.fixtures import PHRASES, Tables
from concord.sources.store import Store


@pytest.fixture
def table(spark, tmp_path):
    path = str(tmp_path / "in")
    spark.range(10).selectExpr("id", "id * 2 as v").write.parquet(path)
    return path


def test_made_once_for_the_same_inputs_and_rules(spark, tmp_path, table):
    store, made = Store(spark, str(tmp_path / "store")), []

    def get(rules="a", where="true"):
        df = spark.read.parquet(table).where(where)
        return store.get("t", [df], rules, lambda: made.append(1) or df.selectExpr("sum(v) s")).first()["s"]

    assert [get(), get(), len(made)] == [90, 90, 1]
    before = store.kept()
    assert get() == 90 and store.kept() == before  # the second time nothing is written
    assert get("b") == 90 and len(made) == 2  # other rules
    assert get(where="id > 5") == 60 and len(made) == 3  # another query over the same files
    spark.range(10, 11).selectExpr("id", "id * 2 as v").write.mode("append").parquet(table)
    assert get() == 110 and len(made) == 4  # other files
    assert len(store.kept()) == 4


def test_a_draft_that_failed_is_no_table(spark, tmp_path, table):
    store, df = Store(spark, str(tmp_path / "store")), spark.read.parquet(table)
    with pytest.raises(Exception):
        store.get("t", [df], "a", lambda: df.selectExpr("raise_error('no') x"))
    assert store.get("t", [df], "a", lambda: df).count() == 10
    inner = lambda: store.get("t", [df], "b", lambda: df) and df.where("id < 3")  # noqa: E731  another made it meanwhile
    assert store.get("t", [df], "b", inner).count() == 10
    assert sum(n.startswith("t-") for n in store.kept()) == 2


def test_removed_by_age(spark, tmp_path, table):
    store, df = Store(spark, str(tmp_path / "store")), spark.read.parquet(table)
    assert store.expire(0) == []
    store.get("t", [df], "a", lambda: df)
    assert store.expire(3600) == []
    time.sleep(0.05)
    assert [n.partition("-")[0] for n in store.expire(0)] == ["t"] and store.kept() == {}
    assert store.get("t", [df], "a", lambda: df).count() == 10


def test_second_report_writes_nothing(spark, sf_dir):
    t = Tables(spark, sf_dir)
    first, kept = queries.queries()["severity_bands"](spark, sf_dir).collect(), Store(spark).kept()
    assert any(n.startswith("scores-") for n in kept)
    assert queries.queries()["severity_bands"](spark, sf_dir).collect() == first
    queries.queries()["run_summary"](spark, sf_dir).collect()
    assert Store(spark).kept() == kept
    assert fingerprint(CURRENT) != fingerprint(STRICT) and t


def test_dictionary_classifies_new_texts_only(spark, tmp_path, monkeypatch):
    known = TextDictionary(spark, str(tmp_path / "d"))
    texts = lambda *which: spark.createDataFrame([(f"{i}-{k}", PHRASES[i]) for i in which for k in range(5)], "clip_id string, cot_text string")
    assert known.report(texts(0, 1, 23), known.learn(texts(0, 1, 23))).collect() == [(15, 2, 2)]
    assert known.report(texts(1, 2, 23), known.learn(texts(1, 2, 23))).collect() == [(15, 2, 1)]
    assert known.report(texts(1, 2), known.learn(texts(1, 2))).collect() == [(10, 2, 0)]
    every = texts(*range(24))
    got = known.classify(every)
    want = text.classify_text(every)
    assert got.columns == want.columns and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()), key=str) or sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    strict = TextDictionary(spark, str(tmp_path / "d"), STRICT)
    assert strict.log.records() == []
    assert sorted(map(str, strict.classify(every).collect())) == sorted(map(str, text.classify_text(every, rules=STRICT).collect()))
    monkeypatch.setattr(TextDictionary, "learn", lambda *_: None)
    unknown = spark.createDataFrame([("x", "Never seen, stop."), ("y", None)], "clip_id string, cot_text string")
    assert {r["clip_id"]: r["long_intent"] for r in known.classify(unknown).collect()} == {"x": None, "y": "unspecified"}


def test_dictionary_killed_before_its_record(spark, tmp_path, monkeypatch):
    known = TextDictionary(spark, str(tmp_path / "d"))
    df = spark.createDataFrame([("a", "Stop."), ("b", "Turn right.")], "clip_id string, cot_text string")
    with monkeypatch.context() as m:
        m.setattr(known.log, "commit", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            known.learn(df)
    assert known.log.read().isEmpty()
    assert known.report(df, known.learn(df)).collect() == [(2, 2, 2)] and known.log.read().count() == 2


def test_rescoring_through_a_dictionary(spark, sf_dir, tmp_path):
    t = Tables(spark, sf_dir)
    old = queries.scored(t).limit(200).cache()
    got = rescore.rescore(old, STRICT, keep_old=True, known=TextDictionary(spark, str(tmp_path / "d"), STRICT))
    assert sorted(map(str, got.collect())) == sorted(map(str, rescore.rescore(old, STRICT, keep_old=True).collect()))
