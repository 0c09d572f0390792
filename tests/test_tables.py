import re

import pytest
from pyspark.sql import functions as F

from concord.functions import kinematics, sql, text
from concord.functions.rules import LAT_COMPAT, LAT_EXECUTIONS, LONG_COMPAT, LONG_EXECUTIONS, STRICT
from concord.operators import extended, score
from concord.plans import fixtures, queries
from concord.plans.fixtures import PHRASES, Tables
from concord.sources import io
from tests.test_text import ODD, variants


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def bucketed(spark, sf_dir):
    t, tables = Tables(spark, sf_dir), []
    for name, way in (("pred_b", t.predictions(errors=True)), ("truth_b", t.ground_truth(errors=True))):
        io.write_bucketed(way, name, io.new_path(spark, name), 8)
        tables.append(spark.table(name))
    yield tables
    for name in ("pred_b", "truth_b"):
        spark.sql(f"drop table {name}")


def test_bucketed_waypoints_are_not_shuffled(spark, bucketed):
    pred, truth = bucketed
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for df in (kinematics.features(pred), kinematics.classify_trajectories(pred), kinematics.curvature(pred), kinematics.paths_together(pred, truth)):
            assert "Exchange" not in plan_of(df) and "Bucketed: true" in plan_of(df)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_waypoints_are_written_to_buckets_without_a_shuffle(spark, sf_dir, monkeypatch):
    plans = []
    monkeypatch.setattr(io, "write_bucketed", lambda way, table, path, n: (plans.append(plan_of(way.repartition(n, "clip_id"))), way.createOrReplaceTempView(table)))
    queries._bucketed(Tables(spark, sf_dir))
    assert [p.count("Exchange") for p in plans] == [1, 1]  # orders by clip, before they become waypoints


def test_tasks_grow_with_the_waypoints(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(fixtures, "PATH_ROWS", 6400)
    t = Tables(spark, sf_dir)
    for way in (t.predictions(), t.ground_truth(), t.arcs()):
        sizes = [r["count"] for r in way.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()]
        assert sum(sizes) == t.orders().count() * 64 and len(sizes) >= sum(sizes) // 6400 and max(sizes) < 3 * 6400


def test_waypoints_of_other_clips_are_left_out_unsorted(spark, sf_dir):
    t = Tables(spark, sf_dir)
    clips = t.index().select("clip_id")
    for df in (*score._of(clips, t.predictions(), t.ground_truth()), extended.curvature_effect(spark.createDataFrame([], io.RESULTS), t.arcs())):
        assert "ShuffledHashJoin" in plan_of(df)
    assert "Sort [clip_id" not in plan_of(score._of(clips, t.predictions())[0]).partition("Generate")[0]


def test_clips_to_look_up_need_no_other_columns(spark, sf_dir):
    t = Tables(spark, sf_dir)
    clips, way = t.clips(), t.predictions()
    got = score._of(clips.unionByName(clips), way)[0]
    assert "c_custkey" in plan_of(clips) and "c_custkey" not in plan_of(score._of(clips, way)[0])
    assert got.count() == clips.count() * 64 and got.select("clip_id").distinct().join(clips, "clip_id").count() == clips.count()


def test_paths_together_are_features_and_error(spark, bucketed):
    pred, truth = bucketed
    near = lambda rows: [tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rows]
    got = kinematics.paths_together(pred, truth)
    want = kinematics.features(pred)
    assert near(got.select(want.columns).orderBy("clip_id").collect()) == near(want.orderBy("clip_id").collect())
    error = kinematics.displacement_error(pred, truth)
    assert near(got.where("n_joined > 0").select(error.columns).orderBy("clip_id").collect()) == near(error.orderBy("clip_id").collect())


def test_paths_with_gaps_and_repeats(spark):
    way = lambda rows: spark.createDataFrame([(c, s, float(x), 0.0, 0.0) for c, s, x in rows], "clip_id string, step int, x double, y double, z double")
    pred = way([("a", 0, 0), ("a", 1, 1), ("a", 3, 3), ("b", 0, 0), ("c", 0, 5), ("d", 0, 0), ("d", 0, 0), ("d", 1, 2)])
    truth = way([("a", 1, 2), ("a", 2, 9), ("a", 3, 6), ("c", 7, 0), ("d", 0, 1), ("d", 1, 1)])
    got = {r["clip_id"]: (r["n_joined"], r["ade_meters"]) for r in kinematics.paths_together(pred, truth).collect()}
    assert got == {"a": (2, 2.0), "b": (0, None), "c": (0, None), "d": (2, 1.0)}


def test_broken_csv_is_turned_away_with_its_reason(spark, tmp_path):
    path = tmp_path / "r.csv"
    names = io.RESULTS.fieldNames()
    good = {n: "" for n in names} | {"clip_id": "c1", "t0_us": "5", "cot_text": '"Stop, ""now"".\nThen go."', "mismatch_score": "0.5", "long_match": "0.5", "lat_match": "1"}
    lines = [good, good | {"clip_id": ""}, good | {"mismatch_score": "1.5"}, good | {"lat_match": "-0.1"}, good | {"error": "failed"}, good | {"t0_us": "five"}, good | {"mismatch_score": "", "clip_id": "c2"}]
    text_of = lambda row: ",".join(row[n] for n in names)
    path.write_text("\n".join([",".join(names), *map(text_of, lines), "c9,1", text_of(good) + ",more"]) + "\n")
    taken, rejected = io.checked_results(spark, str(path))
    assert [(r["clip_id"], r["cot_text"]) for r in taken.orderBy("clip_id").collect()] == [("c1", 'Stop, "now".\nThen go.'), ("c2", 'Stop, "now".\nThen go.')]
    assert taken.dtypes == [(f.name, f.dataType.simpleString()) for f in io.RESULTS]
    reasons = sorted(r["reason"] for r in rejected.collect())
    assert reasons == ["malformed"] * 3 + ["match out of range", "no clip", "score of an error", "score out of range"]
    assert {"c9,1"} <= {r["line"].strip() for r in rejected.where("reason = 'malformed'").collect()}
    assert all(r["file"].endswith("r.csv") for r in rejected.collect())
    for _ in range(2):
        io.quarantine(rejected, str(tmp_path / "bad"))
    assert spark.read.parquet(str(tmp_path / "bad")).count() == 14


def test_runs_are_replaced_one_by_one(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "runs")
    rows = lambda *ids: spark.createDataFrame([(i,) for i in ids], "clip_id string")
    read = lambda: sorted((r["run"], r["clip_id"]) for r in spark.read.schema("clip_id string, run string").parquet(path).collect())
    assert io.latest_run(spark, path) is None
    io.write_run(rows("x", "y"), path, "a", "t1")
    io.write_run(rows("z"), path, "b", "t2")
    assert read() == [("a", "x"), ("a", "y"), ("b", "z")]
    io.write_run(rows("w"), path, "a", "t3")
    assert read() == [("a", "w"), ("b", "z")]
    found, which = io.latest_run(spark, path)
    assert [r["clip_id"] for r in found.collect()] == ["w"] and which == {"run": "a", "timestamp": "t3"}
    with monkeypatch.context() as m:  # killed between the rows and the pointer
        m.setattr(io, "set_latest", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            io.write_run(rows("v"), path, "c", "t4")
    assert io.latest_run(spark, path)[1]["run"] == "a"
    io.write_run(rows("v"), path, "c", "t5")
    assert io.latest_run(spark, path)[1] == {"run": "c", "timestamp": "t5"} and read()[-1] == ("c", "v")


@pytest.mark.parametrize("rules", ["current", "strict"])
def test_sql_functions_are_the_rules(spark, rules):
    rules = STRICT if rules == "strict" else text.CURRENT
    names = sql.register(spark, rules)
    assert len(names) == len(set(names)) == 14
    df = spark.createDataFrame(list(enumerate([*PHRASES, *variants(), *ODD])), "clip_id int, cot_text string")
    df.createOrReplaceTempView("texts")
    got = spark.sql("select clip_id, cot_text, long_intent_of(n) long_intent, lat_intent_of(n) lat_intent, confidence_of(n) confidence from (select *, intent_counts(cot_text) n from texts)")
    assert sorted(map(str, got.collect())) == sorted(map(str, text.classify_text(df, rules=rules).collect()))
    assert not re.search("Python", plan_of(got))
    few = spark.sql("select long_intent('Stop. Then accelerate, stop'), lat_intent(null), intent_confidence('stop')").first()
    assert tuple(few) == ("stop", "unspecified", 1.0)


def test_sql_matrices(spark):
    sql.register(spark)
    for axis, cells, executions in (("long", LONG_COMPAT, LONG_EXECUTIONS), ("lat", LAT_COMPAT, LAT_EXECUTIONS)):
        for intent, values in cells.items():
            got = spark.sql("select " + ", ".join(f"{axis}_compat('{intent}', '{e}')" for e in executions)).first()
            assert tuple(got) == values
    got = spark.sql("select mismatch_score('stop', 'accelerating', 'unspecified', 'straight') a, mismatch_score('unspecified', 'x', 'unspecified', 'y') b, mismatch_type(0.5, 'unspecified', 'unspecified') c").first()
    assert got["b"] == 0.5 and got["c"] == "unclassified_intent" and got["a"] == 1 - LONG_COMPAT["stop"][LONG_EXECUTIONS.index("accelerating")]


def test_sql_paths(spark, sf_dir):
    sql.register(spark)
    packed = Tables(spark, sf_dir).arrivals()
    packed.createOrReplaceTempView("paths")
    got = spark.sql("select clip_id, long_execution(traj) l, lat_execution(traj) t from paths where traj is not null")
    want = kinematics.classify_features(kinematics.features_packed(packed.where("traj is not null"))).select("clip_id", F.col("long_execution").alias("l"), F.col("lat_execution").alias("t"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert queries  # the query over all of it is held against DuckDB in test_entry
