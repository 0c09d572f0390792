import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from concord.functions.rules import LAT_COMPAT, LAT_EXECUTIONS, LONG_COMPAT, LONG_EXECUTIONS, STRICT
from concord.operators import rescore, score
from concord.sources.io import RESULTS, WAYPOINTS

CLIPS = "clip_id string, t0_us long, hour_bucket string, ord long"


def slow(li, le, ti, te):
    a = LONG_COMPAT[li][LONG_EXECUTIONS.index(le)] if li != "unspecified" else None
    b = LAT_COMPAT[ti][LAT_EXECUTIONS.index(te)] if ti != "unspecified" else None
    c = 0.5 * a + 0.5 * b if a is not None and b is not None else a if a is not None else b if b is not None else 0.5
    s = round(1 - c, 3)
    kind = "unclassified_intent" if a is None and b is None else "consistent" if s < 0.3 else "partial_mismatch" if s < 0.6 else "severe_mismatch"
    return s, kind, 0.5 if a is None else a, 0.5 if b is None else b


def test_the_whole_grid(spark):
    grid = list(itertools.product([*LONG_COMPAT, "unspecified"], LONG_EXECUTIONS, [*LAT_COMPAT, "unspecified"], LAT_EXECUTIONS))
    assert len(grid) == 600
    df = spark.createDataFrame(grid, "long_intent string, long_execution string, lat_intent string, lat_execution string")
    for r in score.score(df).collect():
        key = (r["long_intent"], r["long_execution"], r["lat_intent"], r["lat_execution"])
        assert (r["mismatch_score"], r["mismatch_type"], r["long_match"], r["lat_match"]) == slow(*key)


def inputs(spark):
    t = np.linspace(0, 1, 64)
    zero = np.zeros(64)
    cases = {
        "g1": ("Nudge to the left to increase clearance from the construction cones.", 30 * t, 0.5 * t),
        "g2": ("Stop for the pedestrian crossing ahead.", 2 * t, zero),
        "g3": ("Slow down and stay in the current lane.", 40 * t, zero),
        "g4": ("Accelerate to merge into the left lane.", np.cumsum(np.linspace(0.5, 2, 64)), 3 * t),
        "g5": ("Proceed through the intersection.", 50 * t, zero),
        "g6": (None, 50 * t, zero),
        "g7": ("x" * 1200 + " stop", 50 * t, zero),
    }
    clips = spark.createDataFrame([(c, 5, "night", i) for i, c in enumerate([*cases, "none"])], CLIPS)
    text = spark.createDataFrame([(c, v[0]) for c, v in cases.items()], "clip_id string, cot_text string")
    way = spark.createDataFrame([(c, i, float(x), float(y), 0.0) for c, v in cases.items() for i, (x, y) in enumerate(zip(v[1], v[2]))], WAYPOINTS)
    return clips, text, way


def test_golden_cases(spark):
    clips, text, way = inputs(spark)
    out = score.score_clips(clips, text, way, way)
    assert out.columns == RESULTS.fieldNames()
    got = {r["clip_id"]: r for r in out.collect()}
    pick = lambda c: tuple(got[c][k] for k in ("long_intent", "lat_intent", "long_execution", "lat_execution", "long_match", "lat_match", "mismatch_score", "mismatch_type"))
    assert pick("g1") == ("unspecified", "nudge_left", "constant_speed", "shift_left", 0.5, 1.0, 0.0, "consistent")
    assert pick("g2") == ("stop", "unspecified", "stopped", "straight", 1.0, 0.5, 0.0, "consistent")
    assert pick("g3") == ("slow_down", "hold_lane", "constant_speed", "straight", 0.1, 1.0, 0.45, "partial_mismatch")
    assert pick("g4") == ("accelerate", "lane_change_left", "accelerating", "lane_change_left", 1.0, 1.0, 0.0, "consistent")
    assert pick("g5") == ("maintain", "hold_lane", "constant_speed", "straight", 1.0, 1.0, 0.0, "consistent")
    assert pick("g6")[-2:] == (0.5, "unclassified_intent")
    assert got["g7"]["long_intent"] == "stop" and len(got["g7"]["cot_text"]) == 1000  # scored whole, then cut
    assert got["none"]["long_execution"] == "stopped" and got["none"]["ade_meters"] is None
    assert all(got[f"g{i}"]["ade_meters"] == 0.0 for i in range(1, 8))


def test_errors_stay_rows(spark):
    clips, text, way = inputs(spark)
    pred = way.where("not (clip_id = 'g1' and step = 5)").where("clip_id <> 'g2'")
    truth = way.where("not (clip_id = 'g3' and step = 63)").where("clip_id <> 'g4'")
    got = {r["clip_id"]: r for r in score.score_with_errors(clips, text, pred, truth).collect()}
    want = {"g1": "steps not contiguous", "g2": "missing prediction", "g3": "length mismatch", "g4": "missing ground truth", "none": "missing prediction", "g5": None, "g6": None, "g7": None}
    assert {c: r["error"] for c, r in got.items()} == want
    assert got["g1"]["mismatch_score"] is None and got["g1"]["t0_us"] == 5 and got["g5"]["mismatch_score"] == 0.0


def test_rescoring(spark):
    clips, text, way = inputs(spark)
    results = score.score_with_errors(clips, text, way, way)
    short = results.where("clip_id <> 'g7'")
    same = rescore.rescore(short, keep_old=True).collect()
    assert all(r[c] == r[f"old_{c}"] for r in same for c in rescore.OVERRIDDEN)  # null for the error row
    assert rescore.rescore(results).columns == results.columns
    pairs = rescore.rescore(results, STRICT, keep_old=True)
    changed = {r["clip_id"] for r in rescore.reclassified(pairs).collect()}
    assert changed == {"g7"}  # its stored text was cut before the word
    assert rescore.rescore_summary(pairs).collect() == [(8, 1)]
    shift = {r["mismatch_type"]: (r["n_old"], r["n_new"], r["delta"]) for r in rescore.type_shift(pairs).collect()}
    assert sum(v[2] for v in shift.values()) == 0 and sum(v[0] for v in shift.values()) == 7
    assert {r["axis"]: r["delta"] for r in rescore.unspecified_shift(pairs).collect()} == {"long": 1, "lat": 0}


def test_matrices_are_broadcast(spark):
    df = spark.range(10).select(*[F.col("id").cast("string").alias(f"{a}_{k}") for a in ("long", "lat") for k in ("intent", "execution")])
    plan = score.score(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") == 2 and "SortMergeJoin" not in plan and "Python" not in plan
    assert score.score(df).first()["mismatch_score"] == pytest.approx(0.5)


def test_repeated_steps_are_an_error(spark):
    from pyspark.sql import functions as F

    way = spark.createDataFrame([(c, s, float(s), 0.0, 0.0) for c in ("a", "b") for s in range(4)] + [("b", 2, 9.0, 9.0, 0.0)], "clip_id string, step int, x double, y double, z double")
    clips = spark.createDataFrame([("a",), ("b",)], "clip_id string")
    texts = clips.withColumn("cot_text", F.lit("Stop."))
    got = {r["clip_id"]: (r["error"], r["ade_meters"]) for r in score.score_with_errors(clips, texts, way, way.dropDuplicates(["clip_id", "step"])).collect()}
    assert got == {"a": (None, 0.0), "b": ("steps not contiguous", None)}
