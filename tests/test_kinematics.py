import math

import numpy as np
import pytest

from concord.functions import kinematics
from concord.functions.rules import Thresholds

WAY = "clip_id string, step int, x double, y double, z double"


def slow(p, dt=0.1):
    if len(p) < 2:
        return [0.0] * 8
    d = np.hypot(*np.diff(p[:, :2], axis=0).T)
    v = d / dt
    a = float(np.mean(np.diff(v) / dt)) if len(v) > 1 else 0.0
    return [v[0], v[-1], v.mean(), v[-1] - v[0], a, p[-1, 1] - p[0, 1], np.abs(p[:, 1] - p[0, 1]).max(), d.sum()]


def classes(f):
    stopped, acc, lat = f[1], f[4], f[5]
    long = "stopped" if stopped < 0.5 else "accelerating" if acc > 0.3 else "decelerating" if acc < -0.3 else "constant_speed"
    side = "left" if lat > 0 else "right"
    return long, f"lane_change_{side}" if abs(lat) > 1.5 else f"shift_{side}" if abs(lat) > 0.2 else "straight"


def paths():
    rng = np.random.default_rng(0)
    out = {}
    for i in range(120):
        n = int(rng.choice([1, 2, 3, 10, 64]))
        out[f"c{i}"] = np.cumsum(rng.normal(scale=rng.choice([0.01, 0.3, 2]), size=(n, 3)), axis=0)
    t = np.linspace(0, 1, 64)
    zero = np.zeros(64)
    out |= {
        "g1": np.column_stack([30 * t, 0.5 * t, zero]), "g2": np.column_stack([2 * t, zero, zero]), "g3": np.column_stack([40 * t, zero, zero]),
        "g4": np.column_stack([np.cumsum(np.linspace(0.5, 2, 64)), 3 * t, zero]), "g5": np.column_stack([50 * t, zero, zero]),
    }
    return out


def frame(spark, p):
    return spark.createDataFrame([(c, i, *map(float, r)) for c, rows in p.items() for i, r in enumerate(rows)], WAY).repartition(3)


def test_features_and_packed_form_as_numpy(spark):
    p = paths()
    way = frame(spark, p)
    clips = spark.createDataFrame([(c,) for c in [*p, "none"]], "clip_id string")
    long = {r["clip_id"]: r for r in kinematics.classify_trajectories(way, clips).collect()}
    packed = {r["clip_id"]: r for r in kinematics.classify_features(kinematics.features_packed(kinematics.pack(way))).collect()}
    for c, rows in p.items():
        want = slow(rows)
        for got in (long[c], packed[c]):
            assert [got[f] for f in kinematics.FEATURES] == pytest.approx(want, abs=1e-8)
            assert (got["long_execution"], got["lat_execution"]) == classes(want)
    assert (long["none"]["n_steps"], long["none"]["long_execution"], long["none"]["lat_execution"]) == (0, "stopped", "straight")
    back = {(r["clip_id"], r["step"]): (r["x"], r["y"], r["z"]) for r in kinematics.unpack(kinematics.pack(way)).collect()}
    assert back == {(c, i): tuple(r) for c, rows in p.items() for i, r in enumerate(rows)}


def test_thresholds_are_strict_and_nan_is_none_of_them(spark):
    nan = float("nan")
    rows = [
        (0.5, 0.3, 0.2, "constant_speed", "straight"), (0.49, 5.0, -0.21, "stopped", "shift_right"), (0.5, 0.31, 1.5, "accelerating", "shift_left"),
        (9.0, -0.3, -1.51, "constant_speed", "lane_change_right"), (9.0, -0.31, 1.51, "decelerating", "lane_change_left"), (nan, nan, nan, "constant_speed", "straight"),
    ]
    df = spark.createDataFrame([(r[0], r[1], r[2]) for r in rows], "final_speed double, mean_acceleration double, total_lateral_shift double")
    got = [(r["long_execution"], r["lat_execution"]) for r in kinematics.classify_features(df, Thresholds()).collect()]
    assert got == [r[3:] for r in rows]


def test_shift_and_mirror(spark):
    p = {f"c{i}": np.cumsum(np.random.default_rng(i).normal(size=(20, 3)), axis=0) for i in range(20)}
    base = {r["clip_id"]: r for r in kinematics.classify_trajectories(frame(spark, p)).collect()}
    moved = {r["clip_id"]: r for r in kinematics.classify_trajectories(frame(spark, {c: v + 100 for c, v in p.items()})).collect()}
    mirror = {r["clip_id"]: r for r in kinematics.classify_trajectories(frame(spark, {c: v * [1, -1, 1] for c, v in p.items()})).collect()}
    swap = lambda s: s.replace("left", "#").replace("right", "left").replace("#", "right")
    for c in p:
        assert [moved[c][f] for f in kinematics.FEATURES] == pytest.approx([base[c][f] for f in kinematics.FEATURES], abs=1e-6)
        assert mirror[c]["lat_execution"] == swap(base[c]["lat_execution"])


def test_steps_and_error(spark):
    way = frame(spark, {"a": np.array([[0, 0, 0], [3, 4, 9], [3, 4, 0]], dtype=float)})
    got = kinematics.step_acceleration(way).orderBy("step").collect()
    assert [r["speed"] for r in got] == [None, 50.0, 0.0] and [r["acceleration"] for r in got] == [None, None, -500.0]
    truth = frame(spark, {"a": np.array([[0, 1, 0], [3, 4, 0]], dtype=float)})
    assert kinematics.displacement_error(way, truth).collect() == [("a", 0.5, 2)]


def test_curvature_takes_arcs_off(spark):
    u = np.linspace(0, 60, 64)
    lane = 3.5 * (0.5 - 0.5 * np.cos(np.pi * u / 60))
    p = {}
    for r in (30, 50, 200, -50):
        h = u / r
        p[f"arc{r}"] = np.column_stack([r * np.sin(h), r * (1 - np.cos(h)), 0 * u])
        p[f"lane{r}"] = np.column_stack([r * np.sin(h) - lane * np.sin(h), r * (1 - np.cos(h)) + lane * np.cos(h), 0 * u])
    p["straight"] = np.column_stack([u, 0 * u, 0 * u])
    p["two"] = np.array([[0, 0, 0], [1, 1, 0]], dtype=float)
    got = {r["clip_id"]: r["residual"] for r in kinematics.curvature(frame(spark, p)).collect()}
    for r in (30, 50, 200, -50):
        assert abs(got[f"arc{r}"]) < 0.002
    assert got["lane200"] == pytest.approx(3.27, abs=0.02)
    assert got["straight"] == 0.0 and got["two"] == 1.0 and math.isfinite(sum(got.values()))


def test_one_shuffle_for_features_and_join(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        way = frame(spark, {"a": np.zeros((3, 3))})
        clips = spark.createDataFrame([("a",)], "clip_id string").distinct()
        plan = kinematics.features(way).join(clips, "clip_id")._jdf.queryExecution().executedPlan().toString()
        of_way = [line for line in plan.splitlines() if "Exchange hashpartitioning(clip_id" in line]
        assert len(of_way) <= 2  # one for the waypoints, one for the clips
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
