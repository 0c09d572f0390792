import pytest
from pyspark.sql import functions as F

from concord.operators import extended, report, rescore
from concord.operators.score import severity


def test_intervals_match_published_figures(spark):
    lit = lambda *v: [F.lit(float(x)) for x in v]
    one = spark.range(1)
    r = one.select(*report.interval(*lit(0.4991, 0.3463, 2000)), *report.interval(*lit(1.9391, 1.9047, 2000)), *report.proportion_interval(*lit(0.2655, 2000)), *report.proportion_interval(*lit(0.4165, 2000))).first()
    assert [round(v, 4) for v in r[:4]] == [0.4839, 0.5143, 1.8556, 2.0226]
    assert [round(100 * v, 2) for v in r[4:]] == [24.61, 28.49, 39.49, 43.81]


ROWS = "clip_id string, scenario_type string, long_intent string, lat_intent string, long_execution string, lat_execution string, long_match double, lat_match double, mismatch_score double, mismatch_type string, ade_meters double, mean_speed_ms double"


def rows(spark, n=40):
    out = []
    for i in range(n):
        s = [0.0, 0.45, 0.9, None][i % 4]
        out.append((f"c{i:03}", ["night", "morning", "x"][i % 3], "stop", "hold_lane", "stopped", "straight", 1.0, i % 2 / 2, s, "t" if s is not None else None, float(i), float(i)))
    return spark.createDataFrame(out, ROWS)


def test_reports(spark):
    df = rows(spark)
    assert report.run_summary(df).first()[:2] == (40, 30)
    assert report.run_summary(df.limit(0)).first() == (0, 0, None, None, None, None)
    assert report.valid(df.drop("mismatch_score")).count() == 0
    assert report.type_distribution(df.limit(0)).collect() == []
    bands = {r["band"]: r["n"] for r in report.severity_bands(df).collect()}
    assert bands == {"consistent": 10, "partial": 10, "severe": 10}
    assert {r["scenario_type"] for r in rescore.by_scenario(df).collect()} == {"night", "morning"}
    assert report.crosstab(df, "long").collect() == [("stop", "stopped", 30, 1)]
    assert report.axis_gap_ci(df).first()["mean"] == pytest.approx(sum(1 - i % 2 / 2 for i in range(40) if i % 4 != 3) / 30)
    got = [r["b"] for r in spark.createDataFrame([(0.2999,), (0.3,), (0.5999,), (0.6,)], "s double").select(severity(F.col("s")).alias("b")).collect()]
    assert got == ["consistent", "partial", "partial", "severe"]


def test_audit(spark):
    got = extended.audit_slice(rows(spark), 6).collect()
    assert len(got) == 6 and len({r["control_id"] for r in got if r["control_id"]}) == sum(r["control_id"] is not None for r in got)
    assert all(r["mismatch_score"] == 0.9 and (r["control_score"] is None or r["control_score"] < 0.6) for r in got)
