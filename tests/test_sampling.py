import hashlib

import pytest
from pyspark.sql import functions as F

from concord.operators import sampling
from concord.plans.fixtures import Tables
from concord.sources import io


@pytest.fixture(scope="module")
def t(spark, sf_dir):
    return Tables(spark, sf_dir)


def test_buckets_and_scenarios(spark):
    hours = spark.createDataFrame([(h,) for h in [None, -1, *range(26)]], "h int")
    got = {r["h"]: r["b"] for r in hours.select("h", sampling.hour_bucket(F.col("h")).alias("b")).collect()}
    assert [got[h] for h in (None, -1, 0, 6, 7, 10, 11, 14, 15, 18, 19, 23, 24)] == [None, None, "night", "night", "morning", "morning", "midday", "midday", "afternoon", "afternoon", "evening", "evening", None]
    night = {r["h"] for r in hours.where(sampling.in_scenario("night", F.col("h"))).collect()}
    assert night == {0, 1, 2, 3, 4, 5, 20, 21, 22, 23}
    assert hours.where(sampling.in_scenario("rain", F.col("h"))).count() == 28


def test_strata(t):
    clips = sampling.eligible(t.indexed())
    got = sampling.stratified_sample(clips, 100).groupBy("hour_bucket").count().collect()
    assert {r["count"] for r in got} == {20} and len(got) == 5
    assert sampling.stratified_sample(clips, 100).exceptAll(sampling.stratified_sample(clips.repartition(5), 100)).isEmpty()
    assert sampling.stratified_sample(clips, 100, seed=1).exceptAll(sampling.stratified_sample(clips, 100)).count() > 0
    with pytest.raises(ValueError, match="fewer than"):
        sampling.stratified_candidates(clips, 5000)
    assert sampling.stratified_candidates(clips, 2).groupBy("hour_bucket").count().select("count").distinct().collect() == [(1,)]
    assert sampling.quota_fill(sampling.stratified_candidates(clips, 50), t.egomotion(), 4).count() == 0
    drawn = sampling.quota_fill(sampling.stratified_candidates(clips, 50), t.egomotion(), 50)
    fine = {r["clip_id"] for r in sampling.safe_window(sampling.coverage(t.egomotion())).collect()}
    assert {r["clip_id"] for r in drawn.collect()} <= fine
    assert all(2_000_000 <= r["t0_us"] < 13_000_000 for r in drawn.collect())


def test_shapes_of_clip_tables(spark, t):
    with pytest.raises(ValueError, match="split"):
        sampling.clip_metadata(t.index(), t.metadata().withColumn("split", F.lit("x")))
    bare = spark.createDataFrame([("a",)], "clip_id string")
    assert sampling.normalize_clips(bare).collect() == [("a", 5_100_000, "unknown")]
    both = spark.createDataFrame([("a", 7, None, "s")], "clip_id string, t0_us long, hour_bucket string, scenario_type string")
    assert sampling.normalize_clips(both).first()["scenario_type"] is None  # by presence of the column, not of a value
    assert sampling.limit_clips(t.clips(), 0).count() == t.clips().count() and sampling.limit_clips(t.clips(), 3).count() == 3
    assert sampling.shuffled(bare).columns == ["clip_id", "ord"]
    many = sampling.scenario_sample(t.metadata(), ["night", "rain"], 40)
    assert many.groupBy("scenario").count().select("count").distinct().collect() == [(20,)]


def test_sources_and_sinks(spark, t, tmp_path):
    clips = t.clips()
    io.write_eval_set(clips, str(tmp_path / "set"))
    assert io.eval_set(spark, [str(tmp_path / "no"), str(tmp_path / "set")]).count() == clips.count()
    assert io.eval_set(spark, [str(tmp_path / "no")]).count() == 1
    assert io.read_results(spark, str(tmp_path / "none")).schema == io.RESULTS
    rows = spark.createDataFrame([("a", 1, "night", 'says "stop",\nthen goes', *["x"] * 4, 0.5, 0.5, 0.5, "t", 1.0, 2.0, 3.0, 4.0, None)], io.RESULTS)
    for csv in (True, False):
        path = str(tmp_path / f"r{csv}")
        io.append_results(rows, path, csv)
        io.append_results(rows, path, csv)
        assert io.read_results(spark, path, csv).collect() == rows.collect() * 2
    io.write_checkpoint(rows, str(tmp_path / "c"))
    io.write_checkpoint(rows, str(tmp_path / "c"))
    assert spark.read.parquet(str(tmp_path / "c")).count() == 1
    io.write_rescored(rows, ["error", "clip_id"], str(tmp_path / "o"))
    assert spark.read.parquet(str(tmp_path / "o")).columns == ["error", "clip_id"]
    io.write_summary(spark.createDataFrame([(1, None)], "a int, b double"), str(tmp_path / "s"))
    assert '"b":null' in next((tmp_path / "s").glob("part-*.json")).read_text()
    sel = sampling.scenario_sample(t.metadata(), ["night", "clear"], 6)
    m = io.manifest(sel, ["cam"]).first()
    assert m["sensors"] == ["cam"] and sorted((c["clip_id"], c["scenario"]) for c in m["clips"]) == sorted((r["clip_id"], r["scenario"]) for r in sel.collect())
    assert io.profile(rows)[0] == 1


@pytest.mark.parametrize("n", [1, 1001, 1500, 3000])
def test_first_by_hash_is_exact_and_bounded(spark, n):
    """Strata of very different sizes, clips twice, and fewer than n in some."""
    df = spark.range(40_000).selectExpr("concat('c', cast(id % 39000 as string)) clip_id", "case when id < 30000 then 'a' when id < 39990 then 'b' else 'c' end hour_bucket")
    rows = [(r["clip_id"], r["hour_bucket"]) for r in df.collect()]
    key = {c: hashlib.md5(f"7|{c}".encode()).hexdigest() for c, _ in rows}
    want = []
    for s in "abc":
        want += sorted((key[c], c, s) for c, b in rows if b == s)[:n]
    got = sampling._first(df, n, 7, "hour_bucket").collect()
    assert sorted((key[r["clip_id"]], r["clip_id"], r["hour_bucket"]) for r in got) == sorted(want)
    near = {r["hour_bucket"]: r["count"] for r in sampling.near_first(df, n, 7, "hour_bucket").groupBy("hour_bucket").count().collect()}
    assert near["c"] == min(10, near["c"]) and all(min(n, size) <= near[s] <= 1.3 * n + 30 for s, size in (("a", 30_000), ("b", 9_990)))
    one = sampling._first(df.drop("hour_bucket"), n, 7).collect()
    assert [r["clip_id"] for r in one] == [c for _, c in sorted((key[c], c) for c, _ in rows)[:n]]


def test_bins_are_added_up_before_the_shuffle(t):
    plan = sampling.stratified_candidates(sampling.eligible(t.indexed()), 20_000, 3, strict=False)._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in plan and "BroadcastHashJoin" in plan
