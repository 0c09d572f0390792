"""One query for each operator of the study, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.functions import kinematics, sql, text
from concord.functions.rules import CURRENT, LAT_COMPAT, LONG_COMPAT, STRICT, Thresholds, fingerprint
from concord.operators import dictionary, extended, report, rescore, sampling, score
from concord.plans.fixtures import SEED, Tables
from concord.sources import io
from concord.sources.log import BatchLog
from concord.sources.store import Store
from concord.streaming import resume

_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
#: Draws of the sampling queries.
SAMPLE = 400
SCENARIOS = ["night", "clear", "rain"]
#: What scores depend on besides their tables and rule set.
SCORING = (LONG_COMPAT, LAT_COMPAT, Thresholds(), score.BANDS, kinematics.DT, score.STORED_TEXT)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to 6 places, without negative zeros: sums differ in their last bits between engines."""
    return df.select([(F.round(c, digits) + F.lit(0.0)).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


def query(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
    _queries[f.__name__] = lambda spark, sf_dir: rounded(f(Tables(spark, sf_dir)))
    return f


def _inputs(t: Tables) -> list[DataFrame]:
    return [t.clips(), t.reasoning(), t.predictions(), t.ground_truth()]


def scored(t: Tables) -> DataFrame:
    """Stored scores, as every report reads them: made once for the same tables and rules."""
    return Store(t.spark).get("scores", _inputs(t), fingerprint(CURRENT, SCORING), lambda: _scores(t))


def _scores(t: Tables) -> DataFrame:
    return score.score_clips(*_inputs(t))


def pairs(t: Tables) -> DataFrame:
    """Strict scores and what the current rules make of them."""
    store, inputs = Store(t.spark), _inputs(t)
    old = store.get("strict", inputs, fingerprint(STRICT, SCORING), lambda: score.score_clips(*inputs, STRICT))
    return store.get("rescored", inputs, fingerprint(STRICT, CURRENT, SCORING), lambda: rescore.rescore(old, keep_old=True))


# Sampling
@query
def clip_metadata_join(t):
    return t.indexed()


@query
def eligible_clips(t):
    return sampling.eligible(t.indexed())


@query
def hour_bucket(t):
    return t.metadata().select("clip_id", "hour_of_day", sampling.hour_bucket(F.col("hour_of_day")).alias("hour_bucket"))


@query
def draw_t0(t):
    return t.index().select("clip_id", sampling.draw_t0(SEED).alias("t0_us"))


@query
def egomotion_coverage(t):
    return sampling.coverage(t.egomotion())


@query
def safe_window(t):
    return sampling.safe_window(sampling.coverage(t.egomotion()))


@query
def scenario_filter(t):
    return t.metadata().select("clip_id", "hour_of_day", *[sampling.in_scenario(s, F.col("hour_of_day")).alias(f"is_{s}") for s in SCENARIOS])


@query
def stratified_sample(t):
    return sampling.stratified_sample(sampling.eligible(t.indexed()), SAMPLE, SEED)


@query
def stratified_candidates(t):
    rows = sampling.stratified_candidates(sampling.eligible(t.indexed()), SAMPLE, 3, SEED, strict=False)
    return rows.select("clip_id", "hour_bucket", "hour_of_day")


@query
def quota_fill(t):
    drawn = sampling.stratified_candidates(sampling.eligible(t.indexed()), SAMPLE, 3, SEED, strict=False)
    return sampling.quota_fill(drawn, t.egomotion(), SAMPLE, SEED)


def _drawn(t: Tables, n: int) -> DataFrame:
    drawn = sampling.stratified_candidates(sampling.eligible(t.indexed()), n, 3, SEED, strict=False)
    return sampling.quota_fill(drawn, t.egomotion(), n, SEED)


@query
def quota_fill_2000(t):
    """The default size: candidates of 1200 a bucket."""
    return _drawn(t, 2000)


@query
def quota_fill_20000(t):
    return _drawn(t, 20_000)


@query
def simple_sample_2000(t):
    return sampling.simple_sample(sampling.eligible(t.indexed()).drop("hour_of_day"), 2000, SEED)


@query
def simple_sample(t):
    return sampling.simple_sample(sampling.eligible(t.indexed()).drop("hour_of_day"), SAMPLE, SEED)


@query
def scenario_sample(t):
    return sampling.scenario_sample(t.metadata(), SCENARIOS, 300)


@query
def clip_manifest(t):
    """The manifest's one row, read again as rows."""
    made = io.manifest(sampling.scenario_sample(t.metadata(), SCENARIOS, 300), ["camera_front_wide", "egomotion"])
    return made.select(F.explode("clips").alias("c"), F.array_join("sensors", ",").alias("sensors")).select("c.clip_id", "c.scenario", "sensors")


@query
def overdrawn_candidates(t):
    """One of each bucket is more than was asked for: drawn again."""
    return sampling.stratified_candidates(sampling.eligible(t.indexed()), 1, 3, SEED, strict=False).select("clip_id", "hour_bucket", "hour_of_day")


@query
def shuffled_order(t):
    return sampling.shuffled(t.clips(), SEED).select("clip_id", "ord")


@query
def stored_eval_set(t):
    """Written, and read as the first of several paths that there is."""
    path = io.new_path(t.spark, "eval_set")
    io.write_eval_set(t.clips(), path)
    return io.eval_set(t.spark, [f"{path}-none", path])


@query
def normalize_clips(t):
    return sampling.normalize_clips(t.clips().select("clip_id", "t0_us", "hour_bucket")).select("clip_id", "t0_us", "scenario_type")


@query
def limit_clips(t):
    return sampling.limit_clips(t.clips(), 250)


@query
def eval_set_profile(t):
    return sampling.eval_set_profile(t.clips())


@query
def path_inventory(t):
    return io.path_inventory(t.paths())


# Texts
@query
def long_counts(t):
    return text.class_counts(t.reasoning(), axes=("longitudinal",)).drop("cot_text")


@query
def lat_counts(t):
    return text.class_counts(t.reasoning(), axes=("lateral",)).drop("cot_text")


@query
def text_intent(t):
    return text.classify_text(t.reasoning().repartition("clip_id")).drop("cot_text")


# Paths
@query
def step_speed(t):
    return kinematics.step_speed(t.event_paths()).select("clip_id", "step", "distance", "speed")


@query
def step_accel(t):
    return kinematics.step_acceleration(t.event_paths()).select("clip_id", "step", "acceleration")


@query
def trajectory_features(t):
    return kinematics.features(t.predictions(errors=True), t.index())


@query
def exec_class(t):
    return kinematics.classify_trajectories(t.predictions()).select("clip_id", "long_execution", "lat_execution")


@query
def exec_class_packed(t):
    return kinematics.classify_features(kinematics.features_packed(t.packed_paths())).drop("n_steps")


@query
def pack_trajectory(t):
    """Packed, and read again as waypoints in the order of their steps."""
    return kinematics.unpack(kinematics.pack(t.event_paths()))


@query
def unpack_trajectory(t):
    return kinematics.unpack(t.packed_paths())


@query
def ade(t):
    return kinematics.displacement_error(t.predictions(errors=True), t.ground_truth(errors=True))


@query
def curvature_lateral(t):
    return extended.curvature_lateral(t.arcs()).select("clip_id", F.round("residual", 3).alias("residual"), "raw_class", "curve_class")


# Scores
def _classes(t: Tables) -> DataFrame:
    return text.classify_text(t.reasoning()).join(kinematics.classify_trajectories(t.predictions()), "clip_id")


@query
def long_compat(t):
    return score.compatibility(_classes(t), ("long",)).select("clip_id", "long_intent", "long_execution", "long_compat")


@query
def lat_compat(t):
    return score.compatibility(_classes(t), ("lat",)).select("clip_id", "lat_intent", "lat_execution", "lat_compat")


@query
def score_clips(t):
    return _scores(t)


@query
def score_with_errors(t):
    return score.score_with_errors(t.clips(), t.reasoning(), t.predictions(errors=True), t.ground_truth(errors=True))


# Reports
for _f in (report.run_summary, report.type_distribution, report.class_histograms, report.by_scenario, report.mean_ci, report.severity_bands, report.axis_gap_ci, report.severe_by_bucket, report.mismatch_ade_corr, report.ade_by_band, extended.ade_stratified, rescore.classifiable_means):
    _queries[_f.__name__] = lambda spark, sf_dir, f=_f: rounded(f(scored(Tables(spark, sf_dir))))


@query
def rescore_by_scenario(t):
    return rescore.by_scenario(scored(t)).drop("place")


@query
def crosstab_long(t):
    return report.crosstab(scored(t), "long")


@query
def crosstab_lat(t):
    return report.crosstab(scored(t), "lat")


@query
def curvature_effect(t):
    return extended.curvature_effect(scored(t), t.arcs())


@query
def parser_ablation(t):
    return extended.parser_ablation(scored(t))


@query
def audit_slice(t):
    return extended.audit_slice(scored(t))


def _deliveries(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Texts by clip, many of them the same, delivered in two parts."""
    texts = t.reasoning().join(t.orders().select("clip_id", "ok", "ck"), "clip_id")
    texts = texts.select("clip_id", "ok", F.concat("cot_text", F.lit(" #"), (F.col("ck") % 97).cast("string")).alias("cot_text"))
    return texts.where("ok % 3 = 0").drop("ok"), texts.where("ok % 3 <> 0").drop("ok")


@query
def text_dictionary(t):
    """How many texts of each delivery there are, how many different ones, and how many of those had to be classified."""
    known, reports = dictionary.TextDictionary(t.spark, io.new_path(t.spark, "dictionary")), []
    for k, texts in enumerate(_deliveries(t)):
        known.learn(texts)
        reports.append(known.report(texts).select(F.lit(k).alias("delivery"), "*"))
    return reports[0].unionByName(reports[1])


@query
def dictionary_intents(t):
    """The second delivery's intents, looked up."""
    known = dictionary.TextDictionary(t.spark, io.new_path(t.spark, "dictionary"))
    first, second = _deliveries(t)
    known.learn(first)
    return known.classify(second).drop("cot_text")


@query
def rescore_known(t):
    """Strict scores rescored through a dictionary of the current rules."""
    store, inputs = Store(t.spark), _inputs(t)
    old = store.get("strict", inputs, fingerprint(STRICT, SCORING), lambda: score.score_clips(*inputs, STRICT))
    return rescore.rescore(old, known=dictionary.TextDictionary(t.spark, io.new_path(t.spark, "dictionary"))).select(*io.RESULTS.fieldNames())


def _bucketed(t: Tables) -> DataFrame:
    """Predictions and truth as bucketed tables, and what is read off them together."""
    tables = []
    for name, way in (("prediction", t.predictions(errors=True)), ("truth", t.ground_truth(errors=True))):
        path = io.new_path(t.spark, f"bucketed_{name}")
        table = path.rpartition("/")[2].replace("-", "_")
        io.write_bucketed(way, table, path, t.parts)
        tables.append(t.spark.table(table))
    return kinematics.paths_together(*tables)


@query
def ade_bucketed(t):
    return _bucketed(t).where("n_joined > 0").select("clip_id", "ade_meters", "n_joined")


@query
def features_bucketed(t):
    return _bucketed(t).drop("ade_meters", "n_joined")


@query
def results_quarantine(t):
    """Results written as CSV, with lines that are broken in three ways among them; what is taken and what is turned away, and why."""
    path, rejects, rows = io.new_path(t.spark, "results_csv"), io.new_path(t.spark, "rejects"), scored(t)
    io.append_results(rows, path, csv=True)
    some = rows.withColumn("ord", F.substring("clip_id", 2, 20).cast("long")).where("ord % 5 = 0")
    io.append_results(some.where("ord % 2 = 0").withColumn("mismatch_score", F.lit(1.5)), path, csv=True)
    io.append_results(some.where("ord % 3 = 0").withColumn("clip_id", F.lit(None)), path, csv=True)
    some.select("clip_id", F.lit("not a number").alias("t0_us"), F.lit("x").alias("scenario_type")).write.option("header", True).csv(f"{path}/more")
    good, rejected = io.checked_results(t.spark, path)
    more_good, more_rejected = io.checked_results(t.spark, f"{path}/more")
    io.quarantine(rejected.unionByName(more_rejected), rejects)
    counts = t.spark.read.parquet(rejects).groupBy("reason").agg(F.count("*").alias("n"))
    taken = good.unionByName(more_good).groupBy(F.lit("taken").alias("reason")).agg(F.count("*").alias("n"))
    return counts.unionByName(taken)


@query
def results_csv(t):
    """Results written as CSV and read again."""
    path = io.new_path(t.spark, "results_csv")
    io.append_results(scored(t), path, csv=True)
    return io.read_results(t.spark, path, csv=True)


@query
def rescored_file(t):
    """Rescored rows written in the column order of their input, and read again."""
    rows, path = pairs(t).select(*io.RESULTS.fieldNames()), io.new_path(t.spark, "rescored")
    io.write_rescored(rows, io.RESULTS.fieldNames(), path)
    return io.read_results(t.spark, path)


@query
def rescore_csv(t):
    """Results read from CSV for rescoring: strict scores, from their file, under the current rules."""
    store, inputs, path = Store(t.spark), _inputs(t), io.new_path(t.spark, "strict_csv")
    io.append_results(store.get("strict", inputs, fingerprint(STRICT, SCORING), lambda: score.score_clips(*inputs, STRICT)), path, csv=True)
    return rescore.rescore(io.read_results(t.spark, path, csv=True)).select(*io.RESULTS.fieldNames())


@query
def summary_json(t):
    """The run's summary as a line of JSON with its time, and read again."""
    path, schema = io.new_path(t.spark, "summary"), "timestamp string, total_clips long, valid long, mean_mismatch double, mean_ade double, mean_long_match double, mean_lat_match double"
    io.write_summary(report.run_summary(scored(t), "2026-01-03T00:00:00"), path)
    return t.spark.read.schema(schema).json(path)


@query
def checkpoint_rows(t):
    """The rows so far, written over those of the same run."""
    path = io.new_path(t.spark, "checkpoint")
    io.write_checkpoint(scored(t).where("t0_us % 2 = 0"), path, "a")
    io.write_checkpoint(scored(t), path, "a")
    return io.read_results(t.spark, f"{path}/run=a")


@query
def source_profile(t):
    """Rows and columns of the source tables."""
    tables = {"index": t.index(), "metadata": t.metadata(), "egomotion": t.egomotion()}
    rows = [(name, *io.profile(df)) for name, df in tables.items()]
    return t.spark.createDataFrame([(name, n, ",".join(columns)) for name, n, columns in rows], "source string, n long, columns string")


@query
def latest_run(t):
    """Two runs, of which the first is written again without becoming the latest; the summary of the latest with its time."""
    path, rows = io.new_path(t.spark, "runs"), scored(t)
    io.write_run(rows.where("t0_us % 2 = 0"), path, "a", "2026-01-01T00:00:00")
    io.write_run(rows.where("t0_us % 3 = 0"), path, "b", "2026-01-02T00:00:00")
    io.write_run(rows, path, "b", "2026-01-03T00:00:00")
    found, which = io.latest_run(t.spark, path)
    return report.run_summary(found, which["timestamp"])


@query
def sql_scores(t):
    """The surface of SQL functions: intents, executions, error and score of packed paths and their texts."""
    sql.register(t.spark)
    t.arrivals().createOrReplaceTempView("_arrivals")
    return t.spark.sql("""
        select clip_id, long_intent_of(n) as long_intent, lat_intent_of(n) as lat_intent, confidence_of(n) as confidence, long_e as long_execution, lat_e as lat_execution, ade_meters,
          mismatch_score(long_intent_of(n), long_e, lat_intent_of(n), lat_e) as mismatch_score,
          mismatch_type(mismatch_score(long_intent_of(n), long_e, lat_intent_of(n), lat_e), long_intent_of(n), lat_intent_of(n)) as mismatch_type
        from (select clip_id, intent_counts(cot_text) as n, long_execution(traj) as long_e, lat_execution(traj) as lat_e, displacement(traj, truth) as ade_meters from _arrivals where traj is not null)""")


# Resuming and rescoring
@query
def resume_batch(t):
    return resume.next_batch(t.clips(), t.done(), 400)


@query
def batch_progress(t):
    return resume.progress(t.clips(), t.done(), 400)


@query
def run_until_done(t):
    """All clips in batches of a quarter, one of which is killed before its record: the log's rows are those of one run."""
    out, clips = io.new_path(t.spark, "batches"), io.stored(t.clips(), "clips")
    n = -(-clips.count() // 4) or 1
    inputs = (t.reasoning(), t.predictions(errors=True), t.ground_truth(errors=True))
    resume.run_until_done(t.spark, clips, *inputs, out, n, most=1)
    BatchLog(t.spark, out).write(score.score_with_errors(clips.where("ord % 7 = 0"), *inputs), 1)
    resume.run_until_done(t.spark, clips, *inputs, out, n)
    return BatchLog(t.spark, out).newest()


@query
def stream_scores(t):
    """Clips that arrive in files, a part of them twice, scored as a stream."""
    source, out, state = (io.new_path(t.spark, x) for x in ("arrivals", "streamed", "state"))
    rows = io.stored(t.arrivals(), "arrivals_once")
    rows.repartition(5, "clip_id").write.parquet(source)
    rows.where("t0_us % 3000 = 0").repartition(2, "clip_id").write.mode("append").parquet(source)
    resume.stream_packed(t.spark, source, out, state, files=2).awaitTermination()
    return t.spark.read.schema(io.RESULTS).parquet(out)


_queries["rescore"] = lambda spark, sf_dir: rounded(pairs(Tables(spark, sf_dir)).select(*io.RESULTS.fieldNames()))
for _f in (rescore.reclassified, rescore.reclassified_preview, rescore.rescore_summary, rescore.type_shift, rescore.unspecified_shift):
    _queries[_f.__name__] = lambda spark, sf_dir, f=_f: rounded(f(pairs(Tables(spark, sf_dir))))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(sorted(_queries.items()))
