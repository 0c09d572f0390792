import pytest
from pyspark.sql import functions as F

from concord.operators.score import score_packed, score_with_errors
from concord.plans.fixtures import Tables
from concord.sources.io import EVAL_CLIPS
from concord.sources.log import BatchLog
from concord.streaming import resume


def inputs(spark, sf_dir, n):
    t = Tables(spark, sf_dir)
    clips = t.clips().orderBy("ord").limit(n).select(EVAL_CLIPS.fieldNames()).cache()
    own = lambda df: df.join(clips.select("clip_id"), "clip_id", "left_semi").cache()
    return clips, own(t.reasoning()), own(t.predictions(errors=True)), own(t.ground_truth(errors=True))


@pytest.fixture(scope="module")
def fifty(spark, sf_dir):
    return inputs(spark, sf_dir, 50)


def test_batches_make_up_one_run(spark, fifty, tmp_path):
    clips, *tables = fifty
    parts = str(tmp_path / "parts")
    assert resume.run_until_done(spark, clips, *tables, parts, 20) == [20, 20, 10]
    assert resume.run_until_done(spark, clips, *tables, parts, 20) == []
    rows = BatchLog(spark, parts).read()
    assert sorted(map(tuple, rows.drop("batch").collect())) == sorted(map(tuple, score_with_errors(clips, *tables).collect()))
    assert [r["n"] for r in rows.groupBy("batch").count().orderBy("batch").withColumnRenamed("count", "n").collect()] == [20, 20, 10]
    assert resume.progress(clips, rows.limit(45), 4).collect() == [(50, 45, 5, 4, 1)]
    failed = rows.where("error is not null").count()
    assert failed and resume.run_until_done(spark, clips, *tables, parts, 1000, retry_errors=True) == [failed]
    log = BatchLog(spark, parts)
    assert log.read().count() == 50 + failed and log.newest().count() == 50
    assert BatchLog(spark, parts).last()["batch"] == 3


def test_late_clips_are_found(spark, fifty, tmp_path):
    clips, *tables = fifty
    out = str(tmp_path / "late")
    assert resume.run_until_done(spark, clips.where("ord % 3 <> 0"), *tables, out, 100) == [clips.where("ord % 3 <> 0").count()]
    assert resume.run_until_done(spark, clips, *tables, out, 100) == [clips.where("ord % 3 = 0").count()]
    assert BatchLog(spark, out).read().select("clip_id").distinct().count() == 50


def test_large_batches_are_the_first_in_order_and_not_in_one_task(spark, monkeypatch):
    monkeypatch.setattr(resume, "AT_ONCE", 10)
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # small partitions stay apart
    try:
        clips = spark.range(1000).selectExpr("concat('c', id) as clip_id", "if(id % 50 = 0, null, id * 7 % 40) as ord").cache()
        rows = sorted(((r["ord"] is not None, r["ord"] or 0, r["clip_id"]) for r in clips.collect()))
        for n in (11, 400, 640, 999, 1000, 5000):
            for got in (resume.next_after(clips, None, n), resume.next_batch(clips, clips.limit(0), n)):
                assert {r["clip_id"] for r in got.collect()} == {r[2] for r in rows[:n]} and got.count() == min(n, 1000) and got.columns == clips.columns
        sizes = resume.next_after(clips, None, 900).select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
        assert max(r["count"] for r in sizes) < 600
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


class Killed(Exception):
    pass


@pytest.mark.parametrize("point", ["before the rows", "half of the rows", "before the record", "after the record", "no rename"])
def test_killed_at_each_point(spark, fifty, tmp_path, monkeypatch, point):
    clips, *tables = fifty
    out, write, commit = str(tmp_path / "out"), BatchLog.write, BatchLog.commit

    def fail(*_, **__):
        raise Killed

    def write_and_fail(self, rows, batch):
        write(self, rows.where("t0_us % 2 = 0") if point.startswith("half") else rows, batch)
        fail()

    def commit_and_fail(self, batch, **facts):
        if point == "no rename":
            (tmp_path / "out" / "_log" / f".{batch:012d}.json.draft").write_text('{"ba')
        else:
            commit(self, batch, **facts)
        fail()

    assert resume.run_until_done(spark, clips, *tables, out, 20, most=1) == [20]
    with monkeypatch.context() as m:
        if point in ("after the record", "no rename"):
            m.setattr(BatchLog, "commit", commit_and_fail)
        else:
            m.setattr(BatchLog, "write", fail if point == "before the rows" else write_and_fail)
        with pytest.raises(Killed):
            resume.run_until_done(spark, clips, *tables, out, 20)
    seen = BatchLog(spark, out).read().count()
    assert seen == (40 if point == "after the record" else 20)
    assert sum(resume.run_until_done(spark, clips, *tables, out, 20)) == 50 - seen
    rows = BatchLog(spark, out).read().drop("batch")
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, score_with_errors(clips, *tables).collect()))


def test_a_batch_is_recorded_once(spark, tmp_path):
    log = BatchLog(spark, str(tmp_path / "log"))
    assert log.last() is None and log.read().count() == 0
    assert log.commit(0, ord=1) and not log.commit(0, ord=2)
    assert log.last() == {"batch": 0, "ord": 1} and log.records() == [0]


def test_stream_takes_each_clip_once(spark, sf_dir, tmp_path):
    clips, text, pred, truth = inputs(spark, sf_dir, 20)
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    for k, part in enumerate((clips.where("ord % 2 = 0"), clips.where("ord % 2 = 1"), clips.where("ord % 2 = 1"))):
        part.coalesce(1).write.mode("append").parquet(src)
        resume.stream(spark, src, text, pred, truth, out, ck).awaitTermination()
        ids = [r["clip_id"] for r in BatchLog(spark, out).read().collect()]
        assert len(ids) == len(set(ids)) == (20 if k else clips.where("ord % 2 = 0").count())


@pytest.mark.parametrize("remember", [None, "1000 days"])
def test_packed_stream_reads_only_what_arrives(spark, sf_dir, tmp_path, remember):
    rows = Tables(spark, sf_dir).arrivals().cache()
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    total, seen = 0, 0
    for k in range(4):
        part = rows.where(f"t0_us % 4000 in ({k * 1000}, {(k - 1) * 1000 % 4000})") if k < 3 else rows
        part.coalesce(1).write.mode("append").parquet(src)
        query = resume.stream_packed(spark, src, out, ck, files=1, remember=remember)
        query.awaitTermination()
        read = [p for p in query.recentProgress if p["numInputRows"]]
        assert [p["numInputRows"] for p in read] == [part.count()]  # its own file, however much is done
        total = spark.read.parquet(out).count()
        assert read[0]["stateOperators"][0]["numRowsTotal"] == total
        assert "RocksDB" in str(read[0]["stateOperators"][0]["customMetrics"]) or any("rocksdb" in m for m in read[0]["stateOperators"][0]["customMetrics"])
        assert total > seen or k == 3
        seen = total
    got = spark.read.parquet(out)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, map(tuple, score_packed(rows).collect())))
    assert {r["error"] for r in got.select("error").distinct().collect()} >= {None, "missing prediction", "length mismatch"}
