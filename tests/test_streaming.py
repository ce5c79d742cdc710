"""Streams over all files give what the batch queries give."""

from weftline.streaming import jobs

SF = "/root/testdata/sf0.001"


def test_streams_equal_batches(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    for name, f in (("counts", jobs.event_counts), ("states", jobs.job_states)):
        last = {}
        jobs.drained(f(jobs.event_stream(spark, str(tmp_path / "in"), events.schema)), str(tmp_path / name), lambda b, i: last.update({r[0]: r[1] for r in b.collect()}))
        assert last == {r[0]: r[1] for r in f(events).collect()}


def test_extension_windows(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    seen = []
    jobs.drained(jobs.counts_by_window(jobs.event_stream(spark, str(tmp_path / "in"), events.schema)), str(tmp_path / "c"), lambda b, i: seen.append(b.count()))
    assert sum(seen) > 0


def test_first_events_are_heard_once(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    seen = []
    stream = jobs.first_events(jobs.event_stream(spark, str(tmp_path / "in"), events.schema), "60 days")
    jobs.drained(stream, str(tmp_path / "c"), lambda b, i: seen.extend((r.user_id, r.event_type) for r in b.collect()), "append")
    assert sorted(seen) == sorted({(r.user_id, r.event_type) for r in events.collect()})


def test_progress_and_levels(spark):
    rows = [("x", "start", 1), ("x", "html_read", 5), ("x", "unknown", 9), ("y", "complete", 2), ("z", "unknown", 1), ("y", "assets_done", 1)]
    found = jobs.progress(spark.createDataFrame(rows, "job string, stage string, at int")).collect()
    assert {r.job: r.percentage for r in found} == {"x": 30, "y": 100, "z": 0}
    logs = spark.createDataFrame([(x,) for x in ("debug", "info", "Success", "ERROR", "odd", None)], "level string")
    assert [r.level for r in jobs.at_least(logs).collect()] == ["info", "Success", "ERROR"]
    assert [r.level for r in jobs.at_least(logs, "ERROR").collect()] == ["ERROR"]
