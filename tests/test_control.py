"""Logs, pairing, hooks and cancelling on streams: what a stream gives equals what the table gives, and state goes."""

import random
import threading
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from weftline.streaming import control, jobs, logs, pairing

T0 = datetime(2024, 1, 1)
MESSAGES = "job long, at timestamp, n long, status string, message string"


@pytest.fixture
def stateful(spark):
    before = {k: spark.conf.get(k, None) for k in logs.PROVIDER}
    for k, v in logs.PROVIDER.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def parts(spark, rows, schema, folder, sizes):
    """Writes rows in files of some sizes, one a second apart in their names and times, and returns the stream over them."""
    at = 0
    for i, n in enumerate(sizes):
        spark.createDataFrame(rows[at : at + n], schema).coalesce(1).write.mode("append").parquet(folder)
        at += n
        time.sleep(0.02)
    assert at == len(rows)
    return jobs.event_stream(spark, folder, spark.createDataFrame([], schema).schema)


def drain(stream, checkpoint):
    out = []
    query = stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(lambda b, i: out.extend(map(tuple, b.collect()))).trigger(availableNow=True).start()
    query.awaitTermination()
    return out, query


def plain_frames(rows, idle, lapse):
    """A job's log, message after message."""
    out, by = [], {}
    for r in sorted(rows, key=lambda r: (r[1], r[2])):
        by.setdefault(r[0], []).append(r)
    for job, own in by.items():
        last = None
        for _, at, n, status, message in own:
            if last is not None:
                beat = last + timedelta(seconds=idle)
                end = last + timedelta(seconds=lapse)
                while beat < min(at, end):
                    out.append((job, beat, None, ": heartbeat\n\n"))
                    beat += timedelta(seconds=idle)
                if at > end:
                    out.append((job, end, None, 'data: {"type":"status","status":"lapsed"}\n\n'))
                    break
            last = at
            out.append((job, at, n, f'data: {{"type":"status","status":"{status}"}}\n\n' if status else f'data: {{"type":"log","message":"{message or ""}"}}\n\n'))
            if status:
                break
    return out


def some_messages(n, jobs_, seed=1):
    own = random.Random(seed)
    at = T0
    rows = []
    for i in range(n):
        at += timedelta(milliseconds=own.choice([0, 700, 60_000, 7_200_000]))
        status = own.choice([None] * 14 + ["completed", "error"])
        rows.append((own.randrange(jobs_), at, i, status, None if status else own.choice([None, f"é{i}"])))
    return rows


def test_frames(spark):
    rows = some_messages(600, 20)
    found = logs.frames(spark.createDataFrame(rows, MESSAGES), 3_600, 20 * 3_600)
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, plain_frames(rows, 3_600, 20 * 3_600)))
    assert logs.frames(spark.createDataFrame([], MESSAGES)).collect() == []


def test_log_streams_equal_tables(stateful, tmp_path):
    """Messages in files, out of order within the delay, then one far ahead that lets the watermark pass the rest; all state goes."""
    spark, idle, lapse = stateful, 3_600, 72 * 3_600
    rows = sorted([*some_messages(240, 8, 2), *((50, T0 + timedelta(hours=h), 900 + h, None, "x") for h in (1, 97, 98))], key=lambda r: (r[1], r[2]))
    swapped = [r for i in range(0, len(rows), 3) for r in reversed(rows[i : i + 3])]
    ahead = [(99, rows[-1][1] + timedelta(days=40 + i), 10_000 + i, None, "ahead") for i in range(3)]
    stream = parts(spark, swapped + ahead, MESSAGES, str(tmp_path / "in"), [60, 60, 60, 63, 1, 1, 1])
    out, query = drain(logs.streamed(stream, "12 hours", idle, lapse), str(tmp_path / "c"))
    expected = plain_frames(rows, idle, lapse)
    # Jobs whose log is open after their last message go on to the lapse in the stream, as time does.
    finals = {j: max(t for x, t, *_ in expected if x == j) for j in {r[0] for r in rows}}
    told = [(j, t, None if n is None or n != n else int(n), f) for j, t, n, f in out if j != 99]
    assert sorted(map(repr, [x for x in told if x[1] <= finals[x[0]]])) == sorted(map(repr, expected))
    later = [x for x in told if x[1] > finals[x[0]]]
    ends = {j for j, t, n, f in expected if "status" in f}
    assert {x[0] for x in later} == finals.keys() - ends
    assert any("lapsed" in f for *_, f in expected) and all("lapsed" in f or "heartbeat" in f for *_, f in later) and sum("lapsed" in f for *_, f in later) == len(finals.keys() - ends)
    held = sum(s.numRowsTotal for s in query.lastProgress.stateOperators)
    assert held <= 4  # that of job 99


def plain_pairs(rows, limit):
    out, by = [], {}
    for r in sorted(rows, key=lambda r: (r[1], r[2])):
        if r[3] in ("start", "completed", "error"):
            by.setdefault(r[0], []).append(r)
    for job, own in by.items():
        for a, b in zip(own, [*own[1:], None], strict=True):
            if a[3] == "start":
                good = b and b[3] != "start" and b[1] <= a[1] + timedelta(seconds=limit)
                out.append((job, a[2], b[2] if good else None, {"completed": "success", "error": "error"}[b[3]] if good else "failed"))
    return sorted(out, key=repr)


def test_pairs(spark, tmp_path):
    own = random.Random(4)
    at, rows = T0, []
    for i in range(300):
        at += timedelta(minutes=own.choice([0, 1, 30, 300]))
        rows.append((own.randrange(6), at, i, own.choice(["start", "start", "completed", "error", "click"])))
    schema, limit = "job long, at timestamp, n long, kind string", 3_600 * 5
    expected = plain_pairs(rows, limit)
    assert sorted(map(tuple, pairing.paired(spark.createDataFrame(rows, schema), limit).collect()), key=repr) == expected
    ahead = [(99, at + timedelta(days=9 + i), 1_000 + i, "click") for i in range(2)] + [(99, at + timedelta(days=20 + i), 2_000 + i, "completed") for i in range(3)]
    stream = parts(spark, rows + ahead, schema, str(tmp_path / "in"), [100, 100, 100, 1, 1, 1, 1, 1])
    out, query = drain(pairing.streamed(stream, "1 hour", limit), str(tmp_path / "c"))
    assert sorted(out, key=repr) == expected
    assert {x[3] for x in out} == {"success", "error", "failed"}


def test_hooks(spark, tmp_path):
    rows = [(i, "view" if i % 3 else "error") for i in range(30)]
    stream = parts(spark, rows, "n long, event_type string", str(tmp_path / "in"), [10, 10, 10])
    hooks, heard = control.Hooks(), []
    for kind in ("start", "complete", "error", "view", "*"):
        hooks.on(kind, lambda *said, kind=kind: heard.append((kind, *said)))
    hooks.once("view", lambda n: heard.append(("once", n)))

    def bad(*_):
        raise ValueError("no")

    hooks.on("view", bad)
    gone = hooks.on("view", lambda n: heard.append(("gone", n)))
    hooks.off("view", gone)
    assert (hooks.count(), hooks.count("view")) == (7, 3)
    spark.streams.addListener(hooks)
    try:
        _, query = drain(control.observed(stream, ["view", "purchase"]), str(tmp_path / "c"))
        deadline = time.time() + 20
        while hooks.stats["completed"] < 1 and time.time() < deadline:
            time.sleep(0.1)
        assert hooks.stats["errors"] == 0 and [x[0] for x in heard].count("start") == [x[0] for x in heard].count("complete") == 1
        failing = control.observed(stream, ["view"]).select(F.raise_error(F.lit("broken")).cast("string").alias("x"))
        with pytest.raises(Exception, match="broken"):
            failing.writeStream.format("memory").queryName("failing").option("checkpointLocation", str(tmp_path / "f")).trigger(availableNow=True).start().awaitTermination()
        while hooks.stats["errors"] < 1 and time.time() < deadline:
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(hooks)
    of = lambda kind: [x[1:] for x in heard if x[0] == kind]
    assert sum(n for (n,) in of("view")) == 20 and sum(n for (n,) in of("*")) == 30 and len(of("once")) == 1 and of("gone") == []
    assert len(of("start")) == 2 and len(of("complete")) == 1 and len(of("error")) == 1 and "broken" in of("error")[0][1]
    assert hooks.stats["rows"] == 30 and hooks.stats["started"] == 2 and hooks.stats["failed"] == len(of("view"))
    hooks.remove_all()
    assert hooks.count() == 0


def test_cancelled(spark, tmp_path):
    """A running query ends within seconds and its scratch goes; so does a stream; a job that was cancelled before does not begin."""
    import os

    def slow(job):
        spark.range(4).write.parquet(job.scratch("first"))
        assert os.path.exists(job.scratch("first").removeprefix("file://").removeprefix("file:"))
        spark.range(0, 4, 1, 4).select(F.expr("reflect('java.lang.Thread', 'sleep', 120000L)")).collect()

    def streaming(job):
        rate = spark.readStream.format("rate").load()
        job.watch(rate.writeStream.format("noop").option("checkpointLocation", job.scratch("c")).start())

    for work in (slow, streaming):
        job = control.Job(spark)
        threading.Timer(4, job.cancel).start()
        began = time.time()
        with pytest.raises(InterruptedError, match="Clone operation was cancelled by user"):
            job.run(work)
        assert time.time() - began < 40
        assert not os.path.exists(job.scratch().removeprefix("file://").removeprefix("file:"))
    early = control.Job(spark)
    early.cancel()
    with pytest.raises(control.Cancelled):
        early.run(lambda job: pytest.fail("it began"))
    assert control.Job(spark).run(lambda job: spark.range(5).count()) == 5
    with pytest.raises(ZeroDivisionError):
        control.Job(spark).run(lambda job: 1 / 0)


def test_sinks_take_each_batch_once(spark, tmp_path):
    """Jobs, metrics and messages of a stream equal those of the table, though a batch is run again and a first try of another broke off."""
    from weftline.streaming import sinks

    own = random.Random(8)
    kinds = [k for some in sinks.EVENTS.values() for k in some]
    assert len(kinds) == 18 and set(sinks.STATUS) <= set(kinds)
    rows = [(own.randrange(9), T0 + timedelta(seconds=own.randrange(50)), i, own.choice(kinds)) for i in range(200)]
    schema = "job long, at timestamp, n long, kind string"
    stream = parts(spark, rows, schema, str(tmp_path / "in"), [50, 70, 80])
    sink, tries = sinks.integrations(str(tmp_path / "out")), []

    def shaky(batch, number):
        tries.append(number)
        sink(batch, number)
        if tries.count(1) == 1 and number == 1:
            raise RuntimeError("after writing, before the commit")

    start = lambda: stream.writeStream.option("checkpointLocation", str(tmp_path / "c")).foreachBatch(shaky).trigger(availableNow=True).start()
    with pytest.raises(Exception, match="after writing"):
        start().awaitTermination()
    start().awaitTermination()
    assert tries == [0, 1, 1, 2]
    table = spark.createDataFrame(rows, schema)
    for name, made in (("jobs", sinks.jobs), ("metrics", sinks.metrics), ("webhooks", sinks.webhooks)):
        assert sorted(map(tuple, sinks.left(spark, str(tmp_path / "out"), name).collect())) == sorted(map(tuple, made(table).collect())), name
    last = {}
    for job, at, n, kind in sorted(rows, key=lambda r: r[1:3]):
        last[job] = sinks.STATUS.get(kind, last.get(job))
    assert {r.job: r.status for r in sinks.left(spark, str(tmp_path / "out"), "jobs").collect()} == {k: v for k, v in last.items() if v}
