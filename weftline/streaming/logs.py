"""The log of each job as server-sent frames: messages in order until the job has ended, heartbeats where nothing is said.

messages have (job, at, n, status, message): n breaks ties of at, status is null for a message and completed or error for
the end. A job's frames are its messages up to its end, a heartbeat for each `idle` seconds without one, and the status at
last; what comes after the end is dropped. Where nothing is said for `lapse` seconds, the log ends as lapsed. frames() reads
a table, streamed() a stream, with the same rows: the stream holds messages back until the watermark has passed them.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

IDLE, LAPSE = 6 * 3600, 5 * 86400
#: A stream with this state needs this setting.
PROVIDER = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
HEARTBEAT = ": heartbeat\n\n"
SCHEMA = "job long, at timestamp, n long, frame string"


def frames(messages: DataFrame, idle: int = IDLE, lapse: int = LAPSE) -> DataFrame:
    """(job, at, n, frame) of a table of messages; heartbeats and statuses without a message have no n. After the last message of a job that has not ended there is nothing."""
    by = Window.partitionBy("job").orderBy("at", "n")
    ms = lambda c: F.unix_millis(c)
    rows = messages.withColumn("at", F.date_trunc("millisecond", F.col("at").cast("timestamp"))).withColumn("before", ms(F.lag("at").over(by))).withColumn("lapsed", F.coalesce(ms(F.col("at")) - F.col("before") > lapse * 1000, F.lit(False)))
    ended = F.col("status").isNotNull() | F.col("lapsed")
    # Ends before a row: with none, the row still belongs to the log; a lapse ends it before the row itself.
    rows = rows.withColumn("ends", F.coalesce(F.count_if(ended).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).where("ends = 0")
    close = F.when(F.col("lapsed"), F.col("before") + lapse * 1000).otherwise(ms(F.col("at")))
    beats = F.when(F.col("before").isNotNull() & (close - F.col("before") > idle * 1000), F.transform(F.sequence(F.lit(1), ((close - F.col("before") - 1) / (idle * 1000)).cast("long")), lambda k: F.struct((F.col("before") + k * idle * 1000).alias("ms"), F.lit(None).cast("long").alias("n"), F.lit(HEARTBEAT).alias("frame"))))
    status = F.when(F.col("lapsed"), "lapsed").otherwise(F.col("status"))
    data = lambda x: F.concat(F.lit("data: "), F.to_json(x), F.lit("\n\n"))
    said = F.when(status.isNotNull(), data(F.struct(F.lit("status").alias("type"), status.alias("status")))).otherwise(data(F.struct(F.lit("log").alias("type"), F.coalesce("message", F.lit("")).alias("message"))))
    last = F.struct(close.alias("ms"), F.when(~F.col("lapsed"), F.col("n")).alias("n"), said.alias("frame"))
    every = F.concat(F.coalesce(beats, F.array().cast("array<struct<ms:bigint,n:bigint,frame:string>>")), F.array(last))
    return rows.select("job", F.explode(every).alias("x")).select("job", F.timestamp_millis("x.ms").alias("at"), "x.n", "x.frame")


def _data(**said: str) -> str:
    return f"data: {json.dumps(said, ensure_ascii=False, separators=(',', ':'))}\n\n"


class Drain(StatefulProcessor):
    """Per job: the messages that the watermark has not passed yet, when something was said last, the last heartbeat since, and whether the log has ended.

    A timer stands at the next thing to say. The mark of an ended job goes `lapse` seconds after
    its last message, and with it all state; what comes later still would begin a new log.
    """

    def __init__(self, idle: int, lapse: int):
        self.idle, self.lapse = idle * 1000, lapse * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, n long, status string, message string")
        self.last = handle.getValueState("last", "at long, beaten long, ended boolean")

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last, new = self._last(), []
        for frame in rows:
            at = frame["at"].astype("datetime64[ms]").astype("int64").tolist()
            new += zip(at, frame["n"].tolist(), *([None if pd.isna(x) else x for x in frame[c]] for c in ("status", "message")), strict=True)
        if new and last and last[2]:  # what comes after the end is dropped; the end is remembered while something comes
            said = max(last[0], max(r[0] for r in new))
            self.last.update((said, last[1], True))
            self.handle.registerTimer(said + self.lapse + 1)
        elif new:
            self.waiting.appendList(new)
            self.handle.registerTimer(min(r[0] for r in new) + 1)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, state = timerValues.getCurrentWatermarkInMs(), self._last()
        if state and state[2]:
            if now > state[0] + self.lapse:
                self.last.clear()
            return
        waiting = sorted((tuple(r) for r in self.waiting.get()), key=lambda r: r[:2]) if self.waiting.exists() else []
        last, beaten, ended = state or (None, None, False)
        out: list[tuple] = []

        def quiet(until: int) -> bool:
            """Says the heartbeats before `until`, at most up to the lapse; true if that comes before."""
            nonlocal last, beaten
            if last is None:
                return False
            end = last + self.lapse
            out.extend((at, None, HEARTBEAT) for at in range(beaten + self.idle, min(until, end), self.idle))
            beaten += max(0, (min(until, end) - 1 - beaten) // self.idle) * self.idle
            if until > end:
                out.append((end, None, _data(type="status", status="lapsed")))
                last = end
            return until > end

        for at, n, status, message in waiting:
            if at >= now or (ended := quiet(at)):
                break
            last = beaten = at
            out.append((at, n, _data(type="log", message=message or "") if status is None else _data(type="status", status=status)))
            if ended := status is not None:
                break
        ended = ended or quiet(now)
        rest = [] if ended else [r for r in waiting if r[0] >= now]
        if self.waiting.exists():
            self.waiting.clear()
        if rest:
            self.waiting.put(rest)
            self.handle.registerTimer(rest[0][0] + 1)
        if last is not None:
            self.last.update((last, beaten, ended))
            self.handle.registerTimer(last + self.lapse + 1 if ended else min(beaten + self.idle, last + self.lapse) + 1)
        if out:
            yield pd.DataFrame({"job": key[0], "at": pd.to_datetime([x[0] for x in out], unit="ms"), "n": pd.array([x[1] for x in out], dtype="Int64"), "frame": [x[2] for x in out]})

    def _last(self) -> tuple | None:
        return tuple(self.last.get()) if self.last.exists() else None


def streamed(messages: DataFrame, delay: str = "1 hour", idle: int = IDLE, lapse: int = LAPSE) -> DataFrame:
    """(job, at, n, frame) of a stream of messages, each frame once, when the watermark has passed it; messages later than `delay` are dropped. The session needs PROVIDER."""
    rows = messages.select(F.col("job").cast("long").alias("job"), F.col("at").cast("timestamp").alias("at"), F.col("n").cast("long").alias("n"), "status", "message").withWatermark("at", delay)
    return rows.groupBy("job").transformWithStateInPandas(Drain(idle, lapse), SCHEMA, "Append", "EventTime")
