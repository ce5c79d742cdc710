"""What runs, watched and stopped from outside: hooks of streaming queries, and jobs that can be cancelled."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from weftline.session import shared_dir

KINDS = "kinds"


def observed(events: DataFrame, kinds: list[str], kind: str = "event_type") -> DataFrame:
    """events, counted by kind as they pass: the counts come with the progress of the query, without a job of their own."""
    return events.observe(KINDS, F.count("*").alias("*"), *[F.count_if(F.col(kind) == k).alias(k) for k in kinds])


class Hooks(StreamingQueryListener):
    """Callbacks for the queries of a session: start, complete and error of each query once, and kinds of events with their count in a batch.

    on() adds one, once() one that hears a single time, off() takes one out, or all of a kind. "*" hears of all events of
    a batch. One that fails keeps no other from hearing. stats adds up queries, batches, rows, seconds, heard and failed.
    """

    def __init__(self):
        self._by: dict[str, list[tuple[Callable, bool]]] = {}
        self._lock = threading.Lock()
        self.stats = dict.fromkeys(("started", "completed", "errors", "batches", "rows", "heard", "failed"), 0) | {"seconds": 0.0}

    def on(self, kind: str, callback: Callable) -> Callable:
        with self._lock:
            self._by.setdefault(kind, []).append((callback, False))
        return callback

    def once(self, kind: str, callback: Callable) -> Callable:
        with self._lock:
            self._by.setdefault(kind, []).append((callback, True))
        return callback

    def off(self, kind: str, callback: Callable | None = None) -> None:
        with self._lock:
            self._by[kind] = [x for x in self._by.get(kind, []) if callback is not None and x[0] is not callback]

    def remove_all(self) -> None:
        with self._lock:
            self._by.clear()

    def count(self, kind: str | None = None) -> int:
        return sum(len(x) for k, x in self._by.items() if kind in (None, k))

    def _tell(self, kind: str, *said) -> None:
        with self._lock:
            own = list(self._by.get(kind, []))
            self._by[kind] = [x for x in own if not x[1]]
        for callback, _ in own:
            try:
                callback(*said)
                self.stats["heard"] += 1
            except Exception as e:  # noqa: BLE001  as said above
                self.stats["failed"] += 1
                print(f"a hook of {kind} failed: {e}")

    def onQueryStarted(self, event) -> None:
        self.stats["started"] += 1
        self._tell("start", event.name, str(event.id))

    def onQueryProgress(self, event) -> None:
        told = event.progress
        self.stats["batches"] += 1
        self.stats["rows"] += told.numInputRows
        self.stats["seconds"] += told.batchDuration / 1000
        if counts := told.observedMetrics.get(KINDS):
            for kind, n in counts.asDict().items():
                if n:
                    self._tell(kind, n)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        kind = "error" if event.exception else "complete"
        self.stats["errors" if event.exception else "completed"] += 1
        self._tell(kind, str(event.id), *([event.exception] if event.exception else []))


class Cancelled(InterruptedError):
    """Raised in a job that was cancelled. Fixed value: what it says."""

    def __init__(self):
        super().__init__("Clone operation was cancelled by user")


class Job:
    """Work that can be cancelled from another thread: Spark jobs carry its tag, streams are stopped, and its scratch goes in the end, whatever happened.

    run(work) calls work(job); in it, job.scratch() names folders below spark.checkpoint.dir, job.watch(query) waits for a
    stream, and job.check() raises where cancelling was asked for.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.tag = spark, f"weft-{uuid.uuid4().hex}"
        self._asked = threading.Event()
        self._queries: list[StreamingQuery] = []

    def scratch(self, name: str = "") -> str:
        return f"{shared_dir(self.spark)}/{self.tag}/{name}".rstrip("/")

    def check(self) -> None:
        if self._asked.is_set():
            raise Cancelled

    def watch(self, query: StreamingQuery) -> None:
        self._queries.append(query)
        if self._asked.is_set():
            query.stop()
        query.awaitTermination()
        self.check()

    def cancel(self) -> None:
        self._asked.set()
        for query in list(self._queries):
            query.stop()
        self.spark.sparkContext.cancelJobsWithTag(self.tag)

    def run(self, work: Callable[[Job], object]):
        # Tags of the context, as a session's own tags are known to the thread alone that set them.
        self.spark.sparkContext.addJobTag(self.tag)
        try:
            self.check()
            return work(self)
        except Exception:
            self.check()  # the error of an interrupted job is that it was cancelled
            raise
        finally:
            self.spark.sparkContext.removeJobTag(self.tag)
            self._clear()

    def _clear(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.scratch())
        path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
