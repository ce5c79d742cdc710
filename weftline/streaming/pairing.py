"""Starts and the ends that follow them, by job: a join of two streams within an interval, and the same over a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LIMIT = 2 * 86400
#: What a start comes to, by what follows it at once in its job: nothing within the limit, or another start, is a failure. Fixed values.
OUTCOMES = {"completed": "success", "error": "error"}


def _outcome(kind) -> F.Column:
    return F.coalesce(*[F.when(kind == k, v) for k, v in OUTCOMES.items()], F.lit("failed"))


def paired(events: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(job, start, end, outcome) for each start of a table of events (job, at, n, kind: start, completed, error or any other, which is passed over): what follows it first, if within `limit` seconds."""
    by = Window.partitionBy("job").orderBy("at", "n")
    told = events.where(F.col("kind").isin("start", *OUTCOMES)).withColumns({"then": F.lead("kind").over(by), "end": F.lead("n").over(by), "at_end": F.lead("at").over(by)})
    near = F.col("at_end") <= F.col("at") + F.make_dt_interval(secs=F.lit(limit))
    ends = near & F.col("then").isin(*OUTCOMES)
    return told.where("kind = 'start'").select("job", F.col("n").alias("start"), F.when(ends, F.col("end")).alias("end"), _outcome(F.when(ends, F.col("then"))).alias("outcome"))


def streamed(events: DataFrame, delay: str = "1 hour", limit: int = LIMIT) -> DataFrame:
    """paired() of a stream: each start comes out once, when the watermark has passed its limit.

    Every start is joined with what follows it in its job within the limit, an outer join of two streams that forgets what
    the interval leaves behind; the first of these decides. Held are the events of the last `limit` seconds.
    """
    # The watermark is that of all events, of whatever kind.
    timed = events.select("job", F.col("at").cast("timestamp").alias("at"), "n", "kind").withWatermark("at", delay)
    later = timed.where(F.col("kind").isin("start", *OUTCOMES))
    starts = timed.where("kind = 'start'").select(F.col("job").alias("of"), F.col("at").alias("began"), F.col("n").alias("start"))
    follows = (F.col("of") == F.col("job")) & (F.col("at") >= F.col("began")) & (F.col("at") <= F.col("began") + F.expr(f"interval {limit} seconds")) & ((F.col("at") > F.col("began")) | (F.col("n") > F.col("start")))
    first = F.min(F.struct("at", "n", "kind")).alias("first")
    found = starts.join(later, follows, "leftOuter").groupBy("of", "began", "start").agg(first)
    ends = F.col("first.kind").isin(*OUTCOMES)
    return found.select(F.col("of").alias("job"), "start", F.when(ends, F.col("first.n")).alias("end"), _outcome(F.when(ends, F.col("first.kind"))).alias("outcome"))
