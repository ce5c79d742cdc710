"""Conversations replayed turn by turn: faulty turns are held back and tried again, turns wait for the one they answer.

The first sort is by conversation and turn. What became of a turn depends on at most SPAN turns before it, so the iterator
that goes through a conversation keeps SPAN outcomes and nothing else. A conversation is cut where no later turn looks back
over the cut, which hashing makes frequent (one place in 26), so a long conversation is dealt out in runs; where no such
place comes, a run just gets longer. The second sort is by delivery, and adds up the released turns.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from decimal import Decimal
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import stored
from weftline.llm.ordered import boundaries, continued, earlier, in_order

#: A parent is up to SPAN turns back; turns arrive GAP seconds apart; the wait after a failure doubles from WAIT seconds.
SPAN, GAP, WAIT, TRIES = 4, 7, 20, 6


def draw(k: int, conv, turn) -> int:
    """A number of 32 bits for a turn."""
    return crc32(f"{k}:{'' if conv is None else conv}:{'' if turn is None else turn}".encode())


def distance(conv, turn) -> int:
    return draw(0, conv, turn) % (SPAN + 1)


def outcome(conv, turn, p: int, parent: tuple[str, int] | None) -> tuple[str, int, int | None, int | None]:
    """(status, attempts, first_at, last_at) of turn p; parent is (status, last_at) of the turn that it waits for."""
    if parent and parent[0] != "delivered":
        return "blocked", 0, None, None
    first = at = max(GAP * p, parent[1] if parent else 0)
    faulty, repaired = draw(1, conv, turn) % 101 < 50, GAP * p + draw(2, conv, turn) % 101
    for attempt in range(1, TRIES + 1):
        if not faulty or (at >= repaired and draw(attempt + 2, conv, turn) % 3):
            return "delivered", attempt, first, at
        if attempt < TRIES:
            at += WAIT * 2 ** (attempt - 1)
    return "dead", TRIES, first, at


def _numbered(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the place of a turn among those of its conversation in this partition, and the place of the last cut at or before it, if there is one here.

    A turn can be a cut if neither it nor one of the next SPAN - 1 looks back over it. Where the partition ends before
    these are seen it is taken for none, which only makes a run longer.
    """
    waiting: deque = deque()  # (row, distance), SPAN at most
    done: list[tuple] = []
    last, no, seg, started = object(), 0, None, False

    def settle(ends: bool) -> None:
        nonlocal seg
        row, _ = waiting[0]
        whole = ends or len(waiting) == SPAN
        if whole and all(d <= j for j, (_, d) in enumerate(waiting)):
            seg = row[3]
        done.append((*row, seg))
        waiting.popleft()

    for batch in rows:
        for conv, turn, crc, part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if conv != last or not started:
                while waiting:
                    settle(True)
                # What the partition begins with may have begun before; every other conversation begins here.
                last, no, seg, started = conv, 0, 0 if started else None, True
            waiting.append(((conv, turn, crc, no, part), distance(conv, turn)))
            no += 1
            if len(waiting) == SPAN:
                settle(False)
        if done:
            yield _made(done, batch.schema.field(0).type)
            done.clear()
    while waiting:
        settle(False)
    if done:
        yield _made(done, batch.schema.field(0).type)


def _made(rows: list[tuple], key: pa.DataType) -> pa.RecordBatch:
    conv, turn, crc, no, part, seg = zip(*rows, strict=True)
    kinds = {"conv": (conv, key), "turn": (turn, None), "crc": (crc, pa.int64()), "no": (no, pa.int64()), "part": (part, pa.int32()), "seg": (seg, pa.int64())}
    return pa.RecordBatch.from_arrays([pa.array(x, k) if k else pa.array(x, pa.int64()) for x, k in kinds.values()], list(kinds))


def _replayed(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The outcome of each turn; turns come by conversation and place, and a ring holds the last SPAN outcomes."""
    ring: list[tuple] = [(None, -1, "", None)] * SPAN
    for batch in rows:
        made = []
        for conv, turn, crc, p in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            back, parent = distance(conv, turn), None
            if 0 < back <= p:
                of, place, *parent = ring[(p - back) % SPAN]
                if (of, place) != (conv, p - back):
                    raise RuntimeError(f"turn {p} of {conv} came without the one {back} before it")
            status, attempts, first, at = outcome(conv, turn, p, parent)
            ring[p % SPAN] = (conv, p, status, at)
            made.append((conv, turn, p, crc, status, attempts, first, at))
        if made:
            kinds = (batch.schema.field(0).type, pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64())
            names = ["conv", "turn", "p", "crc", "status", "attempts", "first_at", "last_at"]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*made, strict=True), kinds, strict=True)], names)


def _released(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Running sums of each conversation in this partition: turns, their checksums, and checksums times places, modulo 2^64."""
    last, no, crcs, weighed = object(), 0, 0, 0
    for batch in rows:
        made = []
        for conv, crc in zip(batch.column("conv").to_pylist(), batch.column("crc").to_pylist(), strict=True):
            if conv != last:
                last, no, crcs, weighed = conv, 0, 0, 0
            no, crcs = no + 1, crcs + crc
            weighed = (weighed + no * crc) & 0xFFFFFFFFFFFFFFFF
            made.append((no, crcs, weighed))
        if made:
            no_, crcs_, weighed_ = zip(*made, strict=True)
            yield batch.append_column("no", pa.array(no_, pa.int64())).append_column("crcs", pa.array(crcs_, pa.int64())).append_column("weighed", pa.array(np.array(weighed_, dtype=np.uint64).view(np.int64)))


def replayed(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_col, turn_col, status, attempts, first_at, last_at, release_no, state) for each row.

    Turns are numbered by (turn, role, checksum of the text), nulls first: of repeated turns each is one of its own, and
    rows alike in all of that are interchangeable. A null conversation is one too; a null text is empty; null ids count as
    nothing in the hashes. turn is a whole number. An empty table gives no rows; other columns are not looked at. state is
    a sum modulo 2^64, as a signed number. Null are first_at and last_at of blocked turns, release_no and state of all that
    were not delivered.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    crc = F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))
    turns = rows.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).alias("role"), crc.alias("crc"))
    key = turns.schema["conv"].dataType.simpleString()
    ordered = in_order(turns, "conv", "turn", "role", "crc").select("conv", "turn", "crc", "part")
    seen = stored(ordered.mapInArrow(_numbered, f"conv {key}, turn long, crc long, no long, part int, seg long"), "turns")
    ends = boundaries(seen, "conv", "seg").withColumn("before", F.coalesce(F.sum(F.col("no") + 1).over(earlier("conv")), F.lit(0)))
    ends = ends.withColumn("cut", F.last(F.col("before") + F.col("seg"), ignorenulls=True).over(earlier("conv")))
    carried = stored(ends.where("kind = 0").select("part", "conv", "before", "cut"), "turn-ends")
    placed = continued(seen, carried, "conv").select(
        "conv", "turn", "crc", F.expr("no + coalesce(before, 0)").alias("p"), F.expr("coalesce(seg + coalesce(before, 0), cut, 0)").alias("run")
    )
    runs = placed.repartition(n, "conv", "run").sortWithinPartitions("conv", "p").drop("run")
    told = stored(runs.mapInArrow(_replayed, f"conv {key}, turn long, p long, crc long, status string, attempts int, first_at long, last_at long"), "outcomes")

    given = in_order(told.where("status = 'delivered'"), "conv", "last_at", "turn", "p")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in given.schema)
    given = stored(given.mapInArrow(_released, f"{kinds}, no long, crcs long, weighed long"), "releases")
    # Products of places and checksums pass 64 bits in very long conversations, so they are decimals until the end.
    whole = lambda c: F.col(c).cast("decimal(20,0)")
    ends = boundaries(given, "conv", "crcs", "weighed").withColumn("before", F.coalesce(F.sum("no").over(earlier("conv")), F.lit(0)))
    ends = ends.withColumn("gained", F.sum(_folded(whole("before") * whole("crcs") + whole("weighed")).cast("decimal(20,0)")).over(earlier("conv")))
    carried = stored(ends.where("kind = 0").select("part", "conv", "before", _folded(F.col("gained")).alias("gained")), "release-ends")
    state = _folded(F.coalesce(whole("gained"), F.lit(Decimal(0))) + F.coalesce(whole("before"), F.lit(Decimal(0))) * whole("crcs") + whole("weighed"))
    columns = ["conv", "turn", "status", "attempts", "first_at", "last_at"]
    released = continued(given, carried, "conv").select(*columns, F.expr("no + coalesce(before, 0)").alias("release_no"), state.alias("state"))
    none = F.lit(None).cast("long")
    found = released.unionByName(told.where("status <> 'delivered'").select(*columns, none.alias("release_no"), none.alias("state")))
    return found.withColumnsRenamed({"conv": conv_col, "turn": turn_col})


def _folded(whole):
    """A whole decimal modulo 2^64, as a signed long."""
    low = F.pmod(whole, F.lit(Decimal(2**64)))
    return F.when(low >= F.lit(Decimal(2**63)), low - F.lit(Decimal(2**64))).otherwise(low).cast("long")
