"""Exact top-k inner products by blocks in the order of their bounds.

Rows are dealt into ranges of ids and each range into blocks. A block keeps the highest and lowest value of each
dimension (its terms) and its vectors as a matrix (its forward index). For a query, the sum over the dimensions of the
larger of query value times highest and lowest bounds every score in a block; a query's blocks are scored from the
highest bound on, until the bound falls below its k-th score so far. All queries take that step together: those whose
next block is the same are scored against it in one product.

The queries go out in lots of a fixed size, as a broadcast, so no vector is shuffled to meet another and a lot costs one
reading of the vectors. A lot first meets the queries themselves, which are rows as well; the k-th score found there
goes along to all other ranges, where blocks below it are not scored and only rows that can still count come out; how many
blocks that spares hangs on the vectors (of evenly spread ones, none). Scores are exact: floats are used only where all sums stay below 2^53, and Python's integers beyond 2^62.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import stored

#: Vectors in a range and in a block; bytes of the queries that go out together.
RANGE, BLOCK, LOT = 16_384, 256, 1 << 25


def whole(values: pa.ListArray, width: int) -> np.ndarray:
    """floor(256 x) of each component, zeros up to the width."""
    sizes = values.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(values), width))
    out[np.arange(width) < sizes[:, None]] = values.flatten().to_numpy(zero_copy_only=False)
    out = np.floor(256 * out)
    return out if not out.size or np.abs(out).max() < 2**60 else np.array([[int(x) for x in row] for row in out], dtype=object)


def _safe(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both in a type in which their inner products are exact."""
    most = max(int(abs(a).max()) if a.size else 0, 1) * max(int(abs(b).max()) if b.size else 0, 1) * max(a.shape[1], 1)
    if a.dtype != object and b.dtype != object and most < 2**53:
        return a, b
    if most < 2**62:
        return a.astype(np.int64), b.astype(np.int64)
    return (np.array([[int(x) for x in row] for row in m], dtype=object).reshape(m.shape) for m in (a, b))


def search(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query's place, id, score) of the best k rows for each query among ids, without rows of the query's own id and without scores below `least` of the query."""
    vectors, queries = _safe(vectors, queries)
    n, starts = len(queries), np.arange(0, len(ids), BLOCK)
    high, low = np.maximum.reduceat(vectors, starts, axis=0), np.minimum.reduceat(vectors, starts, axis=0)
    up = queries.copy()
    up[up < 0] = 0
    bounds = up @ high.T + (queries - up) @ low.T
    limits = (-(2**63), 2**63 - 1)
    bounds = np.clip(bounds, *limits) if bounds.dtype == object else bounds
    order = np.argsort(-bounds, axis=1, kind="stable")
    # The k-th score so far, or what the query brought along.
    last = np.array([max(int(x), -(2**62)) for x in least]).astype(vectors.dtype) if least.dtype == object and vectors.dtype != object else least.astype(vectors.dtype)
    none = np.iinfo(np.int64).max
    best, names = np.full((n, k), last.min() - 1 if n else 0, dtype=vectors.dtype), np.full((n, k), none)
    open_ = np.arange(n)
    for step in range(len(starts)):
        blocks = order[open_, step]
        going = bounds[open_, blocks] >= last[open_]  # the bounds that follow are no higher
        open_, blocks = open_[going], blocks[going]
        if not len(open_):
            break
        by = np.argsort(blocks, kind="stable")
        cuts = np.flatnonzero(np.diff(blocks[by])) + 1
        for group in np.split(by, cuts):
            at, own = open_[group], ids[starts[blocks[group[0]]] : starts[blocks[group[0]]] + BLOCK]
            score = queries[at] @ vectors[starts[blocks[group[0]]] : starts[blocks[group[0]]] + BLOCK].T
            score = np.clip(score, *limits) if score.dtype == object else score
            good = (score >= last[at, None]) & (own[None, :] != query_ids[at, None])
            met = np.flatnonzero(good.any(axis=1))
            for lot in np.array_split(met, max(1, len(met) // 512)):  # a bounded number of rows is sorted at a time
                if not len(lot):
                    continue
                rows = at[lot]
                scores = np.hstack([best[rows], np.where(good[lot], score[lot], best[rows][:, :1].min() - 1)])
                labels = np.hstack([names[rows], np.where(good[lot], own[None, :], none)])
                taken = _first(scores, labels, k)
                best[rows], names[rows] = np.take_along_axis(scores, taken, 1), np.take_along_axis(labels, taken, 1)
                full = names[rows, k - 1] != none
                last[rows[full]] = np.maximum(last[rows[full]], best[rows[full], k - 1])
    place, nth = np.nonzero((names != none))
    return place, names[place, nth], best[place, nth]


def _first(scores: np.ndarray, labels: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores in each row, those without a label last, ties by label."""
    if scores.dtype != object:
        return np.lexsort((labels, -scores, labels == np.iinfo(np.int64).max), axis=1)[:, :k]
    key = [sorted(range(len(s)), key=lambda i, s=s, own=own: (own[i] == np.iinfo(np.int64).max, -s[i], own[i]))[:k] for s, own in zip(scores.tolist(), labels.tolist(), strict=True)]
    return np.array(key)


def _meeting(given: Broadcast, width: int, k: int):
    """The best rows for the queries of a lot, a range at a time."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, queries, least = given.value

        def met(ids: np.ndarray, vectors: np.ndarray) -> pa.RecordBatch:
            place, own, score = search(ids, vectors, query_ids, queries, least, k)
            return pa.record_batch([pa.array(place, pa.int32()), pa.array(query_ids[place], pa.int64()), pa.array(own, pa.int64()), pa.array(score.astype(np.int64))], names=["place", "query_id", "vec_id", "score"])

        ids, vectors, size = [], [], 0
        for batch in rows:
            for at in range(0, batch.num_rows, RANGE):
                some = batch.slice(at, RANGE)
                ids.append(some.column(0).to_numpy())
                vectors.append(whole(some.column(1), width))
                size += some.num_rows
                if size >= RANGE:
                    yield met(np.concatenate(ids), np.vstack(vectors))
                    ids, vectors, size = [], [], 0
        if size:
            yield met(np.concatenate(ids), np.vstack(vectors))

    return run


def top_k(vectors: DataFrame, is_query, id_col: str = "vec_id", vector_col: str = "embedding", *, k: int = 5, lot: int = LOT) -> DataFrame:
    """(query_id, rank, vec_id, score): for each id of a row where is_query holds, the k best rows by integer inner product.

    Components become floor(256 x). Ties go to smaller ids. Rows that share the query's id are not its candidates;
    otherwise repeated rows are candidates each. Queries that share an id have their best k together. Scores beyond 64
    bits count as the nearest of 64 bits. Rows whose id or vector is null, or whose vector holds a null or a
    non-finite component, take no part; shorter vectors count as followed by zeros. Fewer rows give fewer results.
    Queries go to all workers in lots of at most `lot` bytes, each read by the driver in its turn.
    """
    spark = vectors.sparkSession
    finite = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & finite).select(
        F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks")
    )
    n, width = rows.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    ranges = max(1, -(-n // RANGE), min(n // BLOCK, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    dealt = stored(rows.repartitionByRange(ranges, "id"), "vectors")
    most = max(1, lot // (8 * max(width, 1)))
    asked = stored(dealt.where("asks").select("id", "v").withColumn("lot", F.floor((F.row_number().over(Window.partitionBy(F.spark_partition_id()).orderBy("id")) - 1) / most).cast("long") + F.shiftleft(F.spark_partition_id().cast("long"), 32)), "queries")
    found = None
    shape = "place int, query_id long, vec_id long, score long"
    for group in _lots([(r["lot"], r["count"]) for r in asked.groupBy("lot").count().orderBy("lot").collect()], most):
        own = asked.where(F.col("lot").isin(group)).select("id", "v").toArrow()
        query_ids, queries = own.column(0).to_numpy(), whole(pa.concat_arrays(own.column(1).chunks), width)
        lowest = np.full(len(query_ids), -(2**62), dtype=object if queries.dtype == object else np.int64)
        if queries.dtype == object:
            lowest[:] = -(10**700)
        seed = spark.sparkContext.broadcast((query_ids, queries, lowest))
        first = stored(asked.select("id", "v").mapInArrow(_meeting(seed, width, k), shape), "first")
        ranked = first.withColumn("r", F.row_number().over(Window.partitionBy("place").orderBy(F.desc("score"), "vec_id")))
        bound = ranked.where(F.col("r") == k).select("place", "score").toArrow()  # a row for a query of the lot at most
        lowest[bound.column(0).to_numpy()] = bound.column(1).to_numpy() if queries.dtype != object else lowest[bound.column(0).to_numpy()]
        rest = spark.sparkContext.broadcast((query_ids, queries, lowest))
        more = stored(dealt.where("not asks").select("id", "v").mapInArrow(_meeting(rest, width, k), shape), "rest")
        seed.destroy()
        rest.destroy()
        both = first.union(more)
        found = both if found is None else found.union(both)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _lots(sizes: list[tuple[int, int]], most: int) -> Iterator[list[int]]:
    """Small lots that follow each other, put together up to the size of one."""
    group, full = [], 0
    for name, n in sizes:
        if group and full + n > most:
            yield group
            group, full = [], 0
        group.append(name)
        full += n
    if group:
        yield group
