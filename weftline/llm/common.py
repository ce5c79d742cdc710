"""Helpers that the corpus operators share: scratch tables, word hashes, sorted groups and connected components."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.session import shared_dir

U64 = np.uint64
#: Odd 64-bit constants that mix hashes.
MIX_A, MIX_B, MIX_C = U64(0x9E3779B97F4A7C15), U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)


#: Removes the shuffle files of an execution at its end; without it they stay until the driver's collector finds them unreachable.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str, *, plain: bool = False) -> DataFrame:
    """Writes df as a Parquet table in the shared folder and reads it again: lineage ends there, and a lost executor costs no recomputing beyond it.

    plain: no dictionaries are tried, for columns of hashes, which would overflow them.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").option("parquet.enable.dictionary", str(not plain).lower()).parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Removes tables of stored() that nothing will read again. On a file system that Arrow does not know they stay, as scratch tables at the end do."""
    from pyarrow import fs

    for folder in {path.rsplit("/", 1)[0] for table in tables for path in table.inputFiles()}:
        try:
            files, path = fs.FileSystem.from_uri(folder)
            files.delete_dir(path)
        except (pa.ArrowInvalid, OSError):
            continue


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on unsigned 64-bit integers."""
    x = (x ^ (x >> U64(30))) * MIX_B
    x = (x ^ (x >> U64(27))) * MIX_C
    return x ^ (x >> U64(31))


class WordHashes(dict):
    """64-bit hashes of words (bytes), kept for short words seen lately; the table is emptied at a fixed size."""

    LIMIT, LONG = 300_000, 64

    def __missing__(self, word: bytes) -> int:
        import xxhash

        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= self.LONG:
            if len(self) >= self.LIMIT:
                self.clear()
            self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def batches(rows: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[pa.RecordBatch, int, int]]:
    """Cuts Arrow batches with columns (id, text) so that a piece has about `most` bytes of text, or one row."""
    for batch in rows:
        n = batch.num_rows
        if not n:
            continue
        text = batch.column(1)
        sizes = np.nan_to_num(np.asarray(pc.binary_length(text).to_numpy(zero_copy_only=False), dtype=np.float64)).astype(np.int64)
        ends = np.cumsum(sizes)
        at = 0
        while at < n:
            base = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, base + most, side="right")))
            yield batch, at, min(stop, n)
            at = stop


def sorted_groups(rows: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of rows that share a key, from batches sorted by it; small groups stay in few large pieces until cut."""
    kept: list[pa.RecordBatch] = []
    last = None
    for batch in rows:
        if not batch.num_rows:
            continue
        keys = batch.column(batch.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        if kept and keys[0] != last:
            yield pa.Table.from_batches(kept)
            kept = []
        at = 0
        for cut in cuts:
            kept.append(batch.slice(at, cut - at))
            yield pa.Table.from_batches(kept)
            kept, at = [], int(cut)
        kept.append(batch.slice(at))
        last = keys[-1]
    if kept:
        yield pa.Table.from_batches(kept)


def dealt_by(df: DataFrame, key: str, *then: str) -> DataFrame:
    """df with the rows of a key in one partition, sorted by it."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key).sortWithinPartitions(key, *then)


def components(edges: DataFrame, name: str) -> DataFrame:
    """(node, component) for the nodes of undirected edges (a, b); a component is named by its smallest node.

    Rounds of large-star and small-star (Kiveris et al., 2014) until nothing changes; each round is joins and
    minima by node, so neither a node's links nor a component ever meet in one place. Edges with a null end or
    from a node to itself add nothing.
    """
    now = stored(
        edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
        name,
    )
    state = None
    while True:
        found = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u", F.lit(1)))).first()
        if tuple(found) == state or not found[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v")).distinct()
        state = tuple(found)
        both = now.union(now.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        before, now = now, stored(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), name)
        dropped(before)
