"""Running values along the rows of a key, in order, without the rows of a key meeting in one task.

Rows are put in order by range partitions, so that a long key spreads over many of them. Each partition adds up its own
rows; only the key that a partition begins with can have rows before it, and what those add up to follows from two rows
for each partition: what it has of its last key, and what it asks for its first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def in_order(rows: DataFrame, *keys: str) -> DataFrame:
    """rows in the order of keys over range partitions, nulls first, with `part`: the place of a row's partition."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("part", F.spark_partition_id())


def boundaries(rows: DataFrame, key: str, *values: str) -> DataFrame:
    """(part, kind, key, no, values): kind 1 has the last row of each partition, kind 0 the key that it begins with, and nulls.

    rows has part and no, which counts the rows of a key in a partition. There are two rows for each partition,
    whatever the partitions hold.
    """
    ends = rows.groupBy("part").agg(F.min(F.struct(key)).alias("first"), F.max(F.struct(key, "no", *values)).alias("last"))
    last = ends.select("part", F.lit(1).alias("kind"), *(F.col(f"last.{c}") for c in (key, "no", *values)))
    return last.unionByName(ends.select("part", F.lit(0).alias("kind"), F.col(f"first.{key}")), allowMissingColumns=True)


def earlier(key: str):
    """The window of what earlier partitions have of a key, over the rows of boundaries()."""
    return Window.partitionBy(key).orderBy("part", "kind").rowsBetween(Window.unboundedPreceding, -1)


def continued(rows: DataFrame, carried: DataFrame, key: str) -> DataFrame:
    """rows with the columns of carried (part, key, ...) where a partition goes on with its first key, and nulls elsewhere. Spark sends carried along only if its own limit allows."""
    there = carried.withColumnRenamed("part", "_part").withColumnRenamed(key, "_key")
    return rows.join(there, (F.col("part") == F.col("_part")) & F.col(key).eqNullSafe(F.col("_key")), "left").drop("_part", "_key")
