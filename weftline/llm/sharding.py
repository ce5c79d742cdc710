"""Contiguous shards of near equal bytes, cut from global prefix sums.

Rows are put in the order of their ids by range partitions; each partition reports its bytes and rows, the running
totals of these reports give each partition's place, and a row's place follows from the running total inside its
partition. A row goes to the shard in which the middle of its bytes falls, so every cut is within half a row of its
target. Only sizes and checksums move; texts are read once, where they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import stored


def assign_shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shards: int = 16) -> DataFrame:
    """(id_col, size, text_crc32, shard, slot) for each row of docs.

    size is the text's UTF-8 bytes plus 1; a null text has no bytes, and its checksum is 0, as an empty one's.
    Shards are contiguous in the order of (id, size, checksum), nulls first; slot counts from 0 in a shard. Repeated
    rows are kept and told apart by their place in the input. With fewer rows than shards, some shards stay empty;
    an empty table gives no rows. Other columns are not looked at.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("crc"), F.monotonically_increasing_id().alias("seen")
    )
    keys = ["id", "size", "crc", "seen"]
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = stored(rows.repartitionByRange(n, *keys).withColumn("part", F.spark_partition_id()), "sizes")
    totals = dealt.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("count"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # One row for each partition: a table as long as the job has tasks.
    places = stored(
        totals.select(
            "part", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("byte0"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("row0"), F.sum("bytes").over(everything).alias("total")
        ),
        "places",
    )
    within = Window.partitionBy("part").orderBy(*keys)
    placed = dealt.join(places, "part").select(
        "id", "size", "crc", "total",
        (F.col("byte0") + F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")).alias("start"),
        (F.col("row0") + F.row_number().over(within) - 1).alias("at"),
    )
    # floor((start + size / 2) / total * shards) in whole numbers: no row's middle is at or beyond the total.
    shard = F.expr(f"cast(((2 * start + size) * {shards}) div (2 * total) as int)")
    placed = stored(placed.select("id", "size", "crc", "at", shard.alias("shard")), "placed")
    first = placed.groupBy("shard").agg(F.min("at").alias("first"))
    return placed.join(F.broadcast(first), "shard").select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard", (F.col("at") - F.col("first")).alias("slot")
    )


def write_shards(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", *, shards: int = 16) -> DataFrame:
    """Writes whole rows of docs to path/shard=N and returns the assignment. Ids have to be unique and not null here."""
    found = stored(assign_shards(docs, id_col, text_col, shards=shards), "shards")
    docs.join(found.select(id_col, "shard", "slot"), id_col).write.partitionBy("shard").parquet(path)
    return found
