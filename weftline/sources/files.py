"""Readers and writers of what an archive keeps as files: run documents, listings, captures, manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RESULT = "site_name string, site_url string, site_category string, success boolean, duration_seconds double, total_resources long, file_types map<string,bigint>"
RUN = f"metadata struct<timestamp:string,total_experiments:bigint,successful:bigint,failed:bigint>, results array<struct<{', '.join(x.replace(' ', ':', 1) for x in RESULT.split(', '))}>>"


def runs(spark: SparkSession, folder: str) -> DataFrame:
    """(filename, metadata fields, results) of experiment_*.json; documents that are no JSON are left out."""
    read = spark.read.schema(RUN + ", _corrupt string").option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").option("pathGlobFilter", "experiment_*.json")
    return read.json(folder).where("_corrupt is null").select(F.col("_metadata.file_name").alias("filename"), "metadata.*", "results")


def results(spark: SparkSession, folder: str) -> DataFrame:
    return runs(spark, folder).select("filename", F.inline("results"))


def write_csv(rows: DataFrame, path: str) -> None:
    """Columns in the order of their names; maps as JSON."""
    maps = {name for name, kind in rows.dtypes if kind.startswith(("map", "struct", "array"))}
    rows.select(*[(F.to_json(c) if c in maps else F.col(c)).alias(c) for c in sorted(rows.columns)]).write.mode("overwrite").option("header", True).csv(path)


def files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, length, modificationTime) of all files below a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder).select("path", "length", "modificationTime")


def run_metadata(timestamp: Column, success: Column) -> list[Column]:
    """Aggregates for a run document's metadata: when, how many, how many of them good and bad; rows without success count as bad."""
    good = F.count_if(F.coalesce(success, F.lit(False)))
    return [F.struct(F.min(timestamp).alias("timestamp"), F.count("*").alias("total_experiments"), good.alias("successful"), (F.count("*") - good).alias("failed")).alias("metadata")]


def write_run(rows: DataFrame, folder: str, timestamp: str) -> None:
    """One run as a folder of two documents: metadata.json, and results.json with a line for each row, however many there are."""
    rows.agg(*run_metadata(F.lit(timestamp), F.col("success"))).select("metadata.*").coalesce(1).write.mode("overwrite").json(f"{folder}/metadata.json")
    rows.write.mode("overwrite").json(f"{folder}/results.json")


def manifests(fetched: DataFrame, project: str, timestamp: str) -> DataFrame:
    """(project, manifest): a JSON document of each project's downloads; fetched has (absolute, local, method, size, ok, n), a row for each URL, which n references share.

    A good URL counts once and is skipped n - 1 times, a failed one fails n times. A project's downloads come together in
    one document, as in the file it stands for; projects are never put together.
    """
    done = F.struct(F.col("absolute").alias("url"), F.col("local").alias("local_path"), "method", "size")
    lost = F.struct(F.col("absolute").alias("url"), F.lit("All download methods failed").alias("reason"))
    add = lambda c, good: F.coalesce(F.sum(F.when(F.col("ok") == good, c)), F.lit(0)).cast("long")
    stats = F.struct(add(F.lit(1), True).alias("success"), add(F.col("n"), False).alias("failed"), add(F.col("n") - 1, True).alias("skipped"))
    again = F.flatten(F.array_sort(F.collect_list(F.when(~F.col("ok"), F.array_repeat(lost, F.col("n").cast("int"))))))
    body = F.struct(F.lit(timestamp).alias("timestamp"), F.col(project).cast("string").alias("url"), stats.alias("statistics"),
                    F.array_sort(F.collect_list(F.when(F.col("ok"), done))).alias("successful_downloads"), again.alias("failed_downloads"))
    return fetched.groupBy(project).agg(F.to_json(body).alias("manifest"))


def write_changed(old: DataFrame, new: DataFrame, key: str, text: str, path: str) -> None:
    """Writes the rows of new whose text differs from old's, or that old does not have, and no others."""
    before = old.select(F.col(key), F.col(text).alias("_before"), F.lit(True).alias("_there"))
    changed = new.join(before, key, "left").where(F.col("_there").isNull() | ~F.col(text).eqNullSafe(F.col("_before")))
    changed.select(*new.columns).write.mode("overwrite").parquet(path)


def texts(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, text) of whole files below a folder; bytes that are no UTF-8 come as replacement characters. Spark's reader leaves empty files out."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    return found.select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def batch_report(results: DataFrame) -> DataFrame:
    """One row, `report`: JSON with total, successful, failed, the rate in per cent, and the failed sites sorted; results has (site, success)."""
    good = F.count_if(F.coalesce("success", F.lit(False)))
    lost = F.array_sort(F.collect_set(F.when(~F.coalesce("success", F.lit(False)), F.col("site"))))
    rate = F.when(F.count("*") > 0, F.round(good * 100.0 / F.count("*"), 2)).otherwise(0.0)
    return results.agg(F.to_json(F.struct(F.count("*").alias("total"), good.alias("successful"), (F.count("*") - good).alias("failed"), rate.alias("success_rate"), lost.alias("failed_sites"))).alias("report"))


def write_files(rows: DataFrame, root: str, path: str = "path", content: str = "content") -> None:
    """Writes each row's bytes (or text, as UTF-8) as a file below root, a URI that all workers share, when all tasks are done.

    Folders are made where they are missing, a file that is there is replaced. Rows without a path or content are left
    out; a path that would leave root, or one that comes with two contents, is an error and nothing is written.
    """
    from weftline.sources import archive

    archive.write(rows.select(F.col(path).alias("path"), F.col(content).alias("content")), root)
