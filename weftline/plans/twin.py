"""Registers queries with the SQL that says the same for DuckDB, over tables made up where the archive has none.

The archive's pages have no stylesheets, images or sitemaps, so queries about those add markup that follows from a
page's id. What both dialects call alike is written once; FIX has the few functions that they name differently.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TABLES = ("pages", "documents", "events")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Registry:
    def __init__(self):
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def __call__(self, oracle: str | None = None):
        """Registers a function (spark, sf_dir) under its name, with its oracle."""

        def add(f):
            self.queries[f.__name__] = f
            if oracle:
                self.sql[f.__name__] = oracle
            return f

        return add


#: URLs of pages in every shape that the rules tell apart, by page id; the same text in both dialects.
REFS = """(SELECT page_id, url, CASE page_id % 12
  WHEN 0 THEN '' WHEN 1 THEN '//cdn.example.net/a.js' WHEN 2 THEN 'https://x.example.org/b.css?v=1#t' WHEN 3 THEN 'data:image/png;base64,AAAA'
  WHEN 4 THEN '/img/logo.png' WHEN 5 THEN 'css/site.css' WHEN 6 THEN '/a/b/c.min.js?x=1' WHEN 7 THEN 'fonts/x.woff2' WHEN 8 THEN 'https://x.example.org/'
  WHEN 9 THEN '/img/logo.png' WHEN 10 THEN 'http://y.example.org/p:1/q*.html' ELSE '/docs/readme.pdf' END AS ref FROM pages) refs"""

#: What a fetch of each of them gave: a status by each of three ways, and a size.
OUTCOMES = f"""(SELECT page_id, url, ref, CASE WHEN page_id % 5 = 0 THEN NULL WHEN page_id % 3 = 0 THEN 404 ELSE 200 END AS first_status,
  CASE WHEN page_id % 2 = 0 THEN 500 ELSE 226 END AS second_status, CASE WHEN page_id % 7 = 0 THEN 301 ELSE 200 END AS third_status,
  page_id * 37 % 5000 AS size FROM {REFS}) outcomes"""

#: Runs of an experiment: a day of events is a run, an event one site of it.
RUNS = """(SELECT event_id, date_format_day AS run, CASE WHEN event_id % 11 = 0 THEN NULL ELSE event_type END AS category, user_id AS site,
  event_type <> 'error' AS success, value AS duration FROM (SELECT *, substr(CAST(ts AS STRING), 1, 10) AS date_format_day FROM events) e) runs"""
