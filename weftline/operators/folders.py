"""Queries that go through an archive's files: written from the given tables, read by the archive's source.

Files lie in the folder of spark.checkpoint.dir. A document holds a bounded number of rows: a run 500 events, a sitemap 50
pages, a manifest what was fetched for 10 pages.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from weftline.functions import urls as U
from weftline.operators.archive import _CLEAN, _REFERRING, _SHOTS, _SHOWN, linked, localised, shot_path
from weftline.operators.web import _FETCHED, _METHOD, _from, fetched
from weftline.plans.twin import OUTCOMES, Registry, read
from weftline.session import shared_dir
from weftline.sources import archive as A
from weftline.sources import files

folders = Registry()


def folder(spark) -> str:
    return f"{shared_dir(spark)}/archive-{uuid.uuid4().hex}"


# Runs as documents.

_RESULTS = """(SELECT concat('experiment_', lpad(CAST(CAST(floor(event_id / 500) AS BIGINT) AS STRING), 9, '0'), '.json') AS file, CAST(CAST(ts AS DATE) AS STRING) AS day, event_id, concat('s', user_id) AS site_name, event_type <> 'error' AS success,
  CASE WHEN event_type <> 'error' THEN value END AS duration_seconds, CASE WHEN event_type = 'error' THEN concat('no "', event_id, '"') END AS error, CASE WHEN event_id % 11 <> 0 THEN event_type END AS site_category,
  event_id % 101 AS success_rate, event_id % 13 / 4e0 AS output_size_mb, CASE WHEN event_type = 'view' THEN event_id % 3 END AS css, CASE WHEN event_type = 'view' THEN 1 END AS js FROM events) results"""


def _runs(spark, d) -> str:
    """Writes run documents, with a broken one beside each seventh, and returns their folder."""
    rows = _from(spark, d, _RESULTS, "events")
    types = F.when(F.col("css").isNotNull(), F.create_map(F.lit("css"), "css", F.lit("js"), "js"))
    result = F.struct("site_name", "success", "duration_seconds", "error", "site_category", "success_rate", "output_size_mb", types.alias("file_types"))
    ordered = F.array_sort(F.collect_list(F.struct("event_id", F.to_json(result).alias("result"))))
    documents = rows.groupBy("file").agg(*files.run_metadata(F.concat("day", F.lit("T00:00:00")), F.col("success")), ordered.alias("results"))
    content = F.concat(F.lit('{"metadata":'), F.to_json("metadata"), F.lit(',"results":['), F.array_join(F.col("results.result"), ","), F.lit("]}"))
    good = documents.select(F.col("file").alias("path"), content.alias("content"))
    broken = good.where("cast(substr(path, 12, 9) as long) % 7 = 0").select(F.concat(F.lit("experiment_broken_"), F.substring("path", 12, 9), F.lit(".json")).alias("path"), F.lit('{"metadata":').alias("content"))
    to = folder(spark)
    A.write(good.unionByName(broken), to)
    return to


@folders(f"SELECT file, min(day) || 'T00:00:00' AS timestamp, count(*) AS total_experiments, count(*) FILTER (success) AS successful, count(*) FILTER (NOT success) AS failed FROM {_RESULTS.replace('STRING', 'VARCHAR')} GROUP BY file")
def list_runs(spark, d):
    """Run documents by name, with what their metadata says; broken documents are left out."""
    return A.read(spark, _runs(spark, d), "run")


def variants(results: DataFrame) -> DataFrame:
    """results of the archive's source with `v`, the document as a variant."""
    return results.withColumn("v", F.parse_json("result"))


def fields(documents: DataFrame, column: str = "v") -> StructType:
    """The fields that occur in a column of variants, each with the type that holds all its values, by name; only the merged schema comes to the driver."""
    (schema,) = documents.agg(F.schema_of_variant_agg(column)).first()
    if not schema.startswith("OBJECT<"):
        return StructType([])
    found = StructType.fromDDL(schema.replace("OBJECT<", "STRUCT<")[len("STRUCT<") : -1])
    return StructType(sorted(found.fields, key=lambda f: f.name))


def table_of(documents: DataFrame, column: str = "v") -> DataFrame:
    """Documents with differing fields as a table of texts: one column for each field that any of them has, by name, null where a document lacks it."""
    names = [f.name for f in fields(documents, column).fields]
    if not names:
        raise ValueError("No results to export")
    held = documents.select(F.variant_get(column, "$", "map<string,variant>").alias("held"))
    return held.select(*[F.try_element_at("held", F.lit(name)).cast("string").alias(name) for name in names])


def export_csv_to(documents: DataFrame, path: str, column: str = "v") -> None:
    """Writes documents as CSV, with the union of their fields as header; no documents are an error."""
    table_of(documents, column).write.options(header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


@folders(f"""SELECT duration_seconds, error, CASE WHEN css IS NOT NULL THEN '{{"css":' || css || ',"js":1}}' END AS file_types, output_size_mb, site_category, site_name, CAST(success AS VARCHAR) AS success, success_rate FROM {_RESULTS.replace('STRING', 'VARCHAR')}""")
def export_csv(spark, d):
    """All results of all runs as CSV, read back: the header is the union of the fields that documents have."""
    to = folder(spark)
    export_csv_to(variants(A.read(spark, _runs(spark, d), "result")), to)
    back = spark.read.option("header", True).option("escape", '"').csv(to)
    return back.withColumns({"duration_seconds": F.col("duration_seconds").cast("double"), "output_size_mb": F.col("output_size_mb").cast("double"), "success_rate": F.col("success_rate").cast("long")})


@folders(f"SELECT 'css' AS kind, CAST(sum(css) AS BIGINT) AS n, count(css) AS documents FROM {_RESULTS.replace('STRING', 'VARCHAR')} UNION ALL SELECT 'js', CAST(sum(js) AS BIGINT), count(js) FROM {_RESULTS.replace('STRING', 'VARCHAR')}")
def file_type_histogram(spark, d):
    """The maps of file types in all documents, added up by type."""
    types = variants(A.read(spark, _runs(spark, d), "result")).select(F.explode(F.try_variant_get("v", "$.file_types", "map<string,bigint>")).alias("kind", "count"))
    return types.groupBy("kind").agg(F.sum("count").alias("n"), F.count("*").alias("documents"))


def run_stats(results: DataFrame, name: str) -> DataFrame:
    """One row: count, successful, and over successful results avg_duration, avg_success_rate and total_size_mb of a run; what a document lacks counts as 0."""
    own = results.where(F.col("file") == name)
    number = lambda field: F.coalesce(F.variant_get("v", f"$.{field}", "double"), F.lit(0.0))
    good = F.coalesce(F.variant_get("v", "$.success", "boolean"), F.lit(False))
    mean = lambda field: F.coalesce(F.avg(F.when(good, number(field))), F.lit(0.0))
    return own.agg(F.count("*").alias("count"), F.count_if(good).alias("successful"), mean("duration_seconds").alias("avg_duration"), mean("success_rate").alias("avg_success_rate"),
                   F.coalesce(F.sum(F.when(good, number("output_size_mb"))), F.lit(0.0)).alias("total_size_mb"))


def change(now: Column, before: Column, words: tuple[str, str]) -> Column:
    """The first word for less, the second for more, SAME for neither."""
    return F.when(now < before, words[0]).when(now > before, words[1]).otherwise("SAME")


def compared(results: DataFrame, first: str, second: str) -> DataFrame:
    """Two runs by the names of their documents: the statistics of each, the differences second less first, and these in words and in per cent of the first (0 where that is 0)."""
    one, two = (run_stats(results, name).select(*[F.col(c).alias(f"{c}{i}") for c in ("count", "successful", "avg_duration", "avg_success_rate", "total_size_mb")]) for i, name in ((1, first), (2, second)))
    share = lambda c: F.when(F.col(f"{c}1") > 0, (F.col(f"{c}2") - F.col(f"{c}1")) / F.col(f"{c}1") * 100).otherwise(0.0)
    return one.crossJoin(two).select(
        "*", (F.col("avg_duration2") - F.col("avg_duration1")).alias("duration_change"), (F.col("avg_success_rate2") - F.col("avg_success_rate1")).alias("success_rate_change"), (F.col("total_size_mb2") - F.col("total_size_mb1")).alias("size_change_mb"),
        share("avg_duration").alias("duration_pct"), change(F.col("avg_duration2"), F.col("avg_duration1"), ("FASTER", "SLOWER")).alias("duration_label"),
        change(F.col("avg_success_rate2"), F.col("avg_success_rate1"), ("WORSE", "BETTER")).alias("success_label"), share("total_size_mb").alias("size_pct"),
    )


_STATS = f"""(SELECT count(*) AS count{{0}}, count(*) FILTER (success) AS successful{{0}}, coalesce(avg(duration_seconds) FILTER (success), 0) AS avg_duration{{0}}, coalesce(avg(success_rate) FILTER (success), 0) AS avg_success_rate{{0}},
  coalesce(sum(output_size_mb) FILTER (success), 0) AS total_size_mb{{0}} FROM {_RESULTS.replace('STRING', 'VARCHAR')} WHERE file = 'experiment_00000000{{1}}.json')"""


@folders(f"""SELECT *, avg_duration2 - avg_duration1 AS duration_change, avg_success_rate2 - avg_success_rate1 AS success_rate_change, total_size_mb2 - total_size_mb1 AS size_change_mb,
  CASE WHEN avg_duration1 > 0 THEN (avg_duration2 - avg_duration1) / avg_duration1 * 100 ELSE 0 END AS duration_pct, CASE WHEN avg_duration2 < avg_duration1 THEN 'FASTER' WHEN avg_duration2 > avg_duration1 THEN 'SLOWER' ELSE 'SAME' END AS duration_label,
  CASE WHEN avg_success_rate2 > avg_success_rate1 THEN 'BETTER' WHEN avg_success_rate2 < avg_success_rate1 THEN 'WORSE' ELSE 'SAME' END AS success_label,
  CASE WHEN total_size_mb1 > 0 THEN (total_size_mb2 - total_size_mb1) / total_size_mb1 * 100 ELSE 0 END AS size_pct FROM {_STATS.format(1, 0)} a CROSS JOIN {_STATS.format(2, 1)} b""")
def compare_runs(spark, d):
    """The first two run documents side by side; two rows of one each are joined."""
    return compared(variants(A.read(spark, _runs(spark, d), "result")), "experiment_000000000.json", "experiment_000000001.json")


# Robots files, sitemaps, pages and manifests.

_SITE = "regexp_extract(url, '^[^:/?#]+://([^/?#]*)', 1)"


@folders(f"""SELECT host || '/robots.txt' AS file, CAST(n AS INTEGER) AS n, kind, value FROM (SELECT host, unnest([0, 1, 2, 3]) AS n, unnest(['disallow', 'allow', 'sitemap', 'sitemap']) AS kind, unnest(['/a' || low, '/b:' || pages, 'http://' || host || '/sitemap.xml', '']) AS value
  FROM (SELECT {_SITE} AS host, min(page_id) AS low, count(*) AS pages FROM pages GROUP BY 1) h) r""")
def robots_parse(spark, d):
    """Directives of each host's robots file, in order; groups and comments do not matter, empty paths are left out, empty sitemaps stay."""
    hosts = read(spark, d, "pages").groupBy(F.expr(_SITE).alias("host")).agg(F.min("page_id").alias("low"), F.count("*").alias("pages"))
    text = F.concat(F.lit("# hi\nUser-agent: *\nDISALLOW: /a"), "low", F.lit("\nDisallow:\nallow: /b:"), "pages", F.lit("\r\n Sitemap: http://"), "host", F.lit("/sitemap.xml\nSitemap:\n"))
    to = folder(spark)
    A.write(hosts.select(F.concat("host", F.lit("/robots.txt")).alias("path"), text.alias("content")), to)
    return A.read(spark, to, "robots")


@folders("""SELECT 'sitemaps/' || part || CASE part % 3 WHEN 2 THEN '.rss' ELSE '.xml.gz' END AS file, CASE part % 3 WHEN 2 THEN 'rss' ELSE 'url' END AS kind, url AS loc, CASE part % 3 WHEN 2 THEN 'T' || page_id END AS title, CASE part % 3 WHEN 2 THEN NULL ELSE '2024-01-0' || (page_id % 9 + 1) END AS lastmod,
  NULL AS changefreq, NULL AS priority FROM (SELECT page_id, url, CAST(floor(page_id / 50) AS BIGINT) AS part FROM pages) p""")
def sitemap_files(spark, d):
    """Sitemaps, compressed and nested, and RDF feeds, of 50 pages each; torn files are left out."""
    pages = read(spark, d, "pages").select("page_id", F.expr("replace(replace(url, '&', '&amp;'), '<', '&lt;')").alias("url"), F.expr("floor(page_id / 50)").alias("part"))
    entry = F.when(F.col("part") % 3 == 2, F.concat(F.lit("<item><title>T"), "page_id", F.lit("</title><link>"), "url", F.lit("</link></item>")))
    entry = entry.otherwise(F.concat(F.lit("<url><loc>"), "url", F.lit("</loc><lastmod>2024-01-0"), F.col("page_id") % 9 + 1, F.lit("</lastmod></url>")))
    own = pages.groupBy("part").agg(F.array_join(F.array_sort(F.collect_list(entry)), "").alias("entries"))
    rdf = F.concat(F.lit('<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns="http://purl.org/rss/1.0/"><channel><title>c</title></channel>'), "entries", F.lit("</rdf:RDF>"))
    nested = F.concat(F.lit('<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><group><group>'), "entries", F.lit("</group></group></urlset>"))
    feed = F.col("part") % 3 == 2
    good = own.select(F.concat(F.lit("sitemaps/"), "part", F.when(feed, ".rss").otherwise(".xml.gz")).alias("path"), F.when(feed, rdf).otherwise(nested).alias("content"))
    torn = own.select(F.concat(F.lit("sitemaps/torn"), "part", F.lit(".xml")).alias("path"), F.lit("<urlset><url>").alias("content"))
    to = folder(spark)
    A.write(good.unionByName(torn), to)
    return A.read(spark, to, "sitemap")


_INDEX = f"(SELECT page_id, html FROM ({{0}}) r)"


def _rewritten_sql() -> str:
    from weftline.operators.archive import archive

    return archive.sql["rewrite_html"]


@folders(f"SELECT 'page-' || page_id || '/index.html' AS file, CAST(octet_length(encode(html)) AS BIGINT) AS size, sha256(html) AS sha256 FROM {_INDEX.format(_rewritten_sql())} i")
def written_pages(spark, d):
    """Pages with local references, written as index.html of their folders and read back."""
    pages = _from(spark, d, _REFERRING).select("page_id", "base", F.expr("replace(html, '<article>', concat('<article>', decoy, markup))").alias("html"))
    # Markup is read once: its references are kept, for the files and for the places where these are put in.
    kept = folder(spark)
    linked(pages).write.parquet(kept)
    refs = spark.read.parquet(kept)
    absolute = U.absolute(F.col("base"), F.col("ref"))
    local = refs.select(absolute.alias("absolute")).distinct().where("not endswith(absolute, '.gif')").select("absolute", F.concat(F.lit("assets/"), U.file_name(F.col("absolute"))).alias("local"))
    to = folder(spark)
    A.write(localised(pages, local, refs).select(F.concat(F.lit("page-"), "page_id", F.lit("/index.html")).alias("path"), F.col("html").alias("content")), to)
    return A.read(spark, to, "file", pattern="*/index.html").select("file", "size", F.sha2("content", 256).alias("sha256"))


#: What was fetched for ten pages together: a URL is fetched once, and skipped when it comes again.
_OWN = f"""(SELECT CAST(floor(page_id / 10) AS BIGINT) AS project, absolute, count(*) AS n, max(size) AS size, min({_METHOD}) AS method FROM (SELECT o.*, f.absolute FROM {OUTCOMES.rsplit(' ', 1)[0]} o JOIN {_FETCHED} f USING (page_id)) x GROUP BY 1, 2)"""


@folders(f"""SELECT project || '/download_manifest.json' AS file, '2024-01-31T00:00:00' AS timestamp, CAST(project AS VARCHAR) AS url, CAST(coalesce(sum(CASE WHEN ok THEN 1 END), 0) AS BIGINT) AS success, CAST(coalesce(sum(CASE WHEN NOT ok THEN n END), 0) AS BIGINT) AS failed,
  CAST(coalesce(sum(CASE WHEN ok THEN n - 1 END), 0) AS BIGINT) AS skipped, count(*) FILTER (ok) AS n_good, CAST(coalesce(sum(size) FILTER (ok), 0) AS BIGINT) AS bytes, min(absolute) FILTER (ok) AS first_url, min(absolute) FILTER (NOT ok) AS first_lost FROM (SELECT *, size > 100 AND method IS NOT NULL AS ok FROM {_OWN} o) m GROUP BY project""")
def download_manifest(spark, d):
    """Manifests written as documents, one for ten pages, and read back: their statistics, and what their lists of downloads hold."""
    to = folder(spark)
    made = files.manifests(fetched(spark, d), "project", "2024-01-31T00:00:00")
    A.write(made.select(F.concat("project", F.lit("/download_manifest.json")).alias("path"), F.col("manifest").alias("content")), to)
    good, lost = F.when(F.col("ok"), F.col("url")), F.when(~F.col("ok"), F.col("url"))
    held = A.read(spark, to, "download").groupBy("file").agg(F.count_if("ok").alias("n_good"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.min(good).alias("first_url"), F.min(lost).alias("first_lost"))
    return A.read(spark, to, "manifest").join(held, "file", "left").withColumns({"n_good": F.coalesce("n_good", F.lit(0)), "bytes": F.coalesce("bytes", F.lit(0))})


# Captures and their metadata.


def append_entries(entries: DataFrame, to: str) -> None:
    """Adds entries (path, at, entry: JSON) to the lists that lie below a folder at their paths, after what is there, in the order of `at`; lists that are not there begin.

    Only lists that get something are read and written again, each as a whole when all tasks are done.
    """
    spark = entries.sparkSession
    there = A.read(spark, to, "capture").join(entries.select(F.col("path").alias("file")).distinct(), "file", "left_semi")
    rows = there.select(F.col("file").alias("path"), F.lit(0).alias("new"), F.col("n").cast("long").alias("at"), "entry").union(entries.select("path", F.lit(1), F.col("at").cast("long"), "entry"))
    kept = F.array_sort(F.collect_list(F.struct("new", "at", "entry")))
    A.write(rows.groupBy("path").agg(F.concat(F.lit("["), F.array_join(kept["entry"], ","), F.lit("]")).alias("content")), to)


@folders(f"""SELECT doc_id, {_SHOWN} AS path, '2024-01-30' AS day, {_CLEAN} AS page_dir, CASE WHEN n > 500 THEN n END AS size, CASE WHEN n > 500 THEN sha256(image) END AS sha256, CASE WHEN n > 500 THEN CASE WHEN width IS NULL THEN 'fullpage' ELSE width || 'x' || height END END AS viewport
  FROM (SELECT *, CAST(octet_length(encode(coalesce(image, ''))) AS BIGINT) AS n FROM {_SHOTS}) s""")
def list_screenshots(spark, d):
    """Captures newest first, with the day of their folder and what the metadata documents of their pages say; those of 500 bytes or less have no entry. Entries come in two goes."""
    shots = _from(spark, d, _SHOTS, "documents")
    shots = shots.withColumns({"path": shot_path(F.col("page"), F.col("taken"), F.col("width"), F.col("height")), "size": F.octet_length(F.coalesce("image", F.lit(""))).cast("long")})
    parent = lambda i: F.element_at(F.split("path", "/"), i)
    day = F.when(F.regexp_count(parent(-2), F.lit("-")) == 2, parent(-2))
    view = F.coalesce(F.concat(F.col("width").cast("string"), F.lit("x"), F.col("height").cast("string")), F.lit("fullpage"))
    entry = F.to_json(F.struct("doc_id", F.col("path").alias("filename"), "size", F.sha2("image", 256).alias("sha256"), view.alias("viewport")))
    held = shots.where("size > 500").select(F.concat(parent(-3), F.lit("/"), F.expr("floor(doc_id / 200)"), F.lit(".metadata.json")).alias("path"), F.col("doc_id").alias("at"), entry.alias("entry"))
    to = folder(spark)
    first = held.where("at % 2 = 0")
    A.write(first.groupBy("path").agg(F.concat(F.lit("["), F.array_join(F.sort_array(F.collect_list("entry")), ","), F.lit("]")).alias("content")), to)
    append_entries(held.where("at % 2 = 1"), to)
    told = A.read(spark, to, "capture").select(F.from_json("entry", "doc_id long, size long, sha256 string, viewport string").alias("e")).select("e.*")
    listed = shots.select("doc_id", "path", day.alias("day"), parent(-3).alias("page_dir")).join(told, "doc_id", "left")
    return listed.select("doc_id", "path", "day", "page_dir", "size", "sha256", "viewport").orderBy(F.desc("day"), "doc_id")
