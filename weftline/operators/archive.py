"""Sites as a whole: platform signs, statistics, sitemaps with their URLs, markup and stylesheets rewritten, listings, names.

Where the archive has no table (probes, projects, stylesheets, feeds) one is made up from pages in an expression that both
engines read; what is computed from it is written twice, as expressions here and apart from them as SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions import html as H
from weftline.functions import tables
from weftline.functions import urls as U
from weftline.functions.feeds import sitemap_entries  # noqa: F401  offered here as well
from weftline.operators.web import _CLASS, _FILE, _PATH, _SHAPES, _from, _shapes, srcset_entry
from weftline.plans.twin import REFS, Registry, read
from weftline.session import shared_dir

archive = Registry()

# Platform signs.

#: Markup of pages with signs of the platform, and what probes of its addresses gave; made up.
_PROBED = """(SELECT page_id, url, concat(html, CASE WHEN page_id % 2 = 0 THEN '<link href="/wp-content/themes/astra/s.css"><img src=''/wp-content/themes/other/x.png''>' ELSE '' END,
  CASE WHEN page_id % 3 = 0 THEN '<script src="/wp-includes/j.js"></script>' ELSE '' END,
  CASE page_id % 5 WHEN 0 THEN '<META property="g" name=''Generator'' content="WordPress 6.4.2; x">' WHEN 1 THEN '<meta name="generator" content="Drupal 10">' WHEN 2 THEN '<p>WordPress 5.1</p>' ELSE '' END,
  CASE WHEN page_id % 4 = 0 THEN '<a href="/wp-content/plugins/seo/x"><a href=''/wp-content/plugins/cache/y''><a href="/wp-content/plugins/seo/z">' ELSE '' END) AS h,
  CASE WHEN page_id % 7 = 0 THEN 200 ELSE 404 END AS rest_status, CASE WHEN page_id % 14 = 0 THEN '{"routes":{}}' WHEN page_id % 14 = 7 THEN '{"name":"x"}' END AS rest_body,
  CASE page_id % 11 WHEN 0 THEN 403 WHEN 1 THEN 404 ELSE NULL END AS login_status, CASE page_id % 11 WHEN 0 THEN 200 WHEN 1 THEN 302 ELSE 500 END AS admin_status,
  CASE page_id % 11 WHEN 2 THEN 200 ELSE 301 END AS xmlrpc_status FROM pages) probed"""
#: Patterns of the platform's signs.
_GENERATOR = """<meta[^>]+name=["']generator["'][^>]+content=["']WordPress[^"']*["']"""
_PLUGIN = """/wp-content/plugins/([^/'"]+)"""
_THEME = """/wp-content/themes/([^/'"]+)"""
_Q = lambda pattern: pattern.replace("'", "''")


def fingerprint(html: Column, rest_status: Column, rest_body: Column, probes: dict[str, Column]) -> list[Column]:
    """Signs of the platform in markup and in what probes gave: their weights add up, at most 1; from a half on it is the platform.

    Of the probed addresses the first that answers 200, 302 or 403 counts, once. Plugins are sorted, at most ten.
    """
    generator = F.regexp_extract(html, f"(?i){_GENERATOR}", 0)
    rest = (rest_status == 200) & (F.get_json_object(rest_body, "$.namespaces").isNotNull() | F.get_json_object(rest_body, "$.routes").isNotNull())
    hit = F.coalesce(*[F.when(status.isin(200, 302, 403), F.lit(name)) for name, status in probes.items()])
    tenths = lambda sign, n: F.when(sign, n).otherwise(0)
    score = tenths(html.contains("/wp-content/"), 3) + tenths(html.contains("/wp-includes/"), 3) + tenths(generator != "", 4) + tenths(F.coalesce(rest, F.lit(False)), 5) + tenths(hit.isNotNull(), 2)
    plugins = F.slice(F.array_sort(F.array_distinct(F.regexp_extract_all(html, F.lit(_PLUGIN), 1))), 1, 10)
    return [
        (score >= 5).alias("is_wordpress"), (F.least(score, F.lit(10)) / 10).alias("confidence"), F.regexp_extract(generator, r"(?i)WordPress\s+([\d.]+)", 1).alias("version"),
        F.regexp_extract(html, _THEME, 1).alias("theme"), F.array_join(plugins, ",").alias("plugins"), hit.alias("probe"), F.coalesce(rest, F.lit(False)).alias("api_available"),
    ]


def _signs(spark, d):
    probes = {"/wp-login.php": F.col("login_status"), "/wp-admin/": F.col("admin_status"), "/xmlrpc.php": F.col("xmlrpc_status")}
    return _from(spark, d, _PROBED).select("page_id", "url", *fingerprint(F.col("h"), F.col("rest_status"), F.col("rest_body"), probes))


_API = "(rest_status = 200 AND coalesce(contains(rest_body, '\"namespaces\":') OR contains(rest_body, '\"routes\":'), false))"
_HIT = "CASE WHEN login_status IN (200, 302, 403) THEN '/wp-login.php' WHEN admin_status IN (200, 302, 403) THEN '/wp-admin/' WHEN xmlrpc_status IN (200, 302, 403) THEN '/xmlrpc.php' END"
_TAG = f"regexp_extract(h, '{_Q(_GENERATOR)}', 0, 'i')"
_POINTS = f"""(CASE WHEN h LIKE '%/wp-content/%' THEN 3 ELSE 0 END + CASE WHEN h LIKE '%/wp-includes/%' THEN 3 ELSE 0 END + CASE WHEN {_TAG} <> '' THEN 4 ELSE 0 END
  + CASE WHEN {_API} THEN 5 ELSE 0 END + CASE WHEN ({_HIT}) IS NULL THEN 0 ELSE 2 END)"""
_SIGNS = f"""SELECT page_id, url, {_POINTS} >= 5 AS is_wordpress, CASE WHEN {_POINTS} > 10 THEN 1.0::DOUBLE ELSE {_POINTS} / 10.0::DOUBLE END AS confidence, regexp_extract({_TAG}, 'WordPress\\s+([\\d.]+)', 1, 'i') AS version,
  regexp_extract(h, '{_Q(_THEME)}', 1) AS theme, array_to_string((list_sort(list_distinct(regexp_extract_all(h, '{_Q(_PLUGIN)}', 1))))[1:10], ',') AS plugins, {_HIT} AS probe, {_API} AS api_available FROM {_PROBED}"""


@archive(f"SELECT page_id, is_wordpress, confidence, version, theme, plugins, probe, api_available FROM ({_SIGNS}) s")
def wp_fingerprint(spark, d):
    """Platform signs of each page: markup, first answering probe, interface probe."""
    return _signs(spark, d).drop("url")


_KIND_COUNTS = ("posts", "pages", "categories", "tags", "authors", "media", "other")


def site_stats(pages: DataFrame, signs: DataFrame) -> DataFrame:
    """One row for a host: is any page of the platform, the best confidence, all URLs, and URLs by class (null where the host is not of the platform)."""
    of = pages.select(F.regexp_extract("url", "^[^:/?#]+://([^/?#]*)", 1).alias("host"), U.url_class(F.col("url")).alias("kind"))
    counts = of.groupBy("host").agg(F.count("*").alias("total_urls"), *[F.count_if(F.col("kind") == k).alias(f"{k}_count") for k in _KIND_COUNTS])
    best = signs.groupBy(F.regexp_extract("url", "^[^:/?#]+://([^/?#]*)", 1).alias("host")).agg(F.max("is_wordpress").alias("is_wordpress"), F.max("confidence").alias("confidence"), F.max("version").alias("version"))
    some = [F.when(F.col("is_wordpress"), F.col(f"{k}_count")).alias(f"{k}_count") for k in _KIND_COUNTS]
    return counts.join(best, "host").select("host", "is_wordpress", "confidence", "total_urls", F.when(F.col("is_wordpress"), F.col("version")).alias("version"), *some)


_HOST = "regexp_extract(url, '^[^:/?#]+://([^/?#]*)', 1)"
_SITES = f"""SELECT c.host, s.is_wordpress, s.confidence, c.total_urls, CASE WHEN s.is_wordpress THEN s.version END AS version, {', '.join(f'CASE WHEN s.is_wordpress THEN c.{k} END AS {k}_count' for k in _KIND_COUNTS)}
  FROM (SELECT host, count(*) AS total_urls, {', '.join(f"count(*) FILTER (kind = '{k}') AS {k}" for k in _KIND_COUNTS)} FROM (SELECT {_HOST} AS host, {_CLASS} AS kind FROM (SELECT url, lower({_PATH}) AS p FROM {_SHAPES}) t) u GROUP BY host) c
  JOIN (SELECT {_HOST} AS host, bool_or(is_wordpress) AS is_wordpress, max(confidence) AS confidence, max(version) AS version FROM ({_SIGNS}) x GROUP BY 1) s ON c.host = s.host"""


@archive(_SITES)
def site_statistics(spark, d):
    return site_stats(_shapes(spark, d), _signs(spark, d))


@archive(f"""SELECT host, CASE WHEN is_wordpress THEN '✓ WordPress Site Detected (' || CAST(round(confidence * 100) AS INTEGER) || '% confidence)' || CASE WHEN version <> '' THEN chr(10) || '  Version: ' || version ELSE '' END
  || chr(10) || chr(10) || 'Total URLs Found: ' || total_urls || chr(10) || chr(10) || 'Content Breakdown:' || chr(10) || '  Posts: ' || posts_count || chr(10) || '  Pages: ' || pages_count || chr(10) || '  Categories: ' || categories_count
  || chr(10) || '  Tags: ' || tags_count || chr(10) || '  Authors: ' || authors_count || chr(10) || '  Media: ' || media_count || chr(10) || '  Other: ' || other_count
  ELSE '✗ Not a WordPress site (confidence: ' || CAST(round(confidence * 100) AS INTEGER) || '%)' || chr(10) || 'Total URLs Found: ' || total_urls END AS summary FROM ({_SITES}) t""")
def analysis_summary(spark, d):
    """The statistics of a site as text. Its words and signs."""
    share = F.round(F.col("confidence") * 100).cast("int").cast("string")
    version = F.when(F.col("version") != "", F.concat(F.lit("  Version: "), F.col("version")))
    yes = F.concat_ws("\n", F.concat(F.lit("✓ WordPress Site Detected ("), share, F.lit("% confidence)")), version, F.lit(""), F.concat(F.lit("Total URLs Found: "), "total_urls"), F.lit(""), F.lit("Content Breakdown:"),
                      *[F.concat(F.lit(f"  {k.capitalize()}: "), F.col(f"{k}_count")) for k in _KIND_COUNTS])
    no = F.concat_ws("\n", F.concat(F.lit("✗ Not a WordPress site (confidence: "), share, F.lit("%)")), F.concat(F.lit("Total URLs Found: "), "total_urls"))
    return site_statistics(spark, d).select("host", F.when(F.col("is_wordpress"), yes).otherwise(no).alias("summary"))


# Sitemaps and feeds.

#: A document of each form for each page: sitemap, index, feed in two forms, and one that is broken; made up.
_FEEDS = """(SELECT page_id, CASE page_id % 8 WHEN 0 THEN '<urlset><url><loc>' WHEN 1 THEN concat('<sitemapindex xmlns="http://x"><sitemap><loc>http://h/s', page_id, '.xml</loc></sitemap><sitemap><lastmod>2024</lastmod></sitemap></sitemapindex>')
  WHEN 2 THEN concat('<rss><channel><item><title>T', page_id, '</title><link>http://h/p</link><pubDate>Mon</pubDate></item><item><title>none</title></item></channel></rss>')
  WHEN 3 THEN concat('<feed><entry><title>A', page_id, '</title><link href="http://h/a"/><link href="http://h/b"/><updated>2024-01-02</updated></entry></feed>')
  WHEN 4 THEN concat('<urlset xmlns="http://x"><url><loc>http://h/', page_id, '</loc><lastmod>2024-01-0', page_id % 9 + 1, '</lastmod><changefreq>daily</changefreq><priority>0.5</priority></url><url><loc>http://h/b</loc></url><url><priority>1</priority></url></urlset>')
  WHEN 6 THEN '<urlset><a><b><url><priority>0.1</priority><loc>http://h/deep</loc></url></b></a></urlset>'
  WHEN 7 THEN concat('<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns="http://purl.org/rss/1.0/"><channel/><item><title>R</title><link>', replace(url, '&', '&amp;'), '</link></item></rdf:RDF>') ELSE '<urlset></urlset>' END AS xml FROM pages) feeds"""

@archive("""SELECT page_id, 'sitemap' AS kind, 'http://h/s' || page_id || '.xml' AS loc, NULL AS title, NULL AS lastmod, NULL AS changefreq, NULL AS priority FROM pages WHERE page_id % 8 = 1
  UNION ALL SELECT page_id, 'rss', 'http://h/p', 'T' || page_id, 'Mon', NULL, NULL FROM pages WHERE page_id % 8 = 2 UNION ALL SELECT page_id, 'atom', 'http://h/a', 'A' || page_id, '2024-01-02', NULL, NULL FROM pages WHERE page_id % 8 = 3
  UNION ALL SELECT page_id, 'url', 'http://h/' || page_id, NULL, '2024-01-0' || (page_id % 9 + 1), 'daily', '0.5' FROM pages WHERE page_id % 8 = 4 UNION ALL SELECT page_id, 'url', 'http://h/b', NULL, NULL, NULL, NULL FROM pages WHERE page_id % 8 = 4
  UNION ALL SELECT page_id, 'url', 'http://h/deep', NULL, NULL, NULL, '0.1' FROM pages WHERE page_id % 8 = 6 UNION ALL SELECT page_id, 'rss', url, 'R', NULL, NULL, NULL FROM pages WHERE page_id % 8 = 7""")
def parse_sitemap(spark, d):
    """The entries of sitemaps and feeds in every form, by a table function."""
    tables.register(spark)
    return spark.sql("SELECT f.page_id, e.* FROM {feeds} f, LATERAL sitemap_rows(f.xml) e", feeds=_from(spark, d, _FEEDS))


@archive("SELECT kind, count(*) AS n, count(DISTINCT ref) AS refs FROM (SELECT page_id, unnest(['link', 'img', 'srcset', 'img', 'script', 'meta', 'img']) AS kind, unnest(['/css/' || page_id % 7 || '.css', 'img/' || page_id % 5 || '.png', 'a.png 1x 3w,b.png, gone.gif  2x', 'gone.gif', '//cdn.example.net/' || page_id % 3 || '.js', 'https://x.example.org/' || page_id % 4 || '.jpg', 'bare.png']) AS ref FROM pages) r GROUP BY kind")
def asset_kinds(spark, d):
    """References by kind, counted in SQL over a table function of pages."""
    tables.register(spark)
    pages = _from(spark, d, _REFERRING).select(F.expr("replace(html, '<article>', concat('<article>', decoy, markup))").alias("html"))
    return spark.sql("SELECT a.kind, count(*) AS n, count(DISTINCT a.ref) AS refs FROM {pages} p, LATERAL asset_refs(p.html) a GROUP BY a.kind", pages=pages)


def crawl(links: DataFrame, roots: DataFrame) -> DataFrame:
    """All addresses that sitemaps list, with the sitemap that lists them as `source`, from the roots down; none is left out as a repetition.

    links has (source, url, kind), kind `sitemap` for what is itself a sitemap; each sitemap is read once, at the first
    level that lists it. Levels are checkpointed, each once, so a level costs one join with the links and one with what was seen.
    """
    shared_dir(links.sparkSession)
    level = reached = roots.select("source").distinct().checkpoint()
    while not level.isEmpty():
        below = links.where("kind = 'sitemap'").join(level, "source", "left_semi").select(F.col("url").alias("source")).distinct()
        level = below.join(reached, "source", "left_anti").checkpoint()
        reached = reached.union(level)
    return links.where("kind <> 'sitemap'").join(reached, "source", "left_semi").select("source", "url")


#: Which sitemap lists what: a tree of sitemaps by page with links back to its root, and the pages' own URLs; made up.
_LISTED = """(SELECT CAST(floor(page_id / 3) AS BIGINT) AS source, CAST(page_id AS STRING) AS url, 'sitemap' AS kind FROM pages WHERE page_id > 0 UNION ALL SELECT page_id, '0', 'sitemap' FROM pages WHERE page_id % 5 = 1
  UNION ALL SELECT CAST(floor(page_id / 2) AS BIGINT), url, 'url' FROM pages UNION ALL SELECT page_id, 'http://shared.example.org/', 'url' FROM pages WHERE page_id % 4 = 0) listed"""


@archive(f"""WITH RECURSIVE l AS (SELECT * FROM {_LISTED.replace('STRING', 'VARCHAR')}), seen AS (SELECT CAST(0 AS BIGINT) AS node UNION SELECT CAST(l.url AS BIGINT) FROM l JOIN seen s ON l.source = s.node WHERE l.kind = 'sitemap')
  SELECT l.source, l.url FROM l WHERE l.kind = 'url' AND l.source IN (SELECT node FROM seen)""")
def sitemap_bfs(spark, d):
    links = _from(spark, d, _LISTED).withColumn("source", F.col("source").cast("string"))
    return crawl(links, spark.range(1).select(F.col("id").cast("string").alias("source"))).withColumn("source", F.col("source").cast("long"))


#: Links to sitemaps in every form of address; made up.
_LINKS = """(SELECT page_id, url, concat('<link rel="sitemap" type="x" href="/s', page_id, '.xml"><link href=''/t.xml'' rel=''sitemap''><link rel="icon" href="/i.ico"><link rel="sitemap" href="https://other.example.org/m.xml">',
  '<link href="//cdn.example.net/c.xml" rel="sitemap"><link rel="sitemap" href="r.xml">') AS h FROM (SELECT page_id, concat(regexp_extract(url, '^([^:/?#]+://[^/?#]*)', 1), '/') AS url FROM pages) p) links"""
#: Patterns of links to sitemaps.
_FORMS = ("(?i)<link[^>]*rel=[\"']sitemap[\"'][^>]*href=[\"']([^\"']+)[\"']", "(?i)<link[^>]*href=[\"']([^\"']+)[\"'][^>]*rel=[\"']sitemap[\"']")


@archive(f"""SELECT DISTINCT page_id, CASE WHEN l LIKE 'https://%' THEN l WHEN l LIKE '//%' THEN regexp_extract(url, '^[^/]*') || l WHEN l LIKE '/%' THEN rtrim(url, '/') || l ELSE url || l END AS sitemap
  FROM (SELECT page_id, url, unnest(['/s' || page_id || '.xml', '/t.xml', 'https://other.example.org/m.xml', '//cdn.example.net/c.xml', 'r.xml']) AS l FROM {_LINKS}) t""")
def html_sitemap_links(spark, d):
    """Addresses of <link rel="sitemap">, attributes in either order, against the page's address."""
    found = F.array_distinct(F.concat(*[F.regexp_extract_all("h", F.lit(f), 1) for f in _FORMS]))
    links = _from(spark, d, _LINKS).select("page_id", "url", F.explode(found).alias("l"))
    whole = F.when(F.col("l").startswith("//"), F.concat(F.regexp_extract("url", "^([^:/?#]+:)", 1), "l")).otherwise(U.normalized(F.col("url"), F.col("l")))
    return links.select("page_id", whole.alias("sitemap")).distinct()


#: URLs as feeds list them: some with titles, some with empty ones, some with none; made up.
_TITLED = "(SELECT page_id, html, CASE page_id % 3 WHEN 0 THEN concat('T', page_id) WHEN 1 THEN '' END AS title FROM pages) titled"


@archive(f"""SELECT page_id, CASE WHEN nth <= 50 AND found <> '' THEN found ELSE title END AS title FROM (SELECT page_id, title, trim(regexp_extract(html, '<title[^>]*>([^<]+)</title>', 1, 'i')) AS found,
  CASE WHEN coalesce(title, '') = '' THEN row_number() OVER (PARTITION BY coalesce(title, '') = '' ORDER BY page_id) END AS nth FROM {_TITLED}) t""")
def enrich_titles(spark, d):
    """URLs with their titles; the first 50 of those without one get it from the markup. The limit is the feature."""
    return titled(_from(spark, d, _TITLED), "page_id", 50)


def titled(urls: DataFrame, order: str, most: int) -> DataFrame:
    """(order, title): titles of urls (order, html, title), with those of the first `most` without one, null or empty, from their markup; order has to be unique."""
    few = urls.where("coalesce(title, '') = ''").orderBy(order).limit(most)
    found = few.select(order, F.nullif(F.trim(F.regexp_extract("html", "(?i)<title[^>]*>([^<]+)</title>", 1)), F.lit("")).alias("found"))
    return urls.select(order, "title").join(F.broadcast(found), order, "left").select(order, F.coalesce("found", "title").alias("title"))


# Markup and stylesheets with local files in the place of addresses.


def rewritten(pages: DataFrame, found: DataFrame, local: DataFrame, text: str) -> DataFrame:
    """(page_id, text): each matched piece of a text becomes its new form where its address has a local file.

    found has (page_id, piece, before, absolute, after), local (absolute, local): piece becomes before + local + after.
    The files of a page come together, never those of several; replacing is a fold over the distinct pieces, long ones first.
    """
    new = found.join(local, "absolute").select("page_id", F.struct(F.length("piece").alias("n"), "piece", F.concat("before", "local", "after").alias("new")).alias("change"))
    by_page = new.groupBy("page_id").agg(F.sort_array(F.collect_set("change"), False).alias("changes"))
    put = F.when(F.col("changes").isNull(), F.col(text)).otherwise(F.aggregate("changes", F.col(text), lambda acc, c: F.replace(acc, c["piece"], c["new"])))
    return pages.join(by_page, "page_id", "left").select("page_id", put.alias(text))


_CSS = """(SELECT page_id, concat(regexp_extract(url, '^([^:/?#]+://[^/?#]*)', 1), '/css') AS base, concat('a{background:url("img/', page_id % 5, '.png")} b{src:URL(/f.woff)} c{x:url(data:a)} d{y:url(''img/', page_id % 5, '.png'')} e{z:url( gone.gif )} f{w:url("//cdn.example.net/q.svg")}') AS css FROM pages) sheets"""
_URL = "(?i)url\\([\"']?[^\"')]+[\"']?\\)"


@archive(f"""SELECT page_id, replace(replace(replace(replace(css, 'url("img/' || page_id % 5 || '.png")', 'url(assets/' || page_id % 5 || '.png)'), 'url(''img/' || page_id % 5 || '.png'')', 'url(assets/' || page_id % 5 || '.png)'),
  'URL(/f.woff)', 'url(assets/f.woff)'), 'url("//cdn.example.net/q.svg")', 'url(assets/q.svg)') AS css FROM {_CSS}""")
def css_rewrite(spark, d):
    """Each url() whose file was fetched becomes that file; data, and what was not fetched, stays."""
    sheets = _from(spark, d, _CSS)
    piece = F.explode(F.array_distinct(F.regexp_extract_all("css", F.lit(f"({_URL})"), 1))).alias("piece")
    found = sheets.select("page_id", "base", piece).withColumn("ref", U.stripped(F.regexp_extract("piece", "\\([\"']?([^\"')]+)[\"']?\\)", 1))).where("ref <> '' and not startswith(ref, 'data:')")
    found = found.select("page_id", "piece", F.lit("url(").alias("before"), U.normalized(F.col("base"), F.col("ref")).alias("absolute"), F.lit(")").alias("after"))
    local = found.select("absolute").distinct().where("not endswith(absolute, '.gif')").select("absolute", F.concat(F.lit("assets/"), U.file_name(F.col("absolute"))).alias("local"))
    return rewritten(sheets, found, local, "css")


#: Pages with references in their articles, and decoys; made up.
_REFERRING = """(SELECT page_id, regexp_extract(url, '^([^:/?#]+://[^/?#]*)', 1) AS base, html, concat('<!-- <img src="img/', page_id % 5, '.png"> --><script>var t = "//cdn.example.net/', page_id % 3, '.js";</script>') AS decoy,
  concat('<link rel="stylesheet"', CASE WHEN page_id % 2 = 0 THEN ' href="/css/' ELSE '	HREF = "/css/' END, page_id % 7, '.css"><img alt="src" src=''img/', page_id % 5, '.png'' srcset="a.png 1x 3w,b.png, gone.gif  2x">',
  '<script async src="//cdn.example.net/', page_id % 3, '.js"></script><meta property="og:image" content="https://x.example.org/', page_id % 4, '.jpg"><meta name="d" content="words"><img data-src="no.png" src="gone.gif"><img src=bare.png>') AS markup FROM pages) referring"""


@archive(f"""SELECT page_id, replace(html, '<article>', '<article>' || decoy || replace(replace(replace(replace(replace(replace(markup, '"/css/' || page_id % 7 || '.css"', '"assets/' || page_id % 7 || '.css"'), '''img/' || page_id % 5 || '.png''', '''assets/' || page_id % 5 || '.png'''),
  '"a.png 1x 3w,b.png, gone.gif  2x"', '"assets/a.png 1x, assets/b.png, gone.gif 2x"'), '"//cdn.example.net/' || page_id % 3 || '.js"', '"assets/' || page_id % 3 || '.js"'), '"https://x.example.org/' || page_id % 4 || '.jpg"', '"assets/' || page_id % 4 || '.jpg"'), 'src=bare.png', 'src=assets/bare.png')) AS html FROM {_REFERRING}""")
def rewrite_html(spark, d):
    """Addresses in tags become the files that were fetched, where they stand: in any quotes or none, in srcset with their first descriptor; comments and scripts stay."""
    pages = _from(spark, d, _REFERRING).select("page_id", "base", F.expr("replace(html, '<article>', concat('<article>', decoy, markup))").alias("html"))
    absolute = U.absolute(F.col("base"), F.col("ref"))
    local = linked(pages).select(absolute.alias("absolute")).distinct().where("not endswith(absolute, '.gif')").select("absolute", F.concat(F.lit("assets/"), U.file_name(F.col("absolute"))).alias("local"))
    return localised(pages, local)


def linked(pages: DataFrame) -> DataFrame:
    """(page_id, base, kind, at, until, place, ref, descriptor) of the addresses in pages (page_id, base, html), those of srcset one by one; empty ones and data are none."""
    # One pass: the UDF that reads the markup would run again for each branch of a union.
    refs = pages.select("page_id", "base", F.inline(H.asset_refs("html")))
    entries = F.when(F.col("kind") == "srcset", F.split("ref", ",")).otherwise(F.array("ref"))
    one = refs.select("page_id", "base", "kind", "at", "until", F.posexplode(entries).alias("place", "ref"))
    parts = srcset_entry(F.col("ref"))
    own = [F.when(F.col("kind") == "srcset", part).otherwise(other).alias(name) for name, part, other in zip(("ref", "descriptor"), parts, (F.col("ref"), F.lit("")), strict=True)]
    return one.select("page_id", "base", "kind", "at", "until", "place", *own).where("trim(ref) <> '' and not startswith(ref, 'data:')")


def localised(pages: DataFrame, local: DataFrame, refs: DataFrame | None = None) -> DataFrame:
    """(page_id, html) with the addresses of pages (page_id, base, html) replaced by their files in local (absolute, local); what has none keeps its address.

    The references of a page come together, never those of several; page_id has to be unique. refs is linked(pages), where it is at hand.
    """
    found = (linked(pages) if refs is None else refs).withColumn("absolute", U.absolute(F.col("base"), F.col("ref"))).join(local, "absolute", "left").where("local is not null or kind = 'srcset'")
    entry = F.struct("place", F.trim(F.concat(F.coalesce("local", "ref"), F.lit(" "), "descriptor")).alias("entry"))
    by_value = found.groupBy("page_id", "at", "until").agg(F.array_sort(F.collect_list(entry)).alias("entries"))
    change = F.struct("at", "until", F.array_join(F.col("entries.entry"), ", ").alias("new"))
    by_page = by_value.groupBy("page_id").agg(F.array_sort(F.collect_list(change)).alias("changes"))
    return pages.join(by_page, "page_id", "left").select("page_id", H.spliced(F.col("html"), F.col("changes")).alias("html"))


# Listings.

#: When each project was made, and whether it is whole; made up.
_PROJECTS = "(SELECT page_id, url, TIMESTAMP '2024-01-31 18:00:00' - make_interval(0, 0, 0, CAST(page_id % 5 AS INT), CAST(page_id % 24 AS INT), 0, 0) AS modified, page_id % 7 > 0 AS has_index FROM pages) projects"
_MADE = "(SELECT page_id, url, TIMESTAMP '2024-01-31 18:00:00' - to_days(CAST(page_id % 5 AS INTEGER)) - to_hours(CAST(page_id % 24 AS INTEGER)) AS modified, page_id % 7 > 0 AS has_index FROM pages) projects"


@archive(f"SELECT p.page_id, CASE WHEN EXISTS (SELECT 1 FROM {_MADE} WHERE rtrim(translate(base64(encode(projects.url)), '+/', '-_'), '=') = rtrim(translate(base64(encode(p.url)), '+/', '-_'), '=') AND CAST(projects.modified AS DATE) = DATE '2024-01-31') THEN 'skipped' ELSE 'queued' END AS status FROM pages p")
def skip_cloned_today(spark, d):
    """Pages whose project was made on the as-of day, 2024-01-31, are skipped."""
    today = _from(spark, d, _PROJECTS).where("CAST(modified AS DATE) = DATE '2024-01-31'").select(U.job_id(F.col("url")).alias("job")).distinct().withColumn("made", F.lit(True))
    return read(spark, d, "pages").withColumn("job", U.job_id(F.col("url"))).join(today, "job", "left").select("page_id", F.when(F.col("made"), "skipped").otherwise("queued").alias("status"))


@archive(f"""SELECT CASE WHEN page_id % 4 > 0 THEN base64(encode(url)) ELSE '#' || page_id END AS name, CASE WHEN page_id % 4 > 0 THEN url ELSE 'Unknown URL' END AS url,
  '/cloned/' || CASE WHEN page_id % 4 > 0 THEN base64(encode(url)) ELSE '#' || page_id END || '/index.html' AS preview_url, CAST(epoch(modified) AS BIGINT) AS created FROM {_MADE} WHERE has_index""")
def list_projects(spark, d):
    """Folders with an index.html and the URL that their name encodes, newest first."""
    rows = _from(spark, d, _PROJECTS).where("has_index").withColumn("name", F.when(F.col("page_id") % 4 > 0, U.base64_url(F.col("url"))).otherwise(F.concat(F.lit("#"), F.col("page_id"))))
    shown = rows.select("name", F.coalesce(U.from_base64(F.col("name")), F.lit("Unknown URL")).alias("url"), F.concat(F.lit("/cloned/"), "name", F.lit("/index.html")).alias("preview_url"), F.unix_timestamp("modified").alias("created"))
    return shown.orderBy(F.desc("created"), "name")


def children(files: DataFrame, path: str = "") -> DataFrame:
    """(project, name, path, is_dir, size, modified) of what lies right below a folder of each project, by name; files has (project, path, size, modified)."""
    start = f"{path.strip('/')}/" if path.strip("/") else ""
    below = files.where(F.col("path").startswith(start)).withColumn("rest", F.expr(f"substr(path, {len(start) + 1})")).where("rest <> ''")
    name = F.substring_index("rest", "/", 1)
    rows = below.select("project", name.alias("name"), F.concat(F.lit(start), name).alias("path"), F.col("rest").contains("/").alias("is_dir"), "size", "modified")
    out = rows.groupBy("project", "name", "path", "is_dir").agg(F.max(F.when(F.col("is_dir"), 0).otherwise(F.col("size"))).alias("size"), F.max("modified").alias("modified"))
    return out.orderBy("project", "name")


#: Files of a project (its host) by path; made up.
_FILES = """(SELECT page_id, regexp_extract(url, '^[^:/?#]+://([^/?#]*)', 1) AS project, concat(CASE page_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'css/' WHEN 2 THEN 'img/big/' ELSE 'img/' END, page_id % 6, '.dat') AS path, page_id % 1000 AS size, page_id AS modified FROM pages) files"""


@archive(f"""SELECT project, split_part(path, '/', 1) AS name, split_part(path, '/', 1) AS path, instr(path, '/') > 0 AS is_dir, max(CASE WHEN instr(path, '/') > 0 THEN 0 ELSE size END) AS size, max(modified) AS modified FROM {_FILES} GROUP BY 1, 2, 3, 4""")
def list_dir(spark, d):
    return children(_from(spark, d, _FILES))


@archive(f"""SELECT project, split_part(substr(path, 5), '/', 1) AS name, 'img/' || split_part(substr(path, 5), '/', 1) AS path, instr(substr(path, 5), '/') > 0 AS is_dir, max(CASE WHEN instr(substr(path, 5), '/') > 0 THEN 0 ELSE size END) AS size, max(modified) AS modified FROM {_FILES} WHERE path LIKE 'img/%' GROUP BY 1, 2, 3, 4""")
def list_subdir(spark, d):
    return children(_from(spark, d, _FILES), "img")


#: Captures with their time and view; made up.
_SHOTS = """(SELECT doc_id, text AS image, concat(source, ': p/', doc_id % 7, '*') AS page, concat('http://', source, '/') AS url, TIMESTAMP '2024-01-30 07:08:09.012' AS taken,
  CASE doc_id % 3 WHEN 0 THEN NULL WHEN 1 THEN 1920 ELSE 375 END AS width, CASE doc_id % 3 WHEN 0 THEN NULL WHEN 1 THEN 1080 ELSE 667 END AS height FROM documents) shots"""


def shot_path(page: Column, at: Column, width: Column, height: Column) -> Column:
    """images/<clean page name>/<day>/<time to the millisecond>_<view>.png."""
    view = F.coalesce(F.concat(width.cast("string"), F.lit("x"), height.cast("string")), F.lit("fullpage"))
    return F.concat(F.lit("images/"), U.page_name(page), F.date_format(at, "/yyyy-MM-dd/"), F.date_format(at, "yyyyMMdd_HHmmss_SSS"), F.lit("_"), view, F.lit(".png"))


_CLEAN = "coalesce(nullif(trim(regexp_replace(page, '[^\\p{L}\\p{N} _-]', '', 'g')), ''), 'unnamed')"
_SHOWN = f"'images/' || {_CLEAN} || strftime(taken, '/%Y-%m-%d/%Y%m%d_%H%M%S_') || '012_' || CASE WHEN width IS NULL THEN 'fullpage' ELSE width || 'x' || height END || '.png'"


@archive(f"SELECT doc_id, {_SHOWN} AS path, strftime(taken, '%Y-%m-%dT%H:%M:%S.012') AS captured, CAST(octet_length(encode(coalesce(image, ''))) AS BIGINT) AS size, sha256(image) AS sha256 FROM {_SHOTS}")
def screenshot_path(spark, d):
    """Where a capture goes, and what its metadata says."""
    shots = _from(spark, d, _SHOTS, "documents")
    return shots.select("doc_id", shot_path(F.col("page"), F.col("taken"), F.col("width"), F.col("height")).alias("path"), F.date_format("taken", "yyyy-MM-dd'T'HH:mm:ss.SSS").alias("captured"),
                        F.octet_length(F.coalesce("image", F.lit(""))).cast("long").alias("size"), F.sha2("image", 256).alias("sha256"))


# Names that are given out once.


def numbered(rows: DataFrame, key: list[str], order: str, name: str = "nth", width: int = 1 << 16) -> DataFrame:
    """rows with their place from 0 among those of their key, by a whole-number column: counts by stretches of `order`, then places within a stretch.

    No window is wider than `width` distinct values, however common a key is. Ties in `order` come in any order.
    """
    from pyspark.sql import Window

    rows = rows.withColumn("_stretch", F.floor(F.col(order) / width))
    sizes = rows.groupBy(*key, "_stretch").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*key).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1))
    bases = sizes.select(*key, "_stretch", F.coalesce(before, F.lit(0)).alias("_base"))
    inside = F.row_number().over(Window.partitionBy(*key, "_stretch").orderBy(order)) - 1
    return rows.withColumn("_inside", inside).join(bases, [*key, "_stretch"]).withColumn(name, F.col("_inside") + F.col("_base")).drop("_stretch", "_inside", "_base")


#: The extensions that count as resources.
RESOURCES = ("css", "js", "jpeg", "jpg", "ico", "png", "img", "bmp", "svg", "gif", "javascript", "json", "map", "xml", "woff", "woff2", "ttf", "eot", "webp")


@archive("""SELECT page_id, coalesce(list_contains(['css', 'js', 'jpeg', 'jpg', 'ico', 'png', 'img', 'bmp', 'svg', 'gif', 'javascript', 'json', 'map', 'xml', 'woff', 'woff2', 'ttf', 'eot', 'webp'],
  list_last(string_split(lower(string_split(ref, '?')[1]), '.'))) AND instr(string_split(ref, '?')[1], '.') > 0 AND ref NOT LIKE 'data:%', false) AS valid FROM """ + REFS)
def valid_resource(spark, d):
    """References that end, before a query, with one of the extensions of resources."""
    ok = F.lower(F.substring_index("ref", "?", 1)).rlike(rf"\.({'|'.join(RESOURCES)})$") & ~F.col("ref").startswith("data:")
    return _from(spark, d, REFS).select("page_id", ok.alias("valid"))


#: Views that captures are taken in.
VIEWPORTS = {"mobile": (375, 667), "tablet": (768, 1024), "desktop": (1920, 1080), "desktop_4k": (3840, 2160)}


@archive("""SELECT v.name, v.width, v.height, count(s.doc_id) AS captures, CAST(coalesce(sum(s.n_chars), 0) AS BIGINT) AS size FROM (VALUES ('mobile', 375, 667), ('tablet', 768, 1024), ('desktop', 1920, 1080), ('desktop_4k', 3840, 2160)) AS v(name, width, height)
  LEFT JOIN (SELECT doc_id, n_chars, CASE doc_id % 3 WHEN 1 THEN 1920 WHEN 2 THEN 375 END AS width, CASE doc_id % 3 WHEN 1 THEN 1080 WHEN 2 THEN 667 END AS height FROM documents) s ON s.width = v.width AND s.height = v.height GROUP BY 1, 2, 3""")
def viewport_dim(spark, d):
    """The views that captures are taken in, with the captures of each; whole pages are in none."""
    shots = read(spark, d, "documents").select("doc_id", "n_chars", F.expr("CASE doc_id % 3 WHEN 1 THEN 1920 WHEN 2 THEN 375 END").alias("width"), F.expr("CASE doc_id % 3 WHEN 1 THEN 1080 WHEN 2 THEN 667 END").alias("height"))
    by = shots.groupBy("width", "height").agg(F.count("doc_id").alias("captures"), F.sum("n_chars").alias("size"))
    views = spark.createDataFrame([(k, *v) for k, v in VIEWPORTS.items()], "name string, width int, height int")
    return views.join(by, ["width", "height"], "left").select("name", "width", "height", F.coalesce("captures", F.lit(0)).alias("captures"), F.coalesce("size", F.lit(0)).alias("size"))


def given_names(rows: DataFrame, folder: str, name: str, order: str) -> DataFrame:
    """rows with `given`: their file name in the order of a whole-number column, or the first free one of name1, name2, ... before the first dot.

    A lone extension is the extension of 0. Only a name that comes again takes others than its own, and these begin with
    it, up to the first dot: so names are kin by the shortest of the repeated ones that each begins with, and what has none
    stays as it is. A repeated name without kin gets n with its n-th use; only the others are gone through one after the
    other, by a task for each shortest name, that keeps the names given so far.
    """
    cut = F.substring_index(F.substring_index(name, "?", 1), "#", 1)
    lone = cut.isin(*RESOURCES)
    rows = rows.withColumn("_stem", F.when(lone, "0").otherwise(F.substring_index(cut, ".", 1))).withColumn("_rest", F.when(lone, F.concat(F.lit("."), cut)).otherwise(F.expr(f"substr({_cut(name)}, length(substring_index({_cut(name)}, '.', 1)) + 1)")))
    # A name that ends with its dot has no extension and loses the dot.
    rows = rows.withColumn("_rest", F.when(F.col("_rest") == ".", "").otherwise(F.col("_rest"))).withColumn("_family", F.regexp_replace("_stem", "[0-9]+$", ""))
    kin = [folder, "_family", "_rest"]
    stems = rows.groupBy(*kin, "_stem").agg(F.count("*").alias("_n"))
    begins = F.transform(F.sequence(F.length("_family"), F.length("_stem")), lambda i: F.substring(F.col("_stem"), F.lit(1), i))
    heads = stems.where("_n > 1").select(*kin, F.col("_stem").alias("_head"))
    above = stems.select(*kin, "_stem", F.explode(begins).alias("_head")).join(heads, [*kin, "_head"]).groupBy(*kin, "_stem").agg(F.min("_head").alias("_head"))  # the shortest is the least
    sizes = above.groupBy(*kin, "_head").agg(F.count("*").alias("_stems"))
    ways = above.join(sizes, [*kin, "_head"]).select(*kin, "_stem", "_head", F.when(F.col("_stems") == 1, 1).otherwise(2).alias("_way"))
    rows = rows.join(ways, [*kin, "_stem"], "left").withColumn("_way", F.coalesce("_way", F.lit(0)))
    named = F.concat("_stem", F.when(F.col("_nth") > 0, F.col("_nth").cast("string")).otherwise(""), "_rest")
    plain = rows.where("_way = 0").withColumn("_nth", F.lit(0).cast("long"))
    counted = numbered(rows.where("_way = 1"), [folder, "_stem", "_rest"], order, "_nth")
    kin.append("_head")
    alike = rows.where("_way = 2").repartition(*kin).sortWithinPartitions(*kin, order)
    out = plain.unionByName(counted).withColumn("given", named)
    columns = [c for c in out.columns if not c.startswith("_")]

    def give(frames):
        last, used = None, set()
        for frame in frames:
            new = []
            for key, stem, rest in zip(zip(*(frame[k] for k in kin), strict=True), frame["_stem"], frame["_rest"], strict=True):
                if key != last:
                    last, used, free = key, set(), {}
                n = free.get(stem, 0)
                while f"{stem}{n or ''}{rest}" in used:
                    n += 1
                free[stem] = n
                new.append(f"{stem}{n or ''}{rest}")
                used.add(new[-1])
            yield frame.assign(given=new)[columns]

    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.select(*columns).schema.fields)
    return out.select(*columns).unionByName(alike.select(*[c for c in columns if c != "given"], "_family", "_head", "_stem", "_rest").mapInPandas(give, shape))


def _cut(name: str) -> str:
    return f"substring_index(substring_index({name}, '?', 1), '#', 1)"


_NTH = "(SELECT page_id, file, CAST(row_number() OVER (PARTITION BY file ORDER BY page_id) - 1 AS VARCHAR) AS nth FROM (SELECT page_id, " + _FILE + " AS file FROM " + REFS + ") r) n"


@archive(f"SELECT page_id, CASE WHEN nth = '0' THEN file ELSE regexp_replace(file, '^([^.]*)', '\\1' || nth) END AS name FROM {_NTH}")
def unique_filenames(spark, d):
    """Names as given out one after the other in one folder."""
    refs = _from(spark, d, REFS).select("page_id", F.lit(0).alias("folder"), U.file_name(F.col("ref")).alias("file"))
    return given_names(refs, "folder", "file", "page_id").select("page_id", F.col("given").alias("name"))


@archive()
def unique_filenames_exact(spark, d):
    """The same in eight folders, with names that number each other; tested against a plain restatement."""
    odd = "element_at(array('a.css', 'a1.css', 'css', '.css', 'b.min.js', 'b.min.js?v=2', 'c', 'a.css'), cast(page_id % 8 as int) + 1)"
    refs = read(spark, d, "pages").select((F.col("page_id") % 3).alias("folder"), "page_id", F.expr(odd).alias("file"))
    return given_names(refs, "folder", "file", "page_id").select("folder", "page_id", F.col("given").alias("name"))


# Small documents and paths.


def relative_path(directory: Column, name: Column) -> Column:
    """A file below its project, as markup names it: folder and name with forward slashes, no empty parts."""
    parts = F.filter(F.split(F.translate(F.concat_ws("/", directory, name), "\\", "/"), "/"), lambda x: (x != "") & (x != "."))
    return F.array_join(parts, "/")


@archive(f"""SELECT page_id, array_to_string(list_filter(string_split(replace(concat_ws('/', CASE page_id % 3 WHEN 0 THEN 'assets' || chr(92) || 'img' WHEN 1 THEN '' ELSE './css//' END, {_FILE}), chr(92), '/'), '/'), lambda x: x <> '' AND x <> '.'), '/') AS path FROM {REFS}""")
def local_paths(spark, d):
    refs = _from(spark, d, REFS).withColumn("directory", F.element_at(F.array(F.lit("assets\\img"), F.lit(""), F.lit("./css//")), (F.col("page_id") % 3 + 1).cast("int")))
    return refs.select("page_id", relative_path(F.col("directory"), U.file_name(F.col("ref"))).alias("path"))


#: Levels of messages by their type; made up.
_LOG = "(SELECT event_id, CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'view' THEN 'debug' WHEN 'click' THEN 'info' WHEN 'signup' THEN 'Success' ELSE 'TRACE' END AS level FROM events) log"


@archive(f"SELECT event_id, level FROM {_LOG} WHERE upper(level) NOT IN ('TRACE', 'DEBUG')")
def log_levels(spark, d):
    """Messages at INFO and above."""
    from weftline.streaming.jobs import at_least

    return at_least(_from(spark, d, _LOG, "events"))


@archive("""SELECT '{"total":' || count(*) || ',"successful":' || count(*) FILTER (event_type <> 'error') || ',"failed":' || count(*) FILTER (event_type = 'error') || ',"success_rate":' || round(100.0 * count(*) FILTER (event_type <> 'error') / count(*), 2)
  || ',"failed_sites":[' || coalesce(array_to_string(list_transform(list_sort(list(DISTINCT user_id) FILTER (event_type = 'error')), lambda x: CAST(x AS VARCHAR)), ','), '') || ']}' AS report FROM events""")
def batch_report(spark, d):
    """A batch as one JSON document."""
    from weftline.sources import files

    return files.batch_report(read(spark, d, "events").select(F.col("user_id").alias("site"), (F.col("event_type") != "error").alias("success")))
