"""URLs, references, markup and stylesheets: extraction, normalising, rewriting and download accounting."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from weftline.functions import html as H
from weftline.functions import urls as U
from weftline.plans.twin import OUTCOMES, REFS, Registry, read

web = Registry()

_PATH = "regexp_replace(regexp_extract(url, '^[^:/?#]+://[^/?#]*([^?#]*)', 1), ';[^/]*$', '')"
_DOMAIN = "regexp_extract(url, '^([^:/?#]+://[^/?#]*)', 1)"
_CLASS = f"""CASE WHEN contains(p, '/category/') OR contains(p, '/categories/') THEN 'categories'
  WHEN contains(p, '/tag/') OR contains(p, '/tags/') THEN 'tags' WHEN contains(p, '/author/') OR contains(p, '/authors/') THEN 'authors'
  WHEN contains(p, '/wp-content/uploads/') OR regexp_matches(p, '\\.(jpg|png|pdf|zip)$') THEN 'media'
  WHEN regexp_matches(p, '/[0-9]{{4}}/[0-9]{{2}}/') THEN 'posts'
  WHEN length(p) - length(replace(p, '/', '')) <= 2 AND NOT ends_with(p, '/') THEN 'pages'
  WHEN length(p) - length(replace(p, '/', '')) >= 3 OR regexp_matches(p, '[0-9]{{4}}') THEN 'posts' ELSE 'pages' END"""
#: Pages with some more URL shapes than the archive has.
_SHAPES = """(SELECT page_id, concat(url, CASE page_id % 9 WHEN 1 THEN '/category/a' WHEN 2 THEN '/tags/b/' WHEN 3 THEN '/author/c' WHEN 4 THEN '/x.JPG'
  WHEN 5 THEN '/2024/05/post' WHEN 6 THEN '///' ELSE '' END) AS url FROM (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS url FROM pages) u) shapes"""


def _shapes(spark, d):
    add = F.expr("CASE page_id % 9 WHEN 1 THEN '/category/a' WHEN 2 THEN '/tags/b/' WHEN 3 THEN '/author/c' WHEN 4 THEN '/x.JPG' WHEN 5 THEN '/2024/05/post' WHEN 6 THEN '///' ELSE '' END")
    return read(spark, d, "pages").select("page_id", F.concat(F.regexp_replace("url", "[?#].*$", ""), add).alias("url"))


def _from(spark, d, text: str, *tables: str):
    """The rows of a SQL table expression over tables of d."""
    frames = {t: read(spark, d, t) for t in tables or ("pages",)}
    body = text.rsplit(" ", 1)[0].strip()[1:-1].replace("{", "{{").replace("}", "}}")
    for t in frames:
        body = body.replace(f"FROM {t}", f"FROM {{{t}}}")
    return spark.sql(body, **frames)


@web(f"SELECT regexp_extract(url, '^[^:/?#]+://([^/?#]*)', 1) AS host, {_CLASS} AS category, count(*) AS n FROM (SELECT url, lower({_PATH}) AS p FROM pages) t GROUP BY ALL")
def categorize_urls(spark, d):
    pages = read(spark, d, "pages").select(F.regexp_extract("url", "^[^:/?#]+://([^/?#]*)", 1).alias("host"), U.url_class(F.col("url")).alias("category"))
    return pages.groupBy("host", "category").agg(F.count("*").alias("n"))


@web(f"SELECT page_id, {_CLASS} AS category FROM (SELECT page_id, lower({_PATH}) AS p FROM {_SHAPES}) t")
def categorize_url_shapes(spark, d):
    return _shapes(spark, d).select("page_id", U.url_class(F.col("url")).alias("category"))


@web(f"SELECT page_id, regexp_replace(url, '/+$', '') AS clean FROM {_SHAPES}")
def clean_url(spark, d):
    return _shapes(spark, d).select("page_id", U.clean_url(F.col("url")).alias("clean"))


_NORMAL = f"""CASE WHEN length(trim(ref)) = 0 THEN ref WHEN starts_with(ref, '//') THEN concat('http:', ref) WHEN regexp_matches(ref, '^https?://') THEN ref
  WHEN starts_with(ref, 'data:') THEN ref WHEN starts_with(ref, '/') THEN concat({_DOMAIN}, ref)
  ELSE concat({_DOMAIN}, regexp_replace(concat('/', CASE WHEN regexp_matches(url, '[?#]') THEN regexp_replace(regexp_extract(url, '^[^:/?#]+://[^/?#]*([^?#]*)', 1), '[^/]*$', '')
    ELSE regexp_extract(url, '^[^:/?#]+://[^/?#]*([^?#]*)', 1) END, '/'), '/+', '/', 'g'), ref) END"""


@web(f"SELECT page_id, {_NORMAL} AS absolute FROM {REFS}")
def normalize_url(spark, d):
    return _from(spark, d, REFS).select("page_id", U.normalized(F.col("url"), F.col("ref")).alias("absolute"))


_FOLDER = "regexp_replace(CASE WHEN regexp_matches(url, '[?#]') THEN regexp_replace(regexp_extract(url, '^[^:/?#]+://[^/?#]*([^?#]*)', 1), '[^/]*$', '') ELSE regexp_extract(url, '^[^:/?#]+://[^/?#]*([^?#]*)', 1) || '/' END, '/+', '/', 'g')"
_ABOVE = f"regexp_replace(regexp_replace({_FOLDER}, '[^/]*/$', ''), '^$', '/')"


@web(f"""SELECT page_id, CASE page_id % 5 WHEN 0 THEN {_DOMAIN} || {_ABOVE} || 'a.css' WHEN 1 THEN {_DOMAIN} || {_FOLDER} || 'b.js' WHEN 2 THEN {_DOMAIN} || {_ABOVE} || 'c.png'
  WHEN 3 THEN {_DOMAIN} || regexp_extract(url || '/', '^[^:/?#]+://[^/?#]*([^?#]*)', 1) || '?q=1' ELSE regexp_replace(url || '/', '#.*$', '') || '#f' END AS absolute FROM pages""")
def normalize_url_dots(spark, d):
    """Relative references with dot segments, by RFC 3986 in an Arrow batch function."""
    refs = read(spark, d, "pages").select("page_id", "url", F.expr("element_at(array('../a.css', './b.js', 'x/../../c.png', '?q=1', '#f'), cast(page_id % 5 as int) + 1)").alias("ref"))
    return refs.select("page_id", U.absolute(F.col("url"), F.col("ref")).alias("absolute"))


@web(f"SELECT page_id, {_DOMAIN} AS domain FROM pages")
def get_domain(spark, d):
    return read(spark, d, "pages").select("page_id", U.domain(F.col("url")).alias("domain"))


@web("SELECT page_id, base64(encode(url)) AS folder FROM pages")
def project_folder(spark, d):
    return read(spark, d, "pages").select("page_id", U.base64_url(F.col("url")).alias("folder"))


@web("SELECT page_id, rtrim(translate(base64(encode(url)), '+/', '-_'), '=') AS job FROM pages")
def job_id(spark, d):
    return read(spark, d, "pages").select("page_id", U.job_id(F.col("url")).alias("job"))


@web("SELECT page_id, url AS decoded FROM pages")
def decode_url(spark, d):
    return read(spark, d, "pages").select("page_id", U.from_base64(U.base64_url(F.col("url"))).alias("decoded"))


@web(f"""SELECT page_id, translate(ref, '/\\<>:"|?*', '') AS name FROM {REFS}""")
def sanitize(spark, d):
    return _from(spark, d, REFS).select("page_id", U.sanitized(F.col("ref")).alias("name"))


_PARTS = "list_filter(string_split(regexp_replace(url, '^[^:/?#]+://', ''), '/'), lambda x: x <> '' AND x <> '.')"


@web(f"""SELECT page_id, array_to_string(list_transform(CASE WHEN len({_PARTS}) > 2 THEN ({_PARTS})[2:len({_PARTS}) - 1] ELSE [] END, lambda x: translate(x, '/\\<>:"|?*', '')), '/') AS directory FROM {_SHAPES}""")
def directory_structure(spark, d):
    return _shapes(spark, d).select("page_id", U.directory(F.col("url")).alias("directory"))


_FILE = "coalesce(nullif(regexp_extract(regexp_replace(string_split(string_split(ref, '?')[1], '#')[1], '/+$', ''), '([^/]*)$', 1), ''), 'index.html')"


@web(f"SELECT page_id, {_FILE} AS file FROM {REFS}")
def url_filename(spark, d):
    return _from(spark, d, REFS).select("page_id", U.file_name(F.col("ref")).alias("file"))


@web("SELECT doc_id, coalesce(nullif(trim(regexp_replace(source || ' ' || text, '[^\\p{L}\\p{N} _-]', '', 'g')), ''), 'unnamed') AS page FROM documents")
def clean_page_name(spark, d):
    return read(spark, d, "documents").select("doc_id", U.page_name(F.concat("source", F.lit(" "), "text")).alias("page"))


@web(f"SELECT page_id, CASE WHEN regexp_matches(ref, '^https?://') THEN ref ELSE concat('https://', ref) END AS url FROM {REFS}")
def ensure_scheme(spark, d):
    return _from(spark, d, REFS).select("page_id", U.ensure_scheme(F.col("ref")).alias("url"))


@web("SELECT page_id, sha256(html) AS sha256 FROM pages")
def content_hash(spark, d):
    return read(spark, d, "pages").select("page_id", F.sha2("html", 256).alias("sha256"))


@web("SELECT page_id, trim(regexp_extract(html, '(?i)<title[^>]*>([^<]+)</title>', 1)) AS title FROM pages")
def page_titles(spark, d):
    return read(spark, d, "pages").select("page_id", F.trim(F.regexp_extract("html", "(?i)<title[^>]*>([^<]+)</title>", 1)).alias("title"))


@web("SELECT page_id, url, length(html) AS n_chars FROM pages WHERE html IS NOT NULL")
def scan_pages(spark, d):
    return read(spark, d, "pages").where("html is not null").select("page_id", "url", F.length("html").alias("n_chars"))


# References and elements, by the structure of pages.

#: Markup that the archive's pages lack, put into their articles: references, and decoys in a comment and a script.
_DECOY = """concat('<!-- <img src="no', page_id % 5, '.png"><link href="no.css"> --><script>var t = ''<img src="img/', page_id % 5, '.png">'';</script>')"""
_MARKUP = """concat('<link rel="stylesheet" href="/css/', page_id % 7, '.css"><IMG alt="src" SRC = ''img/', page_id % 5, '.png'' srcset="a', page_id, '.png 1x,  b.png 2x 9w , c.png"><script async	src="//cdn.example.net/',
  page_id % 3, '.js"></script><meta property="og:image" content="https://x.example.org/', page_id % 4, '.jpg?a=1&amp;b=2"><meta name="d" content="words"><img data-src="no.png" srcset="no.png 1x"><script src=plain.js></script>')"""
_FILLED = f"(SELECT page_id, url, replace(html, '<article>', concat('<article>', {_DECOY}, {_MARKUP})) AS html FROM pages) filled"


@web("""SELECT page_id, unnest(['link', 'img', 'srcset', 'script', 'script', 'meta']) AS kind, unnest(['/css/' || page_id % 7 || '.css', 'img/' || page_id % 5 || '.png', 'a' || page_id || '.png 1x,  b.png 2x 9w , c.png',
  '//cdn.example.net/' || page_id % 3 || '.js', 'plain.js', 'https://x.example.org/' || page_id % 4 || '.jpg?a=1&b=2']) AS ref FROM pages""")
def extract_assets(spark, d):
    """References of link, img, script and meta elements; comments and scripts are no markup."""
    return _from(spark, d, _FILLED).select("page_id", F.inline(H.asset_refs("html"))).select("page_id", "kind", "ref")


def srcset_entry(entry):
    """The address and the first descriptor, empty where there is none, of an entry of a srcset attribute."""
    entry = U.stripped(entry)
    return F.regexp_extract(entry, r"^(\S+)", 1), F.regexp_extract(entry, r"^\S+\s+(\S+)", 1)


def srcset(refs):
    """(page_id, at, until, place, ref, descriptor) for the entries of srcset attributes: an address and its first descriptor, empty where there is none. refs has (page_id, at, until, ref)."""
    entries = refs.select("page_id", "at", "until", F.posexplode(F.split("ref", ",")).alias("place", "entry")).where(U.stripped(F.col("entry")) != "")
    ref, descriptor = srcset_entry(F.col("entry"))
    return entries.select("page_id", "at", "until", "place", ref.alias("ref"), descriptor.alias("descriptor"))


@web("SELECT page_id, 'a' || page_id || '.png 1x, b.png 2x, c.png' AS srcset FROM pages")
def srcset_parse(spark, d):
    """The srcset of each image in its normal form: each address with the first of its descriptors."""
    refs = _from(spark, d, _FILLED).select("page_id", F.inline(H.asset_refs("html"))).where("kind = 'srcset'")
    entry = F.struct("place", F.trim(F.concat("ref", F.lit(" "), "descriptor")).alias("entry"))
    by = srcset(refs).groupBy("page_id", "at").agg(F.array_sort(F.collect_list(entry)).alias("entries"))
    return by.select("page_id", F.array_join(F.col("entries.entry"), ", ").alias("srcset"))


_CSS = """concat('a{background:url("img/', page_id % 5, '.png")} b{src:URL(f.woff)} c{x:url(data:a)} d{y:url(''img/', page_id % 5, '.png'')}')"""
_URL = "(?i)url\\([\"'']?([^\"'')]+)[\"'']?\\)"


@web(f"SELECT page_id, u AS ref FROM (SELECT page_id, unnest(regexp_extract_all({_CSS}, '{_URL}', 1)) AS u FROM pages) t WHERE NOT starts_with(u, 'data:')")
def css_urls(spark, d):
    """Addresses in the stylesheets of pages, which get some more rules."""
    styled = _from(spark, d, f"(SELECT page_id, replace(html, '</style>', concat({_CSS}, '</style>')) AS html FROM pages) styled")
    css = F.array_join(F.regexp_extract_all("html", F.lit("(?is)<style[^>]*>(.*?)</style>"), 1), "\n")
    found = styled.select("page_id", F.explode(F.regexp_extract_all(css, F.lit(_URL.replace("''", "'")), 1)).alias("ref"))
    return found.select("page_id", U.stripped(F.col("ref")).alias("ref")).where("not startswith(ref, 'data:')")


@web("SELECT page_id, unnest(regexp_extract_all(html, '(?is)<style[^>]*>(.*?)</style>', 1)) AS css FROM pages")
def inline_css(spark, d):
    return read(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit("(?is)<style[^>]*>(.*?)</style>"), 1)).alias("css"))


#: Pages with an element inside another of its kind, and a selector for each.
_NESTED = """(SELECT page_id, replace(html, '<div class="ad">', '<div class="ad"><div>in</div>') AS html, CASE page_id % 7 WHEN 0 THEN 'article' WHEN 1 THEN '.ad' WHEN 2 THEN '//footer' WHEN 3 THEN '#none'
  WHEN 4 THEN 'body > nav ul' WHEN 5 THEN '//div[@class="ad"]/div[last()]' ELSE '???' END AS selector FROM pages) nested"""
_PART = """CASE page_id % 7 WHEN 0 THEN regexp_extract(html, '(?is)<article>.*?</article>') WHEN 1 THEN regexp_extract(html, '(?is)<div class="ad"><div>in</div>.*?</div>') WHEN 2 THEN regexp_extract(html, '(?is)<footer>.*?</footer>')
  WHEN 4 THEN regexp_extract(html, '(?is)<ul>.*?</ul>') WHEN 5 THEN '<div>in</div>' END"""


@web(f"""SELECT page_id, CASE WHEN part IS NULL THEN NULL WHEN selector LIKE '//%' THEN 'xpath' ELSE 'css' END AS kind, '<html><body>' || part || '</body></html>' AS content,
  CASE WHEN part IS NULL THEN 'Could not find element with selector ''' || selector || '''. Tried both CSS and XPath. Please check your selector.' END AS error FROM (SELECT page_id, selector, {_PART} AS part FROM {_NESTED}) t""")
def extract_content(spark, d):
    """A page cut down to the first element for its selector, read as CSS, else as XPath; what is said where neither finds one."""
    return _from(spark, d, _NESTED).select("page_id", H.content(F.col("html"), F.col("selector")).alias("c")).select("page_id", "c.*")


_PLAIN = "replace(replace(replace(array_to_string(list_transform(string_split_regex(regexp_extract(html, '{0}'), '(?s)<[^>]*>'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), ''), '&copy;', '©'), '&middot;', '·'), '&amp;', '&')"
_SOUGHT = {"article": "(?is)<article\\b[^>]*>.*?</article>", "body nav": "(?is)<nav\\b[^>]*>.*?</nav>", "div.ad": '(?is)<div class="ad">.*?</div>', "footer, #none": "(?is)<footer>.*?</footer>"}


@web("SELECT page_id, array_to_string(list_filter([" + ", ".join(f"CASE WHEN length({_PLAIN.format(p)}) > 100 THEN '{n}' END" for n, p in _SOUGHT.items()) + "], lambda x: x IS NOT NULL), '; ') AS found FROM pages")
def detect_selector(spark, d):
    """Of some selectors those that find an element with more than 100 characters of text."""
    names = F.array(*map(F.lit, [*_SOUGHT, "#none", "a[", "script"]))
    return read(spark, d, "pages").select("page_id", F.array_join(H.detected("html", names), "; ").alias("found"))


# Filters on references.


@web(f"SELECT page_id, ref FROM {REFS} WHERE NOT starts_with(ref, 'data:') AND length(trim(ref)) > 0")
def filter_data_uri(spark, d):
    return _from(spark, d, REFS).where("not startswith(ref, 'data:') and length(trim(ref)) > 0").select("page_id", "ref")


@web("SELECT page_id, contains(lower(CASE page_id % 3 WHEN 0 THEN 'Text/HTML; charset=utf-8' WHEN 1 THEN 'image/png' ELSE 'application/xhtml+xml' END), 'html') AS is_html FROM pages")
def is_html(spark, d):
    kind = F.expr("CASE page_id % 3 WHEN 0 THEN 'Text/HTML; charset=utf-8' WHEN 1 THEN 'image/png' ELSE 'application/xhtml+xml' END")
    return read(spark, d, "pages").select("page_id", F.lower(kind).contains("html").alias("is_html"))


# The network log, and joins with it.

_MESSAGE = """CASE WHEN page_id % 6 = 5 THEN '{broken' WHEN page_id % 6 = 4 THEN '{"message":{}}'
  ELSE concat('{"message":{"params":{"request":{"url":"', url, '"}}}}') END"""


@web("SELECT DISTINCT url FROM pages WHERE page_id % 6 < 4")
def network_log_urls(spark, d):
    found = F.get_json_object(F.expr(_MESSAGE), "$.message.params.request.url")
    return read(spark, d, "pages").select(found.alias("url")).where("url is not null").distinct()


_LOGGED = f"(SELECT DISTINCT {_NORMAL} AS logged FROM {REFS} WHERE page_id % 5 < 3)"


def _normal(spark, d):
    return _from(spark, d, REFS).withColumn("absolute", U.normalized(F.col("url"), F.col("ref")))


@web(f"SELECT page_id FROM {REFS} WHERE {_NORMAL} IN (SELECT logged FROM {_LOGGED} l)")
def network_semi(spark, d):
    refs = _normal(spark, d)
    log = refs.where("page_id % 5 < 3").select(F.col("absolute").alias("logged")).distinct()
    return refs.join(log, F.col("absolute") == F.col("logged"), "left_semi").select("page_id")


_HOSTS = "(SELECT DISTINCT concat('https://log.example.net/get?f=', page_id % 13, '.png') AS logged FROM pages)"


@web(f"SELECT page_id FROM pages p WHERE EXISTS (SELECT 1 FROM {_HOSTS} l WHERE contains(l.logged, concat(p.page_id % 20, '.png')))")
def network_theta(spark, d):
    """File names that occur anywhere in a logged URL."""
    pages = read(spark, d, "pages").select("page_id", F.expr("concat(page_id % 20, '.png')").alias("name"))
    log = read(spark, d, "pages").select(F.expr("concat('https://log.example.net/get?f=', page_id % 13, '.png')").alias("logged"))
    return pages.join(contained(pages, log), "name", "left_semi").select("page_id")


#: Names that share a start and are compared one by one with what holds it; more go into automata of at most AUTOMATON names, for LOGGED URLs at a time.
FEW, AUTOMATON, LOGGED = 8, 50_000, 50_000


def contained(names, log, width: int = 8, few: int = FEW, automaton: int = AUTOMATON, logged: int = LOGGED):
    """The distinct names (name) that are part of a logged URL (logged).

    Every name begins somewhere in the URL that holds it: its first `width` characters, all of a shorter one, meet the
    runs of as many characters of the URLs in an equality join. Where a start is that of few names, each is compared with
    what meets it. The names of a common start become Aho-Corasick automata of a bounded size, and each URL goes through
    each of them once, so that there are as many rows as URLs and finds, not as pairs. The rows are in proportion to the
    characters of the log, and nothing is broadcast unless Spark finds it small.
    """
    names = names.select("name").where("name is not null").distinct().withColumn("start", F.substring("name", 1, width))
    log = log.select("logged").where("logged is not null").distinct()
    # Runs for which there is a name at all: the lengths in use are asked for within the query.
    sizes = names.agg(F.collect_set(F.length("start"))).scalar()
    runs = F.expr("flatten(transform(sizes, n -> transform(sequence(1, greatest(length(logged) - n + 1, 1)), i -> substr(logged, i, n))))")
    grams = log.withColumn("sizes", sizes).where("size(sizes) > 0").select("logged", F.explode(F.array_distinct(runs)).alias("start"))
    common = names.groupBy("start").agg(F.count("*").alias("n")).where(F.col("n") > few)
    some = names.join(common.select("start"), "start", "left_anti").join(grams, "start").where(F.col("logged").contains(F.col("name"))).select("name")
    # Blocks of names by blocks of URLs; a name is in each block of URLs once, and the other way round.
    parts = common.select("start", F.ceil(F.col("n") / automaton).alias("name_parts"))
    met = grams.join(parts, "start")
    url_parts = met.groupBy("start").agg(F.ceil(F.count("*") / logged).alias("url_parts"))
    both = parts.join(url_parts, "start")
    own = lambda text, n: F.pmod(F.xxhash64(text), F.col(n))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    block = ["start", "name_part", "url_part"]
    many = names.join(both, "start").select("start", "name", own("name", "name_parts").alias("name_part"), each("url_parts").alias("url_part"))
    held = met.join(url_parts, "start").select("start", "logged", own("logged", "url_parts").alias("url_part"), each("name_parts").alias("name_part"))
    return some.union(many.groupBy(*block).cogroup(held.groupBy(*block)).applyInArrow(_found, "name string")).distinct()


def _found(names: pa.Table, urls: pa.Table) -> pa.Table:
    """The names of a block that are part of one of its URLs."""
    import ahocorasick

    if not names.num_rows or not urls.num_rows:
        return pa.table({"name": pa.array([], pa.string())})
    machine, found = ahocorasick.Automaton(), set()
    for name in names.column("name").to_pylist():
        machine.add_word(name, name)
    machine.make_automaton()
    for url in urls.column("logged").to_pylist():
        found.update(name for _, name in machine.iter(url))
    return pa.table({"name": pa.array(sorted(found), pa.string())})


@web(f"""SELECT page_id, (SELECT count(*) FROM {_LOGGED} l) = 0 OR {_NORMAL} IN (SELECT logged FROM {_LOGGED} l2)
  OR EXISTS (SELECT 1 FROM {_LOGGED} l3 WHERE contains(l3.logged, {_FILE})) AS passes FROM {REFS}""")
def network_gate(spark, d):
    """A reference passes if nothing was logged, if its URL was, or if its file name is part of a logged URL."""
    refs = _normal(spark, d).withColumn("name", U.file_name(F.col("ref")))
    return gate(refs, refs.where("page_id % 5 < 3").select(F.col("absolute").alias("logged"))).select("page_id", "passes")


def gate(refs, log):
    """refs (absolute, name) with `passes`; log has (logged)."""
    log = log.where("logged is not null").distinct()
    none = log.agg(F.count("*") == 0).scalar()
    by_name = contained(refs, log).withColumn("by_name", F.lit(True))
    out = refs.join(log.withColumn("by_url", F.lit(True)), F.col("absolute") == F.col("logged"), "left").join(by_name, "name", "left")
    return out.withColumn("passes", none | F.coalesce("by_url", F.lit(False)) | F.coalesce("by_name", F.lit(False)))


# Fetch outcomes.

_METHOD = "CASE WHEN first_status IN (200, 201, 202, 203, 204, 206) THEN 'requests' WHEN second_status BETWEEN 200 AND 299 THEN 'urllib3' WHEN third_status BETWEEN 200 AND 299 THEN 'httpx' END"


@web(f"SELECT page_id, {_METHOD} AS method FROM {OUTCOMES}")
def fetch_fallback(spark, d):
    ways = [F.when(F.col("first_status").isin(200, 201, 202, 203, 204, 206), "requests"), F.when(F.col("second_status").between(200, 299), "urllib3"), F.when(F.col("third_status").between(200, 299), "httpx")]
    return _from(spark, d, OUTCOMES).select("page_id", F.coalesce(*ways).alias("method"))


#: What up to three tries by each of the three ways gave, in order; null is an error. Made up.
_TRIED = "(SELECT page_id, " + ", ".join(f"CASE (page_id * 7 + {j * j * 3}) % 17 WHEN 0 THEN 200 WHEN 1 THEN 206 WHEN 2 THEN 226 WHEN 3 THEN NULL WHEN 4 THEN NULL WHEN 5 THEN NULL WHEN 6 THEN 301 ELSE 500 END AS s{j}" for j in range(9)) + " FROM pages) tried"
_WAYS = ("requests", "urllib3", "httpx")


def retried(statuses: list, tries: int = 3):
    """(method, attempts, waited) of a download that tries each way in turn, each up to `tries` times, until one is good.

    statuses are those of all tries in order, null for an error that reaches the loop over the tries; what a way itself
    catches is a bad answer. After an error, but not after the last try of a way, the next try waits half a second, then
    twice as long each time; a bad answer does not wait.
    """
    good = [s.isin(200, 201, 202, 203, 204, 206) if i < tries else s.between(200, 299) for i, s in enumerate(statuses)]
    at = F.array_position(F.array(*[F.coalesce(g, F.lit(False)) for g in good]), True)
    attempts = F.when(at > 0, at).otherwise(len(statuses)).cast("int")
    waits = [F.when(s.isNull() & (attempts > i + 1), 0.5 * 2 ** (i % tries)).otherwise(0.0) for i, s in enumerate(statuses) if i % tries < tries - 1]
    waited = sum(waits, F.lit(0.0))
    return [F.when(at > 0, F.element_at(F.array(*map(F.lit, _WAYS)), F.ceil(at / tries).cast("int"))).alias("method"), attempts.alias("attempts"), waited.alias("waited")]


_GOOD = [f"s{j} IN (200, 201, 202, 203, 204, 206)" if j < 3 else f"s{j} BETWEEN 200 AND 299" for j in range(9)]


@web("SELECT page_id, CASE WHEN n <= 3 THEN 'requests' WHEN n <= 6 THEN 'urllib3' WHEN n <= 9 THEN 'httpx' END AS method, CAST(least(n, 9) AS INTEGER) AS attempts, CAST("
     + " + ".join(f"CASE WHEN s{j} IS NULL AND n > {j + 1} THEN {0.5 * 2 ** (j % 3)} ELSE 0 END" for j in range(9) if j % 3 < 2) + " AS DOUBLE) AS waited FROM (SELECT *, CASE "
     + " ".join(f"WHEN {g} THEN {j + 1}" for j, g in enumerate(_GOOD)) + f" ELSE 10 END AS n FROM {_TRIED}) t")
def download_attempts(spark, d):
    """The way that a download came by, how many tries it took, and how long they waited."""
    return _from(spark, d, _TRIED).select("page_id", *retried([F.col(f"s{j}") for j in range(9)]))


_FETCHED = f"(SELECT page_id, {_NORMAL} AS absolute, ref, size FROM {OUTCOMES} WHERE length(trim(ref)) > 0 AND NOT starts_with(ref, 'data:'))"
_BY_URL = f"(SELECT absolute, count(*) AS n, max(size) > 100 AS ok, sum(CASE WHEN page_id % 4 = 3 THEN 0 ELSE 1 END) > 0 AS gate FROM {_FETCHED} f GROUP BY absolute)"


@web(f"""SELECT CAST(coalesce(sum(CASE WHEN ok AND gate THEN 1 ELSE 0 END), 0) AS BIGINT) AS success, CAST(coalesce(sum(CASE WHEN ok THEN 0 ELSE n END), 0) AS BIGINT) AS failed,
  CAST(coalesce(sum(CASE WHEN ok AND gate THEN n - 1 ELSE 0 END), 0) AS BIGINT) AS skipped,
  CAST(coalesce(sum(CASE WHEN ok AND gate THEN n WHEN ok THEN 0 ELSE n END), 0) AS BIGINT) AS total FROM {_BY_URL} u""")
def download_stats(spark, d):
    """A URL that n references share is fetched once and then skipped n - 1 times; a failing one fails n times; a gated one counts nowhere."""
    refs = _from(spark, d, OUTCOMES).where("length(trim(ref)) > 0 and not startswith(ref, 'data:')").withColumn("absolute", U.normalized(F.col("url"), F.col("ref")))
    by = refs.groupBy("absolute").agg(F.count("*").alias("n"), (F.max("size") > 100).alias("ok"), (F.count_if(F.col("page_id") % 4 != 3) > 0).alias("gate"))
    got = F.col("ok") & F.col("gate")
    add = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    out = by.agg(add(F.when(got, 1).otherwise(0)).alias("success"), add(F.when(F.col("ok"), 0).otherwise(F.col("n"))).alias("failed"), add(F.when(got, F.col("n") - 1).otherwise(0)).alias("skipped"))
    return out.withColumn("total", F.expr("success + failed + skipped"))


@web(f"SELECT f.page_id, f.absolute, u.local FROM {_FETCHED} f LEFT JOIN (SELECT absolute, concat('assets/', length(absolute), '.bin') AS local FROM {_BY_URL} u WHERE ok AND gate) u ON f.absolute = u.absolute")
def rewrite_lookup(spark, d):
    refs = _from(spark, d, OUTCOMES).where("length(trim(ref)) > 0 and not startswith(ref, 'data:')").withColumn("absolute", U.normalized(F.col("url"), F.col("ref")))
    by = refs.groupBy("absolute").agg((F.max("size") > 100).alias("ok"), (F.count_if(F.col("page_id") % 4 != 3) > 0).alias("gate")).where("ok and gate")
    return refs.join(by.select("absolute", F.expr("concat('assets/', length(absolute), '.bin')").alias("local")), "absolute", "left").select("page_id", "absolute", "local")


def fetched(spark, d):
    """(project, absolute, local, method, size, ok, n) of each URL of a project, which is ten pages; n references share it. A URL is good with a good answer of more than 100 bytes."""
    refs = _from(spark, d, OUTCOMES).where("length(trim(ref)) > 0 and not startswith(ref, 'data:')").withColumn("absolute", U.normalized(F.col("url"), F.col("ref")))
    by = refs.groupBy(F.expr("floor(page_id / 10)").alias("project"), "absolute").agg(F.count("*").alias("n"), F.max("size").alias("size"), F.min(F.expr(_METHOD)).alias("method"))
    return by.withColumns({"ok": F.expr("size > 100 and method is not null"), "local": F.expr("concat('assets/', length(absolute), '.bin')")})


@web(f"SELECT page_id, CASE WHEN length(concat(url, '/', ref)) > 80 THEN concat(substr(concat(url, '/', ref), 1, 80), '...') ELSE concat(url, '/', ref) END AS shown FROM {REFS}")
def failed_short(spark, d):
    whole = F.concat("url", F.lit("/"), "ref")
    return _from(spark, d, REFS).select("page_id", F.when(F.length(whole) > 80, F.concat(F.substring(whole, 1, 80), F.lit("..."))).otherwise(whole).alias("shown"))


@web(f"SELECT DISTINCT concat({_DOMAIN}, '/favicon.ico') AS favicon FROM pages")
def favicon_targets(spark, d):
    return read(spark, d, "pages").select(F.concat(U.domain(F.col("url")), F.lit("/favicon.ico")).alias("favicon")).distinct()


# File types. Extensions by category, as documented.
CATEGORIES = {
    "Images": ("jpg", "jpeg", "png", "gif", "webp", "svg", "ico", "bmp", "tiff", "avif"),
    "Stylesheets": ("css", "scss", "sass", "less"),
    "Scripts": ("js", "jsx", "ts", "tsx", "mjs", "cjs"),
    "Fonts": ("woff", "woff2", "ttf", "otf", "eot"),
    "Documents": ("html", "php", "xml", "txt", "md", "pdf"),
    "Media": ("mp4", "webm", "ogg", "mp3", "wav"),
    "Data": ("json", "yaml", "csv"),
}
_EXT = f"lower(regexp_extract({_FILE}, '\\.([A-Za-z0-9]+)$', 1))"
_CATEGORY = "CASE " + " ".join(f"WHEN ext IN ({', '.join(repr(x) for x in v)}) THEN '{k}'" for k, v in CATEGORIES.items()) + " ELSE 'Other' END"


def _typed(spark, d):
    return _from(spark, d, OUTCOMES).withColumn("ext", U.extension(U.file_name(F.col("ref"))))


@web(f"SELECT {_CATEGORY} AS category, count(*) AS total, count(*) FILTER (size > 100) AS success, count(*) FILTER (size <= 100) AS failed FROM (SELECT *, {_EXT} AS ext FROM {OUTCOMES}) t GROUP BY 1")
def file_category_breakdown(spark, d):
    return _typed(spark, d).groupBy(F.expr(_CATEGORY).alias("category")).agg(F.count("*").alias("total"), F.count_if(F.col("size") > 100).alias("success"), F.count_if(F.col("size") <= 100).alias("failed"))


@web(f"SELECT ext, count(*) AS n FROM (SELECT {_EXT} AS ext FROM {OUTCOMES}) t GROUP BY 1")
def file_type_counts(spark, d):
    return _typed(spark, d).groupBy("ext").agg(F.count("*").alias("n"))


@web(f"""SELECT count(*) FILTER (ext = 'css') AS css_count, count(*) FILTER (ext = 'js') AS js_count, count(*) FILTER (ext IN ('jpg','jpeg','png','gif','svg','webp','ico')) AS image_count,
  count(*) FILTER (ext IN ('woff','woff2','ttf','otf','eot')) AS font_count FROM (SELECT {_EXT} AS ext FROM {OUTCOMES}) t""")
def asset_class_counts(spark, d):
    e = F.col("ext")
    return _typed(spark, d).agg(F.count_if(e == "css").alias("css_count"), F.count_if(e == "js").alias("js_count"), F.count_if(e.isin("jpg", "jpeg", "png", "gif", "svg", "webp", "ico")).alias("image_count"), F.count_if(e.isin("woff", "woff2", "ttf", "otf", "eot")).alias("font_count"))


@web(f"SELECT ext, count(*) AS n FROM (SELECT page_id, {_EXT} AS ext FROM {OUTCOMES}) t GROUP BY 1 ORDER BY n DESC, min(page_id) LIMIT 5")
def top5_types(spark, d):
    return _typed(spark, d).groupBy("ext").agg(F.count("*").alias("n"), F.min("page_id").alias("first")).orderBy(F.desc("n"), "first").limit(5).drop("first")


@web(f"SELECT ext, page_id FROM (SELECT page_id, {_EXT} AS ext, row_number() OVER (PARTITION BY {_EXT} ORDER BY page_id) AS r FROM {OUTCOMES}) t WHERE r <= 3")
def top_examples(spark, d):
    from pyspark.sql import Window

    return _typed(spark, d).withColumn("r", F.row_number().over(Window.partitionBy("ext").orderBy("page_id"))).where("r <= 3").select("ext", "page_id")


#: Icons by extension.
_ICONS = {"fas fa-file-code": ("html", "css", "js", "json"), "fas fa-image": ("jpg", "jpeg", "png", "gif", "webp", "svg"), "fas fa-font": ("woff", "woff2", "ttf", "eot"), "fas fa-file-pdf": ("pdf",), "fas fa-file-archive": ("zip",)}
_ICON = "CASE " + " ".join(f"WHEN ext IN ({', '.join(repr(x) for x in v)}) THEN '{k}'" for k, v in _ICONS.items()) + " ELSE 'fas fa-file' END"


@web(f"SELECT page_id, {_ICON} AS icon FROM (SELECT page_id, {_EXT} AS ext FROM {OUTCOMES}) t")
def file_icon(spark, d):
    return _typed(spark, d).select("page_id", F.expr(_ICON).alias("icon"))


@web("SELECT page_id, array_to_string(list_transform(range(1, len(p) + 1), lambda i: array_to_string(p[1:i], '/')), ' > ') AS crumbs FROM (SELECT page_id, list_filter(string_split(regexp_replace(url, '^[^:/?#]+://', ''), '/'), lambda x: x <> '') AS p FROM pages) t")
def breadcrumbs(spark, d):
    p = F.filter(F.split(F.regexp_replace("url", "^[^:/?#]+://", ""), "/"), lambda x: x != "")
    return read(spark, d, "pages").select("page_id", p.alias("p")).select("page_id", F.array_join(F.transform(F.sequence(F.lit(1), F.size("p")), lambda i: F.array_join(F.slice("p", F.lit(1), i), "/")), " > ").alias("crumbs"))


_BYTES = "octet_length(encode(html)) * (page_id * page_id * 7919 % 900001) * (page_id % 4)"
_SCALE = "CASE WHEN n < 1024 THEN 1 WHEN n < 1048576 THEN 1024 WHEN n < 1073741824 THEN 1048576 ELSE 1073741824 END"


@web(f"""SELECT page_id, regexp_replace(CAST(floor(CAST(n AS DOUBLE) / {_SCALE} * 100 + 0.5) / 100 AS VARCHAR), '\\.0$', '') || CASE WHEN n < 1024 THEN ' B' WHEN n < 1048576 THEN ' KB' WHEN n < 1073741824 THEN ' MB' ELSE ' GB' END AS size
  FROM (SELECT page_id, CAST({_BYTES} AS BIGINT) AS n FROM pages) t""")
def human_size(spark, d):
    """Bytes as text, as 1.5 KB."""
    n = F.octet_length("html").cast("long") * F.expr("(page_id * page_id * 7919 % 900001) * (page_id % 4)")
    return read(spark, d, "pages").select("page_id", size_text(n).alias("size"))


def size_text(n):
    """A number of bytes in the largest of B, KB, MB and GB that it reaches, to two places, halves up."""
    k = F.when(n < 1024, 0).when(n < 2**20, 1).when(n < 2**30, 2).otherwise(3)
    amount = F.floor(n.cast("double") / F.pow(F.lit(1024), k) * 100 + 0.5) / 100
    return F.concat(F.regexp_replace(amount.cast("string"), r"\.0$", ""), F.lit(" "), F.element_at(F.array(*map(F.lit, ("B", "KB", "MB", "GB"))), k + 1))
