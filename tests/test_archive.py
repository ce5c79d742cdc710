"""Operators of the archive against values written out by hand and plain restatements."""

import json
import random

import pytest
from pyspark.sql import functions as F

from weftline.operators import archive as A
from weftline.operators import web as W
from weftline.sources import files

SF = "/root/testdata/sf0.001"


def fingerprint(spark, html, rest_status=404, rest_body=None, login=404, admin=404, xmlrpc=404):
    rows = spark.createDataFrame([(html, rest_status, rest_body, login, admin, xmlrpc)], "h string, rs int, rb string, l int, a int, x int")
    probes = {"/wp-login.php": F.col("l"), "/wp-admin/": F.col("a"), "/xmlrpc.php": F.col("x")}
    return rows.select(*A.fingerprint(F.col("h"), F.col("rs"), F.col("rb"), probes)).first()


def test_platform_signs(spark):
    none = fingerprint(spark, "<p>WordPress 5.1, generator</p>")
    assert (none.is_wordpress, none.confidence, none.version, none.probe) == (False, 0.0, "", None)
    assert fingerprint(spark, '<meta name="generator" content="Drupal">').confidence == 0.0
    tag = fingerprint(spark, "<META id=1 name='Generator' content='WordPress 6.4.2; x'>", admin=302, xmlrpc=200)
    assert (tag.is_wordpress, tag.confidence, tag.version, tag.probe) == (True, 0.6, "6.4.2", "/wp-admin/")
    paths = fingerprint(spark, "/wp-content/themes/one/' /wp-includes/ " + " ".join(f"/wp-content/plugins/p{i:02}/x" for i in range(12, 0, -1)))
    assert (paths.confidence, paths.theme, paths.plugins) == (0.6, "one", ",".join(f"p{i:02}" for i in range(1, 11)))
    assert fingerprint(spark, "/wp-content/", 200, '{"namespaces":[]}').confidence == 0.8
    assert fingerprint(spark, "/wp-content/", 200, "no json").confidence == 0.3
    every = fingerprint(spark, '/wp-content/ /wp-includes/ <meta name="generator" content="WordPress">', 200, '{"routes":{}}', 200)
    assert (every.confidence, every.probe, every.api_available) == (1.0, "/wp-login.php", True)


def test_fixed_values(spark):
    assert A.VIEWPORTS == {"mobile": (375, 667), "tablet": (768, 1024), "desktop": (1920, 1080), "desktop_4k": (3840, 2160)}
    assert [x in A.RESOURCES for x in ("img", "bmp", "javascript", "map", "xml", "webp", "otf", "pdf", "mp4")] == [True] * 6 + [False] * 3


def given(rows, resources):
    """Names given out one after the other."""
    used, out = {}, {}
    for folder, at, name in sorted(rows, key=lambda r: r[1]):
        parts = name.split("?")[0].split("#")[0].split(".")
        base, rest = ("0", parts[0]) if len(parts) == 1 and parts[0] in resources else (parts[0], ".".join(parts[1:]))
        own, n = used.setdefault(folder, set()), 0
        while (new := f"{base}{n or ''}" + (f".{rest}" if rest else "")) in own:
            n += 1
        own.add(new)
        out[at] = new
    return out


def test_names_are_given_once(spark):
    names = ["a.css", "a1.css", "a11.css", "css", ".css", "0.css", "b.min.js", "b.min.js?x=1", "c", "c1", "page1.js", "page2.js", "d.", "x"]
    rng = random.Random(3)
    rows = [(i % 3, i, rng.choice(names)) for i in range(400)] + [(0, 1000 + i, f"only{i}.gif") for i in range(20)] + [(1, 70_000 * i, "far.css") for i in range(6, 12)]
    frame = spark.createDataFrame(rows, "folder long, at long, file string").repartition(5)
    found = A.given_names(frame, "folder", "file", "at").collect()
    assert {r["at"]: r["given"] for r in found} == given(rows, A.RESOURCES)
    assert len(found) == len(rows)
    # Many repeated names of one family: each with what begins with it, apart from the others; and names that nothing reaches.
    stems = [f"page{i}" for i in (1, 2, 3, 12, 13, 21, 111, 120, 121, 4, 40, 400)] + ["page", "p", "pa1"]
    for some in (stems[:12], stems):
        rows = [(0, i, rng.choice(some) + ".js") for i in range(900)] + [(0, 2_000 + i, f"page{9_000 + i}.js") for i in range(50)] + [(0, 3_000 + i, "page90.js") for i in range(3)]
        frame = spark.createDataFrame(rows, "folder long, at long, file string").repartition(4)
        assert {r["at"]: r["given"] for r in A.given_names(frame, "folder", "file", "at").collect()} == given(rows, A.RESOURCES)
    frame = spark.createDataFrame(rows, "folder long, at long, file string")
    assert A.given_names(frame.limit(0), "folder", "file", "at").count() == 0


def test_places_across_stretches(spark):
    rows = spark.createDataFrame([("a", i) for i in range(0, 1000, 3)] + [("b", 5)], "k string, at long").repartition(4)
    found = {(r.k, r["at"]): r.nth for r in A.numbered(rows, ["k"], "at", width=64).collect()}
    assert found == {("a", i): i // 3 for i in range(0, 1000, 3)} | {("b", 5): 0}


def test_sitemap_entries(spark):
    def entries(xml):
        return [tuple(r) for r in spark.createDataFrame([(xml,)], "x string").select(F.inline(A.sitemap_entries(F.col("x")))).collect()]

    one = '<urlset xmlns="http://x"><url><loc>u</loc><lastmod>l</lastmod><changefreq>c</changefreq><priority>0.5</priority></url><url><loc/></url></urlset>'
    assert entries(one) == [("url", "u", None, "l", "c", "0.5")]
    assert entries("<sitemapindex><sitemap><loc>s</loc></sitemap></sitemapindex>") == [("sitemap", "s", None, None, None, None)]
    assert entries("<feed><entry><title>t</title><link href='a'/><updated>d</updated></entry></feed>") == [("atom", "a", "t", "d", None, None)]
    assert entries("<urlset><url><loc>u") == entries("") == entries(None) == []


def fed(spark, folder, name):
    """What differs between a feed of odd pages and its SQL."""
    import duckdb
    from twins import compared

    from weftline.queries import ORACLE_SQL, QUERIES

    titles = ["a", "", "cut &am", "&", "&nbsp; &#0; &amp", "]]> \"q\" 'q'", "two\r\nlines\tand", "&amp;lt;", " ", "<![CDATA["]
    pages = [(i, f"https://h/{i}?a=1&b=<\"2\">\t3", f"<html><TITLE>x</TITLE><title k='v'>{t}</title>") for i, t in enumerate(titles)] + [(90, "https://h/n", None), (91, "https://h/m", "<p>")]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{folder}/pages.parquet/*.parquet'")
    return compared(spark, con, name, QUERIES[name], ORACLE_SQL[name], str(folder))


def test_rss_of_odd_pages(spark, tmp_path):
    assert fed(spark, tmp_path, "parse_rss") is None


def test_atom_of_odd_pages(spark, tmp_path):
    assert fed(spark, tmp_path, "parse_atom") is None


def test_crawl_keeps_every_listing(spark):
    rows = [("a", "b", "sitemap"), ("b", "a", "sitemap"), ("a", "u", "url"), ("b", "u", "url"), ("b", "u", "url"), ("z", "v", "url"), ("b", "b", "sitemap")]
    found = A.crawl(spark.createDataFrame(rows, "source string, url string, kind string"), spark.createDataFrame([("a",)], "source string"))
    assert sorted(map(tuple, found.collect())) == [("a", "u"), ("b", "u"), ("b", "u")]


def test_rewriting(spark):
    r = next(r for r in A.rewrite_html(spark, SF).collect() if r.page_id == 1)
    new = ('<article><!-- <img src="img/1.png"> --><script>var t = "//cdn.example.net/1.js";</script><link rel="stylesheet"\tHREF = "assets/1.css"><img alt="src" src=\'assets/1.png\' srcset="assets/a.png 1x, assets/b.png, gone.gif 2x">'
           '<script async src="assets/1.js"></script><meta property="og:image" content="assets/1.jpg"><meta name="d" content="words"><img data-src="no.png" src="gone.gif"><img src=assets/bare.png>')  # fmt: skip
    page = spark.read.parquet(f"{SF}/pages.parquet").where("page_id = 1").first().html
    assert r.html == page.replace("<article>", new)
    r = next(r for r in A.css_rewrite(spark, SF).collect() if r.page_id == 1)
    assert r.css == "a{background:url(assets/1.png)} b{src:url(assets/f.woff)} c{x:url(data:a)} d{y:url(assets/1.png)} e{z:url( gone.gif )} f{w:url(assets/q.svg)}"


def test_children_of_folders(spark):
    rows = [("p", "index.html", 5, 1), ("p", "img/a.png", 7, 2), ("p", "img/b/c.png", 8, 3)]
    frame = spark.createDataFrame(rows, "project string, path string, size long, modified long")
    assert [(r.name, r.is_dir, r.size, r.modified) for r in A.children(frame).collect()] == [("img", True, 0, 3), ("index.html", False, 5, 1)]
    assert [(r.path, r.is_dir) for r in A.children(frame, "img").collect()] == [("img/a.png", False), ("img/b", True)]


def test_network_gate(spark):
    refs = spark.createDataFrame([("http://h/test.jpg", "test.jpg"), ("http://h/missing.jpg", "missing.jpg"), ("http://h/x", "a"), ("http://h/long", "a-very-long-name.css")], "absolute string, name string")

    def passes(*logged):
        return {r.name: r.passes for r in W.gate(refs, spark.createDataFrame([(x,) for x in logged], "logged string")).collect()}

    assert passes() == {"test.jpg": True, "missing.jpg": True, "a": True, "a-very-long-name.css": True}
    assert passes("http://h/test.jpg") == {"test.jpg": True, "missing.jpg": False, "a": False, "a-very-long-name.css": False}
    assert passes("http://c/q?f=a-very-long-name.css", "x") == {"test.jpg": False, "missing.jpg": False, "a": True, "a-very-long-name.css": True}


def test_documents_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("a", True, 1.5, 3, {"css": 1}), ("b", False, None, None, None), ("c", None, 2.0, 1, {})], "site_name string, success boolean, duration_seconds double, total_resources long, file_types map<string,bigint>")
    files.write_run(rows, str(tmp_path / "run"), "2024-01-31T00:00:00")
    assert spark.read.json(str(tmp_path / "run/metadata.json")).first().asDict() == {"timestamp": "2024-01-31T00:00:00", "total_experiments": 3, "successful": 1, "failed": 2}
    assert spark.read.json(str(tmp_path / "run/results.json")).count() == 3
    document = {"metadata": {"timestamp": "t", "total_experiments": 1, "successful": 1, "failed": 0}, "results": [{"site_name": "a", "success": True, "file_types": {"css": 2}}]}
    (tmp_path / "old").mkdir()
    (tmp_path / "old/experiment_1.json").write_text(json.dumps(document, indent=2))
    (tmp_path / "old/experiment_2.json").write_text("{broken")
    (found,) = files.results(spark, str(tmp_path / "old")).collect()
    assert (found.filename, found.site_name, found.file_types) == ("experiment_1.json", "a", {"css": 2})
    files.write_csv(rows, str(tmp_path / "csv"))
    back = spark.read.option("header", True).csv(str(tmp_path / "csv"))
    assert back.columns == sorted(rows.columns) and back.where("site_name = 'a'").first().file_types == '{"css":1}'


def test_manifests(spark):
    rows = [("p", "u1", "f1", "requests", 5, True, 3), ("p", "u2", None, None, 0, False, 2)]
    found = files.manifests(spark.createDataFrame(rows, "project string, absolute string, local string, method string, size long, ok boolean, n long"), "project", "2024-01-31T00:00:00").first()
    lost = {"url": "u2", "reason": "All download methods failed"}
    assert json.loads(found.manifest) == {"timestamp": "2024-01-31T00:00:00", "url": "p", "statistics": {"success": 1, "failed": 2, "skipped": 2},
                                          "successful_downloads": [{"url": "u1", "local_path": "f1", "method": "requests", "size": 5}], "failed_downloads": [lost, lost]}


def test_more_documents(spark, tmp_path):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, css string")
    new = spark.createDataFrame([(1, "a"), (2, "c"), (3, None), (4, "d")], "id int, css string")
    files.write_changed(old, new, "id", "css", str(tmp_path / "css"))
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "css")).collect())) == [(2, "c"), (4, "d")]
    (tmp_path / "t").mkdir()
    (tmp_path / "t/a.css").write_bytes("é".encode() + b"\xff")
    assert [r.text for r in files.texts(spark, str(tmp_path / "t"), "*.css").collect()] == ["é�"]
    report = files.batch_report(spark.createDataFrame([("b", False), ("a", None), ("c", True)], "site string, success boolean")).first().report
    assert json.loads(report) == {"total": 3, "successful": 1, "failed": 2, "success_rate": 33.33, "failed_sites": ["a", "b"]}
    assert json.loads(files.batch_report(spark.createDataFrame([], "site string, success boolean")).first().report)["success_rate"] == 0.0


def test_names_in_urls(spark):
    """Every name that is part of a URL, whatever its length, and no other."""
    own = random.Random(9)
    urls = ["".join(own.choice("ab./") for _ in range(own.randint(0, 30))) for _ in range(60)] + [None, ""]
    names = ["".join(own.choice("ab./") for _ in range(own.randint(1, 14))) for _ in range(200)] + [u[3:20] for u in urls if u and len(u) > 4] + [None]
    frame = lambda rows, name: spark.createDataFrame([(x,) for x in rows], f"{name} string")
    found = {r.name for r in W.contained(frame(names, "name"), frame(urls, "logged")).collect()}
    assert found == {n for n in names if n and any(n in u for u in urls if u)}
    # The same with every start taken for a common one, in blocks of a few names and URLs.
    assert found == {r.name for r in W.contained(frame(names, "name"), frame(urls, "logged"), few=0, automaton=3, logged=2).collect()}
    assert W.contained(frame(names, "name"), frame([], "logged")).count() == 0 == W.contained(frame([], "name"), frame(urls, "logged")).count()


def test_relative_paths(spark):
    rows = spark.createDataFrame([("a\\b", "c.css"), ("", "c.css"), (None, "c.css"), ("./x//", "d/e.js")], "d string, n string")
    assert [r.p for r in rows.select(A.relative_path(F.col("d"), F.col("n")).alias("p")).collect()] == ["a/b/c.css", "c.css", "c.css", "x/d/e.js"]


def test_files_are_written(spark, tmp_path):
    rows = [("index.html", "é<p>"), ("css/a/b.css", ""), ("css//./c.css", "x"), (None, "x"), ("no", None)]
    frame = spark.createDataFrame(rows, "path string, content string").repartition(3)
    files.write_files(frame, f"file://{tmp_path}/out")
    assert sorted((r.path.split("/out/")[1], r.text) for r in files.texts(spark, str(tmp_path / "out")).collect()) == [("css/c.css", "x"), ("index.html", "é<p>")]
    assert (tmp_path / "out/css/a/b.css").read_bytes() == b""
    files.write_files(frame.limit(0), f"file://{tmp_path}/out")
    with pytest.raises(Exception, match="no path below the root"):
        files.write_files(spark.createDataFrame([("../x", "y")], "path string, content string"), f"file://{tmp_path}/out")


def test_retries(spark):
    """Against the tries one after the other."""
    own = random.Random(6)
    rows = [tuple(own.choice([None, None, 500, 404, 301, 204, 226]) if own.random() < 0.6 else None for _ in range(9)) for _ in range(300)] + [(None,) * 9, (500,) * 9]

    def plain(tries):
        n = 0
        for way, name in enumerate(("requests", "urllib3", "httpx")):
            for _ in range(3):
                status, n = tries[n], n + 1
                if status is not None and (status in (200, 201, 202, 203, 204, 206) if way == 0 else 200 <= status < 300):
                    return name, n
        return None, n

    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + ", ".join(f"s{j} int" for j in range(9)))
    found = {r.i: (r.method, r.attempts) for r in frame.select("i", *W.retried([F.col(f"s{j}") for j in range(9)])).collect()}
    wrong = {i: (found[i], plain(r)) for i, r in enumerate(rows) if found[i] != plain(r)}
    assert not wrong


def test_waits_between_tries(spark):
    """Half a second after an error, then one; none after a way's last try, a bad answer or the end."""
    rows = [((None,) * 9, 4.5), ((500,) * 9, 0.0), ((None, 200) + (None,) * 7, 0.5), ((500, None, None, 226) + (None,) * 5, 1.0), ((None, 404, None, None, 299) + (None,) * 4, 1.0), ((200,) + (None,) * 8, 0.0)]
    frame = spark.createDataFrame([(i, *r) for i, (r, _) in enumerate(rows)], "i int, " + ", ".join(f"s{j} int" for j in range(9)))
    found = dict(frame.select("i", W.retried([F.col(f"s{j}") for j in range(9)])[2]).collect())
    assert found == {i: waited for i, (_, waited) in enumerate(rows)}


def test_markup_is_read_once(spark):
    """Entries of srcset attributes come from the same reading as all other addresses."""
    html = '<img src="a.png" srcset="b.png 1x 3w, ,c.png"><img src="data:y" srcset="data:x, d.png 2x"><link rel="stylesheet" href=" "><script src="e, f.js"></script>'
    found = A.linked(spark.createDataFrame([(1, "https://h", html), (1, "https://i", "<img src=g.png>"), (2, "", None)], "page_id long, base string, html string"))
    rows = sorted((r.base, r.kind, r.place, r.ref, r.descriptor) for r in found.collect())
    assert rows == [("https://h", "img", 0, "a.png", ""), ("https://h", "script", 0, "e, f.js", ""), ("https://h", "srcset", 0, "b.png", "1x"), ("https://h", "srcset", 1, "d.png", "2x"), ("https://h", "srcset", 2, "c.png", ""), ("https://i", "img", 0, "g.png", "")]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("asset_refs(") == 1


def test_titles(spark):
    """Those without a title, null or empty, get it from the markup, the first `most` of them alone; where that has none they stay."""
    rows = [(1, "<title>a</title>", "T"), (2, "<TITLE x> b </title>", None), (3, "<p>", ""), (4, "<title>d</title>", ""), (5, "<title>e</title>", None)]
    urls = spark.createDataFrame(rows, "at int, html string, title string")
    assert sorted(map(tuple, A.titled(urls, "at", 3).collect())) == [(1, "T"), (2, "b"), (3, ""), (4, "d"), (5, None)]


def test_many_names_of_one_start(spark):
    """100,000 names and as many URLs that all share their first characters: rows in proportion to the finds."""
    names = spark.range(0, 100_000).selectExpr("concat('wp-image-', id * 7, '.png') as name")
    urls = spark.range(0, 100_000).selectExpr("concat('https://x.example.org/wp-image-', id, '.png?v=1') as logged")
    found = {r.name for r in W.contained(names, urls).collect()}
    assert found == {f"wp-image-{i}.png" for i in range(0, 100_000, 7)}
