"""The archive's data source: kinds of files read, filters, broken files, and writing that leaves nothing of a failed try."""

import glob
import gzip
import json
import os

import pytest
from pyspark.sql import functions as F

from weftline.sources import archive


@pytest.fixture
def folder(tmp_path):
    def put(name, content):
        path = tmp_path / "in" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content if isinstance(content, bytes) else content.encode())

    result = {"site_name": "a", "success": True}
    put("experiment_1.json", json.dumps({"metadata": {"timestamp": "t", "total_experiments": 2, "successful": 1, "failed": 1}, "results": [result, {"x": [1]}]}))
    put("experiment_2.json", json.dumps({"results": []}))
    put("experiment_3.json", "{broken")
    put("experiment_4.json", "[1, 2]")
    put("sub/experiment_5.json", json.dumps({"metadata": {"total_experiments": 3}}))
    put("_hidden/experiment_6.json", "{}")
    put("a/robots.txt", "# x\nUser-agent: *\nDISALLOW: /a\nDisallow:\nallow: /b:c\n Sitemap: http://h/s.xml\nSitemap:\n")
    put("a/deep.xml", '<urlset xmlns="http://x"><group><url><loc>http://h/1</loc><lastmod>d</lastmod></url></group><url><loc/></url></urlset>')
    put("a/z.xml.gz", gzip.compress(b"<sitemapindex><a><sitemap><loc>http://h/s</loc></sitemap></a></sitemapindex>"))
    put("a/rdf.xml", '<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns="http://purl.org/rss/1.0/"><channel><title>c</title></channel><item><title>T</title><link>http://h/r</link></item></rdf:RDF>')
    put("a/feed.rss", "<rss><channel><item><link>http://h/f</link></item><item><title>none</title></item></channel></rss>")
    put("a/bad.xml", "<urlset><url>")
    put("a/torn.xml.gz", gzip.compress(b"<urlset></urlset>")[:12])
    put("p/download_manifest.json", json.dumps({"timestamp": "t", "url": "u", "statistics": {"success": 1, "failed": 1, "skipped": 4}, "successful_downloads": [{"url": "a", "local_path": "b", "method": "requests", "size": 3}], "failed_downloads": [{"url": "c", "reason": "404"}]}))
    return str(tmp_path / "in")


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_kinds(spark, folder):
    of = lambda kind, **o: rows(archive.read(spark, folder, kind, **o))
    assert of("run") == [("experiment_1.json", "t", 2, 1, 1), ("experiment_2.json", "unknown", 0, 0, 0), ("sub/experiment_5.json", "unknown", 3, 0, 0)]
    assert of("run", bytes="1") == of("run")
    assert of("result") == [("experiment_1.json", 0, '{"site_name": "a", "success": true}'), ("experiment_1.json", 1, '{"x": [1]}')]
    assert of("robots") == [("a/robots.txt", i, *x) for i, x in enumerate([("disallow", "/a"), ("allow", "/b:c"), ("sitemap", "http://h/s.xml"), ("sitemap", "")])]
    assert [r[:3] for r in of("sitemap")] == [("a/deep.xml", "url", "http://h/1"), ("a/feed.rss", "rss", "http://h/f"), ("a/rdf.xml", "rss", "http://h/r"), ("a/z.xml.gz", "sitemap", "http://h/s")]
    assert of("manifest") == [("p/download_manifest.json", "t", "u", 1, 1, 4)]
    assert of("download") == [("p/download_manifest.json", False, "c", None, None, None, "404"), ("p/download_manifest.json", True, "a", "b", "requests", 3, None)]
    assert [r[0] for r in of("file", pattern="a/*.xml, p/*")] == ["a/bad.xml", "a/deep.xml", "a/rdf.xml", "p/download_manifest.json"]
    assert of("file", pattern="none*") == []
    with pytest.raises(Exception, match="experiment_3.json is no run"):
        of("run", mode="fail")
    with pytest.raises(Exception, match="no such kind: x"):
        of("x")


def test_filters_reach_the_listing(spark, folder):
    spark.conf.set(archive.PUSHDOWN, "true")
    try:
        runs = archive.read(spark, folder, "run", mode="fail").where("file = 'experiment_1.json' and total_experiments > 1")
        assert rows(runs) == [("experiment_1.json", "t", 2, 1, 1)]  # broken files are not opened
        assert [r[0] for r in rows(archive.read(spark, folder, "run", mode="fail").where("file like 'sub/%'"))] == ["sub/experiment_5.json"]
        assert [r[0] for r in rows(archive.read(spark, folder, "run", mode="fail").where("file in ('experiment_1.json', 'experiment_2.json')"))] == ["experiment_1.json", "experiment_2.json"]
    finally:
        spark.conf.unset(archive.PUSHDOWN)
    few = archive.Reader(folder, "run", ("*experiment_*.json",), 1, False).partitions()
    assert [p.names for p in few] == [["experiment_1.json"], ["experiment_2.json"], ["experiment_3.json"], ["experiment_4.json"], ["sub/experiment_5.json"]]


def there(root):
    return {os.path.relpath(p, root): open(p, "rb").read() for p in glob.glob(f"{root}/**/*", recursive=True) if os.path.isfile(p)}


def test_written(spark, tmp_path):
    root = str(tmp_path / "out")
    os.makedirs(root)
    given = [("a/b.txt", "é"), ("./c//d.txt", ""), ("z.xml.gz", "<a/>"), ("a/b.txt", "é"), (None, "x"), ("n", None)]
    archive.write(spark.createDataFrame(given, "path string, content string"), root)
    assert {k: gzip.decompress(v) if k.endswith(".gz") else v for k, v in there(root).items()} == {"a/b.txt": "é".encode(), "c/d.txt": b"", "z.xml.gz": b"<a/>"}
    before = os.stat(f"{root}/a/b.txt").st_mtime_ns
    archive.write(spark.createDataFrame([("a/b.txt", "é"), ("c/d.txt", "new"), ("z.xml.gz", "<a/>")], "path string, content string"), root, changed="true")
    assert os.stat(f"{root}/a/b.txt").st_mtime_ns == before and there(root)["c/d.txt"] == b"new"
    kept = there(root)
    for bad in ([("x", "1"), ("x", "2")], [("../x", "1")], [("a/../../x", "1")], [("", "1")]):
        with pytest.raises(Exception, match="two contents|no path below"):
            archive.write(spark.createDataFrame([("new.txt", "n"), *bad], "path string, content string"), root)
        assert there(root) == kept and not glob.glob(f"{root}/_staging*")


def test_a_failed_try_leaves_nothing(tmp_path):
    """Runs with tasks tried again: each partition's first try writes some files and dies; what is there afterwards is each file once, whole, and no staging."""
    import subprocess
    import sys

    script = f"""
import sys
sys.path.insert(0, {os.path.dirname(os.path.dirname(os.path.abspath(__file__)))!r})
from pyspark import TaskContext
from pyspark.sql import SparkSession
from weftline.sources import archive
spark = SparkSession.builder.master("local[2, 4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "3").getOrCreate()

def dies(rows):
    for batch in rows:
        yield batch
        if TaskContext.get().attemptNumber() < 2:
            raise RuntimeError("lost")

rows = spark.range(200).selectExpr("concat('d', id % 7, '/', id, '.txt') as path", "repeat(cast(id as string), 1000) as content")
spark.dataSource.register(archive.ArchiveSource)
torn = rows.repartition("path").mapInArrow(dies, "path string, content string").selectExpr("path", "cast(content as binary) as content")
torn.write.format(archive.NAME).mode("append").save({str(tmp_path / "out")!r})
"""
    os.makedirs(tmp_path / "out")
    subprocess.run([sys.executable, "-c", script], check=True, timeout=300, capture_output=True)
    assert there(tmp_path / "out") == {f"d{i % 7}/{i}.txt": (str(i) * 1000).encode() for i in range(200)}


def test_fields_of_documents(spark, tmp_path):
    """Documents with differing keys: the header is their sorted union, texts that need quotes come back, no documents are an error."""
    from weftline.operators import folders

    given = ['{"b": 1, "a": "x,\\"y\\"\\n"}', '{"c": {"k": [1, null]}, "b": "two"}', '{"it\'s": true}', "{}"]
    documents = spark.createDataFrame([(x,) for x in given], "result string")
    found = folders.variants(documents)
    assert [f.name for f in folders.fields(found).fields] == ["a", "b", "c", "it's"]
    folders.export_csv_to(found, str(tmp_path / "csv"))
    back = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(str(tmp_path / "csv"))
    assert back.columns == ["a", "b", "c", "it's"]
    assert sorted(map(tuple, back.collect()), key=repr) == sorted([('x,"y"\n', "1", None, None), (None, "two", '{"k":[1,null]}', None), (None, None, None, "true"), (None,) * 4], key=repr)
    for none in (found.where("false"), folders.variants(documents.where("result = '{}'"))):
        with pytest.raises(ValueError, match="No results to export"):
            folders.table_of(none)


def test_two_runs(spark):
    """By hand: a failed result counts, but not in means and sums; missing numbers are 0; a run that is not there has nothing."""
    from weftline.operators import folders

    rows = [("a", '{"success": true, "duration_seconds": 4, "success_rate": 50, "output_size_mb": 2}'), ("a", '{"success": true}'), ("a", '{"duration_seconds": 99}'), ("b", '{"success": true, "duration_seconds": 1.5, "success_rate": 25, "output_size_mb": 2}'), ("c", '{"success": false}')]
    results = folders.variants(spark.createDataFrame(rows, "file string, result string"))
    of = lambda one, two: tuple(folders.compared(results, one, two).first())
    assert of("a", "b") == (3, 2, 2.0, 25.0, 2.0, 1, 1, 1.5, 25.0, 2.0, -0.5, 0.0, 0.0, -25.0, "FASTER", "SAME", 0.0)
    assert of("b", "a")[10:] == (0.5, 0.0, 0.0, pytest.approx(100 / 3), "SLOWER", "SAME", 0.0)
    assert of("c", "b") == (1, 0, 0.0, 0.0, 0.0, 1, 1, 1.5, 25.0, 2.0, 1.5, 25.0, 2.0, 0.0, "SLOWER", "BETTER", 0.0)
    assert of("none", "none")[:10] == (0, 0, 0.0, 0.0, 0.0) * 2


def test_table_functions(spark):
    from weftline.functions import tables

    tables.register(spark)
    frame = spark.createDataFrame([(1, "<a><b><url><loc>u</loc></url></b></a>", "<img src=x><!-- <img src=y> -->"), (2, "<a>", ""), (3, None, None)], "id int, xml string, html string")
    frame.createOrReplaceTempView("given")
    assert [tuple(r) for r in spark.sql("SELECT g.id, s.kind, s.loc, s.title FROM given g, LATERAL sitemap_rows(g.xml) s").collect()] == [(1, "url", "u", None)]
    assert [tuple(r) for r in spark.sql("SELECT g.id, a.* FROM given g, LATERAL asset_refs(g.html) a").collect()] == [(1, "img", "x", 9, 10)]
    with pytest.raises(Exception, match="sitemap_rows takes a text, not int"):
        spark.sql("SELECT * FROM sitemap_rows(5)").collect()


def test_entries_are_appended(spark, tmp_path):
    from weftline.operators import folders

    root = str(tmp_path / "out")
    os.makedirs(root)
    for rows in ([("a/metadata.json", 2, '{"i":"é"}'), ("a/metadata.json", 1, '{"i":1}'), ("b/metadata.json", 1, "{}")], [("a/metadata.json", 0, '{"i":3}'), ("c/metadata.json", 0, "[]")]):
        folders.append_entries(spark.createDataFrame(rows, "path string, at int, entry string"), root)
    assert {k: json.loads(v) for k, v in there(root).items()} == {"a/metadata.json": [{"i": 1}, {"i": "é"}, {"i": 3}], "b/metadata.json": [{}], "c/metadata.json": [[]]}


def test_new_folders_are_moved_whole(tmp_path, monkeypatch):
    """At the end of a write a folder costs one move, however many files it has; folders that are there get the files."""
    from pyarrow import fs

    class Counting:
        moves = 0

        def __getattr__(self, name):
            return getattr(fs.LocalFileSystem(), name)

        def move(self, *way):
            Counting.moves += 1
            fs.LocalFileSystem().move(*way)

    writer = archive.Writer(str(tmp_path), False)
    written = []
    for task in "ab":
        for name in [*(f"{task}{i}/x/{j}.txt" for i in range(20) for j in range(5)), f"both/{task}.txt", "both/in/one.txt", f"{task}.txt"]:
            path = tmp_path / writer.staging / task / name
            path.parent.mkdir(parents=True, exist_ok=True)
            path.write_text(name + task)
            written.append(name)
    (tmp_path / "a0").mkdir()
    (tmp_path / "a0/old.txt").write_text("old")
    monkeypatch.setattr(archive, "opened", lambda root: (Counting(), root))
    writer.commit([archive.Staged(str(tmp_path / writer.staging / task), 103) for task in "ab"])
    there = {str(x.relative_to(tmp_path)) for x in tmp_path.rglob("*") if x.is_file()}
    assert there == {*written, "a0/old.txt"} and (tmp_path / "both/in/one.txt").read_text() == "both/in/one.txtb"
    assert Counting.moves < 60
