"""Expressions against plain restatements, the standard library and hand-made cases."""

from urllib.parse import urljoin

from pyspark.sql import functions as F

from weftline.functions import urls as U


def one(spark, expression, **columns):
    return spark.createDataFrame([tuple(columns.values())], list(columns)).select(expression).first()[0]


def test_relative_references_follow_the_rfc(spark):
    bases = ["http://h/a", "http://h/a/", "http://h", "http://h/a/b?x=1/2", "http://h/a//b#f"]
    refs = ["x.css", "d/x.css", "/r.css", "//c/x.js", "https://z/y"]
    rows = [(b, r) for b in bases for r in refs]
    got = spark.createDataFrame(rows, "base string, ref string").select("base", "ref", U.normalized(F.col("base"), F.col("ref")).alias("n"), U.normalized_udf("base", "ref").alias("u")).collect()
    for base, ref, native, udf in got:
        expected = "http:" + ref if ref.startswith("//") else urljoin(base + "/", ref)
        assert native == udf == expected, (base, ref)


def test_names(spark):
    assert one(spark, U.clean_url(F.col("u")), u="http://h/a///") == "http://h/a"
    assert one(spark, U.file_name(F.col("u")), u="http://h/a/b.css?v=1#x") == "b.css"
    assert one(spark, U.file_name(F.col("u")), u="") == "index.html"
    assert one(spark, U.domain(F.col("u")), u="https://a:b@h:8/p?q") == "https://a:b@h:8"
    assert one(spark, U.page_name(F.col("u")), u="**") == "unnamed"
    assert one(spark, U.from_base64(F.col("u")), u="no base64!") is None
    assert one(spark, U.from_base64(F.col("u")), u="/////w==") is None
    long = "http://h/" + "x" * 100
    assert one(spark, U.from_base64(U.base64_url(F.col("u"))), u=long) == long
    assert one(spark, U.directory(F.col("u")), u="http://h/a//./b?/c.html") == "a/b"


def test_url_classes(spark):
    cases = {"/category/x": "categories", "/tags/x/": "tags", "/author/x": "authors", "/a.PNG": "media", "/2024/05/x": "posts", "/about": "pages", "/a/b/c/d": "posts", "/a/": "pages", "/2024/": "posts", "": "pages"}
    for path, kind in cases.items():
        assert one(spark, U.url_class(F.col("u")), u="http://h" + path) == kind, path


def test_dot_segments(spark):
    """By RFC 3986, on references that the expression leaves to the batch function."""
    cases = {("http://h/a/b", "../c.css"): "http://h/a/c.css", ("http://h/a/b", "./c.css"): "http://h/a/b/c.css", ("http://h/a", "x/../../c.png"): "http://h/c.png", ("http://h/a", "../../../c"): "http://h/c", ("http://h/a", "?q=1"): "http://h/a/?q=1", ("http://h/a", ""): ""}
    rows = spark.createDataFrame(list(cases), "base string, ref string")
    assert {(r.base, r.ref): r.u for r in rows.select("base", "ref", U.normalized_udf("base", "ref").alias("u")).collect()} == cases


def test_command_line(spark, capsys):
    from weftline.__main__ import main

    assert main([]) == 0 and "page_titles" in capsys.readouterr().out
    assert main(["no_such_query", "x"]) == 2
    assert main(["page_titles", "/root/testdata/sf0.001"]) == 0 and "title" in capsys.readouterr().out
