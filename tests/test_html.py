"""Pages by structure, against the standard library's parser and a plain stack over it."""

import random
from html.parser import HTMLParser

import pytest

from weftline.functions import html as H

SF = "/root/testdata/sf0.01"
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
rng = random.Random(11)


class Plain(HTMLParser):
    """Nested dictionaries: every element with its name, attributes and children; texts as strings."""

    def __init__(self, html):
        super().__init__()
        self.root = {"name": "", "attrs": {}, "inside": []}
        self.stack = [self.root]
        self.all = []
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        new = {"name": tag, "attrs": {k: v or "" for k, v in attrs}, "inside": []}
        self.stack[-1]["inside"].append(new)
        self.all.append(new)
        if tag not in VOID:
            self.stack.append(new)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.stack.pop()

    def handle_endtag(self, tag):
        self.stack[-1]["inside"].append(None)  # a run of text ends at any tag
        if any(x["name"] == tag for x in self.stack[1:]):
            while self.stack.pop()["name"] != tag:
                pass

    def handle_data(self, data):
        inside = self.stack[-1]["inside"]
        if inside and isinstance(inside[-1], str):
            inside[-1] += data
        else:
            inside.append(data)

    def handle_comment(self, data):
        self.stack[-1]["inside"].append(None)

    handle_decl = handle_pi = unknown_decl = handle_comment


def text(node, top=True):
    out = ""
    for x in node["inside"]:
        if isinstance(x, str):
            out += x.strip() if top or node["name"] not in ("script", "style") else ""
        elif x:
            out += text(x, False)
    return out


def same(html):
    tree, plain = H.parsed(html), Plain(html)
    assert [(e.name, {k: v[0] for k, v in e.attrs.items()}) for e in tree.elements] == [(x["name"], x["attrs"]) for x in plain.all]
    where = {id(x): i for i, x in enumerate(plain.all)}
    for i, x in enumerate(plain.all):
        assert tree.children(i) == [where[id(c)] for c in x["inside"] if isinstance(c, dict)]
        assert tree.text(i) == text(x)
        for name, (value, at, until) in tree.elements[i].attrs.items():
            if "&" not in html[at:until]:
                assert html[at:until] == value, name


def test_pages(spark):
    for r in spark.read.parquet(f"{SF}/pages.parquet").select("html").collect():
        same(r.html)


PIECES = ["<div>", "<p class='a b'>", "</p>", "</div>", "<b>", "</b>", "<br>", "<img src=x.png alt='>'>", "<img/>", "<a href=\"/q?a=1&amp;b=2\">", "</a>", "text ", " &amp; é ", "<!-- <p>no</p> -->", "<script>if (a<b) '</p>'</script>", "<style>p{}</style>", "<ul><li>1<li>2</ul>", "<!DOCTYPE html>", "< no tag", "<section/>", "</none>"]


@pytest.mark.parametrize("seed", range(60))
def test_soup(seed):
    pick = random.Random(seed)
    same("<html>" + "".join(pick.choice(PIECES) for _ in range(pick.randrange(1, 60))))


PAGE = """<html><body><nav id=n><ul class="x y"><li>1</li><li lang="de-AT">2<li>3</ul></nav><div class="ad"><div>in</div>out</div><article data-k="v1 v2"><p>one<p>two<b>bold</article>
<p class="last">end<img src="a.png"><img src="b.jpg"></body></html>"""


@pytest.mark.parametrize(("selector", "kind", "content"), [
    ("div", "css", '<div class="ad"><div>in</div>out</div>'), ("div div", "css", "<div>in</div>"), ("body > div", "css", '<div class="ad"><div>in</div>out</div>'), (".ad>div", "css", "<div>in</div>"), ("#n .y li:first-child", "css", "<li>1</li>"),
    ("li + li", "css", '<li lang="de-AT">2<li>3</li>'), ("[lang|=de]", "css", '<li lang="de-AT">2<li>3</li>'), ("nav ~ article b", "css", "<b>bold</b>"), ("[data-k~='v2'] p", "css", "<p>one<p>two<b>bold</p>"), ("img[src$='.jpg']", "css", '<img src="b.jpg">'),
    ("h1, b", "css", "<b>bold</b>"), ("*[class^=las]", "css", '<p class="last">end<img src="a.png"><img src="b.jpg"></p>'), ("//article//b", "xpath", "<b>bold</b>"), ("/html/body/div/div[1]", "xpath", "<div>in</div>"), ("//img[2]", "xpath", '<img src="b.jpg">'),
    ("//*[@id='n']/ul/li[last()]", "xpath", '<li lang="de-AT">2<li>3</li>'), ("//p[contains(@class, 'as')]", "xpath", '<p class="last">end<img src="a.png"><img src="b.jpg"></p>'), ("//div[@class]", "xpath", '<div class="ad"><div>in</div>out</div>'),
])
def test_selectors(selector, kind, content):
    tree = H.parsed(PAGE)
    found = H.first(tree, selector)
    assert (found[0], tree.outer(found[1])) == (kind, content)


@pytest.mark.parametrize("selector", ["", "h1", "#nn", "..", "//h1", "//p[0]", "//p[text()='x']", "a[", "p:hover", "nav > li", "//nav/li", "???", "article + nav"])
def test_nothing_found(selector):
    assert H.first(H.parsed(PAGE), selector) is None


def test_columns(spark):
    """Nulls, empty texts, selectors by row, the error, and what strict does with it."""
    rows = [(1, PAGE, "nav li"), (2, PAGE, "h1"), (3, None, "p"), (4, "", "p"), (5, PAGE, None), (6, "<p>" * 3_000 + "deep", "p p p")]
    pages = spark.createDataFrame(rows, "page_id int, html string, selector string")
    from pyspark.sql import functions as F

    found = {r[0]: r[1] for r in pages.select("page_id", H.content(F.col("html"), F.col("selector"))).collect()}
    lost = lambda s: f"Could not find element with selector '{s}'. Tried both CSS and XPath. Please check your selector."
    assert tuple(found[1]) == ("css", "<html><body><li>1</li></body></html>", None)
    assert [tuple(found[i]) for i in (2, 3, 4, 5)] == [(None, None, lost("h1")), (None,) * 3, (None, None, lost("p")), (None,) * 3]
    assert found[6].content.startswith("<html><body><p>") and len(found[6].content) > 8_000
    with pytest.raises(Exception, match="Could not find element with selector '(h1|p)'"):
        pages.select(H.content(F.col("html"), F.col("selector"), strict=True).alias("c")).select("c.error").collect()
    refs = pages.where("page_id in (1, 3, 4)").select("page_id", H.asset_refs("html")).collect()
    assert {r[0]: r[1] and [(x.kind, x.ref) for x in r[1]] for r in refs} == {1: [("img", "a.png"), ("img", "b.jpg")], 3: None, 4: []}
    changes = spark.createDataFrame([("abcdef", [(1, 2, "XY"), (4, 4, "-")]), ("abc", None), ("é\U0001f600b", [(1, 2, "")])], "t string, c array<struct<at:int,until:int,new:string>>")
    assert [r[0] for r in changes.select(H.spliced(F.col("t"), F.col("c"))).collect()] == ["aXYcd-ef", "abc", "éb"]
