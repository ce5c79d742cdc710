"""Markup by structure: a tag-soup tree for each page, selectors over it, and the places of references in the text.

Pages are read in Arrow batches, one after the other; what comes back are columns (references with their offsets, the first
element for a selector, texts), so that joins, grouping and rewriting stay with Spark.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from dataclasses import dataclass, field
from functools import lru_cache
from html import unescape

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

#: Elements that hold nothing, and elements whose content is no markup.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr basefont bgsound command frame keygen".split())
RAW = ("script", "style")
_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>"']|"[^"]*"|'[^']*')*+|[^>]*)(?:>|\Z)""", re.S
)
_ATTR = re.compile(r"""([^\s/>=][^\s/>=]*)(?:\s*=+\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']?[^\s>]*)))?""")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}


@dataclass(slots=True)
class Element:
    """An element by offsets into its page: the start tag begins at `at` and ends at `inner`; what it holds ends at `close`, all of it at `end`."""

    name: str
    attrs: dict[str, tuple[str, int, int]]
    parent: int
    at: int
    inner: int
    close: int = -1
    end: int = -1
    last: int = -1

    def get(self, name: str) -> str | None:
        return self.attrs[name][0] if name in self.attrs else None


@dataclass(slots=True)
class Tree:
    """The elements of a page in document order, and its runs of text as (offset, text, container)."""

    html: str
    elements: list[Element] = field(default_factory=list)
    texts: list[tuple[int, str, int]] = field(default_factory=list)

    def children(self, parent: int) -> list[int]:
        found, at, stop = [], parent + 1, self.elements[parent].last if parent >= 0 else len(self.elements) - 1
        while at <= stop:
            found.append(at)
            at = self.elements[at].last + 1
        return found

    def outer(self, i: int) -> str:
        """The markup of an element as it stands; one that the page never closes gets an end tag."""
        e = self.elements[i]
        whole = self.html[e.at : e.end]
        return whole if e.end > e.close or e.name in VOID or e.inner == e.end and whole.endswith("/>") else f"{whole}</{e.name}>"

    def text(self, i: int) -> str:
        """The text in an element: its runs, each without white space at its ends; comments are none, scripts and styles only of themselves."""
        e = self.elements[i]
        own = self.texts[bisect_left(self.texts, (e.inner,)) : bisect_left(self.texts, (e.close,))]
        return "".join(text.strip() for _, text, holder in own if self.elements[holder].name not in RAW or holder == i)


def parsed(html: str) -> Tree:
    """An end tag closes the innermost open element of its name and all in it, and is nothing if there is none; what is open at the end ends there."""
    tree, stack = Tree(html), [-1]
    elements, open_names = tree.elements, {}
    text_from = at = 0

    def said(stop: int) -> None:
        if stop > text_from:
            run = html[text_from:stop]
            if stack[-1] >= 0:
                tree.texts.append((text_from, unescape(run) if "&" in run and elements[stack[-1]].name not in RAW else run, stack[-1]))

    def shut(close: int, end: int) -> None:
        i = stack.pop()
        elements[i].close, elements[i].end, elements[i].last = close, end, len(elements) - 1
        open_names[elements[i].name] -= 1

    while found := _TOKEN.search(html, at):
        said(found.start())
        text_from = at = found.end()
        name = found["name"]
        if name is None:
            continue
        name = name.lower()
        if found["close"]:
            if open_names.get(name):
                while elements[stack[-1]].name != name:
                    shut(found.start(), found.start())
                shut(found.start(), found.end())
            continue
        base, attrs = found.start("attrs"), {}
        for a in _ATTR.finditer(found["attrs"]):
            k = next((k for k in (2, 3, 4) if a[k] is not None), 0)
            value = a[k] if k else ""
            attrs[a[1].lower()] = (unescape(value) if "&" in value else value, base + (a.start(k) if k else a.end()), base + a.end(k if k else 0))
        elements.append(Element(name, attrs, stack[-1], found.start(), found.end()))
        stack.append(len(elements) - 1)
        open_names[name] = open_names.get(name, 0) + 1
        if name in VOID or found["attrs"].endswith("/"):
            shut(found.end(), found.end())
        elif name in RAW:
            stop = _RAW_END[name].search(html, at)
            at = stop.start() if stop else len(html)
    said(len(html))
    while len(stack) > 1:
        shut(len(html), len(html))
    return tree


# Selectors. A compound is a tuple of tests of one element; a CSS selector is alternatives of (combinator, compound) from right to left.

_SIMPLE = re.compile(
    r"""(?P<tag>\*|[a-zA-Z][\w-]*)|\#(?P<id>[\w-]+)|\.(?P<cls>[\w-]+)|\[\s*(?P<attr>[\w:-]+)\s*(?:(?P<op>[~^$*|]?=)\s*(?:"(?P<dq>[^"]*)"|'(?P<sq>[^']*)'|(?P<bare>[\w-]+))\s*)?\]|:(?P<pseudo>first-child|last-child|only-child)"""
)
_BETWEEN = re.compile(r"\s*([>+~,])\s*|\s+")
_HOLDS = {
    "=": lambda have, want: have == want, "~=": lambda have, want: want in have.split(), "^=": lambda have, want: bool(want) and have.startswith(want), "$=": lambda have, want: bool(want) and have.endswith(want),
    "*=": lambda have, want: bool(want) and want in have, "|=": lambda have, want: have == want or have.startswith(want + "-"),
}


@lru_cache(1024)
def css(selector: str) -> list[list[tuple[str, tuple]]]:
    """Tags, #id, .class, [attribute] with all operators, first, last and only child, joined by descent, >, + and ~, in lists. Anything else is an error."""
    text, at, steps, out, between = selector.strip(), 0, [], [], ""
    while True:
        tests, start = [], at
        while (found := _SIMPLE.match(text, at)) and (at == start or not found["tag"]):
            value = next((v for v in (found["dq"], found["sq"], found["bare"]) if v is not None), "")
            tests.append(next((k, v.lower() if k == "tag" else v) for k, v in found.groupdict().items() if v is not None and k in ("tag", "id", "cls", "pseudo", "attr")) + ((found["op"], value) if found["attr"] else ()))
            at = found.end()
        if not tests:
            raise ValueError(f"no CSS selector: {selector}")
        steps.append((between, tuple(tests)))
        if at == len(text):
            return [*out, steps[::-1]]
        found = _BETWEEN.match(text, at)
        if not found:
            raise ValueError(f"no CSS selector: {selector}")
        between, at = found[1] or " ", found.end()
        if between == ",":
            out.append(steps[::-1])
            steps, between = [], ""


def _is(tree: Tree, i: int, tests: tuple) -> bool:
    e = tree.elements[i]
    for kind, want, *more in tests:
        if kind == "tag":
            good = want in ("*", e.name)
        elif kind == "id":
            good = e.get("id") == want
        elif kind == "cls":
            good = want in (e.get("class") or "").split()
        elif kind == "attr":
            have = e.get(want.lower())
            good = have is not None and (not more[0] or _HOLDS[more[0]](have, more[1]))
        else:
            others = tree.children(e.parent)
            good = (want == "last-child" or others[0] == i) and (want == "first-child" or others[-1] == i)
        if not good:
            return False
    return True


def _fits(tree: Tree, i: int, steps: list, k: int = 0) -> bool:
    """Does element i fit step k (the last is 0), and something before it the steps before that?"""
    between, tests = steps[k]
    if not _is(tree, i, tests):
        return False
    if k + 1 == len(steps):
        return True
    parent = tree.elements[i].parent
    if between in "+~":
        before = [x for x in tree.children(parent) if x < i]
        return any(_fits(tree, x, steps, k + 1) for x in (before[-1:] if between == "+" else before[::-1]))
    while parent >= 0:
        if _fits(tree, parent, steps, k + 1):
            return True
        if between == ">":
            return False
        parent = tree.elements[parent].parent
    return False


def first_css(tree: Tree, selector: str) -> int | None:
    ways = css(selector)
    return next((i for i in range(len(tree.elements)) if any(_fits(tree, i, steps) for steps in ways)), None)


_STEP = re.compile(r"(//?)?([a-zA-Z][\w-]*|\*)((?:\[[^\]]*\])*)")
_PREDICATE = re.compile(r"""\[\s*(?:(?P<n>\d+)|(?P<last>last\(\))|@(?P<attr>[\w:-]+)(?:\s*=\s*(?P<q>["'])(?P<is>.*?)(?P=q))?|contains\(\s*@(?P<in>[\w:-]+)\s*,\s*(?P<r>["'])(?P<part>.*?)(?P=r)\s*\))\s*\]""")


@lru_cache(1024)
def xpath(selector: str) -> list[tuple[bool, str, list]]:
    """Steps / and // with a name or *, and the predicates [n], [last()], [@a], [@a='v'] and [contains(@a, 'v')]. Anything else is an error."""
    text, at, steps = selector.strip().removeprefix("."), 0, []
    while at < len(text):
        found = _STEP.match(text, at)
        if not found or (steps and not found[1]):
            raise ValueError(f"no XPath: {selector}")
        tests, inner = [], 0
        while inner < len(found[3]):
            test = _PREDICATE.match(found[3], inner)
            if not test:
                raise ValueError(f"no XPath: {selector}")
            tests.append(test.groupdict())
            inner = test.end()
        steps.append((found[1] == "//", found[2].lower(), tests))
        at = found.end()
    if not steps:
        raise ValueError(f"no XPath: {selector}")
    return steps


def first_xpath(tree: Tree, selector: str) -> int | None:
    now = [-1]
    for deep, name, tests in xpath(selector):
        found: set[int] = set()
        holders: set[int] = set()
        for i in now:
            holders.add(i)
            if deep:
                holders.update(range(i + 1, (tree.elements[i].last if i >= 0 else len(tree.elements) - 1) + 1))
        for holder in holders:
            own = [c for c in tree.children(holder) if name in ("*", tree.elements[c].name)]
            for test in tests:
                if test["n"] or test["last"]:
                    place = len(own) if test["last"] else int(test["n"])
                    own = own[place - 1 : place] if place else []
                elif test["attr"]:
                    own = [c for c in own if (have := tree.elements[c].get(test["attr"])) is not None and test["is"] in (None, have)]
                else:
                    own = [c for c in own if test["part"] in (tree.elements[c].get(test["in"]) or "")]
            found.update(own)
        now = sorted(found)
    return now[0] if now else None


def first(tree: Tree, selector: str) -> tuple[str, int] | None:
    """How a selector was read, and the first element for it: as CSS, else as XPath."""
    for kind, find in (("css", first_css), ("xpath", first_xpath)):
        try:
            if (i := find(tree, selector)) is not None:
                return kind, i
        except ValueError:
            continue
    return None


_LOOKS = ("http://", "https://", "//", "/")


def references(tree: Tree) -> list[dict]:
    """Addresses in link, img, script and meta, in this order, an image's srcset after its src; meta only where the content looks like an address."""
    kinds: dict[str, list] = {"link": [], "img": [], "script": [], "meta": []}
    for e in tree.elements:
        name = {"link": "href", "meta": "content"}.get(e.name, "src")
        if e.name in kinds and name in e.attrs and (e.name != "meta" or e.get(name).startswith(_LOOKS)):
            kinds[e.name].append((e.name, *e.attrs[name]))
            if e.name == "img" and e.get("srcset"):
                kinds["img"].append(("srcset", *e.attrs["srcset"]))
    return [dict(zip(("kind", "ref", "at", "until"), x, strict=True)) for own in kinds.values() for x in own]


_KIND = StructField("kind", StringType())
REFS = ArrayType(StructType([_KIND, StructField("ref", StringType()), StructField("at", IntegerType()), StructField("until", IntegerType())]))
PART = StructType([_KIND, StructField("content", StringType())])
_REFS = pa.list_(pa.struct([("kind", pa.string()), ("ref", pa.string()), ("at", pa.int32()), ("until", pa.int32())]))
_PART = pa.struct([("kind", pa.string()), ("content", pa.string())])


@F.arrow_udf(REFS)
def asset_refs(html: pa.Array) -> pa.Array:
    """references() of a page, with the code-point offsets of each attribute's value; null for null."""
    return pa.array([None if h is None else references(parsed(h)) for h in html.to_pylist()], _REFS)


@F.arrow_udf(PART)
def selected(html: pa.Array, selector: pa.Array) -> pa.Array:
    """How a selector was read (css, xpath) and the markup of the first element for it; null where there is none."""
    out = []
    for h, s in zip(html.to_pylist(), selector.to_pylist(), strict=True):
        tree = None if h is None or s is None else parsed(h)
        found = tree and first(tree, s)
        out.append({"kind": found[0], "content": tree.outer(found[1])} if found else None)
    return pa.array(out, _PART)


@F.arrow_udf(ArrayType(StringType()))
def detected(html: pa.Array, selectors: pa.Array) -> pa.Array:
    """Of some CSS selectors those whose first element has more than 100 characters of text; what is no selector finds nothing."""

    def finds(tree: Tree, selector: str) -> bool:
        try:
            return (i := first_css(tree, selector)) is not None and len(tree.text(i)) > 100
        except ValueError:
            return False

    out = []
    for h, own in zip(html.to_pylist(), selectors.to_pylist(), strict=True):
        tree = None if h is None or own is None else parsed(h)
        out.append(tree and [s for s in own if s is not None and finds(tree, s)])
    return pa.array(out, pa.list_(pa.string()))


#: What is said where neither reading finds an element, and the page that an element is put in.
_LOST = ("Could not find element with selector '", "'. Tried both CSS and XPath. Please check your selector.")


def content(html: Column, selector: Column, strict: bool = False) -> Column:
    """struct<kind, content, error>: a page cut down to the first element for a selector; where there is none, the error is said, or with strict raised."""
    part = selected(html, selector)
    error = F.concat(F.lit(_LOST[0]), selector, F.lit(_LOST[1]))
    whole = F.concat(F.lit("<html><body>"), part["content"], F.lit("</body></html>"))
    lost = part.isNull() & selector.isNotNull() & html.isNotNull()
    told = F.when(lost, F.raise_error(error).cast("string") if strict else error)
    return F.struct(part["kind"].alias("kind"), whole.alias("content"), told.alias("error"))


def spliced(text: Column, changes: Column) -> Column:
    """text with its pieces [at, until) replaced; changes is array<struct<at, until, new>> in order, without overlaps. Null changes change nothing."""
    start = F.struct(F.lit("").alias("done"), F.lit(0).alias("at"))
    step = lambda acc, c: F.struct(F.concat(acc["done"], F.substring(text, acc["at"] + 1, c["at"] - acc["at"]), c["new"]).alias("done"), c["until"].alias("at"))
    end = lambda acc: F.concat(acc["done"], F.substring(text, acc["at"] + 1, F.length(text)))
    return F.when(changes.isNull(), text).otherwise(F.aggregate(changes, start, step, end))
