"""Sitemaps, sitemap indexes and feeds, at any depth; robots files."""

from __future__ import annotations

import re
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

FIELDS = ("kind", "loc", "title", "lastmod", "changefreq", "priority")
ENTRY = StructType([StructField(name, StringType()) for name in FIELDS])
_ARROW = pa.list_(pa.struct([(name, pa.string()) for name in FIELDS]))
_NAMESPACE = re.compile('xmlns="[^"]+"')
#: For each form, in the order in which they are tried: its element, where the address is, and what else is read. Fixed values.
_FORMS = (
    ("sitemap", "sitemap", "loc", {}),
    ("rss", "item", "link", {"title": "title", "lastmod": "pubDate"}),
    ("atom", "entry", "link", {"title": "title", "lastmod": "updated"}),
    ("url", "url", "loc", {"lastmod": "lastmod", "changefreq": "changefreq", "priority": "priority"}),
)


def entries(xml: str | None) -> list[tuple]:
    """(kind, loc, title, lastmod, changefreq, priority) of a document's entries, at any depth below its root; the first form that has elements decides.

    An entry without an address is none, an empty field is null; a broken, empty or null document has no entries.
    """
    try:
        root = ElementTree.fromstring(_NAMESPACE.sub("", xml or ""))
    except (ElementTree.ParseError, ValueError):
        return []
    for kind, element, address, others in _FORMS:
        found = root.findall(f".//{element}")
        if found:
            out = []
            for x in found:
                at = x.find(address)
                loc = None if at is None else at.get("href") if kind == "atom" else at.text
                if loc:
                    out.append((kind, loc, *((x.findtext(others[name]) or None) if name in others else None for name in FIELDS[2:])))
            return out
    return []


@F.arrow_udf(ArrayType(ENTRY))
def sitemap_entries(xml: pa.Array) -> pa.Array:
    """entries() of each document."""
    return pa.array([[dict(zip(FIELDS, e, strict=True)) for e in entries(x)] for x in xml.to_pylist()], _ARROW)


#: What stands for a character in markup, the ampersand first; white space would come back changed from an attribute. Fixed values.
_ESCAPES = {"&": "&amp;", "<": "&lt;", ">": "&gt;", '"': "&quot;", "\t": "&#9;", "\n": "&#10;", "\r": "&#13;"}


def escaped(text: Column) -> Column:
    """Text as markup, for an element or a quoted attribute, whatever it looks like; null stays null. Control characters that XML 1.0 has no form for stay as they are."""
    for character, form in _ESCAPES.items():
        text = F.replace(text, F.lit(character), F.lit(form))
    return text


_DIRECTIVES = ("sitemap", "disallow", "allow")


def directives(text: str | None) -> list[tuple[str, str]]:
    """(kind, value) of a robots file, in order; groups and comments do not matter, empty paths are left out, empty sitemaps stay."""
    out = []
    for line in (text or "").split("\n"):
        line = line.strip()
        kind = line.partition(":")[0].lower()
        if kind in _DIRECTIVES and ":" in line:
            value = line.partition(":")[2].strip()
            if value or kind == "sitemap":
                out.append((kind, value))
    return out
