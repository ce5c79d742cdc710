"""URLs and paths as column expressions: cleaning, joining, splitting, classifying. All run inside code generation."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def stripped(x: Column) -> Column:
    """x without white space at its ends (Spark's trim takes spaces only)."""
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def clean_url(url: Column) -> Column:
    """Without trailing slashes; nothing else changes."""
    return F.regexp_replace(url, "/+$", "")


def ensure_scheme(url: Column) -> Column:
    return F.when(url.rlike("^https?://"), url).otherwise(F.concat(F.lit("https://"), url))


def domain(url: Column) -> Column:
    """scheme://authority, port and user included; empty where there is no scheme."""
    return F.regexp_extract(url, r"^([^:/?#]+://[^/?#]*)", 1)


def path(url: Column) -> Column:
    """The path, without query and fragment, and without what follows a semicolon in its last segment."""
    whole = F.regexp_extract(url, r"^[^:/?#]+://[^/?#]*([^?#]*)", 1)
    return F.regexp_replace(whole, r";[^/]*$", "")


def normalized(base: Column, ref: Column) -> Column:
    """ref as an absolute URL. Null for relative references with dot segments; normalized_udf takes those too."""
    # A relative reference replaces what follows the last slash of base + "/", which may be in the query; slashes in a row are one.
    whole = F.regexp_extract(base, r"^[^:/?#]+://[^/?#]*([^?#]*)", 1)
    folder = F.when(base.rlike("[?#]"), F.regexp_replace(whole, "[^/]*$", "")).otherwise(whole)
    simple = ~ref.rlike(r"(^|/)\.\.?(/|$|\?|#)") & ~ref.rlike(r"^[?#;]") & ~ref.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:")
    return (
        F.when(F.length(stripped(ref)) == 0, ref)
        .when(ref.startswith("//"), F.concat(F.lit("http:"), ref))
        .when(ref.rlike("^https?://"), ref)
        .when(ref.startswith("data:"), ref)
        .when(ref.startswith("/"), F.concat(domain(base), ref))
        .when(simple, F.concat(domain(base), F.regexp_replace(F.concat(F.lit("/"), folder, F.lit("/")), "/+", "/"), ref))
    )


@F.pandas_udf(StringType())
def normalized_udf(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """normalized() for every reference, by RFC 3986 where it is relative."""
    from urllib.parse import urljoin, urlparse

    def one(base: str | None, ref: str | None) -> str | None:
        if ref is None or not ref.strip():
            return ref
        if ref.startswith("//"):
            return "http:" + ref
        if ref.startswith(("http://", "https://", "data:")) or base is None:
            return ref
        try:
            if ref.startswith("/"):
                parts = urlparse(base)
                return f"{parts.scheme}://{parts.netloc}{ref}"
            return urljoin(base + "/", ref)
        except ValueError:
            return ref

    for base, ref in batches:
        yield pd.Series([one(b, r) for b, r in zip(base, ref, strict=True)])


def absolute(base: Column, ref: Column) -> Column:
    """normalized() for every reference; only those that the expressions leave open go through Python."""
    simple = normalized(base, ref)
    return F.coalesce(simple, normalized_udf(F.when(simple.isNull(), base), F.when(simple.isNull(), ref)))


def base64_url(url: Column) -> Column:
    """Standard base64 of the UTF-8 bytes, without the line breaks that Spark's base64 may put in."""
    return F.translate(F.base64(F.encode(url, "UTF-8")), "\r\n", "")


def job_id(url: Column) -> Column:
    """URL-safe base64 without padding."""
    return F.rtrim(F.translate(base64_url(url), "+/", "-_"), F.lit("="))


def from_base64(name: Column) -> Column:
    """The text behind a base64 name; null where it is not base64, or not of text."""
    return F.try_validate_utf8(F.try_to_binary(name, F.lit("base64")).cast("string"))


def sanitized(name: Column) -> Column:
    """Without the characters that file systems refuse."""
    return F.translate(name, '/\\<>:"|?*', "")


def directory(url: Column) -> Column:
    """Where a page's file goes below its project: path segments but the first and last, empty and '.' ones left out."""
    parts = F.filter(F.split(F.regexp_replace(url, "^[^:/?#]+://", ""), "/"), lambda x: (x != "") & (x != "."))
    middle = F.when(F.size(parts) > 2, F.slice(parts, F.lit(2), F.size(parts) - 2)).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.transform(middle, sanitized), "/")


def file_name(url: Column) -> Column:
    """The last path segment without query and fragment; index.html where there is none."""
    cut = F.regexp_replace(F.substring_index(F.substring_index(url, "?", 1), "#", 1), "/+$", "")
    return F.coalesce(F.nullif(F.element_at(F.split(cut, "/"), -1), F.lit("")), F.lit("index.html"))


def extension(name: Column) -> Column:
    """What follows the last dot of a file name, in lower case; empty where there is none."""
    return F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))


def page_name(name: Column) -> Column:
    """Letters, digits, spaces, hyphens and underscores of a name; unnamed where none is left."""
    return F.coalesce(F.nullif(F.trim(F.regexp_replace(name, r"[^\p{L}\p{N} _-]", "")), F.lit("")), F.lit("unnamed"))


def url_class(url: Column) -> Column:
    """The kind of page that a path stands for on a blogging platform."""
    p = F.lower(path(url))
    slashes = F.length(p) - F.length(F.replace(p, F.lit("/"), F.lit("")))
    has = lambda *words: F.greatest(*[p.contains(w) for w in words])
    return (
        F.when(has("/category/", "/categories/"), "categories")
        .when(has("/tag/", "/tags/"), "tags")
        .when(has("/author/", "/authors/"), "authors")
        .when(p.contains("/wp-content/uploads/") | p.rlike(r"\.(jpg|png|pdf|zip)$"), "media")
        .when(p.rlike("/[0-9]{4}/[0-9]{2}/"), "posts")
        .when((slashes <= 2) & ~p.endswith("/"), "pages")
        .when((slashes >= 3) | p.rlike("[0-9]{4}"), "posts")
        .otherwise("pages")
    )
