"""Table functions for SQL: FROM pages, LATERAL sitemap_rows(xml) and LATERAL asset_refs(html)."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from weftline.functions import feeds, html


def _texts(what: str, argument: AnalyzeArgument, schema: StructType) -> AnalyzeResult:
    if not isinstance(argument.dataType, StringType):
        raise ValueError(f"{what} takes a text, not {argument.dataType.simpleString()}")
    return AnalyzeResult(schema)


@udtf
class SitemapRows:
    """The entries of a sitemap, an index or a feed, at any depth; no rows for broken, empty and null documents."""

    @staticmethod
    def analyze(xml: AnalyzeArgument) -> AnalyzeResult:
        return _texts("sitemap_rows", xml, feeds.ENTRY)

    def eval(self, xml: str) -> Iterator[tuple]:
        yield from feeds.entries(xml)


@udtf
class AssetRefs:
    """The addresses in a page's link, img, script and meta elements, with the places of their values; no rows for null."""

    @staticmethod
    def analyze(page: AnalyzeArgument) -> AnalyzeResult:
        return _texts("asset_refs", page, html.REFS.elementType)

    def eval(self, page: str) -> Iterator[tuple]:
        for ref in html.references(html.parsed(page)) if page is not None else ():
            yield tuple(ref.values())


def register(spark: SparkSession) -> None:
    spark.udtf.register("sitemap_rows", SitemapRows)
    spark.udtf.register("asset_refs", AssetRefs)
