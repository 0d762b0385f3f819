"""Listing pages and book replies that a fetcher has landed as JSON: which of them count, and their rows.

A page row: run (of the fetcher), page (from 0), the page's items and, at venue A, its cursor.
Fetching, signing and retries are a connector's work; these are the rules for what it got.

Pages without run or number are left out; a page landed twice counts twice, as the items of
pages aren't made distinct; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from crossbook.sources.venues import LISTING_A, LISTING_B

# Pages of a listing at most, markets of a page at venue B.
MAX_PAGES, PAGE_SIZE = 100, 100
_EVENT = LISTING_A.removeprefix("ord BIGINT, ")
_MARKET = LISTING_B.removeprefix("ord BIGINT, ")
PAGE_A = f"run STRING, page BIGINT, cursor STRING, events ARRAY<STRUCT<{_EVENT}>>"
PAGE_B = f"run STRING, page BIGINT, markets ARRAY<STRUCT<{_MARKET}>>"
BOOK_A = "orderbook_fp STRUCT<yes_dollars: ARRAY<ARRAY<STRING>>, no_dollars: ARRAY<ARRAY<STRING>>>"


def read_pages(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Landed pages, one JSON document a line; a line that isn't one is left out."""
    return spark.read.schema(schema).json(path).filter("run is not null and page is not null")


def parsed(rows: DataFrame, schema: str) -> DataFrame:
    """Pages (PAGE_A or PAGE_B) of the data source ``landed_pages``: run, page, value. What isn't JSON is a page without items."""
    body = F.from_json("value", schema.split(", ", 2)[2])
    return rows.filter("run is not null and page is not null").select("run", "page", body.alias("body")).select("run", "page", "body.*")


def _until(pages: DataFrame, last: Column, max_pages: int) -> DataFrame:
    """The run's pages up to the first one that ends it, that one included."""
    before = W.partitionBy("run").orderBy("page").rowsBetween(W.unboundedPreceding, -1)
    ended = F.coalesce(F.max(F.col("_last")).over(before), F.lit(False))
    return pages.filter(F.col("page") < max_pages).withColumn("_last", F.coalesce(last, F.lit(True))).withColumn("_ended", ended).filter("not _ended").drop("_last", "_ended")


def _items(pages: DataFrame, name: str) -> DataFrame:
    """Each item with ``ord``, its place in the run: pages count 2**32 each."""
    each = pages.select("run", "page", F.posexplode(name).alias("at", "item"))
    return each.select("run", (F.shiftleft(F.col("page").cast("long"), 32) + F.col("at")).alias("ord"), "item.*")


def listing_a(pages: DataFrame, max_pages: int = MAX_PAGES) -> DataFrame:
    """Events (schema LISTING_A, and run) of venue A's pages: a page without events, without cursor or with the
    cursor that it was asked for by is the last one."""
    asked = F.lag("cursor").over(W.partitionBy("run").orderBy("page"))
    marked = pages.withColumn("_asked", asked)
    last = (F.coalesce(F.size("events"), F.lit(0)) <= 0) | F.col("cursor").isNull() | (F.col("cursor") == "") | F.coalesce(F.col("cursor") == F.col("_asked"), F.lit(False))
    return _items(_until(marked, last, max_pages), "events")


def listing_b(pages: DataFrame, page_size: int = PAGE_SIZE, max_pages: int = MAX_PAGES) -> DataFrame:
    """Markets (schema LISTING_B, and run) of venue B's pages: a page with fewer than ``page_size`` is the last one."""
    return _items(_until(pages, F.coalesce(F.size("markets"), F.lit(0)) < page_size, max_pages), "markets")


def replies(lines: DataFrame, schema: str = BOOK_A) -> DataFrame:
    """id and ``book`` of replies (id, value): null where the fetch failed or the value isn't a book."""
    book = F.from_json("value", schema)
    return lines.select("id", F.when(book[schema.split(" ", 1)[0]].isNotNull(), book).alias("book"))


def book_of(books: DataFrame, market_id: str) -> DataFrame:
    """The one book of a market; no row without one."""
    return books.filter(F.col("id") == market_id).limit(1)


def known_only(messages: DataFrame, markets: DataFrame, slug: str = "marketSlug") -> DataFrame:
    """Messages of markets that are listed; ``messages`` may be a stream."""
    known = markets.select(F.col("slug").alias("_slug")).distinct()
    return messages.join(F.broadcast(known) if messages.isStreaming else known, F.col(slug) == F.col("_slug"), "left_semi")
