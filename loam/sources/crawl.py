"""Crawling over stored pages: breadth-first search as joins, one round for each depth."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import text as T
from ..functions.urls import resolved


def crawl(pages: DataFrame, seeds: DataFrame, depth: int = 3, most: int = 500, least_bytes: int = 50) -> DataFrame:
    """url, depth and content_hash of the pages reached from seeds (url), nearest first, at most `most`, those of one url by hash; pages of fewer than least_bytes of text aren't kept.

    A link leads to the page of the same host and path. The limit is the crawl's budget of pages.
    """
    address = lambda u: F.regexp_replace(F.regexp_replace(u, r"[?#].*$", ""), r"/$", "")
    known = pages.select("url", address(resolved(F.col("url"), F.col("url"))).alias("address"), F.transform(T.links(F.col("html"), F.col("url")), address).alias("targets"), T.html_to_text(F.col("html")).alias("content"))
    seen = known.join(seeds.distinct(), "url", "left_semi").select("address").distinct().withColumn("depth", F.lit(0)).checkpoint()
    for level in range(1, depth + 1):
        edge = seen.filter(F.col("depth") == level - 1).join(known, "address").select(F.explode("targets").alias("address")).distinct()
        fresh = edge.join(known.select("address").distinct(), "address", "left_semi").join(seen, "address", "left_anti").withColumn("depth", F.lit(level))
        seen = seen.union(fresh).checkpoint()
        if not seen.filter(F.col("depth") == level).limit(1).count():
            break
    reached = known.join(seen, "address").filter(F.octet_length("content") >= least_bytes).withColumn("content_hash", F.sha2("content", 256))
    order = ["depth", "url", "content_hash"]
    place = F.row_number().over(Window.orderBy(*order))
    return reached.orderBy(*order).limit(most).select("url", "depth", "content_hash", place.alias("place"))
