"""Pages of which several have one URL, against SQL."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from loam.plans import ORACLES, QUERIES
from loam.sources.crawl import crawl
from loam.sources.tables import with_checkpoints

# page_id % 3 <> 0 is known, page_id % 5 = 0 with another hash, page_id % 2 = 0 comes again.
PAGES = {1: "a", 2: "a", 4: "a", 5: "b", 10: "b", 3: "c", 6: "c", 7: "d", 8: "e", 11: "f", 13: "f", 12: "g"}
TABLES = {
    "documents": ([(0, "", "en", "src1")], "doc_id bigint, text string, lang string, source string"),
    "events": ([(0, dt.datetime(2024, 1, 1))], "user_id bigint, ts timestamp"),
    "labels": ([(0, 1, 0)], "doc_id bigint, quality int, toxic int"),
}


def of_both(spark, at, name, pages):
    """The rows of a query and of its SQL."""
    duckdb = pytest.importorskip("duckdb")
    for table, (rows, schema) in (TABLES | {"pages": (pages, "page_id bigint, url string, html string")}).items():
        spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{at}/{table}.parquet")
        duckdb.sql(f"CREATE OR REPLACE VIEW {table} AS SELECT * FROM '{at}/{table}.parquet/*.parquet'")
    got = QUERIES[name](spark, str(at))
    wanted = duckdb.sql(ORACLES[name])
    return sorted(map(tuple, got.select(wanted.columns).collect()), key=str), sorted(wanted.fetchall(), key=str)


def test_statuses_of_pages_with_one_url(spark, tmp_path):
    got, wanted = of_both(spark, tmp_path, "reingest", [(i, f"http://s.org/{u}", f"<p>{u}{i % 2}</p>") for i, u in PAGES.items()])
    assert got == wanted and sum(r[1] for r in got) > len(PAGES)


def test_upserts_over_pages_with_one_url(spark, tmp_path):
    pages = [(i, f"http://s.org/{u}", f"<p>{u}{i}</p>") for i, u in PAGES.items()] + [(14, "http://s.org/d", None), (16, "http://s.org/h", None), (19, None, "<p>x</p>"), (20, None, "<p>y</p>")]
    got, wanted = of_both(spark, tmp_path, "upsert_pages", pages)
    assert got == wanted and len(got) > len(set(got))


def test_crawled_pages_of_one_url_have_one_order(spark):
    with_checkpoints(spark)
    body = lambda i: f"<p>{'text of a page ' * 6}{i}</p>"
    pages = spark.createDataFrame([(f"http://s.org/{i // 8}", body(i)) for i in range(40)], "url string, html string")
    got = [[(r.url, r.content_hash, r.place) for r in crawl(p, pages.select("url"), most=20).orderBy("place").collect()] for p in (pages.orderBy("html").coalesce(1), pages.orderBy(F.desc("html")).coalesce(1))]
    assert got[0] == got[1] and [r[:2] for r in got[0]] == sorted(r[:2] for r in got[0]) and len(got[0]) == 20
