"""Queries over stored memories: listing, counting, deleting, updating, upserting, joining."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions import gates, text as T
from ..operators import curation, records
from ..sources.tables import EXCHANGES_SQL, MEMORIES_SQL, crawled, memories, table
from .registry import query
from .text_queries import HTML_TEXT, LINKS, ROUTINE, SAID, encoded_sql, trim_sql

WITH = "WITH " + MEMORIES_SQL


def epoch(column: str):
    return F.expr(f"timestampdiff(SECOND, timestamp_ntz '1970-01-01 00:00:00', {column})")


@query("list_memories", WITH + "SELECT id, source, hit_count FROM mem WHERE regexp_matches(content, '(?i)licen[cs]ed|copyright') ORDER BY created_at DESC, id LIMIT 50")
def list_memories(spark, sf):
    return memories(spark, sf).filter(F.col("content").rlike("(?i)licen[cs]ed|copyright")).orderBy(F.desc("created_at"), "id").limit(50).select("id", "source", "hit_count")


@query("list_by_source", WITH + "SELECT id, source, epoch(created_at)::BIGINT AS created FROM mem WHERE starts_with(source, 'source:src1') ORDER BY created_at DESC, id LIMIT 100")
def list_by_source(spark, sf):
    return memories(spark, sf).filter(F.col("source").startswith("source:src1")).orderBy(F.desc("created_at"), "id").limit(100).select("id", "source", epoch("created_at").alias("created"))


@query("list_oldest", WITH + "SELECT id, content FROM mem ORDER BY created_at, id LIMIT 500")
def list_oldest(spark, sf):
    return memories(spark, sf).orderBy("created_at", "id").limit(500).select("id", "content")


@query("count_by_source", WITH + "SELECT source, count(*) AS n FROM mem GROUP BY source")
def count_by_source(spark, sf):
    return memories(spark, sf).groupBy("source").agg(F.count("*").alias("n"))


@query("insert_memories", WITH + "SELECT source, count(*) AS n, max(id) AS last_id FROM (SELECT id, source FROM mem UNION ALL SELECT item_id + 1000000 AS id, 'benchmark' AS source FROM benchmark) GROUP BY source")
def insert_memories(spark, sf):
    fresh = table(spark, sf, "benchmark").select((F.col("item_id") + 1000000).alias("id"), F.lit("benchmark").alias("source"))
    return memories(spark, sf).select("id", "source").unionByName(fresh).groupBy("source").agg(F.count("*").alias("n"), F.max("id").alias("last_id"))


@query("delete_memories", WITH + "SELECT id, source FROM mem WHERE NOT starts_with(source, 'source:src2') AND id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def delete_memories(spark, sf):
    toxic = table(spark, sf, "labels").filter("toxic = 1").select(F.col("doc_id").alias("id"))
    return memories(spark, sf).filter(~F.col("source").startswith("source:src2")).join(toxic, "id", "left_anti").select("id", "source")


@query("update_content", WITH + "SELECT m.id, coalesce('updated: ' || b.text, m.content) AS content FROM mem m LEFT JOIN benchmark b ON b.item_id = m.id")
def update_content(spark, sf):
    fresh = table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), F.concat(F.lit("updated: "), "text").alias("fresh"))
    return memories(spark, sf).select("id", "content").join(fresh, "id", "left").select("id", F.coalesce("fresh", "content").alias("content"))


NOW = "timestamp_ntz '2024-03-01 00:00:00'"


@query("inserted_memories", WITH + "SELECT id, source, epoch(created_at)::BIGINT AS created FROM mem UNION ALL SELECT item_id + 1000000, 'benchmark', epoch(CASE WHEN item_id % 2 = 0 THEN TIMESTAMP '2024-02-01 00:00:00' ELSE TIMESTAMP '2024-03-01 00:00:00' END)::BIGINT FROM benchmark")
def inserted_memories(spark, sf):
    """Benchmark items as new memories; every second one has no time of its own."""
    at = F.when(F.col("item_id") % 2 == 0, F.expr("timestamp_ntz '2024-02-01 00:00:00'"))
    fresh = table(spark, sf, "benchmark").select((F.col("item_id") + 1000000).alias("id"), F.lit("benchmark").alias("source"), at.alias("created_at"))
    return records.inserted(memories(spark, sf).select("id", "source", "created_at"), fresh, F.expr(NOW)).select("id", "source", epoch("created_at").alias("created"))


@query("updated_memories", WITH + ", emb AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings), o AS (SELECT m.id, m.content, emb.e FROM mem m JOIN emb ON emb.id = m.id) SELECT o.id, coalesce(b.text, o.content) AS content, round(coalesce(n.e, o.e)[1], 6) AS first, len(coalesce(n.e, o.e)) AS dim FROM o LEFT JOIN benchmark b ON b.item_id = o.id LEFT JOIN emb n ON b.item_id IS NOT NULL AND n.id = (SELECT max(id) FROM emb) - o.id")
def updated_memories(spark, sf):
    """Content and vector change together: benchmark item n becomes memory n, with the vector that is n-th from the last."""
    own = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    rows = memories(spark, sf).select("id", "content").join(own, "id")
    last = own.agg(F.max("id").alias("last"))
    back = own.join(F.broadcast(last)).select((F.col("last") - F.col("id")).alias("id"), "embedding")
    changes = table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("content")).join(back, "id")
    return records.changed(rows, changes, "id").select("id", "content", F.round(F.col("embedding")[0].cast("double"), 6).alias("first"), F.size("embedding").cast("bigint").alias("dim"))


@query("changed_sources", "WITH s AS (SELECT source AS name, count(*) AS pages FROM documents GROUP BY source), l AS (SELECT d.source AS name, count(*) AS memories FROM documents d JOIN labels USING (doc_id) WHERE toxic = 0 GROUP BY d.source), i AS (SELECT name, 'pending' AS status, 0 AS page_count, 0 AS memory_count FROM s UNION ALL SELECT DISTINCT 'benchmark', 'pending', 0, 0 FROM benchmark) SELECT i.name, CASE WHEN l.name IS NULL THEN i.status ELSE 'ready' END AS status, CASE WHEN l.name IS NULL THEN i.page_count ELSE s.pages END AS page_count, coalesce(l.memories, 0) AS memory_count FROM i LEFT JOIN s USING (name) LEFT JOIN l USING (name) WHERE i.name <> 'src3'")
def changed_sources(spark, sf):
    """Sources are entered as pending, get the state of their crawl, and one goes."""
    docs, fine = table(spark, sf, "documents"), table(spark, sf, "labels").filter("toxic = 0").select("doc_id")
    pending = [F.lit("pending").alias("status"), F.lit(0).cast("bigint").alias("page_count"), F.lit(0).cast("bigint").alias("memory_count")]
    entered = docs.select(F.col("source").alias("name")).distinct().select("name", *pending)
    entered = entered.union(table(spark, sf, "benchmark").select(F.lit("benchmark").alias("name")).distinct().select("name", *pending))
    stored = docs.join(fine, "doc_id").groupBy("source").agg(F.count("*").alias("memory_count"))
    crawls = docs.groupBy("source").agg(F.count("*").alias("page_count")).join(stored, "source").select(F.col("source").alias("name"), F.lit("ready").alias("status"), "page_count", "memory_count")
    return records.changed(entered, crawls, "name").filter("name <> 'src3'")


PAGES = "WITH p AS (SELECT url, page_id, sha256(html) AS content_hash FROM pages), known AS (SELECT url, CASE WHEN page_id % 5 = 0 THEN 'old' ELSE content_hash END AS content_hash FROM p WHERE page_id % 3 <> 0) "


def _pages(spark, sf):
    pages = table(spark, sf, "pages").select("url", "page_id", F.sha2("html", 256).alias("content_hash"))
    known = pages.filter("page_id % 3 <> 0").select("url", F.when(F.col("page_id") % 5 == 0, F.lit("old")).otherwise(F.col("content_hash")).alias("content_hash"))
    return pages, known


@query("page_changes", PAGES + "SELECT p.url, CASE WHEN k.content_hash IS NULL THEN 'new' WHEN k.content_hash = p.content_hash THEN 'unchanged' ELSE 'changed' END AS status FROM p LEFT JOIN known k USING (url)")
def page_changes(spark, sf):
    return curation.page_changes(*_pages(spark, sf))


@query("upsert_pages", PAGES + "SELECT coalesce(f.url, k.url) AS url, coalesce(f.content_hash, k.content_hash) AS content_hash FROM known k FULL JOIN (SELECT url, content_hash FROM p WHERE page_id % 2 = 0) f ON f.url = k.url")
def upsert_pages(spark, sf):
    pages, known = _pages(spark, sf)
    return curation.upserted(known, pages.filter("page_id % 2 = 0").select("url", "content_hash"), ["url"])


@query("page_lookup", PAGES + "SELECT p.page_id, k.content_hash FROM p JOIN known k USING (url) WHERE p.page_id % 4 = 1")
def page_lookup(spark, sf):
    pages, known = _pages(spark, sf)
    return pages.filter("page_id % 4 = 1").select("url", "page_id").join(known, "url").select("page_id", "content_hash")


@query(
    "reingest",
    WITH + ", " + PAGES[5:] + ", st AS (SELECT p.url, p.page_id, p.content_hash, CASE WHEN k.content_hash IS NULL THEN 'new' WHEN k.content_hash = p.content_hash THEN 'unchanged' ELSE 'changed' END AS status FROM p LEFT JOIN known k USING (url)) "
    "SELECT status, count(*) AS pages, sum(CASE WHEN status = 'unchanged' THEN 0 ELSE 1 END)::BIGINT AS rebuilt, min(page_id) AS first_page FROM st GROUP BY status",
)
def reingest(spark, sf):
    pages, known = _pages(spark, sf)
    return curation.with_status(pages, known).groupBy("status").agg(F.count("*").alias("pages"), F.sum(F.when(F.col("status") == "unchanged", 0).otherwise(1)).alias("rebuilt"), F.min("page_id").alias("first_page"))


@query("remove_source", WITH + "SELECT source, count(*) AS n FROM mem WHERE NOT starts_with(source, 'source:src3|') GROUP BY source")
def remove_source(spark, sf):
    rows = memories(spark, sf)
    gone = rows.filter(F.col("source").startswith("source:src3|")).select("id")
    return rows.join(gone, "id", "left_anti").groupBy("source").agg(F.count("*").alias("n"))


SOURCES = WITH + ", s AS (SELECT split_part(split_part(source, ':', 2), '|', 1) AS name, min(created_at) AS created, count(*) AS memory_count FROM mem WHERE starts_with(source, 'source:') GROUP BY 1) "


@query("sources", SOURCES + "SELECT name, memory_count, epoch(created)::BIGINT AS created, row_number() OVER (ORDER BY created DESC, name) AS place FROM s")
def sources(spark, sf):
    name = F.split_part(F.split_part(F.col("source"), F.lit(":"), F.lit(2)), F.lit("|"), F.lit(1))
    rows = memories(spark, sf).filter(F.col("source").startswith("source:")).groupBy(name.alias("name")).agg(F.min("created_at").alias("at"), F.count("*").alias("memory_count"))
    return rows.select("name", "memory_count", epoch("at").alias("created"), F.row_number().over(Window.orderBy(F.desc("at"), "name")).cast("bigint").alias("place"))


@query("recent_retrievals", WITH + ", e AS (SELECT event_id, user_id AS memory_id, value AS score, ts FROM events ORDER BY ts DESC, event_id LIMIT 50) SELECT e.event_id, e.memory_id, e.score, CASE WHEN m.content IS NULL THEN '' WHEN length(m.content) > 200 THEN substr(m.content, 1, 200) || '...' ELSE m.content END AS content, coalesce(m.source, '') AS source FROM e LEFT JOIN mem m ON m.id = e.memory_id + 900")
def recent_retrievals(spark, sf):
    recent = table(spark, sf, "events").orderBy(F.desc("ts"), "event_id").limit(50).select("event_id", F.col("user_id").alias("memory_id"), F.col("value").alias("score"))
    own = memories(spark, sf).select("id", "content", "source")
    short = F.when(F.length("content") > 200, F.concat(F.substring("content", 1, 200), F.lit("..."))).otherwise(F.coalesce("content", F.lit("")))
    return recent.join(own, F.col("memory_id") + 900 == F.col("id"), "left").select("event_id", "memory_id", "score", short.alias("content"), F.coalesce("source", F.lit("")).alias("source"))


@query("top_memories", WITH + "SELECT id, hit_count FROM mem WHERE hit_count > 0 ORDER BY hit_count DESC, id LIMIT 10")
def top_memories(spark, sf):
    return memories(spark, sf).filter("hit_count > 0").orderBy(F.desc("hit_count"), "id").limit(10).select("id", "hit_count")


@query("list_across_databases", WITH + "SELECT id, db FROM (SELECT id, created_at, CASE WHEN source = 'mcp' THEN 0 ELSE 1 END AS db FROM mem) ORDER BY db, created_at DESC, id LIMIT 200")
def list_across_databases(spark, sf):
    rows = memories(spark, sf).select("id", "created_at", F.when(F.col("source") == "mcp", 0).otherwise(1).alias("db"))
    return rows.orderBy("db", F.desc("created_at"), "id").limit(200).select("id", "db")


@query("record_hits", "SELECT user_id AS memory_id, count(*) AS hits, epoch_us(max(ts)) AS last_retrieved FROM events GROUP BY user_id")
def record_hits(spark, sf):
    return table(spark, sf, "events").groupBy(F.col("user_id").alias("memory_id")).agg(F.count("*").alias("hits"), F.expr("timestampdiff(MICROSECOND, timestamp_ntz '1970-01-01 00:00:00', max(ts))").alias("last_retrieved"))


@query("quality_pass", WITH + "SELECT id FROM mem WHERE (coalesce(quality_score, 0) = 0 OR quality_score >= 0.05) AND starts_with(source, 'source:')")
def quality_pass(spark, sf):
    return memories(spark, sf).filter(gates.passes_quality(F.col("quality_score")) & F.col("source").startswith("source:")).select("id")


SWEEP = (
    WITH + ", b AS (SELECT * FROM mem ORDER BY created_at, id LIMIT {n}), x AS (SELECT *, greatest(1, max(hit_count) OVER ()) AS most, "
    "greatest(0, (epoch_us(TIMESTAMP '2024-03-01 00:00:00') - epoch_us(coalesce(last_retrieved, created_at))) / 1e6) AS idle, "
    "CASE WHEN content_score > 0 THEN 604800.0 + least(1, content_score) * (7776000.0 - 604800.0) ELSE 7776000.0 END AS half FROM b), "
    "y AS (SELECT id, hit_count, created_at, least(1, greatest(0, (CASE WHEN hit_count = 0 THEN 0.5 ELSE log2(hit_count + 1.0) / log2(most + 1.0) END) * pow(0.5, idle / half))) AS score FROM x) "
    "SELECT id, round(score, 6) AS score, (epoch(TIMESTAMP '2024-03-01 00:00:00') - epoch(created_at) >= 86400 AND score < 0.1 AND hit_count = 0) AS pruned FROM y"
)


def _sweep(batch):
    return lambda spark, sf: curation.swept(memories(spark, sf), F.expr("timestamp_ntz '2024-03-01 00:00:00'"), batch=batch).withColumn("score", F.round("score", 6))


query("sweep_oldest", SWEEP.format(n=500))(_sweep(500))
query("sweep_all", SWEEP.format(n=1_000_000_000))(_sweep(None))


EX = "WITH " + EXCHANGES_SQL


@query("gate_cascade", "WITH " + EXCHANGES_SQL + SAID + f", s AS (SELECT *, CASE WHEN conv_id % 4 = 0 THEN NULL WHEN turn % 3 = 0 THEN 'SKIP because' ELSE answer END AS reply FROM a) SELECT id, CASE WHEN {ROUTINE} THEN 'pre_filter' WHEN octet_length(encode({trim_sql('r')})) < 400 THEN 'length_filter' WHEN score < 0.35 THEN 'content_score_filter' WHEN reply IS NULL THEN 'no_synthesizer' WHEN regexp_matches(reply, '^SKIP[\\n ]') THEN 'synthesizer_skip' ELSE 'stored' END AS stage FROM s")
def gate_cascade(spark, sf):
    """Each exchange with the gate that it ends at; some of them are turned into mere acknowledgments."""
    from ..sources.tables import exchanges

    user = F.when(F.col("turn") % 4 == 0, F.lit(" Thanks! ")).otherwise(F.col("user_msg"))
    answer = F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit("Done. "), "answer")).otherwise(F.col("answer"))
    reply = F.when(F.col("conv_id") % 4 == 0, F.lit(None)).when(F.col("turn") % 3 == 0, F.lit("SKIP because")).otherwise(F.col("answer"))
    return exchanges(spark, sf).select("id", gates.gate(user, answer, F.col("score"), reply, least=400).alias("stage"))


ADDRESS = r"regexp_replace(regexp_replace({}, '[?#].*$', ''), '/$', '')"
CRAWL = (
    f"WITH RECURSIVE {HTML_TEXT}, {LINKS}, known AS (SELECT page_id, url, content, {ADDRESS.format(encoded_sql('url'))} AS address FROM page), leads AS (SELECT DISTINCT k.address, {ADDRESS.format('link')} AS target FROM link JOIN known k USING (page_id)), "
    "r AS (SELECT address, 0 AS depth FROM known WHERE page_id % 50 = 0 UNION SELECT l.target, r.depth + 1 FROM r JOIN leads l ON l.address = r.address WHERE r.depth < 3 AND l.target IN (SELECT address FROM known)), "
    "reached AS (SELECT address, min(depth) AS depth FROM r GROUP BY address) "
    "SELECT url, depth, sha256(content) AS content_hash, row_number() OVER (ORDER BY depth, url) AS place FROM known JOIN reached USING (address) WHERE octet_length(encode(content)) >= 50 ORDER BY depth, url LIMIT 500"
)


@query("crawl_pages", CRAWL)
def crawl_pages(spark, sf):
    """Breadth-first over the links of pages, by joins: depth at most 3; a page's links lead to pages whose URL has their path."""
    from ..sources.crawl import crawl
    from ..sources.tables import with_checkpoints

    with_checkpoints(spark)
    pages = table(spark, sf, "pages")
    return crawl(pages, pages.filter("page_id % 50 = 0").select("url"))


@query("page_text", f"WITH {HTML_TEXT} SELECT page_id, url, content, sha256(content) AS content_hash FROM page")
def page_text(spark, sf):
    return crawled(spark, sf)


@query("page_links", None)
def page_links(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.links(F.col("html"), F.col("url")).alias("links"))
