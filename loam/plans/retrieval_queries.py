"""Queries over vectors: search, fusion, diversity, scores, duplicates. The reference thresholds are vacuous on these vectors, so lower ones are given."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import gates, vectors as V
from ..operators import curation, retrieval, scoring
from ..operators.embed import hash_embedded
from ..operators.pivots import nearest_earlier
from ..sources.tables import MEMORIES_SQL, memories, shared_folder, staged, table, vectors, with_checkpoints
from .registry import query

EMB = "emb AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e, label FROM embeddings)"
QUERY = "q AS (SELECT id AS query_id, e AS v FROM emb WHERE id % 50 = 0)"
COS = "list_cosine_similarity(e, v)"
NEAR = f"WITH {EMB}, {QUERY}, s AS (SELECT query_id, id, {COS} AS score FROM emb, q), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) - 1 AS rank FROM s) "


def _items(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


def _queries(spark, sf):
    return _items(spark, sf).filter("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("vector"))


@query("vector_topk", f"WITH {EMB}, z AS (SELECT e AS v FROM emb WHERE id = 0) SELECT id, label, round({COS}, 6) AS score FROM emb, z ORDER BY {COS} DESC, id LIMIT 5")
def vector_topk(spark, sf):
    found = retrieval.nearest(_items(spark, sf), _queries(spark, sf).filter("query_id = 0"), 5)
    return found.join(_items(spark, sf).select("id", "label"), "id").select("id", "label", F.round("score", 6).alias("score"))


@query("vector_search", NEAR + "SELECT query_id, id, round(score, 6) AS score, rank FROM r WHERE rank < 10")
def vector_search(spark, sf):
    return retrieval.nearest(_items(spark, sf), _queries(spark, sf), 10).select("query_id", "id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


@query("filtered_search", f"WITH {MEMORIES_SQL}, {EMB}, {QUERY}, s AS (SELECT query_id, m.id, {COS} AS score FROM emb m JOIN mem USING (id), q WHERE (coalesce(quality_score, 0) = 0 OR quality_score >= 0.05) AND starts_with(source, 'source:src')), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) - 1 AS rank FROM s) SELECT query_id, id, round(score, 6) AS score, rank FROM r WHERE rank < 5")
def filtered_search(spark, sf):
    found = retrieval.nearest(vectors(spark, sf), _queries(spark, sf), 5, 0.05, "source:src")
    return found.select("query_id", "id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


WORDS = "q AS (SELECT item_id AS query_id, text FROM benchmark WHERE item_id % 5 = 0), dw AS (SELECT doc_id AS id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{Nd}]+'), lambda w: w <> '') AS w FROM documents), shape AS (SELECT count(*) AS n, avg(len(w)) AS m FROM dw), qw AS (SELECT DISTINCT query_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{Nd}]+'), lambda w: w <> '')) AS word FROM q), p AS (SELECT word, id, size, count(*) AS tf FROM (SELECT id, len(w) AS size, unnest(w) AS word FROM dw) WHERE word IN (SELECT word FROM qw) GROUP BY ALL), df AS (SELECT word, count(*) AS df FROM p GROUP BY 1), sc AS (SELECT query_id, id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / m))), 9) AS score FROM p JOIN df USING (word) JOIN qw USING (word), shape GROUP BY ALL), kr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) - 1 AS rank FROM sc)"


def _texts(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))


def _text_queries(spark, sf):
    return table(spark, sf, "benchmark").filter("item_id % 5 = 0").select(F.col("item_id").alias("query_id"), "text")


@query("keyword_search", f"WITH {WORDS} SELECT query_id, id, round(score, 6) AS score, rank FROM kr WHERE rank < 10")
def keyword_search(spark, sf):
    found = retrieval.keyword_search(_texts(spark, sf), _text_queries(spark, sf), 10)
    return found.select("query_id", "id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


@query("stored_keyword_search", f"WITH {WORDS} SELECT query_id, id, round(score, 6) AS score, rank FROM kr WHERE rank < 10")
def stored_keyword_search(spark, sf):
    """keyword_search from a stored index, which reads no text and skips blocks of postings that can't win."""
    from ..operators.keyword_index import KeywordIndex

    found = KeywordIndex.built(_texts(spark, sf), shared_folder(spark)).search(_text_queries(spark, sf), 10)
    return found.select("query_id", "id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


@query("indexed_search", None)
def indexed_search(spark, sf):
    """vector_search by the inverted-file index."""
    from ..operators.vector_index import VectorIndex

    found = VectorIndex.built(_items(spark, sf), shared_folder(spark)).search(_queries(spark, sf), 10)
    return found.select("query_id", "id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


FUSED = f"WITH {WORDS}, {EMB}, vq AS (SELECT item_id AS query_id, e AS v FROM benchmark JOIN emb ON id = item_id WHERE item_id % 5 = 0), vs AS (SELECT query_id, id, {COS} AS score FROM emb, vq), vr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) - 1 AS rank FROM vs), f AS (SELECT query_id, id, sum(1.0 / (rank + 61)) AS score FROM (SELECT query_id, id, rank FROM vr WHERE rank < 20 UNION ALL SELECT query_id, id, rank FROM kr WHERE rank < 20) GROUP BY ALL) "


@query("rank_fusion", FUSED + "SELECT query_id, id, round(score, 9) AS score FROM f")
def rank_fusion(spark, sf):
    both = _text_queries(spark, sf).join(_items(spark, sf).select(F.col("id").alias("query_id"), F.col("embedding").alias("vector")), "query_id")
    lists = retrieval.fused(retrieval.nearest(_items(spark, sf), both.select("query_id", "vector"), 20), retrieval.keyword_search(_texts(spark, sf), both.select("query_id", "text"), 20))
    return lists.select("query_id", "id", F.round("score", 9).alias("score"))


HYBRID = (
    f"WITH RECURSIVE {MEMORIES_SQL}, {EMB}, {WORDS}, vq AS (SELECT item_id AS query_id, e AS v FROM benchmark JOIN emb ON id = item_id WHERE item_id % 5 = 0), "
    f"vs AS (SELECT query_id, m.id, {COS} AS score FROM emb m JOIN mem USING (id), vq WHERE coalesce(quality_score, 0) = 0 OR quality_score >= 0.05), vr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) - 1 AS rank FROM vs), "
    "f AS (SELECT query_id, id, sum(1.0 / (rank + 61)) AS score FROM (SELECT query_id, id, rank FROM vr WHERE rank < 20 UNION ALL SELECT query_id, id, rank FROM kr WHERE rank < 20 AND query_id IN (SELECT query_id FROM vq)) GROUP BY ALL), "
    f"c AS (SELECT f.query_id, f.id, f.score, e, round({COS}, 12) AS rel FROM f JOIN emb USING (id) JOIN vq USING (query_id)), "
    "pick AS (SELECT query_id, 1 AS step, [min(id)] AS ids FROM (SELECT query_id, id, rank() OVER (PARTITION BY query_id ORDER BY round(0.7 * rel, 12) DESC) AS k FROM c) WHERE k = 1 GROUP BY query_id UNION ALL SELECT query_id, step + 1, list_append(ids, nid) FROM (SELECT p.query_id, p.step, p.ids, (SELECT x.id FROM (SELECT c.id, round(0.7 * c.rel - 0.3 * greatest(0, (SELECT max(round(list_cosine_similarity(c.e, o.e), 12)) FROM c o WHERE o.query_id = c.query_id AND list_contains(p.ids, o.id))), 12) AS val FROM c WHERE c.query_id = p.query_id AND NOT list_contains(p.ids, c.id)) x ORDER BY val DESC, x.id LIMIT 1) AS nid FROM pick p WHERE p.step < 5)), "
    "o AS (SELECT query_id, unnest(ids) AS id, unnest(generate_series(0, 4))::INTEGER AS place FROM pick WHERE step = 5) SELECT query_id, id, round(score, 9) AS score, place FROM o JOIN c USING (query_id, id)"
).replace("FROM documents), shape", "FROM documents WHERE doc_id IN (SELECT id FROM emb)), shape")


@query("hybrid_search", HYBRID)
def hybrid_search(spark, sf):
    both = _text_queries(spark, sf).join(_items(spark, sf).select(F.col("id").alias("query_id"), F.col("embedding").alias("vector")), "query_id")
    return retrieval.hybrid_search(vectors(spark, sf), both, 5).withColumn("score", F.round("score", 9))


@query("diverse_results", f"WITH RECURSIVE {EMB}, {QUERY}, s AS (SELECT query_id, id, e, round({COS}, 12) AS rel FROM emb, q), c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rel DESC, id) AS r FROM s) WHERE r <= 12), pick AS (SELECT query_id, 1 AS step, [min(id)] AS ids FROM (SELECT query_id, id, rank() OVER (PARTITION BY query_id ORDER BY round(0.7 * rel, 12) DESC) AS k FROM c) WHERE k = 1 GROUP BY query_id UNION ALL SELECT query_id, step + 1, list_append(ids, nid) FROM (SELECT p.query_id, p.step, p.ids, (SELECT x.id FROM (SELECT c.id, round(0.7 * c.rel - 0.3 * greatest(0, (SELECT max(round(list_cosine_similarity(c.e, o.e), 12)) FROM c o WHERE o.query_id = c.query_id AND list_contains(p.ids, o.id))), 12) AS val FROM c WHERE c.query_id = p.query_id AND NOT list_contains(p.ids, c.id)) x ORDER BY val DESC, x.id LIMIT 1) AS nid FROM pick p WHERE p.step < 5)) SELECT query_id, id, place FROM (SELECT query_id, unnest(ids) AS id, unnest(generate_series(0, 4))::INTEGER AS place FROM pick WHERE step = 5)")
def diverse_results(spark, sf):
    found = retrieval.nearest(_items(spark, sf), _queries(spark, sf), 12)
    ready = found.join(_items(spark, sf).select("id", "embedding"), "id").join(F.broadcast(_queries(spark, sf)), "query_id")
    return retrieval.diverse(ready.select("query_id", "vector", "id", "embedding", "score"), 5).select("query_id", "id", "place")


@query("fan_out_search", NEAR + "SELECT query_id, id, round(score, 6) AS score FROM r WHERE rank < 5")
def fan_out_search(spark, sf):
    items = _items(spark, sf)
    lists = [retrieval.nearest(items.filter(F.col("label") % 2 == i), _queries(spark, sf), 5) for i in (0, 1)]
    return retrieval.fan_out(lists, 5).select("query_id", "id", F.round("score", 6).alias("score"))


PROTO = f"WITH {EMB}, g AS (SELECT m.id, list_cosine_similarity(m.e, p.e) AS s FROM emb m, emb p WHERE p.id < 6), n AS (SELECT m.id, list_cosine_similarity(m.e, p.e) AS s, row_number() OVER (PARTITION BY m.id ORDER BY list_cosine_similarity(m.e, p.e) DESC) AS r FROM emb m, emb p WHERE p.id BETWEEN 6 AND 15), a AS (SELECT id, q, n FROM (SELECT id, avg(s) AS q FROM g GROUP BY id) JOIN (SELECT id, avg(s) AS n FROM n WHERE r <= 3 GROUP BY id) USING (id)) "


@query("content_scores", PROTO + "SELECT id, round(CASE WHEN q + n <= 0 THEN 0.5 ELSE least(1, greatest(0, q / (q + n))) END, 6) AS score FROM a")
def content_scores(spark, sf):
    """The first 16 vectors stand for texts worth keeping and for noise."""
    return _content_scores(spark, sf).select("id", F.round("content_score", 6).alias("score"))


@query("default_scores", None)
def default_scores(spark, sf):
    """All documents, by hashed vectors, against the default prototypes."""
    good, noise = scoring.prototypes(spark, hash_embedded)
    docs = hash_embedded(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", "embedding")
    return scoring.scored(docs, good, noise).select("doc_id", F.round("content_score", 6).alias("score"))


PROTO_SCORE = "CASE WHEN q + n <= 0 THEN 0.5 ELSE least(1, greatest(0, q / (q + n))) END"


def _content_scores(spark, sf):
    items = _items(spark, sf)
    protos = [list(r["embedding"]) for r in items.filter("id < 16").orderBy("id").collect()]  # 16 rows
    return scoring.scored(items.select("id", "embedding"), protos[:6], protos[6:])


@query("half_lives", PROTO + f"SELECT id, round(604800 + ({PROTO_SCORE}) * (7776000 - 604800), 0) AS seconds FROM a")
def half_lives(spark, sf):
    """How long a memory is held, by its content score."""
    return _content_scores(spark, sf).select("id", F.round(V.scaled_half_life(F.col("content_score")), 0).alias("seconds"))


@query("store_gate", PROTO + f"SELECT id, round({PROTO_SCORE}, 9) < 0.35 AS stopped FROM a")
def store_gate(spark, sf):
    return _content_scores(spark, sf).select("id", gates.below_store_gate(F.round("content_score", 9), 0.35).alias("stopped"))


PAIRS = f"WITH {EMB}, p AS (SELECT x.id AS a, y.id AS b, list_cosine_similarity(x.e, y.e) AS similarity FROM emb x JOIN emb y ON x.id < y.id WHERE list_cosine_similarity(x.e, y.e) >= 0.3) "


@query("similar_pairs", PAIRS + "SELECT a, b, round(similarity, 6) AS similarity FROM p")
def similar_pairs(spark, sf):
    return curation.similar_pairs(_items(spark, sf), 0.3).select("a", "b", F.round("similarity", 6).alias("similarity"))


IN_ORDER = (
    PAIRS.replace("WITH ", "WITH RECURSIVE ", 1)
    + ", place AS (SELECT id, row_number() OVER (ORDER BY id) AS r FROM emb), told AS (SELECT b AS id, list(a) AS before FROM p GROUP BY b), line AS (SELECT place.r, place.id, coalesce(told.before, []) AS before FROM place LEFT JOIN told USING (id)), "
    "st AS (SELECT 0::BIGINT AS r, []::BIGINT[] AS held UNION ALL SELECT line.r, CASE WHEN list_has_any(st.held, line.before) THEN st.held ELSE list_append(st.held, line.id) END FROM st JOIN line ON line.r = st.r + 1), "
    "held AS (SELECT unnest(held) AS id FROM (SELECT held FROM st ORDER BY r DESC LIMIT 1)) "
)


@query("kept_in_order", IN_ORDER + "SELECT emb.id, emb.id IN (SELECT id FROM held) AS kept FROM emb")
def kept_in_order(spark, sf):
    """Checked against the sequential rule in the tests, too."""
    with_checkpoints(spark)
    return curation.kept_alike(_items(spark, sf), 0.3)


@query("source_extensions", IN_ORDER + ", " + MEMORIES_SQL + ", sides AS (SELECT p.b AS id, p.a AS other, similarity FROM p JOIN held x ON x.id = p.a JOIN mem y ON y.id = p.b), best AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY similarity DESC, other) AS r FROM sides) SELECT b.id, b.other AS extends, round(b.similarity, 6) AS similarity FROM best b JOIN mem m ON m.id = b.other WHERE r = 1 AND starts_with(m.source, 'source:') AND b.similarity < 0.9")
def source_extensions(spark, sf):
    """Items with the kept item that they are most like, where that is from a source and they don't say the same."""
    with_checkpoints(spark)
    items = _items(spark, sf).select("id", "embedding")
    nearest = nearest_earlier(items, curation.kept_alike(items, 0.3).filter("kept"), 0.3)
    return curation.source_extensions(memories(spark, sf).select("id", "source"), nearest, 0.3, 0.9).withColumn("similarity", F.round("similarity", 6))


@query("topic_boundaries", f"WITH {EMB}, x AS (SELECT id, list_cosine_similarity(e, lag(e) OVER (ORDER BY id)) AS s FROM emb) SELECT id, round(s, 6) AS similarity, s IS NULL OR s < 0.1 AS opens FROM x")
def topic_boundaries(spark, sf, run: int = 1024):
    """Likeness of neighbours. The row before is looked for in runs of ids; the first of a run has the last of the run before, and the first run of a run of runs that of the one before, so that no task orders more than a run, or the runs of runs."""
    from pyspark.sql import Window

    items = _items(spark, sf).select("id", "embedding", F.expr(f"id div {run}").alias("run"))
    lasts = items.groupBy("run").agg(F.max("id").alias("last_id")).withColumn("above", F.expr(f"run div {run}"))
    higher = lasts.groupBy("above").agg(F.max("last_id").alias("last_id"))  # a row for a million ids
    far = higher.select("above", F.lag("last_id").over(Window.orderBy("above")).alias("far"))
    near_run = lasts.select("run", "above", F.lag("last_id").over(Window.partitionBy("above").orderBy("run")).alias("near"))
    carried = near_run.join(far, "above").select("run", F.coalesce("near", "far").alias("carried"))
    inside = items.select("id", "run", F.lag("id").over(Window.partitionBy("run").orderBy("id")).alias("inside"))
    order = inside.join(carried, "run").select("id", F.coalesce("inside", "carried").alias("before"))
    last = items.select(F.col("id").alias("before"), F.col("embedding").alias("last"))
    near = F.when(F.col("last").isNotNull(), V.cosine(F.col("embedding"), F.col("last")))
    return items.join(order, "id").join(last, "before", "left").select("id", F.round(near, 6).alias("similarity"), (near.isNull() | (near < 0.1)).alias("opens"))


HEAD, FOOT = (x.replace("'", "''") for x in (retrieval.CONTEXT_HEAD, retrieval.CONTEXT_FOOT))
BLOCKS = (
    NEAR + f", {MEMORIES_SQL}, t AS (SELECT query_id, rank, chr(10) || '---' || chr(10) || '[' || (rank + 1) || '] (source: ' || source || ', score: ' || printf('%.2f', score) || ')' || chr(10) || content || chr(10) AS entry FROM r JOIN mem USING (id) WHERE rank < 5), "
    "u AS (SELECT *, sum(octet_length(encode(entry))) OVER (PARTITION BY query_id ORDER BY rank) AS used FROM t) "
    f"SELECT query_id, '{HEAD}' || coalesce(string_agg(entry, '' ORDER BY rank) FILTER (WHERE used <= {2048 * 4 - len(retrieval.CONTEXT_HEAD.encode()) - len(retrieval.CONTEXT_FOOT)}), '') || '{FOOT}' AS context FROM u GROUP BY query_id"
)


@query("context_blocks", BLOCKS)
def context_blocks(spark, sf):
    found = retrieval.nearest(vectors(spark, sf), _queries(spark, sf), 5)
    return retrieval.context_block(found.join(memories(spark, sf).select("id", "source", "content"), "id"))


@query("hash_embeddings", None)
def hash_embeddings(spark, sf):
    from ..operators.embed import hash_embedded

    return hash_embedded(table(spark, sf, "documents").select("doc_id", "text"), 64)


@query("document_duplicates", None)
def document_duplicates(spark, sf):
    """Near-duplicates of documents in order, by hashed embeddings."""
    from ..operators.embed import hash_embedded

    with_checkpoints(spark)
    items = staged(hash_embedded(table(spark, sf, "documents").select("doc_id", "text"), 128).select(F.col("doc_id").alias("id"), "embedding"))
    return curation.kept_alike(items, 0.92, ready=True)



@query("document_chunks", None)
def document_chunks(spark, sf):
    from ..operators.chunking import chunked

    return chunked(table(spark, sf, "documents"))


@query("chunk_topics", None)
def chunk_topics(spark, sf):
    from ..operators.chunking import chunked, topic_groups
    from ..operators.embed import hash_embedded

    return topic_groups(hash_embedded(chunked(table(spark, sf, "documents"), 512).select("doc_id", "pos", "text"), 64))


@query("merged_memories", None)
def merged_memories(spark, sf):
    from ..operators.merging import merged

    with_checkpoints(spark)
    return merged(vectors(spark, sf).select("id", "content", "embedding", "hit_count", "created_at"), 0.3, scan=None).select("id", "content", "absorbed")
