import numpy as np
import pytest
from pyspark.sql import functions as F

from loam.operators import curation, pivots, retrieval
from loam.operators.vector_index import VectorIndex
from loam.sources.tables import with_checkpoints


def clustered(seed, n=3000, dims=16, centres=40, spread=0.25):
    rng = np.random.default_rng(seed)
    return (rng.normal(size=(centres, dims))[rng.integers(0, centres, n)] + spread * rng.normal(size=(n, dims))).astype(float)


def frame_of(spark, vectors, start=0):
    rows = [(start + i, v.tolist(), 0.01 if i % 3 else 0.5, f"source:s{i % 10}") for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "id bigint, embedding array<double>, quality_score double, source string").repartition(4)


def recall(found, exact):
    want = {(r.query_id, r.id) for r in exact.collect()}
    got = {(r.query_id, r.id) for r in found.collect()}
    return len(want & got) / len(want), len(want), len(got)


def test_index_recalls_what_exact_search_finds(spark, tmp_path):
    with_checkpoints(spark)
    v = clustered(1)
    items, more = frame_of(spark, v[:2500]), frame_of(spark, v[2500:], 2500)
    index = VectorIndex.built(items, str(tmp_path / "index"))
    queries = items.filter("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("vector"))
    share, n, m = recall(index.search(queries, 10), retrieval.nearest(items, queries, 10))
    assert share >= 0.9 and n == m == 500
    before = {p.name for p in (tmp_path / "index" / "rows").rglob("*.parquet")}
    index.append(more)
    assert before < {p.name for p in (tmp_path / "index" / "rows").rglob("*.parquet")}
    everything = items.union(more)
    share, n, m = recall(VectorIndex(spark, index.path).search(queries, 10), retrieval.nearest(everything, queries, 10))
    assert share >= 0.9 and n == m == 500 and index.rows().count() == 3000
    # A filter that leaves few rows: every query is answered all the same.
    share, n, m = recall(index.search(queries, 10, 2, 0.05, "source:s6"), retrieval.nearest(everything, queries, 10, 0.05, "source:s6"))
    assert share >= 0.9 and n == m == 500
    # With all cells probed the search is exact.
    assert recall(index.search(queries, 10, 10_000), retrieval.nearest(everything, queries, 10))[0] == 1


def test_index_edges(spark, tmp_path):
    with_checkpoints(spark)
    rows = [(1, [1.0, 0.0]), (2, []), (3, None), (4, [1.0]), (5, [0.0, 0.0]), (6, [0.0, 1.0])]
    items = spark.createDataFrame(rows, "id bigint, embedding array<double>")
    index = VectorIndex.built(items, str(tmp_path / "a"))
    asked = spark.createDataFrame([(9, [2.0, 0.1]), (8, [1.0])], "query_id bigint, vector array<double>")
    assert [r.id for r in index.search(asked.limit(1), 2).orderBy("rank").collect()] == [1, 6] and index.rows().count() == 6
    assert index.search(asked, 5).filter("query_id = 8 and score > 0").count() == 0
    empty = VectorIndex.built(items.limit(0), str(tmp_path / "b"))
    assert empty.search(asked, 3).count() == 0


@pytest.mark.parametrize("threshold", [0.5, 0.9, 0.97, 1.0])
def test_pivot_join_equals_all_pairs_and_compares_fewer(spark, threshold):
    with_checkpoints(spark)
    v = np.vstack([clustered(2, 1200), np.repeat(clustered(3, 4), 25, axis=0)])
    items = frame_of(spark, v).select("id", "embedding")
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    s = np.triu(unit @ unit.T, 1)
    sure = {(int(a), int(b)) for a, b in np.argwhere(s >= threshold + 1e-9)}
    maybe = {(int(a), int(b)) for a, b in np.argwhere(s >= threshold - 1e-9)}
    got = [(r.a, r.b) for r in pivots.pivot_pairs(items, threshold, 64, 90).collect()]
    assert len(got) == len(set(got)) and sure <= set(got) <= maybe
    met, everything = pivots.compared(pivots.cell_rows(items, threshold, 64)), len(v) * (len(v) - 1) // 2
    assert met < (0.15 if threshold >= 0.9 else 1.0) * everything


@pytest.mark.parametrize(("threshold", "block", "one_cell"), [(0.05, 300, True), (0.95, 300, False), (0.3, 5000, True)])
def test_nearest_alike_equal_the_sorted_scores_with_copies_by_id(spark, threshold, block, one_cell):
    with_checkpoints(spark)
    v = np.vstack([clustered(2, 600), np.repeat(clustered(3, 4), 25, axis=0)])
    items = frame_of(spark, v).select("id", "embedding")
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    s = np.array([(unit * u).sum(axis=1) for u in unit])
    np.fill_diagonal(s, -1)
    want = {(a, int(b), r) for a in range(len(v)) for r, b in enumerate(np.lexsort((np.arange(len(v)), -s[a]))[:5], 1) if s[a, b] >= threshold}
    assert {(r.a, r.b, r.r) for r in pivots.nearest_alike(items, threshold, 5, 64, block).collect()} == want
    assert (pivots.fewest_rows(items, threshold, 64, block).select("cell").distinct().count() == 1) == one_cell


def test_pivot_join_edges(spark):
    with_checkpoints(spark)
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, []), (5, None), (6, [1.0]), (7, [3.0]), (8, [-1.0, 0.0])]
    items = spark.createDataFrame(rows, "id bigint, embedding array<double>")
    assert sorted((r.a, r.b) for r in curation.similar_pairs(items, 0.5).collect()) == [(1, 2), (6, 7)]
    assert curation.similar_pairs(items.limit(0), 0.5).count() == 0


def test_indexed_query_recalls_nine_in_ten(spark, sf_dir):
    from loam.plans import QUERIES

    share, n, m = recall(QUERIES["indexed_search"](spark, sf_dir), QUERIES["vector_search"](spark, sf_dir))
    assert share >= 0.9 and n == m == 100
