"""An inverted-file index of vectors: coarse cells around centroids, stored as a table partitioned by cell.

Centroids are learnt from a bounded sample; every row is assigned to the cell of the nearest one and keeps its whole
vector. A search reads the cells nearest to its queries only and scores what it finds there exactly; filters come
before the cut to k, and a query that finds fewer than k rows goes on to further cells, to all of them at last.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from .retrieval import MOST_QUERIES, best_of_task, filtered, ranked

SAMPLE = 20_000


def unit(v):
    import numpy as np

    norm = np.linalg.norm(v, axis=-1, keepdims=True)
    return v / np.where(norm == 0, 1, norm)


def learnt_centroids(vectors, cells: int, rounds: int = 12):
    """Centroids of unit vectors by spherical k-means, from spread-out rows; cells that lose all rows take the worst-placed ones."""
    import numpy as np

    v = unit(vectors)
    centroids = v[np.linspace(0, len(v) - 1, cells).astype(int)].copy()
    for _ in range(rounds):
        near = np.concatenate([(part @ centroids.T).argmax(axis=1) for part in np.array_split(v, max(1, len(v) // 2000))])
        sums = np.zeros_like(centroids)
        np.add.at(sums, near, v)
        empty = np.flatnonzero(np.bincount(near, minlength=cells) == 0)
        if len(empty):
            likeness = np.einsum("ij,ij->i", v, centroids[near])
            sums[empty] = v[np.argsort(likeness, kind="stable")[: len(empty)]]
        centroids = unit(sums)
    return centroids


def cells_to_probe(vectors, centroids, recall: float, k: int = 10, queries: int = 200) -> int:
    """How many cells hold the share `recall` of the k nearest in a sample of some of its rows. The sample's neighbours are farther away than those in all rows, so these are found rather more often."""
    import numpy as np

    v = unit(vectors)
    q = v[np.linspace(0, len(v) - 1, min(queries, len(v))).astype(int)]
    cell = np.concatenate([(part @ centroids.T).argmax(axis=1) for part in np.array_split(v, max(1, len(v) // 2000))])
    order = np.argsort(-(q @ centroids.T), axis=1, kind="stable")
    place = np.argsort(order, axis=1)
    near = np.argsort(-(q @ v.T), axis=1, kind="stable")[:, :k]
    needed = np.sort(np.take_along_axis(place, cell[near], axis=1).ravel())
    return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)]) + 1


class VectorIndex:
    """The index in a folder: `centroids` (cell, centroid), `schema` and `rows` (id, embedding and what else items have, by cell).

    Vectors of another length than the centroids', nulls and empty ones among them, are in cell -1, which no search
    probes: their likeness is 0. Rows appended later take the nearest of the same centroids.
    """

    def __init__(self, spark: SparkSession, path: str):
        import numpy as np

        self.spark, self.path = spark, path
        rows = spark.read.parquet(f"{path}/centroids").orderBy("cell").collect()  # at most SAMPLE
        told = json.loads(spark.read.text(f"{path}/schema").first()[0])
        self.schema, self.probe = StructType.fromJson(told["schema"]), told["probe"]
        self.centroids = np.array([r.centroid for r in rows], float) if rows else np.zeros((0, 0))

    @classmethod
    def built(cls, items: DataFrame, path: str, cells: int | None = None, sample: int = SAMPLE, recall: float = 0.95) -> VectorIndex:
        """The index of items (id, embedding, any further columns) in an empty folder.

        The sample is the `sample` rows of least id hash, whatever the number of items; cells: the root of the number of
        items, at most an eighth of the sample. How many of them a search looks at is measured on the sample, by recall.
        """
        import numpy as np

        spark = items.sparkSession
        known = items.filter(F.size("embedding") > 0)
        n, length = known.agg(F.count("*"), F.mode(F.size("embedding"))).first()
        rows = known.filter(F.size("embedding") == (length or 0)).select("id", F.col("embedding").cast("array<double>").alias("e")).orderBy(F.xxhash64("id"), "id").limit(sample).collect()
        wanted = cells or max(1, math.isqrt(n or 0))
        learnt = learnt_centroids(np.array([r.e for r in rows], float), min(wanted, max(1, len(rows) // (1 if cells else 8)))) if rows else np.zeros((0, 0))
        probe = cells_to_probe(np.array([r.e for r in rows], float), learnt, recall) if rows else 0
        spark.createDataFrame([Row(cell=i, centroid=[float(x) for x in c]) for i, c in enumerate(learnt)], "cell int, centroid array<double>").coalesce(1).write.parquet(f"{path}/centroids")
        schema = StructType([*items.schema.fields, StructField("cell", IntegerType())])
        spark.createDataFrame([(json.dumps({"schema": json.loads(schema.json()), "probe": probe}),)], "value string").coalesce(1).write.text(f"{path}/schema")
        index = cls(spark, path)
        index.append(items)
        return index

    def append(self, items: DataFrame) -> None:
        """Adds items. A cell that holds many of them is split over tasks, by Spark, before it is written."""
        assigned = self.with_cells(items)
        assigned.hint("rebalance", "cell").write.mode("append").partitionBy("cell").parquet(f"{self.path}/rows")

    def with_cells(self, items: DataFrame) -> DataFrame:
        """items with cell."""
        sent = self.spark.sparkContext.broadcast(self.centroids)
        def assign(batches):
            import numpy as np
            import pyarrow as pa
            import pyarrow.compute as pc

            centroids = sent.value
            for batch in batches:
                lists = batch.column("embedding")
                sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
                cell = np.full(batch.num_rows, -1, np.int32)
                fits = (sizes == centroids.shape[1]) & (sizes > 0)
                if fits.any():
                    flat = pc.list_flatten(lists.filter(pa.array(fits))).to_numpy(zero_copy_only=False).astype(float)
                    cell[fits] = (unit(flat.reshape(-1, centroids.shape[1])) @ centroids.T).argmax(axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], names=[*batch.schema.names, "cell"])

        return items.select(*self.schema.names[:-1]).mapInArrow(assign, self.schema)

    def rows(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/rows")

    def search(self, queries: DataFrame, k: int, probe: int | None = None, least_quality: float | None = None, source_prefix: str | None = None) -> DataFrame:
        """query_id, id, score and rank of k rows near each query (query_id, vector), in blocks of MOST_QUERIES queries.

        probe: how many cells a query looks at, in place of the number measured when the index was built. Queries that find fewer than k rows there,
        because filters leave few, look at four times as many, and so on.
        """
        import numpy as np

        cells = len(self.centroids)
        first = min(cells, probe or self.probe)
        blocks = max(1, -(-queries.count() // MOST_QUERIES))
        dealt = queries.select("query_id", F.col("vector").cast("array<double>").alias("vector"), F.pmod(F.xxhash64("query_id"), F.lit(blocks)).alias("block"))
        out = []
        for block in range(blocks):
            open_ = [(r.query_id, r.vector or []) for r in dealt.filter(F.col("block") == block).collect()]
            width = first
            while open_:
                fits = [len(v) == self.centroids.shape[1] for _, v in open_] if cells else [False] * len(open_)
                order = np.argsort(-(unit(np.array([v if ok else np.zeros(self.centroids.shape[1]) for (_, v), ok in zip(open_, fits)])) @ self.centroids.T), axis=1, kind="stable")[:, :width] if cells else np.zeros((len(open_), 0), int)
                by_cell: dict[int, list[int]] = {}
                for i, near in enumerate(order.tolist()):
                    for cell in near:
                        by_cell.setdefault(cell, []).append(i)
                found = self.probed(open_, by_cell, k, least_quality, source_prefix).checkpoint()
                full = width >= cells
                counts = {} if full else {r.query_id: r["n"] for r in found.groupBy("query_id").agg(F.count("*").alias("n")).collect()}  # a row a query
                short = [] if full else [q for q in open_ if counts.get(q[0], 0) < k]
                if short:
                    found = found.join(F.broadcast(self.spark.createDataFrame([(q,) for q, _ in short], "query_id bigint")), "query_id", "left_anti")
                out.append(found)
                open_, width = short, min(cells, 4 * width)
        empty = self.spark.createDataFrame([], "query_id bigint, id bigint, score double, rank int")
        for found in out:
            empty = empty.union(found)
        return empty

    def probed(self, asked: list, by_cell: dict[int, list[int]], k: int, least_quality: float | None, source_prefix: str | None) -> DataFrame:
        """The best k of each asked query among the rows of its cells; only these cells' files are read."""
        sent = self.spark.sparkContext.broadcast((asked, by_cell))
        kept = filtered(self.rows().filter(F.col("cell").isin(sorted(by_cell))), least_quality, source_prefix)
        kept = kept.select("cell", F.col("id").cast("bigint").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"))

        def best(batches):
            import pyarrow as pa
            import pyarrow.compute as pc

            queries, cells = sent.value
            for batch in batches:
                for cell in pc.unique(batch.column("cell")).to_pylist():
                    own = batch.filter(pc.equal(batch.column("cell"), cell))
                    yield from best_of_task([pa.RecordBatch.from_arrays([own.column("id"), own.column("embedding")], names=["id", "embedding"])], [queries[i] for i in cells[cell]], k)

        return ranked(kept.mapInArrow(best, "query_id bigint, id bigint, score double"), k).select("query_id", "id", "score", "rank")
