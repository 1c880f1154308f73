"""A stored keyword index: postings in blocks with each block's best weight, so that a search skips blocks that can't win.

Folders below the index's path, all of them Parquet, appended to by each change (a generation):

- `sizes`: id, size (words) and generation of each row added; `gone`: id and generation of each row deleted;
- `postings`: word, bucket (of the word, by which it is partitioned), block, ids, tfs and sizes of up to BLOCK rows in
  order of falling weight, and what bounds the block: most (its largest tf) and least (its smallest size).

A row is there if it was added and not deleted in a later generation. How many rows there are, their mean size and the
document frequencies come from what is there, so that scores are those of a search over the texts themselves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .retrieval import ranked, tokens

BLOCK = 128
BUCKETS = 64
POSTINGS = "word string, block int, ids array<bigint>, tfs array<int>, sizes array<int>, most int, least int, generation int, bucket int"


class KeywordIndex:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def table(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    @classmethod
    def built(cls, items: DataFrame, path: str) -> KeywordIndex:
        """The index of items (id, content) in an empty folder. id: unique longs; null content has no words and no size."""
        index = cls(items.sparkSession, path)
        index.spark.createDataFrame([], "id bigint, generation int").write.parquet(f"{path}/gone")
        index._added(items, 0)
        return index

    def generation(self) -> int:
        last = [self.table(name, "generation int").agg(F.max("generation")).first()[0] for name in ("sizes", "gone")]
        return max((g for g in last if g is not None), default=-1)

    def add(self, items: DataFrame) -> None:
        """Adds items whose ids aren't there; postings of their own are written, none is read."""
        self._added(items, self.generation() + 1)

    def delete(self, ids: DataFrame) -> None:
        """Rows of ids (id) are not found any more; those that aren't there change nothing."""
        ids.select(F.col("id").cast("bigint").alias("id"), F.lit(self.generation() + 1).alias("generation")).write.mode("append").parquet(f"{self.path}/gone")

    def _added(self, items: DataFrame, generation: int) -> None:
        worded = items.select(F.col("id").cast("bigint").alias("id"), tokens(F.col("content")).alias("words")).withColumn("size", F.size("words"))
        worded.select("id", "size", F.lit(generation).alias("generation")).write.mode("append").parquet(f"{self.path}/sizes")
        counted = worded.select("id", "size", F.explode("words").alias("word")).groupBy("word", "id", "size").agg(F.count("*").cast("int").alias("tf")).checkpoint()
        # A frequent word is dealt over many lots by id, each with blocks of its own, so that no task holds all of its rows.
        often = counted.groupBy("word").agg(F.count("*").alias("df")).filter(F.col("df") > 64 * BLOCK).select("word", F.ceil(F.col("df") / (64 * BLOCK)).cast("int").alias("lots"))
        dealt = counted.join(often, "word", "left").withColumn("lot", F.pmod(F.xxhash64("id"), F.coalesce("lots", F.lit(1))).cast("int"))
        order = Window.partitionBy("word", "lot").orderBy(F.desc(F.col("tf") / (F.col("tf") + F.col("size"))), "id")
        placed = dealt.withColumn("block", F.floor((F.row_number().over(order) - 1) / BLOCK).cast("int"))
        rows = F.array_sort(F.collect_list(F.struct("id", "tf", "size")))
        blocks = placed.groupBy("word", "lot", "block").agg(rows.alias("r"), F.max("tf").alias("most"), F.min("size").alias("least"))
        out = blocks.select("word", "block", F.col("r.id").alias("ids"), F.col("r.tf").alias("tfs"), F.col("r.size").alias("sizes"), "most", "least", F.lit(generation).alias("generation"), F.pmod(F.xxhash64("word"), F.lit(BUCKETS)).cast("int").alias("bucket"))
        out.hint("rebalance", "bucket").sortWithinPartitions("bucket", "word").write.mode("append").partitionBy("bucket").parquet(f"{self.path}/postings")

    def there(self) -> DataFrame:
        """id, size and since, the generation, of the rows that are there."""
        last = self.table("gone", "id bigint, generation int").groupBy("id").agg(F.max("generation").alias("left_in"))
        rows = self.table("sizes", "id bigint, size int, generation int")
        return rows.join(last, "id", "left").filter("left_in is null or left_in < generation").select("id", "size", F.col("generation").alias("since"))

    def search(self, queries: DataFrame, k: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
        """query_id, id, score and rank by BM25 of the best k rows for each of queries (query_id, text), as keyword_search gives them.

        First, the most promising blocks of each query word are scored: the k-th best sum of a row's weights in them is a
        score that the winners reach at least. Then a block is read only if its bound and the best bounds of the query's
        other words reach that score together.
        """
        words = queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("word")).checkpoint()
        asked = words.select("word").distinct()
        buckets = [r[0] for r in asked.select(F.pmod(F.xxhash64("word"), F.lit(BUCKETS)).cast("int")).distinct().collect()]  # BUCKETS at most
        read = self.table("postings", POSTINGS).filter(F.col("bucket").isin(buckets)).join(F.broadcast(asked) if asked.count() <= 100_000 else asked, "word", "left_semi")
        deleted = self.table("gone", "id bigint, generation int").groupBy("id").agg(F.max("generation").alias("left_in"))
        changed = deleted.limit(1).count() > 0
        shape = self.there().agg(F.count("*").alias("n"), F.avg("size").alias("mean")).first()
        n, mean = shape.n, shape["mean"] or 1.0

        def rows_of(blocks: DataFrame) -> DataFrame:
            """A row for each row that is there of the blocks."""
            flat = blocks.select(*[c for c in blocks.columns if c not in ("ids", "tfs", "sizes")], F.explode(F.arrays_zip("ids", "tfs", "sizes")).alias("r"))
            flat = flat.select(*[c for c in flat.columns if c != "r"], F.col("r.ids").alias("id"), F.col("r.tfs").alias("tf"), F.col("r.sizes").alias("size"))
            return flat.join(deleted, "id", "left").filter("left_in is null or left_in < generation").drop("left_in") if changed else flat

        counts = rows_of(read).groupBy("word").agg(F.count("*").alias("df")) if changed else read.groupBy("word").agg(F.sum(F.size("ids")).alias("df"))
        idf = F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        weight = lambda tf, size: idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * size / mean))
        spread = counts.checkpoint()
        bounded = read.join(spread, "word").withColumn("bound", weight(F.col("most"), F.col("least"))).withColumn("block_id", F.struct("word", "generation", "block", F.get("ids", F.lit(0)).alias("first")))
        bounds = bounded.select("word", "block_id", "bound").checkpoint()
        top = bounds.groupBy("word").agg(F.max("bound").alias("top"))
        by_query = words.join(top, "word")
        totals = by_query.groupBy("query_id").agg(F.sum("top").alias("total"))
        best_first = F.row_number().over(Window.partitionBy("word").orderBy(F.desc("bound"), "block_id"))
        first = bounds.withColumn("r", best_first).filter(F.col("r") <= 1 + 2 * k // BLOCK).select("block_id")
        tried = rows_of(bounded.join(first, "block_id", "left_semi")).select("word", "id", weight(F.col("tf"), F.col("size")).alias("weight"))
        known = tried.join(words, "word").groupBy("query_id", "id").agg(F.sum("weight").alias("known"))
        floor = ranked(known.withColumnRenamed("known", "score"), k).groupBy("query_id").agg(F.min("score").alias("floor"), F.count("*").alias("rows"))
        floor = floor.select("query_id", F.when(F.col("rows") >= k, F.col("floor")).alias("floor"))
        # What a row of a block can reach at most: the block's bound and the best of the query's other words.
        reach = bounds.join(by_query, "word").join(totals, "query_id").join(floor, "query_id", "left")
        wanted = reach.filter("floor is null or bound + total - top >= floor - 1e-9").select("query_id", "block_id").checkpoint()
        self.last_blocks = wanted.select("block_id").distinct(), bounds  # what the search reads, and what it knows of
        hits = rows_of(bounded.join(wanted.select("block_id").distinct(), "block_id", "left_semi")).select("block_id", "id", weight(F.col("tf"), F.col("size")).alias("weight"))
        # A row may have words in blocks that were skipped for the query: those can't have decided, as such a row can't win.
        scores = hits.join(wanted, "block_id").groupBy("query_id", "id").agg(F.round(F.sum("weight"), 9).alias("score"))
        return ranked(scores, k)
