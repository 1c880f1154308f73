"""The library's tables as derived from the driver's: memories, retrieval events, pages, exchanges."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import text as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_checkpoints(spark: SparkSession) -> SparkSession:
    """Sees to it that checkpoint() has the shared folder of spark.checkpoint.dir, or where that is unset (tests) one of its own."""
    if not spark.conf.get("spark.checkpoint.dir", None) and not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The path of a new folder that driver and executors share, below that of with_checkpoints."""
    root = with_checkpoints(spark).conf.get("spark.checkpoint.dir", None) or spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return f"{root}/loam-{uuid.uuid4().hex}"


def staged(rows: DataFrame) -> DataFrame:
    """rows, written to a new shared_folder as compressed Parquet and read from there: for texts and other wide rows, where checkpoint() takes the space of rows in memory."""
    path, schema = shared_folder(rows.sparkSession), rows.schema
    rows.write.option("compression", "zstd").parquet(path)
    return rows.sparkSession.read.schema(schema).parquet(path)


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, content, source, created_at, hit_count, last_retrieved, quality_score and content_score of each document."""
    docs, events, labels = (table(spark, sf_dir, n) for n in ("documents", "events", "labels"))
    hits = events.groupBy(F.col("user_id").alias("id")).agg(F.count("*").alias("hit_count"), F.max("ts").alias("last_retrieved"))
    scored = labels.select(F.col("doc_id").alias("id"), F.round(F.col("quality") * 0.9 + F.col("toxic") * 0.03, 2).alias("quality_score"))
    source = F.when(F.col("doc_id") % 7 == 0, F.lit("mcp")).otherwise(F.concat(F.lit("source:"), F.col("source"), F.lit("|"), F.col("lang")))
    rows = docs.select(
        F.col("doc_id").alias("id"), F.col("text").alias("content"), source.alias("source"),
        F.expr("timestamp_ntz '2024-01-01 00:00:00' + make_dt_interval(0, 0, cast(doc_id as int), 0)").alias("created_at"),
        ((F.col("doc_id") % 11) / 10.0).alias("content_score"),
    )
    return rows.join(hits, "id", "left").join(scored, "id", "left").withColumn("hit_count", F.coalesce("hit_count", F.lit(0)))


MEMORIES_SQL = """
mem AS (
  SELECT d.doc_id AS id, d.text AS content, CASE WHEN d.doc_id % 7 = 0 THEN 'mcp' ELSE 'source:' || d.source || '|' || d.lang END AS source,
         TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(d.doc_id AS INTEGER)) AS created_at, (d.doc_id % 11) / 10.0 AS content_score,
         coalesce(e.hit_count, 0) AS hit_count, e.last_retrieved, l.quality_score
  FROM documents d
  LEFT JOIN (SELECT user_id AS id, count(*) AS hit_count, max(ts) AS last_retrieved FROM events GROUP BY 1) e ON e.id = d.doc_id
  LEFT JOIN (SELECT doc_id AS id, round(quality * 0.9 + toxic * 0.03, 2) AS quality_score FROM labels) l ON l.id = d.doc_id
)"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memories that have an embedding, with it."""
    own = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")
    return own.join(memories(spark, sf_dir), "id")


def exchanges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, conv_id, user_msg and answer: each user turn with the assistant turn after it, and a content score."""
    turns = table(spark, sf_dir, "conversations")
    order = Window.partitionBy("conv_id").orderBy("turn")
    after = turns.withColumn("next_role", F.lead("role").over(order)).withColumn("answer", F.lead("text").over(order))
    pairs = after.filter((F.col("role") == "user") & (F.col("next_role") == "assistant"))
    return pairs.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "conv_id", "turn", F.col("text").alias("user_msg"), "answer", ((F.col("conv_id") * 7 + F.col("turn") * 3) % 20 / 20.0).alias("score"))


EXCHANGES_SQL = """
ex AS (
  SELECT conv_id * 1000 + turn AS id, conv_id, turn, text AS user_msg, answer, (conv_id * 7 + turn * 3) % 20 / 20.0 AS score
  FROM (SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS answer FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
  WHERE role = 'user' AND next_role = 'assistant'
)"""


def crawled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """url, content and content_hash of each page."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", T.html_to_text(F.col("html")).alias("content"))
    return pages.withColumn("content_hash", F.sha2("content", 256))
