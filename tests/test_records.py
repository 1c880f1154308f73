"""Prototypes and scores, models of one's own, changes of rows, sweeps by ticks."""

import tempfile

import numpy as np
from pyspark.sql import functions as F

from loam.operators import embed, records, scoring
from loam.streaming import streams


def plain_score(v, good, noise, top=3):
    def like(a, b):
        n = np.linalg.norm(a) * np.linalg.norm(b)
        return float(np.dot(a, b) / n) if n else 0.0

    q = np.mean([like(v, g) for g in good])
    n = np.mean(sorted((like(v, g) for g in noise), reverse=True)[:top])
    return 0.5 if q + n <= 0 else min(1.0, max(0.0, q / (q + n)))


def test_scores_by_default_and_given_prototypes(spark, sf_dir):
    docs = embed.hash_embedded(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    for given in ((), tuple(f"rejected {i} words" for i in range(200))):
        good, noise = scoring.prototypes(spark, embed.hash_embedded, noise=given)
        assert len(good) == 6 and len(noise) == (150 if given else 3)
        for r in scoring.scored(docs, good, noise).collect():
            assert abs(r.content_score - plain_score(np.array(r.embedding, float), np.array(good), np.array(noise))) < 1e-9
    last = embed.hash_embedded(spark.createDataFrame([("rejected 199 words",)], "text string")).first().embedding
    assert noise[-1] == list(last)


def test_scores_of_odd_vectors(spark):
    rows = spark.createDataFrame([(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, 0.0, 0.0]), (5, [1.0, 0.0]), (5, [1.0, 0.0])], "id int, embedding array<float>")
    got = sorted((r.id, round(r.content_score, 6)) for r in scoring.scored(rows.withColumn("content_score", F.lit("x")), [[1.0, 0.0]], [[1.0, 1.0]]).collect())
    assert got == [(1, 0.5), (2, 0.5), (3, 0.5), (4, 0.5), (5, 0.585786), (5, 0.585786)]
    assert scoring.scored(rows.limit(0), [[1.0, 0.0]], []).count() == 0


def test_a_model_of_ones_own(spark):
    def make():
        return lambda texts: [[len(texts) <= 4, len(t)] for t in texts]

    rows = spark.createDataFrame([(i, None if i == 3 else "x" * i) for i in range(11)], "id int, text string")
    got = {r.id: list(r.embedding) for r in embed.embedded(rows, make).collect()}
    assert got == {i: [1.0, 0.0 if i == 3 else float(i)] for i in range(11)}


def test_inserted_and_changed(spark):
    rows = spark.createDataFrame([(1, "a", 5), (None, "n", 6), (2, "b", 7)], "id int, v string, created_at int")
    fresh = spark.createDataFrame([(3, None), (4, 9)], "id int, created_at int")
    now = F.lit(100)
    assert sorted((r.id, r.created_at) for r in records.inserted(rows, fresh, now).collect() if r.id) == [(1, 5), (2, 7), (3, 100), (4, 9)]
    assert records.inserted(rows, fresh.drop("created_at"), now).filter("created_at = 100").count() == 2
    changes = spark.createDataFrame([(2, None), (8, "z"), (None, "y")], "id int, v string")
    assert sorted(map(str, ((r.id, r.v, r.created_at) for r in records.changed(rows, changes, "id").collect()))) == ["(1, 'a', 5)", "(2, None, 7)", "(None, 'n', 6)"]


def test_sweeps_and_rebuilt_noise(spark):
    root = tempfile.mkdtemp()
    spark.sparkContext.setCheckpointDir(f"{root}/cut")
    spark.range(1).write.parquet(f"{root}/ticks")
    schema = "id bigint, content string, embedding array<float>, created_at timestamp_ntz, hit_count bigint, last_retrieved timestamp_ntz, quality_score double, content_score double, source string"
    rows = [(1, "kept", [1.0, 0.0], "2024-02-01", 9, "2024-02-28"), (2, "idle", [0.0, 1.0], "2020-01-01", 0, None)]
    memories = spark.createDataFrame(rows, "id bigint, content string, embedding array<float>, c string, hit_count bigint, l string").select(
        "id", "content", "embedding", F.col("c").cast("timestamp_ntz").alias("created_at"), "hit_count", F.col("l").cast("timestamp_ntz").alias("last_retrieved"), F.lit(0.5).alias("quality_score"), F.lit(0.5).alias("content_score"), F.lit("s").alias("source")
    )
    assert set(memories.columns) == {c.split()[0] for c in schema.split(", ")}
    ticks = lambda: spark.readStream.schema("id bigint").parquet(f"{root}/ticks")
    streams.sweeps(ticks(), lambda: memories, lambda df: df.write.mode("overwrite").parquet(f"{root}/swept"), lambda: F.expr("timestamp_ntz '2024-03-01 00:00:00'"), f"{root}/c1").awaitTermination()
    assert [r.content for r in spark.read.parquet(f"{root}/swept").collect()] == ["kept"]
    log = spark.range(400).select("id", F.concat(F.lit("r"), "id").alias("answer"))
    streams.rebuilt_noise(ticks(), lambda: log, lambda df: df.write.mode("overwrite").parquet(f"{root}/noise"), f"{root}/c2").awaitTermination()
    got = [r.prototype for r in spark.read.parquet(f"{root}/noise").orderBy("id").collect()]
    assert len(got) == 150 and got[0] == "r250" and got[-1] == "r399"
