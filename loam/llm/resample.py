"""Target-distribution importance resampling: hashed word features tell how much likelier a text is in the target
than in the corpus; a Gumbel draw makes the highest scores a weighted sample without replacement.

Words are runs of a-z, 0-9 and non-ASCII characters after lower-casing A-Z. A feature is a run of 1 to `grams` words,
joined by one space; its bucket is the CRC-32 of its UTF-8 bytes modulo `buckets`. What reaches the driver and every
task is one array of gains, `buckets` long, whatever the input's size; texts never shuffle.

The k-th best row is found by a distributed quickselect: each round deals the rows still in question between random
pivot keys and counts, for each pivot, what lies below, at and above it; one pass gives the counts and the next
round's pivots. Winners alone are then sorted.

Null or empty texts have no features and weigh 0; an empty target or table is a count of zero; repeated rows and equal
scores are told apart by doc_id (null last), then by text digest, then by a number given when rows are written: rows
alike in all three are interchangeable. Columns of docs named like a result are replaced.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from array import array

from pyspark.sql import Column, DataFrame, Row, Window, functions as F

from .common import ddl, map_texts, staged, utf8_column, with_computed
from .decontaminate import words_of

BUCKETS = 10_000
KEY = ["lower", "no_id", "doc_id", "digest", "row"]


def feature_buckets(words: list[bytes], grams: int, buckets: int):
    """The bucket of each feature of a text."""
    import numpy as np

    found = array("I", map(zlib.crc32, words))
    for n in range(2, grams + 1):
        found.extend(zlib.crc32(b" ".join(words[i : i + n])) for i in range(len(words) - n + 1))
    return np.frombuffer(found, np.uint32) % buckets


def bucket_counts(docs: DataFrame, grams: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """bucket and n, the features of all texts of docs in it; each task adds up an array of its own first."""

    def count(parts):
        import numpy as np

        total = np.zeros(buckets, np.int64)
        for part in parts:
            for text in utf8_column(part, "text"):
                total += np.bincount(feature_buckets(words_of(text), grams, buckets), minlength=buckets)
        at = np.flatnonzero(total)
        yield [at.tolist(), total[at].tolist()]

    return map_texts(docs.select("text"), ddl("bucket int, part_n bigint"), count).groupBy("bucket").agg(F.sum("part_n").alias("n"))


def bucket_gains(docs: DataFrame, target: DataFrame, grams: int = 1, buckets: int = BUCKETS) -> list[int]:
    """For each bucket a thousand times the log of target to corpus frequency, each count plus one, rounded down."""
    counts = []
    for table in (docs, target):
        own = [0] * buckets
        for r in bucket_counts(table, grams, buckets).collect():  # at most `buckets` rows
            own[r.bucket] = r.n
        counts.append(own)
    corpus, wanted = counts
    total, wanted_total = (float(sum(x) + buckets) for x in counts)
    return [math.floor(1000 * math.log((t + 1.0) * total / ((s + 1.0) * wanted_total))) for s, t in zip(corpus, wanted)]


def luck(doc_id, seed: int) -> int:
    """A thousand times a standard Gumbel value that doc_id alone decides (null: an empty id), rounded down."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def score_documents(docs: DataFrame, target: DataFrame, grams: int = 1, buckets: int = BUCKETS, seed: int = 2024) -> DataFrame:
    """docs with n_words, n_features, weight and score of every row."""
    gains = docs.sparkSession.sparkContext.broadcast(array("q", bucket_gains(docs, target, grams, buckets)))

    def compute(part):
        import numpy as np

        table = np.frombuffer(gains.value, np.int64)
        n_words, n_features, weights, scores = [], [], [], []
        for doc_id, text in zip(part.column("doc_id").to_pylist(), utf8_column(part, "text")):
            words = words_of(text)
            at = feature_buckets(words, grams, buckets)
            n_words.append(len(words))
            n_features.append(len(at))
            weights.append(int(table[at].sum()))
            scores.append(weights[-1] + luck(doc_id, seed))
        return [n_words, n_features, weights, scores]

    return with_computed(docs, ddl("n_words bigint, n_features bigint, weight bigint, score bigint"), compute)


def literal(key: Row, kinds: dict) -> str:
    """key in SQL, which costs one call for all its values."""
    quoted = {c: "null" if key[c] is None else "'" + str(key[c]).replace("\\", "\\\\").replace("'", "\\'") + "'" for c in KEY}
    return "named_struct(" + ", ".join(f"'{c}', cast({quoted[c]} as {kinds[c].simpleString()})" for c in KEY) + ")"


def at_most(key: Row, kinds: dict) -> Column:
    """Whether a row's key is key or comes before it."""
    return F.struct(*KEY) <= F.expr(literal(key, kinds))


def kth_key(rows: DataFrame, k: int, pivots: int = 32) -> Row:
    """The k-th least KEY (from 1) of rows, all different, by quickselect: at most 2 * pivots * (pivots + 1) rows a round reach the driver."""
    kinds = {c: rows.schema[c].dataType for c in KEY}
    live, turn, between = rows.select(*KEY), 0, []
    while True:
        # Interval i holds what is above pivot i - 1 up to pivot i itself; equal says whether it is that pivot.
        key, edges = F.struct(*KEY), F.expr(f"array({', '.join(literal(p, kinds) for p in between)})")
        where = F.size(F.filter(edges, lambda p: p < key)) if between else F.lit(0)
        equal = F.get(edges, where).eqNullSafe(key) if between else F.lit(False)
        dealt = live.select(key.alias("key"), where.alias("interval"), equal.alias("equal"), F.xxhash64("row", F.lit(turn)).alias("draw"))
        found = dealt.groupBy("interval", "equal", F.pmod("draw", F.lit(pivots)).alias("lot")).agg(F.count("*").alias("n"), F.min_by("key", "draw").alias("key")).collect()
        below = 0
        for i in range(len(between) + 1):
            inside = sum(r.n for r in found if r.interval == i and not r.equal)
            if below < k <= below + inside:
                break
            below += inside
            if i < len(between):  # exactly one row is the pivot
                below += 1
                if below == k:
                    return between[i]
        else:
            raise ValueError(f"there is no row {k}")
        # What is left is one interval, without the pivots at either end.
        if i:
            live = live.filter(~at_most(between[i - 1], kinds))
        if i < len(between):
            live = live.filter(F.struct(*KEY) < F.expr(literal(between[i], kinds)))
        k -= below
        between = sorted((r["key"] for r in found if r.interval == i and not r.equal), key=order_of)
        turn += 1


def order_of(key: Row) -> tuple:
    """A key's place in Spark's order: null ids are told by no_id, so that their own value is not asked."""
    return key.lower, key.no_id, 0 if key.no_id else key.doc_id, key.digest, key.row


def draw(scored: DataFrame, percent: int = 10, least_words: int = 20, pivots: int = 32) -> DataFrame:
    """scored with rank: 1, 2, 3... for the percent (rounded down) highest scores among rows of least_words words or more, ties to the smaller doc_id; null for all others."""
    digest = F.xxhash64("text") if "text" in scored.columns else F.lit(0).cast("bigint")
    keyed = scored.drop("rank").select(*[F.col(f"`{c}`").alias(f"kept_{i}") for i, c in enumerate(scored.drop("rank").columns)], (-F.col("score")).alias("lower"), F.col("doc_id").isNull().alias("no_id"), "doc_id", digest.alias("digest"), (F.col("n_words") >= least_words).alias("may_win"))
    rows = staged(keyed.withColumn("row", F.monotonically_increasing_id()), "scored")  # written once, so that a row keeps its number
    names = scored.drop("rank").columns
    result = [F.col(f"kept_{i}").alias(c) for i, c in enumerate(names)]
    candidates = rows.filter("may_win")
    k = candidates.count() * percent // 100
    if not k:
        return rows.select(*result, F.lit(None).cast("bigint").alias("rank"))
    won = F.col("may_win") & at_most(kth_key(candidates, k, pivots), {c: rows.schema[c].dataType for c in KEY})
    ranked = in_order(rows.filter(won)).select(*result, "rank")
    return ranked.union(rows.filter(~won).select(*result, F.lit(None).cast("bigint")))


def in_order(winners: DataFrame) -> DataFrame:
    """winners with rank, their place in the order of KEY: dealt into ranges, which are written, sorted each by itself and numbered after the rows of those before."""
    dealt = staged(winners.repartitionByRange(*KEY).withColumn("range", F.spark_partition_id()), "winners")
    sizes = dealt.groupBy("range").count()
    before = sizes.select(F.col("range"), (F.sum("count").over(Window.orderBy("range")) - F.col("count")).alias("before"))  # a row a range
    inside = dealt.withColumn("inside", F.row_number().over(Window.partitionBy("range").orderBy(*KEY)))
    return inside.join(F.broadcast(before), "range").withColumn("rank", F.col("inside") + F.col("before"))


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, grams: int = 1, buckets: int = BUCKETS, seed: int = 2024) -> DataFrame:
    """The drawn rows of docs with their columns and rank."""
    own = docs.drop("rank")
    return draw(score_documents(own, target, grams, buckets, seed), percent, least_words).filter("rank is not null").select(*[c for c in own.columns], "rank")
