"""Rows of a store: insert with a default time, change by key, change of a source's state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def inserted(rows: DataFrame, fresh: DataFrame, now: Column) -> DataFrame:
    """rows and those of fresh; where these have no created_at, or a null one, it is now. Columns that one side lacks are null there."""
    given = fresh if "created_at" in fresh.columns else fresh.withColumn("created_at", F.lit(None).cast(rows.schema["created_at"].dataType))
    return rows.unionByName(given.withColumn("created_at", F.coalesce("created_at", now)), allowMissingColumns=True)


def changed(rows: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """rows, of which those whose key is in changes (one row a key) take all columns of it, nulls too. Keys that rows doesn't have, and null keys, change nothing."""
    taken = changes.select(F.col(key), F.struct(*[c for c in changes.columns if c != key]).alias("__new"))
    new = {c for c in changes.columns if c != key}
    return rows.join(taken, key, "left").select(*[F.when(F.col("__new").isNotNull(), F.col("__new")[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in rows.columns])
