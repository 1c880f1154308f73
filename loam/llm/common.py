"""Helpers shared by the training-data operators."""

from __future__ import annotations

import functools
import sys
import tempfile
import types
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(col):
    """Lower-cases A-Z alone, unlike lower(), which follows Unicode."""
    return F.translate(col, UPPER, LOWER)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where that is unset a new temporary one, in local mode (tests) only."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        chosen = spark.sparkContext._jsc.sc().getCheckpointDir()
        if chosen.isDefined():
            root = chosen.get()
        else:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            root = tempfile.mkdtemp(prefix="spark-")
            spark.sparkContext.setCheckpointDir(root)
    return root


def staged(df: DataFrame, label: str) -> DataFrame:
    """Writes df to the shared folder and reads it again: later work starts from files that survive lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/loam-{uuid.uuid4().hex}/{label}"
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def process_cache(name: str) -> dict:
    """A dict that lives as long as the Python worker process, so that tasks after the first find it filled."""
    home = sys.modules.setdefault("_loam_process_cache", types.ModuleType("_loam_process_cache"))
    return home.__dict__.setdefault(name, {})


BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession, most: int = 4 << 20) -> None:
    """Bounds the bytes of the Arrow batches that Spark hands to Python, unless the session has a bound of its own: rows alone don't, with long texts."""
    if spark.conf.get(BATCH_BYTES, None) is None:
        spark.conf.set(BATCH_BYTES, str(most))


def slices(batch, column: str, most: int = 1 << 20):
    """Parts of an Arrow batch that hold about most bytes of the text column, or one longer text: bounds what one step holds in memory."""
    import numpy as np
    import pyarrow.compute as pc

    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        done = int(sizes[start - 1]) if start else 0
        end = max(start + 1, int(np.searchsorted(sizes, done + most, side="right")))
        yield batch.slice(start, end - start)
        start = end


def text_column(batch, column: str) -> list[str]:
    """The texts of a batch, empty for null."""
    return [x or "" for x in batch.column(column).to_pylist()]


def utf8_column(batch, column: str) -> list[bytes]:
    """The texts of a batch as UTF-8, empty for null."""
    import pyarrow as pa

    values = batch.column(column)
    return [x or b"" for x in values.cast(pa.large_binary() if pa.types.is_large_string(values.type) else pa.binary()).to_pylist()]


def with_computed(df: DataFrame, fields: T.StructType, compute, text: str | None = "text") -> DataFrame:
    """df with further columns, computed from Arrow batches whose text is bounded (see slices).

    compute: gets a batch, gives a list of lists or Arrow arrays, one for each field. A column of df that has
    the name of a new one is replaced. text=None: batches come as they are.
    """
    bound_batches(df.sparkSession)
    base = df.drop(*[f.name for f in fields])
    names = [*base.columns, *fields.names]

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = [f.type for f in to_arrow_schema(fields)]
        for batch in batches:
            for part in slices(batch, text) if text else [batch]:
                new = [x if isinstance(x, pa.Array) else pa.array(x, kind) for x, kind in zip(compute(part), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, *new], names=names)

    return base.mapInArrow(run, T.StructType([*base.schema.fields, *fields.fields]))


def map_texts(df: DataFrame, fields: T.StructType, compute, text: str = "text", most: int = 1 << 20) -> DataFrame:
    """Rows of their own (several or none for each of df): compute takes an iterator of batches of about `most` bytes and yields lists of columns."""

    bound_batches(df.sparkSession)

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = [f.type for f in to_arrow_schema(fields)]
        for columns in compute(part for batch in batches for part in slices(batch, text, most)):
            yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, kind) for x, kind in zip(columns, kinds, strict=True)], names=fields.names)

    return df.mapInArrow(run, fields)


def ddl(text: str) -> T.StructType:
    return T.StructType.fromDDL(text)


def keeps_columns(operator):
    """For operators from documents to documents: columns they don't know get names of their own meanwhile, so that no name clashes, and come back in their order."""

    @functools.wraps(operator)
    def run(docs: DataFrame, *args, **kwargs) -> DataFrame:
        names = {c: c if c in ("doc_id", "text", "n_chars") else f"aside_{i}_of_input" for i, c in enumerate(docs.columns)}
        out = operator(docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]), *args, **kwargs)
        return out.select(*[F.col(n).alias(c) for c, n in names.items()])

    return run
