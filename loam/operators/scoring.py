"""Content scores: how like a text's vector is to texts worth keeping, against its likeness to noise."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

# What stands for texts worth keeping, and for noise, where nothing else is given.
GOOD = (
    "important technical decision with reasoning and rationale",
    "architecture pattern approach and implementation details",
    "debugging solution root cause analysis and fix",
    "configuration setup deployment and environment instructions",
    "code pattern best practice convention and design",
    "error message workaround resolution and explanation",
)
NOISE = (
    "greeting acknowledgment helpful response sure happy",
    "let me know if you need anything else feel free",
    "i will help you with that certainly of course",
)


def prototypes(spark: SparkSession, embed: Callable[[DataFrame], DataFrame], good: Sequence[str] = (), noise: Sequence[str] = (), most_noise: int = 150):
    """(good vectors, noise vectors): of the texts given, the defaults for none; of noise, such as rejected texts in order, the last most_noise."""
    good, noise = list(good) or list(GOOD), (list(noise) or list(NOISE))[-most_noise:]
    rows = [(i, t) for i, t in enumerate([*good, *noise])]
    found = {r["place"]: list(r["embedding"]) for r in embed(spark.createDataFrame(rows, "place int, text string")).select("place", "embedding").collect()}
    return [found[i] for i in range(len(good))], [found[i] for i in range(len(good), len(rows))]


def scored(rows: DataFrame, good: list[list[float]], noise: list[list[float]], top: int = 3) -> DataFrame:
    """rows (embedding) with content_score, 0 to 1: the mean cosine to `good`, as a share of it and the mean of the `top` greatest cosines to `noise`.

    Vectors that are null, of another length or without extent are like nothing, which gives 0.5. The vectors given
    travel with the tasks: some hundreds at most. A column content_score of rows is replaced.
    """
    base = rows.drop("content_score")
    schema = T.StructType([*base.schema.fields, T.StructField("content_score", T.DoubleType())])

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        def units(x):
            x = np.asarray(x, float)
            norms = np.linalg.norm(x, axis=1, keepdims=True)
            return np.divide(x, norms, out=np.zeros_like(x), where=norms > 0)

        of_good, of_noise = (units(v) if len(v) else None for v in (good, noise))
        dim = len((good or noise)[0]) if good or noise else 0
        for batch in batches:
            vectors = batch.column("embedding")
            fits = pc.fill_null(pc.equal(pc.list_value_length(vectors), dim), False).to_numpy(zero_copy_only=False)
            q, n = np.zeros(len(vectors)), np.zeros(len(vectors))
            if dim and fits.any():
                own = vectors.filter(pa.array(fits)).flatten()
                own = units(own.to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim))
                if of_good is not None:
                    q[fits] = (own @ of_good.T).mean(axis=1)
                if of_noise is not None:
                    n[fits] = -np.sort(-(own @ of_noise.T), axis=1)[:, :top].mean(axis=1)
            says = q + n > 0
            share = np.divide(q, q + n, out=np.full(len(q), 0.5), where=says)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.clip(share, 0, 1))], names=[*batch.schema.names, "content_score"])

    return base.mapInArrow(run, schema)
