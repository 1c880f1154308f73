"""Values at given ranks, and places in an order, without one task that sorts a whole group.

Cut points from an approximate sketch deal the values of a group into ranges; the sizes of the ranges tell which one
holds a rank, and only the values of those are counted, so that a frequent one is one row, and sorted. The cut points
decide how even the work is, never the result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sources.tables import with_checkpoints

CUTS = 256
MOST_GROUPS = 1000


def at_ranks(rows: DataFrame, group: list[str], value: str, ranks: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """The group columns, and for each name in ranks the value at that rank (from 1, of the number of values n) of the group's sorted values. Nulls are no values; a null group is a group; without rows there is no row.

    rows is read three times: for the sketch, for the sizes of ranges, and for the values of the few ranges that hold a
    rank. Only sums and these values are shuffled, as long as there are no more than MOST_GROUPS groups; beyond that,
    the cut points are joined by shuffle.
    """
    key = F.struct(*[F.col(c) for c in group]) if group else F.struct(F.lit(0).alias("all"))
    keyed = rows.select(key.alias("key"), F.col(value).alias("value")).filter("value is not null")
    shape = keyed.groupBy("key").agg(F.percentile_approx("value", [i / CUTS for i in range(1, CUTS)], F.lit(4 * CUTS)).alias("cuts"), F.count("*").alias("n"))
    shape, few = fixed(shape)
    sent = F.broadcast if few else lambda table: table
    # How many cut points are below the value, by halving: CUTS is a power of two.
    steps = F.array(*[F.lit(CUTS >> i) for i in range(1, CUTS.bit_length())])
    below = F.aggregate(steps, F.lit(0), lambda low, step: F.when(F.get("cuts", low + step - 1) < F.col("value"), low + step).otherwise(low))
    placed = keyed.join(sent(shape), "key").select("key", "value", "n", below.alias("range"))
    upto = F.sum("size").over(Window.partitionBy("key").orderBy("range"))  # at most CUTS rows a group
    sizes = placed.groupBy("key", "range").agg(F.count("*").alias("size"), F.first("n").alias("n")).withColumn("before", upto - F.col("size"))
    asked = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), rank(F.col("n")).cast("bigint").alias("rank")) for name, rank in ranks.items()]))
    wanted = sizes.withColumn("asked", asked).filter("asked.rank > before and asked.rank <= before + size").select("key", "range", (F.col("asked.rank") - F.col("before")).alias("rest"), "asked.name")
    wanted, _ = fixed(wanted, MOST_GROUPS * len(ranks))
    inside = placed.join(sent(wanted.select("key", "range").distinct()), ["key", "range"], "left_semi").groupBy("key", "range", "value").agg(F.count("*").alias("times"))
    counted = inside.join(sent(wanted), ["key", "range"]).withColumn("upto", F.sum("times").over(Window.partitionBy("key", "range", "name").orderBy("value")))
    found = counted.filter("upto >= rest").groupBy("key").agg(*[F.min(F.when(F.col("name") == name, F.col("value"))).alias(name) for name in ranks])
    return found.select(*[F.col(f"key.{c}").alias(c) for c in group], *ranks)


def fixed(table: DataFrame, most: int = MOST_GROUPS) -> tuple[DataFrame, bool]:
    """table as it is now, whatever is computed again later, and whether it has no more than `most` rows, which then came by way of the driver."""
    rows = table.limit(most + 1).collect()
    if len(rows) <= most:
        return table.sparkSession.createDataFrame(rows, table.schema), True
    return with_checkpoints(table.sparkSession) and table.checkpoint(), False


def percent(p: int) -> Callable[[Column], Column]:
    """The least rank that at least p in a hundred values reach."""
    return lambda n: F.greatest(F.lit(1), F.floor((n * p + 99) / 100))


def places(rows: DataFrame, group: list[str], order: list[Column], name: str = "place") -> DataFrame:
    """rows with the place (from 1) of each in its group's order, which must tell all rows of a group apart.

    Rows are dealt to ranges of group and order and written once, so that a lost executor changes no range; a place is
    that inside the range plus the sizes of the group's ranges before it.
    """
    dealt = rows.repartitionByRange(*[F.col(c) for c in group], *order).withColumn("range", F.spark_partition_id()).checkpoint()
    upto = F.sum("size").over(Window.partitionBy(*group).orderBy("range"))  # a row a range
    before = dealt.groupBy(*group, "range").agg(F.count("*").alias("size")).select(*[F.col(c).alias(f"own_{c}") for c in group], F.col("range").alias("own_range"), (upto - F.col("size")).alias("before"))
    same = F.col("range") == F.col("own_range")
    for c in group:
        same = same & F.col(c).eqNullSafe(F.col(f"own_{c}"))
    inside = F.row_number().over(Window.partitionBy(*group, "range").orderBy(*order))
    return dealt.withColumn("inside", inside).join(before, same).withColumn(name, F.col("inside") + F.col("before")).select(*rows.columns, name)
