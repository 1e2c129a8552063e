"""Places in a global order without one task for all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.runtime import cut


def global_place(df: DataFrame, *order: Column | str, name: str = "place") -> DataFrame:
    """df with each row's 1-based place in the order (which must be total).

    Rows are range-partitioned by the order, numbered inside their partition,
    and moved on by the sizes of the partitions before: one number a partition.
    """
    parts = cut(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()))
    sizes = parts.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_p", "_before")
    inside = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    return parts.join(F.broadcast(before), "_p").withColumn(name, (F.col("_before") + inside).cast("bigint")).drop("_p", "_before")


def global_lead(df: DataFrame, columns: list[str], *order: Column | str) -> DataFrame:
    """df with next_<column> of the following row in a global order: an equi-join of places."""
    placed = cut(global_place(df, *order, name="_place"))
    after = placed.select((F.col("_place") - 1).alias("_place"), *[F.col(c).alias(f"next_{c}") for c in columns])
    return placed.join(after, "_place", "left").drop("_place")
