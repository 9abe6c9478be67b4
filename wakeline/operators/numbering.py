"""Row numbers and running sums in large groups, without ever sorting a whole group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered(rows: DataFrame, group: list[str], bucket: Column, order: list, name: str, running: dict[str, str] | None = None) -> DataFrame:
    """Adds name (from 1) in the order of (bucket, order) inside group, and running sums {new column: summed column}.

    bucket must rise with the order. Rows are numbered inside their bucket; what lies before a bucket is a running sum over one row a
    bucket. So a group of any size is spread over its buckets.
    """
    running = running or {}
    cut = rows.withColumn("_b", bucket)
    totals = cut.groupBy(*group, "_b").agg(F.count(F.lit(1)).alias("_n"), *[F.sum(c).alias(f"_s_{new}") for new, c in running.items()])
    before = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*group, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"), *[F.coalesce(F.sum(f"_s_{new}").over(before), F.lit(0)).alias(f"_o_{new}") for new in running])
    inside = Window.partitionBy(*group, "_b").orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = cut.join(offsets, [*group, "_b"]).withColumn(name, F.row_number().over(inside) + F.col("_n0"))
    for new, c in running.items():
        out = out.withColumn(new, F.sum(c).over(upto) + F.col(f"_o_{new}"))
    return out.drop("_b", "_n0", *[f"_o_{new}" for new in running])
