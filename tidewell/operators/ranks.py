"""Ranks in a total order over a whole table, without one task that holds it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def global_rank(df: DataFrame, bucket: Column, order: list[str], name: str = "rank") -> DataFrame:
    """``df`` with its rows numbered from 0 by ``order``.

    ``bucket`` must not fall as the order goes on. Buckets are counted first, so one window holds a row for each bucket
    and every other one the rows of a single bucket.
    """
    rows = df.withColumn("s_bucket", bucket)
    sizes = rows.groupBy("s_bucket").agg(F.count(F.lit(1)).alias("s_n"))
    before = Window.orderBy("s_bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("s_bucket", F.coalesce(F.sum("s_n").over(before), F.lit(0)).alias("s_base"))
    within = F.row_number().over(Window.partitionBy("s_bucket").orderBy(*order)) - 1
    return rows.join(base, "s_bucket").withColumn(name, (F.col("s_base") + within).cast("bigint")).drop("s_bucket", "s_base")


def of_ids(column: str, size: int = 4096) -> Column:
    """Buckets of ``size`` neighbouring whole numbers."""
    return F.floor(F.col(column) / size)
