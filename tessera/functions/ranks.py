"""Exact ranks without gathering a key in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Leading hex digits of the ticket that make a bucket: 4096 buckets of a key.
DIGITS = 3


def ranked(df: DataFrame, ticket: Column, keys: list[str] | None = None, tie: list[str] | None = None) -> DataFrame:
    """Add `_rank` (from 0) and `_size` within keys by ticket (a hex string), ties by columns.

    Buckets of leading digits keep the order of tickets. Their counts are summed up, and ranks are taken within
    (key, bucket): a key with a third of all rows is spread over all its buckets.
    """
    keys = keys or []
    rows = df.withColumns({"_ticket": ticket}).withColumn("_bucket", F.substring("_ticket", 1, DIGITS))
    per = rows.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    by_key = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    per = per.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        F.col("_bucket").alias("_kb"),
        (F.sum("_n").over(by_key.orderBy("_bucket")) - F.col("_n")).alias("_below"),
        F.sum("_n").over(by_key).alias("_size"),
    )
    on = F.col("_bucket") == F.col("_kb")
    for i, k in enumerate(keys):
        on &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
    inside = Window.partitionBy(*keys, "_bucket").orderBy("_ticket", *(tie or []))
    return rows.withColumn("_at", F.row_number().over(inside) - 1).join(per, on).select(*df.columns, (F.col("_below") + F.col("_at")).alias("_rank"), "_size")
