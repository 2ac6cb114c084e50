"""Ordered operators over keys of any size.

A window over a whole key sorts that key in one task. The functions here cut every key into buckets of
an ordering expression, run the window inside a bucket, and carry what earlier buckets contribute over
a table with one row per bucket. A hot key is thus spread over its buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _with_carry(df: DataFrame, keys: list[str], bucket: str, summary: list[Column], carry: dict[str, Column], after: bool = False) -> DataFrame:
    """df with the carry columns, each computed over the per-bucket summary rows before (or after) this one's bucket."""
    per = df.groupBy(*keys, bucket).agg(*summary)
    order = Window.partitionBy(*keys).orderBy(bucket)
    others = order.rowsBetween(1, Window.unboundedFollowing) if after else order.rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(*keys, bucket, *[c.over(others).alias(n) for n, c in carry.items()])
    on = [df[k].eqNullSafe(per[k]) for k in [*keys, bucket]]
    condition = on[0]
    for c in on[1:]:
        condition = condition & c
    return df.join(per, condition).drop(*[per[k] for k in [*keys, bucket]])


def position(df: DataFrame, keys: list[str], order: list[str], bucket: Column, name: str = "idx") -> DataFrame:
    """df with the row's place, from 0, in the order of its key. `bucket` must not decrease in that order."""
    rows = df.withColumn("__b", bucket)
    rows = _with_carry(rows, keys, "__b", [F.count(F.lit(1)).alias("__n")], {"__before": F.sum("__n")})
    own = Window.partitionBy(*keys, "__b").orderBy(*order)
    return rows.withColumn(name, F.coalesce("__before", F.lit(0)) + F.row_number().over(own) - 1).drop("__b", "__before")


def running_max(df: DataFrame, keys: list[str], order: list[str], bucket: Column, value: str, name: str) -> DataFrame:
    """df with the largest value of the rows before, in the order of the key; null for the first."""
    rows = df.withColumn("__b", bucket)
    rows = _with_carry(rows, keys, "__b", [F.max(value).alias("__m")], {"__before": F.max("__m")})
    own = Window.partitionBy(*keys, "__b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn(name, F.greatest(F.col("__before"), F.max(value).over(own))).drop("__b", "__before")


def running_sum(df: DataFrame, keys: list[str], order: list[str], bucket: Column, value: str, name: str) -> DataFrame:
    """df with the sum of the values up to and including the row, in the order of its key."""
    rows = df.withColumn("__b", bucket)
    rows = _with_carry(rows, keys, "__b", [F.sum(value).alias("__m")], {"__before": F.sum("__m")})
    own = Window.partitionBy(*keys, "__b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.coalesce("__before", F.lit(0)) + F.sum(value).over(own)).drop("__b", "__before")


def forward_fill(df: DataFrame, keys: list[str], order: list[str], bucket: Column, value: str, default: Column, name: str) -> DataFrame:
    """df with the last non-null value up to the row, in the order of its key, else the default."""
    rows = df.withColumn("__b", bucket)
    own = Window.partitionBy(*keys, "__b").orderBy(*order)
    rows = rows.withColumn("__r", F.when(F.col(value).isNotNull(), F.row_number().over(own)))
    latest = F.max_by(F.col(value), F.col("__r")).alias("__m")  # __r is unique in a bucket: no ties
    rows = _with_carry(rows, keys, "__b", [latest], {"__before": F.last("__m", ignorenulls=True)})
    filled = F.last(value, ignorenulls=True).over(own.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn(name, F.coalesce(filled, F.col("__before"), default)).drop("__b", "__r", "__before")


def neighbours(df: DataFrame, keys: list[str], order: list[str], bucket: Column, value: str, name: str) -> DataFrame:
    """df with the value of the row just before, in the order of its key (null for the first)."""
    rows = df.withColumn("__b", bucket)
    own = Window.partitionBy(*keys, "__b").orderBy(*order)
    rows = rows.withColumn("__r", F.row_number().over(own))
    rows = _with_carry(rows, keys, "__b", [F.max_by(value, "__r").alias("__m")], {"__before": F.last("__m")})
    return rows.withColumn(name, F.when(F.col("__r") == 1, F.col("__before")).otherwise(F.lag(value).over(own))).drop("__b", "__r", "__before")


def successors(df: DataFrame, keys: list[str], order: list[str], bucket: Column, value: Column, name: str) -> DataFrame:
    """df with the value (no null) of the row just after, in the order of its key (null for the last)."""
    rows = df.withColumns({"__b": bucket, "__v": value})
    own = Window.partitionBy(*keys, "__b").orderBy(*order)
    rows = rows.withColumns({"__r": F.row_number().over(own), "__lead": F.lead("__v").over(own)})
    rows = _with_carry(rows, keys, "__b", [F.min_by("__v", "__r").alias("__m")], {"__after": F.first("__m")}, after=True)
    return rows.withColumn(name, F.coalesce("__lead", "__after")).drop("__b", "__v", "__r", "__lead", "__after")
