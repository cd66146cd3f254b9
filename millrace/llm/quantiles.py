"""Percentiles of very large numeric columns from mergeable logarithmic buckets.

A value ``v`` > 0 falls into bucket ``ceil(log(v) / log(gamma))`` with ``gamma = (1 + a) / (1 - a)``, so the
bucket's middle ``2 gamma^i / (gamma + 1)`` is within the relative error ``a`` of every value in it.
Negative values have mirrored buckets, zero has its own, and so have the infinities.  Buckets are ordered as
one signed integer.  A sketch is rows of (keys, bucket, n): sketches of partitions or days combine by
adding counts, and a percentile is the middle of the bucket that holds its rank.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ALPHA = 0.01


def _shape(alpha: float) -> tuple[float, int, int]:
    """log(gamma); what keeps the signed bucket of the smallest positive double above 0; the bucket of infinity."""
    if not 0 < alpha < 1:
        raise ValueError("alpha must be between 0 and 1")
    lg = math.log((1 + alpha) / (1 - alpha))
    shift = math.ceil(745.2 / lg) + 1
    return lg, shift, shift + math.ceil(709.8 / lg) + 2


def bucket_of(value: Column, alpha: float = ALPHA) -> Column:
    """The signed bucket of a double; null for null and not-a-number."""
    lg, shift, top = _shape(alpha)
    size = F.abs(value)
    i = F.when(size == float("inf"), F.lit(top)).otherwise(F.ceil(F.ln(size) / lg) + shift)
    return F.when(value.isNull() | F.isnan(value), F.lit(None)).when(value == 0, F.lit(0)).when(value > 0, i).otherwise(-i).cast("int")


def middle_of(bucket: Column, alpha: float = ALPHA) -> Column:
    """The value a bucket stands for."""
    lg, shift, top = _shape(alpha)
    i = F.abs(bucket)
    # the exponential of the sum stays finite where gamma^i alone would not
    size = F.exp((i - shift) * F.lit(lg) + F.lit(math.log(2 / (math.exp(lg) + 1))))
    return F.when(bucket == 0, F.lit(0.0)).when(i == top, F.signum(bucket) * float("inf")).otherwise(F.signum(bucket) * size)


def sketch(df: DataFrame, keys: Sequence[str], value: str, alpha: float = ALPHA) -> DataFrame:
    """(keys, bucket, n): counts of the values of each group; null and not-a-number do not count.

    Counted before the shuffle: what moves is at most one row for each group and bucket of a partition, so a hot
    group is no larger than its buckets.
    """
    b = df.select(*keys, bucket_of(F.col(value).cast("double"), alpha).alias("bucket")).filter(F.col("bucket").isNotNull())
    return b.groupBy(*keys, "bucket").agg(F.count(F.lit(1)).alias("n"))


def combine(sketches: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Adds sketches, of partitions or finer groups, to those of ``keys``."""
    return sketches.groupBy(*keys, "bucket").agg(F.sum("n").alias("n"))


def percentile_name(q: float) -> str:
    return "p" + f"{100 * q:g}".replace(".", "_").rjust(2, "0")


def percentile_buckets(sketches: DataFrame, keys: Sequence[str], quantiles: Sequence[float]) -> DataFrame:
    """(keys, n_values, b50, ...): the bucket of the value of rank ``ceil(q n)`` (1 at least) in each group."""
    keys = list(keys)
    by = Window.partitionBy(*keys)
    up = by.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    c = sketches.select(*keys, "bucket", F.sum("n").over(up).alias("upto"), F.sum("n").over(by).alias("total"))
    at = [F.min(F.when(F.col("upto") >= F.greatest(F.ceil(F.col("total") * F.lit(q)), F.lit(1)), F.col("bucket"))).alias("b" + percentile_name(q)[1:]) for q in quantiles]
    return c.groupBy(*keys).agg(F.max("total").alias("n_values"), *at)


def percentiles(sketches: DataFrame, keys: Sequence[str], quantiles: Sequence[float], alpha: float = ALPHA) -> DataFrame:
    """(keys, n_values, p50, ...): percentiles within the relative error ``alpha`` of the value of that rank.

    ``alpha`` must be that of the sketches.  A group without values has no row; an infinite value comes out as such.
    """
    for q in quantiles:
        if not 0 <= q <= 1:
            raise ValueError("a quantile lies between 0 and 1")
    b = percentile_buckets(sketches, keys, quantiles)
    return b.select(*keys, "n_values", *[middle_of(F.col("b" + percentile_name(q)[1:]), alpha).alias(percentile_name(q)) for q in quantiles])
