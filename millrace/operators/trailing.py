"""Totals over trailing periods by block decomposition."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.series import DAY_MS, SERIES, steps, without_copies


def daily(measurements: DataFrame) -> DataFrame:
    """(topic, sensor_name, day, day_sum, day_count) of usable readings that are no copies; day is days since 1970."""
    u = without_copies(measurements)
    return u.groupBy(*SERIES, F.floor(F.col("ms") / DAY_MS).cast("long").alias("day")).agg(F.sum("reading").alias("day_sum"), F.count(F.lit(1)).alias("day_count"))


def trailing_totals(days: DataFrame, windows: Sequence[int] = (7, 30), keys: Sequence[str] = SERIES) -> DataFrame:
    """Totals of the last ``w`` days of each key, for every day from its first to its last.

    ``days`` has one row for each key and active day: ``keys``, day, day_sum, day_count.  The result adds
    the days between without activity (sum and count 0) and, for each ``w``, sum_w, count_w and avg_w
    (null where the count is 0).

    The days are cut into blocks of ``w``; prefix sums run from a block's start, suffix sums to its end,
    and a trailing total is the prefix of its day plus the suffix of the day ``w`` - 1 before, in the
    block before: two additions however long the period, and no subtraction that would leave a remainder of
    a huge faulty reading in later totals.  The only shuffle is that by key; a key has one row a day.
    """
    keys = list(keys)
    by = Window.partitionBy(*keys).orderBy("day")
    nxt = F.coalesce(F.lead("day").over(by) - 1, F.col("day"))
    spans = days.withColumn("start", F.min("day").over(Window.partitionBy(*keys))).withColumn("until", nxt).withColumnRenamed("day", "active")
    dense = steps(spans, F.col("active"), F.col("until"), 1, "day")
    on = F.col("day") == F.col("active")
    out = dense.select(*keys, "day", (F.col("day") - F.col("start")).alias("i"), F.when(on, F.col("day_sum")).otherwise(F.lit(0.0)).alias("day_sum"), F.when(on, F.col("day_count")).otherwise(F.lit(0)).cast("long").alias("day_count"))
    for w in windows:
        block = F.floor(F.col("i") / w)
        inside = Window.partitionBy(*keys, f"b{w}").orderBy("day")
        prefix, suffix = inside.rowsBetween(Window.unboundedPreceding, 0), inside.rowsBetween(0, Window.unboundedFollowing)
        out = out.withColumn(f"b{w}", block)
        for c, kind in (("sum", "double"), ("count", "long")):
            out = out.withColumn(f"p_{c}", F.sum(f"day_{c}").over(prefix)).withColumn(f"s_{c}", F.sum(f"day_{c}").over(suffix))
            back = F.lag(f"s_{c}", w - 1).over(by) if w > 1 else F.lit(None)
            whole = F.pmod(F.col("i"), F.lit(w)) == w - 1  # the period is the block itself
            out = out.withColumn(f"{c}_{w}", (F.col(f"p_{c}") + F.when(whole, F.lit(0)).otherwise(F.coalesce(back, F.lit(0)))).cast(kind)).drop(f"p_{c}", f"s_{c}")
        out = out.withColumn(f"avg_{w}", F.when(F.col(f"count_{w}") > 0, F.col(f"sum_{w}") / F.col(f"count_{w}"))).drop(f"b{w}")
    return out.drop("i")


def activity(measurements: DataFrame, windows: Sequence[int] = (7, 30)) -> DataFrame:
    """:func:`trailing_totals` of measurements: topic, sensor_name, activity_day (yyyy-mm-dd), day_sum,
    day_count and sum_w, count_w, avg_w for each window.  Unusable rows and copies do not count; an empty
    table gives no rows."""
    t = trailing_totals(daily(measurements), windows)
    day = F.date_format(F.timestamp_millis(F.col("day") * DAY_MS), "yyyy-MM-dd").alias("activity_day")
    return t.select("topic", "sensor_name", day, *[c for c in t.columns if c not in (*SERIES, "day")])
