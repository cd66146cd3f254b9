"""Irregular readings onto a regular hourly grid, by shape-preserving cubic interpolation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.series import HOUR_MS, SERIES, hour_of, steps, without_copies


def _slope(h0: Column, h1: Column, d0: Column, d1: Column) -> Column:
    """Inner knot: the weighted harmonic mean of the slopes on both sides, 0 at a turn (Fritsch and Butland)."""
    w1, w2 = 2 * h1 + h0, h1 + 2 * h0
    return F.when(d0 * d1 > 0, (w1 + w2) / (w1 / d0 + w2 / d1)).otherwise(F.lit(0.0))


def _end(h0: Column, h1: Column, d0: Column, d1: Column) -> Column:
    """End knot next to an interval (h0, d0) followed by (h1, d1): three points, kept to the shape."""
    s = ((2 * h0 + h1) * d0 - h0 * d1) / (h0 + h1)
    return F.when(s * d0 <= 0, F.lit(0.0)).when((d0 * d1 <= 0) & (F.abs(s) > 3 * F.abs(d0)), 3 * d0).otherwise(s)


def hourly_grid(measurements: DataFrame, longest_gap_hours: int = 6, shard_hours: int = 720) -> DataFrame:
    """One row for each series and hour from its first to its last usable reading.

    Columns: topic, sensor_name, hour_start_ms, n_readings, value, status.  An hour with usable
    readings has their mean (``observed``).  Gaps of up to ``longest_gap_hours`` hours are filled at the
    middle of the hour (``filled``) by a monotone cubic through the hourly means, placed at the mean
    event time of their readings; longer gaps part the series into segments and stay null (``gap``).

    Readings are aggregated by hour before the shuffle, which bounds a hot sensor by its hours.  Each
    series is cut into time shards; a shard gets the two knots next to it on either side from its
    neighbours, all an interval's cubic depends on.  Copies and unusable rows do not count, an empty table gives
    no rows.  The missing hours of a gap come from two explosions, so one far-off event time makes no huge array.
    """
    u = without_copies(measurements).withColumn("hour", hour_of(F.col("ms")))
    knots = u.groupBy(*SERIES, "hour").agg(
        F.count(F.lit(1)).alias("n"), F.avg("reading").alias("y"), F.avg((F.col("ms") - F.col("hour")).cast("double")).alias("off")
    )
    knot = F.struct("hour", (F.col("hour") + F.col("off")).alias("x"), "y", "n")
    shards = knots.withColumn("shard", F.floor(F.col("hour") / (shard_hours * HOUR_MS))).groupBy(*SERIES, "shard").agg(F.sort_array(F.collect_list(knot)).alias("own"))
    by = Window.partitionBy(*SERIES).orderBy("shard")
    none = F.array().cast("array<struct<hour:bigint,x:double,y:double,n:bigint>>")

    def halo(c: Column, start: int, n: int) -> Column:
        return F.coalesce(F.when(F.size(c) >= 2, F.slice(c, start, n)).otherwise(c), none)

    head, tail = halo(F.col("own"), 1, 2), halo(F.col("own"), -2, 2)
    edges = shards.withColumn("head", head).withColumn("tail", tail)
    # a neighbour may hold a single knot: two shards away there is the other one
    before = F.concat(F.coalesce(F.lag("tail", 2).over(by), none), F.coalesce(F.lag("tail", 1).over(by), none))
    after = F.concat(F.coalesce(F.lead("head", 1).over(by), none), F.coalesce(F.lead("head", 2).over(by), none))
    full = edges.withColumn("before", before).withColumn("after", after)
    n0 = F.least(F.size("before"), F.lit(2))
    full = full.select(
        *SERIES,
        n0.alias("n0"),
        F.size("own").alias("m"),
        F.concat(F.when(F.size("before") > 2, F.slice("before", -2, 2)).otherwise(F.col("before")), F.col("own"), F.slice("after", 1, 2)).alias("k"),
    )

    def at(i: Column) -> Column:
        return F.get(F.col("k"), i)

    # one interval a knot: from it to the next one, with the knots around
    idx = F.sequence(F.col("n0"), F.col("n0") + F.col("m") - 1)
    rows = full.select(*SERIES, F.inline(F.transform(idx, lambda i: F.struct(F.when(i > 0, at(i - 1)).alias("p"), at(i).alias("a"), at(i + 1).alias("b"), at(i + 2).alias("q")))))
    near = F.lit((longest_gap_hours + 1) * HOUR_MS)

    def joined(left: str, right: str) -> Column:
        return F.coalesce(F.col(f"{right}.hour") - F.col(f"{left}.hour") <= near, F.lit(False))

    h = F.col("b.x") - F.col("a.x")
    d = (F.col("b.y") - F.col("a.y")) / h
    hp, dp = F.col("a.x") - F.col("p.x"), (F.col("a.y") - F.col("p.y")) / (F.col("a.x") - F.col("p.x"))
    hq, dq = F.col("q.x") - F.col("b.x"), (F.col("q.y") - F.col("b.y")) / (F.col("q.x") - F.col("b.x"))
    left, right = joined("p", "a"), joined("b", "q")
    sa = F.when(left, _slope(hp, h, dp, d)).when(right, _end(h, hq, d, dq)).otherwise(d)
    sb = F.when(right, _slope(h, hq, d, dq)).when(left, _end(h, hp, d, dp)).otherwise(d)
    short = joined("a", "b")
    rows = rows.select(
        *SERIES, "a", F.col("b.hour").alias("until"), short.alias("short"), F.when(short, h).alias("h"), F.when(short, d).alias("d"), F.when(short, sa).alias("sa"), F.when(short, sb).alias("sb")
    )
    # the missing hours of the interval, after its own
    rows = steps(rows, F.col("a.hour"), F.coalesce(F.col("until") - HOUR_MS, F.col("a.hour")), HOUR_MS, "hour_start_ms")
    seen = F.col("hour_start_ms") == F.col("a.hour")
    s = (F.col("hour_start_ms") + HOUR_MS / 2 - F.col("a.x"))
    c2, c3 = (3 * F.col("d") - 2 * F.col("sa") - F.col("sb")) / F.col("h"), (F.col("sa") + F.col("sb") - 2 * F.col("d")) / (F.col("h") * F.col("h"))
    cubic = F.col("a.y") + s * (F.col("sa") + s * (c2 + s * c3))
    return rows.select(
        *SERIES,
        "hour_start_ms",
        F.when(seen, F.col("a.n")).otherwise(F.lit(0)).cast("long").alias("n_readings"),
        F.when(seen, F.col("a.y")).when(F.col("short"), cubic).alias("value"),
        F.when(seen, F.lit("observed")).when(F.col("short"), F.lit("filled")).otherwise(F.lit("gap")).alias("status"),
    )
