"""Late and out-of-order events: aggregates by event time, provisional and corrected.

K-slack over a recorded log.  Every message is held against the watermark in force when it arrived; what is at most the slack behind is
admitted to the buffer of its series and slice of event time, which is the sort of that slice and spills where it must.  From there events
are released in event-time order to the final, order-sensitive aggregation.  The provisional values are those of the events that
were in the buffer when the watermark passed their hour's end.  The unbounded form is :mod:`millrace.streaming.kslack`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.series import HOUR_MS, SERIES, hour_of, usable

LOG = ("topic", "kafka_partition")
#: Event time that one buffer spans: a hot series is many buffers an hour.
SLICE_MS = 300_000


def _carry(messages: DataFrame, marks: DataFrame, span: int) -> DataFrame:
    """(topic, kafka_partition, bucket, wm): the highest watermark of all buckets before this one.

    Two levels of running maxima, over buckets within a stretch of ``span`` buckets and over stretches, so
    that a partition with a third of the log is no single sort of its buckets.
    """
    seen = messages.select(*LOG, "bucket").distinct().withColumn("wm", F.lit(None).cast("long"))
    b = seen.unionByName(marks.groupBy(*LOG, "bucket").agg(F.max("wm").alias("wm"))).groupBy(*LOG, "bucket").agg(F.max("wm").alias("wm"))
    b = b.withColumn("stretch", F.floor(F.col("bucket") / span))
    upto = (Window.unboundedPreceding, -1)
    s = b.groupBy(*LOG, "stretch").agg(F.max("wm").alias("top"))
    s = s.withColumn("base", F.max("top").over(Window.partitionBy(*LOG).orderBy("stretch").rowsBetween(*upto))).drop("top")
    inner = F.max("wm").over(Window.partitionBy(*LOG, "stretch").orderBy("bucket").rowsBetween(*upto))
    b = b.withColumn("inner", inner).join(s, [*LOG, "stretch"])
    return b.select(*LOG, "bucket", F.greatest("inner", "base").alias("wm")).filter(F.col("wm").isNotNull())


def with_watermark(messages: DataFrame, checkpoints: DataFrame, bucket: int = 4096, span: int = 4096, log: DataFrame | None = None) -> DataFrame:
    """``messages`` with ``wm``: the watermark in force for each, in ms, or null.

    That is the greatest non-null watermark saved for its topic and partition with ``as_of_offset`` below its
    ``kafka_offset``.  The log is cut into buckets of ``bucket`` offsets; each bucket is merged with its own
    checkpoints and the highest watermark of all before it, so a task sorts at most one bucket at a time and no
    pairs of messages and checkpoints are formed.  Null offsets or partitions have no watermark.  ``log`` is a table
    that holds the offsets of all messages (by default ``messages``): its buckets are listed in a scan of their columns.
    """
    cut = F.floor(F.col("at") / bucket).alias("bucket")
    marks = (
        checkpoints.filter(F.col("watermark").isNotNull() & F.col("as_of_offset").isNotNull() & F.col("topic").isNotNull() & F.col("kafka_partition").isNotNull())
        .select(*LOG, F.col("as_of_offset").alias("at"), F.unix_millis(F.col("watermark").cast("timestamp")).alias("wm"))
        .select("*", cut)
    )
    cols = [c for c in messages.columns if c not in ("topic", "kafka_partition")]
    row = messages.select(*LOG, F.col("kafka_offset").alias("at"), F.struct(*cols).alias("row")).select("*", cut)
    none = F.lit(None).cast(row.schema["row"].dataType)
    offsets = (messages if log is None else log).select(*LOG, F.col("kafka_offset").alias("at")).select(*LOG, cut)
    carry = _carry(offsets, marks, span).select(*LOG, "bucket", (F.col("bucket") * bucket - 1).alias("at"), "wm", F.lit(1).alias("kind"), none.alias("row"))
    both = (
        row.select(*LOG, "bucket", "at", F.lit(None).cast("long").alias("wm"), F.lit(0).alias("kind"), "row")
        .unionByName(marks.select(*LOG, "bucket", "at", "wm", F.lit(1).alias("kind"), none.alias("row")))
        .unionByName(carry)
    )
    # at one offset the message comes before the checkpoint that includes it
    w = Window.partitionBy(*LOG, "bucket").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("wm", F.max("wm").over(w)).filter(F.col("kind") == 0).select(*LOG, "row.*", "wm")


def hourly_with_late(measurements: DataFrame, checkpoints: DataFrame, slack_ms: int = 6 * HOUR_MS, bucket: int = 4096, span: int = 4096, slice_ms: int = SLICE_MS) -> DataFrame:
    """Aggregates for each series and hour of event time, as published and as corrected.

    Columns: topic, sensor_name, window_start_ms; count, sum, min, max, first and last reading by event time
    (ties by partition and offset) and the largest rise from one reading to the next (0 if there is none), as
    ``provisional_*`` (on time) and ``final_*`` (with accepted late readings); n_late_accepted, n_late_dropped.
    A usable reading that is no copy is late if the watermark in force is at or past its hour's end, accepted if it
    is at most ``slack_ms`` behind that watermark, else dropped.  Provisional values of an hour with late readings only
    are null (count 0).

    Messages move twice: by offset, to meet their watermark, and by series and slice, where copies are found and the buffer is
    released in order.  What goes on from a slice is one row, in which first, last and rise of neighbouring slices fit together.
    """
    m = with_watermark(usable(measurements, "kafka_partition", "kafka_offset"), checkpoints, bucket, span, measurements)
    m = m.withColumn("slice", F.floor(F.col("ms") / slice_ms)).repartition(*SERIES, "slice")
    # copies share series, time and so slice; a row without a partition is its own group
    own = F.when(F.col("kafka_partition").isNull(), F.col("kafka_offset")).alias("own")
    once = m.groupBy(*SERIES, "slice", "ms", "reading", "kafka_partition", own).agg(F.min("kafka_offset").alias("kafka_offset"), F.min_by("wm", "kafka_offset").alias("wm"))
    late = F.coalesce(F.col("wm") >= hour_of(F.col("ms")) + HOUR_MS, F.lit(False))
    once = once.withColumn("state", F.when(~late, 0).when(F.col("ms") >= F.col("wm") - slack_ms, 1).otherwise(2))
    released = Window.partitionBy(*SERIES, "slice").orderBy("ms", "kafka_partition", "kafka_offset")
    before = released.rowsBetween(Window.unboundedPreceding, -1)
    kinds = {"provisional": F.col("state") == 0, "final": F.col("state") <= 1}
    order = once.withColumn("nth", F.row_number().over(released))
    for k, on in kinds.items():
        order = order.withColumn(f"{k}_before", F.last(F.when(on, F.col("reading")), ignorenulls=True).over(before))

    def of_slice(k: str, on: Column) -> list[Column]:
        v, at = F.when(on, F.col("reading")), F.when(on, F.col("nth"))
        out = {"count": F.count(v), "sum": F.sum(v), "min": F.min(v), "max": F.max(v), "first": F.min_by("reading", at), "last": F.max_by("reading", at), "rise": F.max(v - F.col(f"{k}_before"))}
        return [c.alias(f"{k}_{n}") for n, c in out.items()]

    s = F.col("state")
    slices = order.groupBy(*SERIES, "slice").agg(*[c for k, on in kinds.items() for c in of_slice(k, on)], F.count(F.when(s == 1, 1)).alias("n_late_accepted"), F.count(F.when(s == 2, 1)).alias("n_late_dropped"))
    slices = slices.withColumn("window_start_ms", hour_of(F.col("slice") * slice_ms))
    earlier = Window.partitionBy(*SERIES, "window_start_ms").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    for k in kinds:
        slices = slices.withColumn(f"{k}_before", F.last(f"{k}_last", ignorenulls=True).over(earlier))

    def of_hour(k: str) -> list[Column]:
        c = {n: F.col(f"{k}_{n}") for n in ("count", "sum", "min", "max", "first", "last", "rise", "before")}
        at = F.when(c["count"] > 0, F.col("slice"))
        rise = F.max(F.when(c["count"] > 0, F.greatest(c["rise"], c["first"] - c["before"], F.lit(0.0))))
        out = {"count": F.sum(c["count"]), "sum": F.sum(c["sum"]), "min": F.min(c["min"]), "max": F.max(c["max"]), "first": F.min_by(c["first"], at), "last": F.max_by(c["last"], at), "rise": rise}
        return [v.alias(f"{k}_{n}") for n, v in out.items()]

    return slices.groupBy(*SERIES, "window_start_ms").agg(*[c for k in kinds for c in of_hour(k)], F.sum("n_late_accepted").alias("n_late_accepted"), F.sum("n_late_dropped").alias("n_late_dropped"))
