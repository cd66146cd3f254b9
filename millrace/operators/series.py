"""What the operators on measurements share: sensors, event times, usable readings and copies.

All of it is declarative column work; nothing here runs a job except :func:`bounded`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LEAST_EVENT_MS = 1_000_000_000_000
HOUR_MS, DAY_MS = 3_600_000, 86_400_000
SERIES = ("topic", "sensor_name")


def sensor(c: str = "sensor_name") -> Column:
    """The sensor: without leading and trailing spaces, in lower case; null stays null."""
    return F.lower(F.trim(F.col(c)))


def event_ms(c: str = "occurred_at_ms") -> Column:
    """The event time in ms, null where it is missing or unusable."""
    return F.when(F.col(c) >= LEAST_EVENT_MS, F.col(c))


def number(c: str = "reading") -> Column:
    """The reading, null where it is null or not-a-number."""
    return F.when(~F.isnan(F.col(c)), F.col(c))


def hour_of(ms: Column) -> Column:
    return ms - F.pmod(ms, F.lit(HOUR_MS))


def usable(measurements: DataFrame, *more: str) -> DataFrame:
    """Usable readings: (topic, sensor_name, ms, reading) and the columns ``more``.

    Rows without topic, sensor, event time or a number as reading are left out, at the scan.
    """
    return (
        measurements.filter((F.col("occurred_at_ms") >= LEAST_EVENT_MS) & F.col("sensor_name").isNotNull() & F.col("topic").isNotNull() & F.col("reading").isNotNull() & ~F.isnan("reading"))
        .select("topic", sensor().alias("sensor_name"), F.col("occurred_at_ms").alias("ms"), "reading", *more)
    )


def without_copies(measurements: DataFrame, keep_offset: bool = False) -> DataFrame:
    """Usable readings, each copy group once: (topic, sensor_name, ms, reading[, kafka_partition, kafka_offset]).

    A copy equals an earlier row of its topic and partition in sensor, event time and reading, so
    one row a group is what is left; ``keep_offset`` gives it the smallest offset.  A row without a
    partition has no copies and is none.  One hash aggregation, pre-aggregated before its shuffle;
    its key is nearly unique, so no group is hot.
    """
    u = usable(measurements, "kafka_partition", "kafka_offset")
    # a row without a partition is its own group
    own = F.when(F.col("kafka_partition").isNull(), F.col("kafka_offset"))
    if keep_offset:
        return u.groupBy("topic", "sensor_name", "ms", "reading", "kafka_partition", own.alias("_own")).agg(F.min("kafka_offset").alias("kafka_offset")).drop("_own")
    return u.select("topic", "sensor_name", "ms", "reading", "kafka_partition", own.alias("_own")).distinct().drop("kafka_partition", "_own")


def steps(df: DataFrame, first: Column, last: Column, step: int, name: str, block: int = 4096) -> DataFrame:
    """One row for each of the numbers ``first``, ``first`` + ``step``, ... up to ``last``, as the column ``name``.

    In two explosions, so that a far-off time that spans a huge gap makes many rows but no huge array: a gap may be ``block`` times the
    longest array long.
    """
    many = F.floor((last - first) / step)
    cut = df.select("*", first.alias("_first"), many.alias("_many")).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.floor(F.col("_many") / block), F.lit(0)))).alias("_block"))
    ends = F.least((F.col("_block") + 1) * block - 1, F.col("_many"))
    inner = F.sequence(F.col("_block") * block, F.greatest(ends, F.col("_block") * block))
    return cut.select("*", F.explode(inner).alias("_i")).withColumn(name, F.col("_first") + F.col("_i") * step).drop("_first", "_many", "_block", "_i")


def bounded(spark: SparkSession, small: DataFrame, most: int) -> DataFrame:
    """``small`` as a broadcast if it has at most ``most`` rows, else as it is, to be shuffled.

    At most ``most`` + 1 rows reach the driver.
    """
    rows = small.limit(most + 1).collect()
    if len(rows) > most:
        return small
    return F.broadcast(spark.createDataFrame(rows, small.schema))
