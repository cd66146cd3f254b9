"""Made-up measurements, for trying streams without a broker."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def measurements(spark: SparkSession, rows_per_second: int = 100, sensors: int = 10, seed: int = 0) -> DataFrame:
    """A stream of (topic, value, timestamp): JSON messages of ``sensors`` sensors, two in five of them temperatures (0 to 115),
    the others humidities (0 to 1)."""
    s = spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load()
    u = [F.pmod(F.xxhash64("value", F.lit(seed + i)), F.lit(1_000_000)) / 1_000_000 for i in range(3)]
    topic = F.when(u[0] < 0.4, F.lit("temperature")).otherwise(F.lit("humidity"))
    reading = F.when(u[0] < 0.4, u[1] * 115).otherwise(u[1])
    body = F.to_json(F.struct(F.unix_millis("timestamp").alias("occurred_at_ms"), F.concat(F.lit("sensor_"), F.floor(u[2] * sensors).cast("string")).alias("sensor_name"), reading.alias("reading")))
    return s.select(topic.alias("topic"), body.cast("binary").alias("value"), "timestamp")
