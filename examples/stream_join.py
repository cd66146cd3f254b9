"""Means of temperature and humidity of each sensor and second side by side."""

from pyspark.sql import SparkSession

from millrace import Context, col
from millrace import functions as F
from millrace.sources.synthetic import measurements

SAMPLE = '{"occurred_at_ms": 100, "sensor_name": "foo", "reading": 0.0}'

if __name__ == "__main__":
    spark = SparkSession.builder.master("local[2]").config("spark.sql.session.timeZone", "UTC").config("spark.sql.shuffle.partitions", "2").getOrCreate()
    ctx = Context(spark)

    def means(topic, name):
        m = measurements(spark).filter(f"topic = '{topic}'")
        return ctx.from_topic(topic, SAMPLE, "localhost:9092", "occurred_at_ms", messages=m).window(["sensor_name"], [F.avg(col("reading")).alias(name)], 1000)

    h = means("humidity", "humidity")
    for c in ("sensor_name", "window_start_time", "window_end_time"):
        h = h.with_column_renamed(c, f"h_{c}")
    keys = ["sensor_name", "window_start_time", "window_end_time"]
    try:
        means("temperature", "temperature").join(h, "inner", keys, [f"h_{k}" for k in keys]).select(["sensor_name", "temperature", "humidity", "window_start_time"]).print_stream()
    finally:
        ctx.shutdown()
