"""Aggregates of made-up temperatures over windows of a second, printed as they close.  Stop with Ctrl-C."""

from pyspark.sql import SparkSession

from millrace import Context, col
from millrace import functions as F
from millrace.sources.synthetic import measurements

SAMPLE = '{"occurred_at_ms": 100, "sensor_name": "foo", "reading": 0.0}'

if __name__ == "__main__":
    spark = SparkSession.builder.master("local[2]").config("spark.sql.session.timeZone", "UTC").config("spark.sql.shuffle.partitions", "2").getOrCreate()
    ctx = Context(spark)
    messages = measurements(spark).filter("topic = 'temperature'")
    try:
        ctx.from_topic("temperature", SAMPLE, "localhost:9092", "occurred_at_ms", messages=messages).window(
            [col("sensor_name")],
            [F.count(col("reading")).alias("n"), F.min(col("reading")).alias("lo"), F.max(col("reading")).alias("hi"), F.median(col("reading")).alias("median"), F.stddev(col("reading")).alias("sd")],
            1000,
        ).filter(col("hi") > 100).print_stream()
    finally:
        ctx.shutdown()
