import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


MEASUREMENTS = "msg_id long, topic string, kafka_partition int, kafka_offset long, kafka_timestamp timestamp, occurred_at_ms long, sensor_name string, reading double"


@pytest.fixture
def measurements(spark):
    """Makes the table of rows (topic, partition, offset, ms, sensor, reading), with columns that no operator should stumble over."""
    import datetime

    def make(rows):
        t0 = datetime.datetime(2009, 1, 1, tzinfo=datetime.UTC)
        full = [(i, t, p, o, t0 + datetime.timedelta(seconds=i), ms, s, r) for i, (t, p, o, ms, s, r) in enumerate(rows)]
        df = spark.createDataFrame(full, MEASUREMENTS)
        from pyspark.sql import functions as F

        # names that operators use inside
        return df.withColumn("ms", F.lit("x")).withColumn("hour", F.lit(None).cast("string")).withColumn("wm", F.lit(1)).withColumn("day", F.lit(0)).withColumn("shard", F.lit("s")).withColumn("bucket", F.lit(1.5))

    return make
