"""Queries that run as streams: a table is replayed as files, in several runs that go on from one checkpoint, and compared with SQL.

Each is fed the whole table first, then, in a run of its own after a restart, one event far in the future, which closes the windows, and at last the
whole table again, now late.  States are in RocksDB.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as S

from millrace import functions as F
from millrace.context import Context
from millrace.expr import col
from millrace.operators.lineage import shared_folder
from millrace.plans.engine_queries import _DAYW, _END, DAY, HOUR, keeper, r6
from millrace.plans.tables import table
from millrace.sources.timeunits import MILLIS
from millrace.stream import DataStream
from millrace.streaming.kslack import kslack

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
query = keeper(QUERIES, SQL)
#: The lateness allowed, beyond any table's span, so that files may come in any order, and the last event, in ms, beyond that.
LATENESS, LAST = "4000 days", 4_000_000_000_000


def replayed(spark: SparkSession, data: DataFrame, make: Callable[[Context, str, str], DataFrame], last: DataFrame) -> DataFrame:
    """What the stream that ``make`` builds of a context, a folder and its schema has put out after all runs."""
    place = f"{shared_folder(spark)}/replay-{uuid.uuid4().hex}"
    setting = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(setting, None)
    ctx = Context(spark).with_checkpoint(f"{place}/checkpoint", rocksdb=True)
    try:
        for rows in (data.repartition(2), last, data.repartition(1)):
            rows.write.mode("append").parquet(f"{place}/in")
            out = make(ctx, f"{place}/in", data.schema)
            q = out.writeStream.format("parquet").option("checkpointLocation", f"{place}/checkpoint").option("path", f"{place}/out").outputMode("append").trigger(availableNow=True).start()
            q.awaitTermination()
    finally:
        spark.conf.unset(setting) if before is None else spark.conf.set(setting, before)
    return spark.read.schema(out.schema).parquet(f"{place}/out")


def _events(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    data = table(spark, d, "events").select("event_id", S.unix_millis(S.col("ts").cast("timestamp")).alias("ms"), "event_type", "value")
    return data, spark.createDataFrame([(-1, LAST, "end", None)], data.schema)


def _windows(spark: SparkSession, d: str, window: Callable[[DataStream], DataStream]) -> DataFrame:
    data, last = _events(spark, d)
    out = replayed(spark, data, lambda c, folder, schema: window(c.from_files(folder, schema, "ms", MILLIS, "parquet", 1, LATENESS)).visible, last)
    return out.select(*[S.col(c).cast("timestamp_ntz").alias(c) if k == "timestamp" else S.col(c) for c, k in out.dtypes])


@query(f"SELECT event_type, count(value) AS n, min(value) AS lo, max(value) AS hi, round(avg(value), 6) AS mean, {_DAYW} AS window_start_time, {_DAYW} {_END} AS window_end_time FROM events GROUP BY ALL")
def stream_tumbling(spark, d):
    aggs = [F.count(col("value")).alias("n"), F.min(col("value")).alias("lo"), F.max(col("value")).alias("hi"), F.avg(col("value")).alias("mean")]
    return _windows(spark, d, lambda s: s.window([col("event_type")], aggs, DAY).with_column("mean", F.round(col("mean"), 6)))


@query(f"""SELECT event_type, count(*) AS n, max(value) AS hi, s AS window_start_time, s {_END} AS window_end_time
FROM (SELECT *, make_timestamp(((epoch_ms(ts) // 43200000) - i) * 43200000 * 1000) AS s FROM events, generate_series(0, 1) AS g(i)) GROUP BY ALL HAVING max(value) > 60""")
def stream_sliding_having(spark, d):
    return _windows(spark, d, lambda s: s.window(["event_type"], [F.count_star().alias("n"), F.max(col("value")).alias("hi")], DAY, 12 * HOUR).filter(col("hi") > 60))


@query(f"""WITH c AS (SELECT count(*) AS clicks, {_DAYW} AS w FROM events WHERE event_type = 'click' GROUP BY w), p AS (SELECT round(avg(value), 6) AS spent, {_DAYW} AS w FROM events WHERE event_type = 'purchase' GROUP BY w)
SELECT clicks, spent, c.w AS window_start_time FROM c JOIN p ON c.w = p.w""")
def stream_window_join(spark, d):
    def window(s: DataStream) -> DataStream:
        clicks = s.filter(col("event_type") == "click").window([], [F.count_star().alias("clicks")], DAY)
        buys = s.filter(col("event_type") == "purchase").window([], [F.avg(col("value")).alias("spent")], DAY).with_column_renamed("window_start_time", "s").with_column_renamed("window_end_time", "e")
        return clicks.join(buys, "inner", ["window_start_time", "window_end_time"], ["s", "e"]).select(["clicks", r6(col("spent"), "spent"), "window_start_time"])

    data, last = _events(spark, d)
    both = last.unionByName(last.withColumn("event_type", S.lit("click"))).unionByName(last.withColumn("event_type", S.lit("purchase")))
    out = replayed(spark, data, lambda c, folder, schema: window(c.from_files(folder, schema, "ms", MILLIS, "parquet", 1, LATENESS)).visible, both)
    return out.withColumn("window_start_time", S.col("window_start_time").cast("timestamp_ntz"))


_ORDER = "(PARTITION BY event_type, epoch_ms(ts) // 86400000 ORDER BY epoch_ms(ts), value)"


@query(f"""SELECT event_type, w AS window_start_ms, count(*) AS n, round(sum(value), 4) AS total, arg_min(value, (ms, value)) AS first, arg_max(value, (ms, value)) AS last, coalesce(max(greatest(value - before, 0)), 0) AS rise
FROM (SELECT event_type, value, epoch_ms(ts) AS ms, epoch_ms(ts) // 86400000 * 86400000 AS w, lag(value) OVER {_ORDER} AS before FROM events WHERE value IS NOT NULL) GROUP BY event_type, w""")
def stream_kslack(spark, d):
    """Daily aggregates that depend on the order of events, released by the K-slack buffer."""

    def make(c: Context, folder: str, schema) -> DataFrame:
        raw = c.spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
        return kslack(raw.withColumn("at", S.timestamp_millis("ms")), ["event_type"], "at", "value", DAY, LATENESS)

    data, last = _events(spark, d)
    out = replayed(spark, data, make, last.withColumn("value", S.lit(0.0)))
    return out.filter(S.col("kind") == "final").drop("kind").withColumn("total", S.round("total", 4))

