"""Processing only new or changed records: reread from the oldest open position, minus what is done.

:func:`unprocessed` takes the log itself as the ledger of what is done.  :class:`Ledger` keeps one between runs, so that the done part of
the log need not be read again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.series import DAY_MS, bounded, sensor

#: So many partitions of all topics may be broadcast; more are joined by a shuffle.
MOST_PARTITIONS = 100_000
LOG = ["topic", "kafka_partition"]
PAIR = [*LOG, "sensor_name", "occurred_at_ms", "reading"]
COLUMNS = [*LOG, "kafka_offset", "sensor_name", "occurred_at_ms", "reading", "msg_id"]


def committed_offsets(pipeline_runs: DataFrame, stream_reads: DataFrame, batch_reads: DataFrame) -> DataFrame:
    """(topic, kafka_partition, committed): the offset up to which each partition is done.

    A run counts if its status row with the latest ``updated_at`` says succeeded (spaces and case
    ignored; of rows updated at once, one that does not say so wins, so nothing is skipped).  A
    checkpoint counts for the partitions it lists with an offset and its reader was assigned.  The one
    with the highest (run_id, epoch) decides; of equal ones the lowest offset, so nothing is skipped.
    All three tables are small next to the log; repeated rows do not matter.
    """
    ok = F.lower(F.trim("run_status")) == "succeeded"
    runs = (
        pipeline_runs.filter(F.col("run_id").isNotNull())
        .groupBy("run_id")
        .agg(F.max(F.struct("updated_at", (~F.coalesce(ok, F.lit(False))).alias("open"))).alias("last"))
        .filter(~F.col("last.open"))
        .select("run_id")
    )
    readers = stream_reads.select("run_id", "channel_tag", "topic", F.explode("assigned_partitions").alias("kafka_partition")).distinct()
    points = batch_reads.select("run_id", "channel_tag", "epoch", F.explode("offsets_read").alias("kafka_partition", "offset")).filter(F.col("offset").isNotNull())
    best = F.max(F.struct("run_id", "epoch", (-F.col("offset")).alias("back"))).alias("best")
    return (
        points.join(runs, "run_id")
        .join(readers, ["run_id", "channel_tag", "kafka_partition"])
        .groupBy("topic", "kafka_partition")
        .agg(best)
        .select("topic", "kafka_partition", (-F.col("best.back")).alias("committed"))
    )


def _narrow(messages: DataFrame) -> DataFrame:
    return messages.select("msg_id", *LOG, "kafka_offset", sensor().alias("sensor_name"), "occurred_at_ms", "reading")


def _whole() -> Column:
    """Whether a row has a key and a version: without one it is never a copy."""
    return reduce(lambda a, c: a & F.col(c).isNotNull(), PAIR, ~F.isnan("reading"))


def _past(committed: str = "committed") -> Column:
    return F.col(committed).isNull() | (F.col("kafka_offset") > F.col(committed))


def _first(log: DataFrame) -> DataFrame:
    """Of each key and version the row of the smallest offset.  Pre-aggregated; the pair is nearly unique, so no group is hot."""
    return log.filter(_whole()).groupBy(*PAIR).agg(F.min("kafka_offset").alias("kafka_offset"), F.min_by("msg_id", "kafka_offset").alias("msg_id")).select(*COLUMNS)


def unprocessed(spark: SparkSession, messages: DataFrame, committed: DataFrame) -> DataFrame:
    """The messages past the committed offset of their topic and partition that are no copies.

    One aggregation pairs keys and versions (sensor and event time; reading) with their smallest offset.  A pair whose smallest
    offset is committed is in the ledger, and its copies past that offset are overlap; the others are new, with the row of that offset.
    The log moves once.  A row with a null in topic, partition, sensor, event time or reading, or not-a-number as reading, is no copy.

    Gives the columns topic, kafka_partition, kafka_offset, sensor_name, occurred_at_ms, reading and
    msg_id of ``messages``; an empty ``committed`` means that all is open.
    """
    log, marks = _narrow(messages), bounded(spark, committed, MOST_PARTITIONS)
    rows = _first(log).unionByName(log.filter(~F.coalesce(_whole(), F.lit(False))).select(*COLUMNS))
    return rows.join(marks, LOG, "left").filter(_past()).select(*COLUMNS)


class Ledger:
    """The keys and versions processed so far, and how far each run came, kept in a folder between runs.

    A run takes :meth:`fresh`, delivers it, then calls :meth:`commit`.  That writes the pairs of the run, then its offsets, each
    to a place of its own; a run counts only if its offsets are there.  So a run that fails at any point has done nothing, and what it
    wrote is overwritten when it is repeated under the same number.  Delivery must be idempotent or part of the same commit.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def _read(self, what: str, schema: str) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{what}")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{what}")

    def offsets(self) -> DataFrame:
        """(topic, kafka_partition, resume, upto): where the last run that came there has to be resumed, and how far it came."""
        rows = self._read("offsets", "topic string, kafka_partition int, resume long, upto long, run long")
        last = F.max(F.struct("run", "resume", "upto")).alias("last")
        return rows.groupBy(*LOG).agg(last).select(*LOG, "last.resume", "last.upto")

    def pairs(self) -> DataFrame:
        """What the runs that count have processed."""
        runs = self._read("offsets", "run long").select("run").distinct()
        rows = self._read("pairs", "topic string, kafka_partition int, sensor_name string, occurred_at_ms long, reading double, kafka_offset long, run long, day long")
        return rows.join(F.broadcast(runs), "run", "left_semi")

    def fresh(self, messages: DataFrame) -> DataFrame:
        """The messages that no run has processed: those past the offset where their partition is resumed, without copies among
        them, anti-joined with the ledger by key and version (rows without these by their offset).

        What lies before is dropped right after the scan, by a broadcast join with the offsets, so it is not shuffled; of the ledger
        only the days of the candidates are read.
        """
        marks = bounded(self.spark, self.offsets().select(*LOG, "resume"), MOST_PARTITIONS)
        log = _narrow(messages).join(marks, LOG, "left").filter(_past("resume"))  # partitions without an offset are read whole
        done = self.pairs()
        first = _first(log).withColumn("day", _day())
        days = bounded(self.spark, first.select("day").distinct(), MOST_PARTITIONS)
        new = first.join(done.join(days, "day", "left_semi").select(*PAIR), PAIR, "left_anti").select(*COLUMNS)
        odd = log.filter(~F.coalesce(_whole(), F.lit(False))).select(*COLUMNS)
        at = [*LOG, "kafka_offset"]
        return new.unionByName(odd.join(done.filter(F.col("day").isNull()).select(*at), at, "left_anti").select(*COLUMNS))

    def commit(self, run: int, fresh: DataFrame, upto: DataFrame, open_from: DataFrame | None = None) -> None:
        """Run number ``run`` has processed ``fresh`` and come to ``upto`` (topic, kafka_partition, upto).

        ``open_from`` (topic, kafka_partition, open_from) is the first offset of the oldest transaction still open, where there is one: the
        next run rereads from there."""
        whole = F.coalesce(_whole(), F.lit(False))
        rows = fresh.select(*PAIR, "kafka_offset", F.when(whole, _day()).alias("day"))
        rows.write.mode("overwrite").partitionBy("day").parquet(f"{self.folder}/pairs/run={run}")
        ends = upto.select(*LOG, "upto")
        ends = ends.withColumn("resume", F.col("upto")) if open_from is None else ends.join(open_from, LOG, "left").withColumn("resume", F.least("upto", F.col("open_from") - 1))
        ends.select(*LOG, "resume", "upto").coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/offsets/run={run}")


def _day() -> Column:
    return F.floor(F.col("occurred_at_ms") / DAY_MS).cast("long")
