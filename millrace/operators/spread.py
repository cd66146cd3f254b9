"""Using all cores where a table comes in few pieces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def spread(spark: SparkSession, scan: DataFrame) -> DataFrame:
    """``scan`` over as many partitions as there are cores, if it has no more than half as many.

    For steps that take far longer than moving their rows.  A table of many files, as any large one, is left as it is.
    """
    cores = spark.sparkContext.defaultParallelism
    return scan.repartition(cores) if 2 * scan.rdd.getNumPartitions() <= cores else scan
