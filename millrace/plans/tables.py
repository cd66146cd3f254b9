"""Reading the tables of a directory of Parquet files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name``: a Parquet file or a folder of them.  Filters and columns are pushed to the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
