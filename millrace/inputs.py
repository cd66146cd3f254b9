"""Inputs that a session can make tables of."""

from __future__ import annotations

from abc import ABC, abstractmethod
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame as SparkDataFrame
from pyspark.sql import SparkSession


class BaseInputSource(ABC):
    """Tells whether it can make a table of something, and makes it."""

    @abstractmethod
    def is_correct_input(self, input_item: Any, table_name: str, **kwargs: Any) -> bool: ...

    @abstractmethod
    def build_table(self, input_item: Any, table_name: str, **kwargs: Any) -> Any: ...


class LocationInputPlugin(BaseInputSource):
    """Tables of files, by their extension."""

    FORMATS = {".parquet": "parquet", ".json": "json", ".orc": "orc", ".csv": "csv"}

    def __init__(self, spark: SparkSession) -> None:
        self._spark = spark

    def is_correct_input(self, input_item: Any, table_name: str, **kwargs: Any) -> bool:
        return isinstance(input_item, str)

    def build_table(self, input_item: str, table_name: str, **kwargs: Any) -> SparkDataFrame:
        kind = self.FORMATS.get(Path(input_item).suffix.lower())
        if kind is None:
            raise RuntimeError(f"unsupported input: {input_item}")
        r = self._spark.read.format(kind)
        return (r.option("header", True).option("inferSchema", True) if kind == "csv" else r).load(input_item)
