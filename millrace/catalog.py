"""Names of what a session holds."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame as SparkDataFrame
from pyspark.sql import SparkSession
from pyspark.sql.pandas.types import to_arrow_schema


class Table:
    """A table of a database."""

    def __init__(self, df: SparkDataFrame, kind: str = "view") -> None:
        self.df, self._kind = df, kind

    def schema(self) -> pa.Schema:
        return to_arrow_schema(self.df.schema)

    def kind(self) -> str:
        return self._kind


class Database:
    """The tables of a database; ``public`` is the default one."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self._spark, self._name = spark, "default" if name == "public" else name

    def names(self) -> set[str]:
        return {t.name for t in self._spark.catalog.listTables(self._name)}

    def table(self, name: str) -> Table:
        for t in self._spark.catalog.listTables(self._name):
            if t.name == name:
                full = name if t.isTemporary else f"{self._name}.{name}"
                return Table(self._spark.table(full), t.tableType.lower())
        raise KeyError(f"no table {name} in {self._name}")


class Catalog:
    """The databases of a session."""

    def __init__(self, spark: SparkSession) -> None:
        self._spark = spark

    def names(self) -> list[str]:
        return [d.name for d in self._spark.catalog.listDatabases()]

    def database(self, name: str = "public") -> Database:
        return Database(self._spark, name)
