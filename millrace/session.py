"""Sessions for tables and SQL."""

from __future__ import annotations

import re
import uuid
import warnings
from collections.abc import Sequence
from typing import Any

import pyarrow as pa
import pyarrow.dataset
from pyspark.sql import DataFrame as SparkDataFrame
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_schema

from millrace.catalog import Catalog, Table
from millrace.expr import to_sort
from millrace.frame import DataFrame
from millrace.inputs import LocationInputPlugin
from millrace.udf import AggregateUDF, ScalarUDF


class SessionConfig:
    """Settings, each given as the Spark setting it comes to.  Those that Spark decides by itself are kept but have no effect."""

    def __init__(self, config_options: dict[str, str] | None = None) -> None:
        self.options: dict[str, str] = dict(config_options or {})
        self.default_catalog_and_schema: tuple[str, str] | None = None

    def set(self, key: str, value: Any) -> SessionConfig:
        self.options[key] = str(value).lower() if isinstance(value, bool) else str(value)
        return self

    def with_create_default_catalog_and_schema(self, enabled: bool = True) -> SessionConfig:
        return self  # there always is one

    def with_default_catalog_and_schema(self, catalog: str, schema: str) -> SessionConfig:
        self.default_catalog_and_schema = (catalog, schema)
        return self

    def with_information_schema(self, enabled: bool = True) -> SessionConfig:
        return self  # the catalog answers instead

    def with_batch_size(self, batch_size: int) -> SessionConfig:
        return self.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch_size).set("spark.sql.parquet.columnarReaderBatchSize", batch_size)

    def with_target_partitions(self, target_partitions: int) -> SessionConfig:
        return self.set("spark.sql.shuffle.partitions", target_partitions)

    def with_repartition_aggregations(self, enabled: bool = True) -> SessionConfig:
        return self

    def with_repartition_joins(self, enabled: bool = True) -> SessionConfig:
        return self

    def with_repartition_windows(self, enabled: bool = True) -> SessionConfig:
        return self

    def with_repartition_sorts(self, enabled: bool = True) -> SessionConfig:
        return self

    def with_repartition_file_scans(self, enabled: bool = True) -> SessionConfig:
        return self if enabled else self.set("spark.sql.files.maxPartitionBytes", 1 << 40)

    def with_repartition_file_min_size(self, size: int) -> SessionConfig:
        return self.set("spark.sql.files.maxPartitionBytes", size)

    def with_parquet_pruning(self, enabled: bool = True) -> SessionConfig:
        return self.set("spark.sql.parquet.filterPushdown", enabled)


class RuntimeConfig:
    """Where and how much may be spilled: settings of a session that is still to be made."""

    def __init__(self) -> None:
        self.options: dict[str, str] = {}

    def with_disk_manager_disabled(self) -> RuntimeConfig:
        warnings.warn("Spark always may spill; the disk stays in use", stacklevel=2)
        return self

    def with_disk_manager_os(self) -> RuntimeConfig:
        self.options.pop("spark.local.dir", None)
        return self

    def with_disk_manager_specified(self, *paths: Any) -> RuntimeConfig:
        self.options["spark.local.dir"] = ",".join(map(str, paths))
        return self

    def with_unbounded_memory_pool(self) -> RuntimeConfig:
        return self

    def with_fair_spill_pool(self, size: int) -> RuntimeConfig:
        """A pool of ``size`` bytes beside the heap, which sorts, joins and aggregates share and spill beyond."""
        self.options |= {"spark.memory.offHeap.enabled": "true", "spark.memory.offHeap.size": str(size)}
        return self

    def with_greedy_memory_pool(self, size: int) -> RuntimeConfig:
        return self.with_fair_spill_pool(size)

    def with_temp_file_path(self, path: Any) -> RuntimeConfig:
        return self.with_disk_manager_specified(path)


class SQLOptions:
    """Which kinds of statements may be run."""

    def __init__(self) -> None:
        self.ddl = self.dml = self.statements = True

    def with_allow_ddl(self, allow: bool = True) -> SQLOptions:
        self.ddl = allow
        return self

    def with_allow_dml(self, allow: bool = True) -> SQLOptions:
        self.dml = allow
        return self

    def with_allow_statements(self, allow: bool = True) -> SQLOptions:
        self.statements = allow
        return self

    def check(self, spark: SparkSession, query: str) -> None:
        """Raises ValueError if the parsed statement is of a kind that is not allowed."""
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(query)
        kind = plan.getClass().getSimpleName()
        if re.search(r"Insert|Update|Delete|Merge", kind):
            if not self.dml:
                raise ValueError(f"DML is not allowed: {kind}")
        elif re.match(r"(Create|Drop|Alter|Rename|Truncate|Replace|Repair|Recover)", kind) or kind.endswith(("CreateTable", "DropTable")):
            if not self.ddl:
                raise ValueError(f"DDL is not allowed: {kind}")
        elif re.search(r"Command|SetVariable|CreateVariable", kind) and not self.statements:
            raise ValueError(f"statements are not allowed: {kind}")


class SessionContext:
    """Reads, registers and queries tables, over one Spark session."""

    def __init__(self, config: SessionConfig | None = None, runtime: RuntimeConfig | None = None, spark: SparkSession | None = None) -> None:
        if spark is None:
            b = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
            for k, v in (runtime.options if runtime else {}).items():
                b = b.config(k, v)
            spark = b.getOrCreate()
        self.spark = spark
        self._id = str(uuid.uuid4())
        for k, v in (config.options if config else {}).items():
            spark.conf.set(k, v)
        if config and config.default_catalog_and_schema:
            spark.catalog.setCurrentDatabase("default" if config.default_catalog_and_schema[1] == "public" else config.default_catalog_and_schema[1])

    # SQL
    def sql(self, query: str, options: SQLOptions | None = None) -> DataFrame:
        if options is not None:
            options.check(self.spark, query)
        return DataFrame(self.spark.sql(query))

    def sql_with_options(self, query: str, options: SQLOptions) -> DataFrame:
        return self.sql(query, options)

    # tables from memory
    def _named(self, df: SparkDataFrame, name: str | None) -> DataFrame:
        if name:
            df.createOrReplaceTempView(name)
        return DataFrame(df)

    def create_dataframe(self, partitions: list[list[pa.RecordBatch]], name: str | None = None, schema: pa.Schema | None = None) -> DataFrame:
        batches = [b for p in partitions for b in p]
        return self._named(self.spark.createDataFrame(pa.Table.from_batches(batches, schema)), name)

    def create_dataframe_from_logical_plan(self, plan: DataFrame | SparkDataFrame) -> DataFrame:
        """A table of a plan, which here is the lazy table itself."""
        return DataFrame(plan.df if isinstance(plan, DataFrame) else plan)

    def from_pylist(self, data: list[dict[str, Any]], name: str | None = None) -> DataFrame:
        return self.from_arrow(pa.Table.from_pylist(data), name)

    def from_pydict(self, data: dict[str, list[Any]], name: str | None = None) -> DataFrame:
        return self.from_arrow(pa.Table.from_pydict(data), name)

    def from_arrow(self, data: Any, name: str | None = None) -> DataFrame:
        if isinstance(data, pa.RecordBatch):
            data = pa.Table.from_batches([data])
        elif not isinstance(data, pa.Table):
            data = pa.RecordBatchReader.from_stream(data).read_all() if hasattr(data, "__arrow_c_stream__") else pa.table(data)
        return self._named(self.spark.createDataFrame(data), name)

    from_arrow_table = from_arrow

    def from_pandas(self, data: Any, name: str | None = None) -> DataFrame:
        return self._named(self.spark.createDataFrame(data), name)

    def from_polars(self, data: Any, name: str | None = None) -> DataFrame:
        return self.from_arrow(data.to_arrow(), name)

    def empty_table(self) -> DataFrame:
        return DataFrame(self.spark.createDataFrame([], T.StructType([])))

    # the catalog
    def register_table(self, name: str, table: Any) -> None:
        df = table.df if hasattr(table, "df") else LocationInputPlugin(self.spark).build_table(table, name) if isinstance(table, str) else table
        df.createOrReplaceTempView(name)

    def deregister_table(self, name: str) -> None:
        self.spark.catalog.dropTempView(name)

    def register_record_batches(self, name: str, partitions: list[list[pa.RecordBatch]]) -> None:
        self.create_dataframe(partitions, name)

    def register_dataset(self, name: str, dataset: pa.dataset.Dataset) -> None:
        """A dataset of files is read by Spark from its files; any other is taken into memory."""
        files = getattr(dataset, "files", None)
        if files and dataset.format.default_extname in ("parquet", "orc", "csv"):
            r = self.spark.read.schema(from_arrow_schema(dataset.schema)).option("header", True)
            r.format(dataset.format.default_extname).load(list(files)).createOrReplaceTempView(name)
        else:
            self.spark.createDataFrame(dataset.to_table()).createOrReplaceTempView(name)

    def register_udf(self, udf: ScalarUDF) -> None:
        self.spark.udf.register(udf.name, udf.spark)

    def register_udaf(self, udaf: AggregateUDF) -> None:
        """Makes the function callable in SQL.  There it runs over the collected rows of each group; called in ``aggregate`` it runs in
        two stages and holds no group as a whole."""
        import pandas as pd
        from pyspark.sql import functions as F

        from millrace.udf import _arrow, _plain, spark_type

        def run(*cols):
            acc = udaf.accumulator()
            acc.update(*[pa.array(c, _arrow(t), from_pandas=True) for c, t in zip(cols, udaf.input_types)])
            return _plain(acc.evaluate())

        n = len(udaf.input_types)
        scope: dict[str, Any] = {"pd": pd, "run": run}
        kind = {"double": "float", "bigint": "int", "string": "str", "boolean": "bool"}.get(spark_type(udaf.return_type).simpleString(), "float")
        exec(f"def call({', '.join(f'a{i}: pd.Series' for i in range(n))}) -> {kind}:\n    return run({', '.join(f'a{i}' for i in range(n))})", scope)  # noqa: S102
        self.spark.udf.register(udaf.name, F.pandas_udf(scope["call"], spark_type(udaf.return_type)))

    def register_object_store(self, schema: str, store: Any, host: str | None = None) -> None:
        """Hands the settings of ``store`` to the file systems of Spark."""
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for k, v in store.settings(host).items():
            conf.set(k, v)

    def catalog(self, name: str = "default") -> Catalog:
        return Catalog(self.spark)

    def tables(self) -> set[str]:
        return {t.name for t in self.spark.catalog.listTables()}

    def table(self, name: str) -> DataFrame:
        return DataFrame(self.spark.table(name))

    def table_exist(self, name: str) -> bool:
        return self.spark.catalog.tableExists(name)

    def read_table(self, table: Table | str) -> DataFrame:
        return DataFrame(self.spark.table(table) if isinstance(table, str) else table.df)

    def session_id(self) -> str:
        return self._id

    def execute(self, plan: DataFrame, partitions: int = 0) -> Any:
        """The batches of one partition of ``plan``; those of the others stay where they are."""
        return plan.partition(partitions)

    # files
    def _read(self, kind: str, path: Any, schema: pa.Schema | None, extension: str | None, partition_cols: Sequence[Any] | None, options: dict[str, Any], sort_order: Sequence[Any] | None = None) -> SparkDataFrame:
        r = self.spark.read.format(kind)
        if schema is not None:
            fields = from_arrow_schema(schema)
            for name, arrow_type in partition_cols or []:
                if name not in fields.names:
                    fields = fields.add(name, from_arrow_schema(pa.schema([(name, arrow_type if isinstance(arrow_type, pa.DataType) else pa.string())]))[0].dataType)
            r = r.schema(fields)
        if extension:
            r = r.option("pathGlobFilter", f"*{extension}*") if "*" not in str(path) and not str(path).endswith(extension) else r
        df = r.options(**{k: v for k, v in options.items() if v is not None}).load([str(p) for p in path] if isinstance(path, (list, tuple)) else str(path))
        return df.sortWithinPartitions(*[to_sort(s) for s in sort_order]) if sort_order else df

    def read_json(self, path: Any, schema: pa.Schema | None = None, schema_infer_max_records: int = 1000, file_extension: str = ".json", table_partition_cols: Sequence[Any] | None = None, file_compression_type: str | None = None) -> DataFrame:
        return DataFrame(self._read("json", path, schema, file_extension, table_partition_cols, {}))

    def read_csv(self, path: Any, schema: pa.Schema | None = None, has_header: bool = True, delimiter: str = ",", schema_infer_max_records: int = 1000, file_extension: str = ".csv", table_partition_cols: Sequence[Any] | None = None, file_compression_type: str | None = None) -> DataFrame:
        return DataFrame(self._read("csv", path, schema, file_extension, table_partition_cols, {"header": has_header, "sep": delimiter, "inferSchema": schema is None}))

    def read_parquet(self, path: Any, table_partition_cols: Sequence[Any] | None = None, parquet_pruning: bool = True, file_extension: str = ".parquet", skip_metadata: bool = True, schema: pa.Schema | None = None, file_sort_order: Sequence[Any] | None = None) -> DataFrame:
        return DataFrame(self._read("parquet", path, schema, file_extension, table_partition_cols, {"mergeSchema": not skip_metadata}, file_sort_order))

    def read_avro(self, path: Any, schema: pa.Schema | None = None, file_partition_cols: Sequence[Any] | None = None, file_extension: str = ".avro") -> DataFrame:
        """Needs Spark's Avro package."""
        return DataFrame(self._read("avro", path, schema, file_extension, file_partition_cols, {}))

    def register_parquet(self, name: str, path: Any, *args: Any, **kw: Any) -> None:
        """As :meth:`read_parquet`, under a name."""
        self.register_table(name, self.read_parquet(path, *args, **kw))

    def register_csv(self, name: str, path: Any, *args: Any, **kw: Any) -> None:
        """As :meth:`read_csv`, under a name."""
        self.register_table(name, self.read_csv(path, *args, **kw))

    def register_json(self, name: str, path: Any, *args: Any, **kw: Any) -> None:
        """As :meth:`read_json`, under a name."""
        self.register_table(name, self.read_json(path, *args, **kw))

    def register_avro(self, name: str, path: Any, schema: pa.Schema | None = None, file_extension: str = ".avro", table_partition_cols: Sequence[Any] | None = None) -> None:
        self.register_table(name, self.read_avro(path, schema, table_partition_cols, file_extension))

    def register_listing_table(self, name: str, path: Any, table_partition_cols: Sequence[Any] | None = None, file_extension: str = ".parquet", schema: pa.Schema | None = None, file_sort_order: Sequence[Any] | None = None) -> None:
        self.register_table(name, DataFrame(self._read(file_extension.lstrip("."), path, schema, file_extension, table_partition_cols, {}, file_sort_order)))
