"""The batch table interface: a bounded relation with immutable, lazy transformations."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame as SparkDataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from millrace.expr import Expr, ExprFuncBuilder, grouped_frames, to_column, to_named, to_sort
from millrace.record_batch import RecordBatchStream
from millrace.udf import UDAFCall, aggregate_with_udafs

#: Names of join types and Spark's.
JOINS = {"inner": "inner", "left": "left", "right": "right", "full": "full", "semi": "left_semi", "anti": "left_anti"}


def aggregated(df: SparkDataFrame, group_by: Sequence[Any], aggs: Sequence[Any]) -> SparkDataFrame:
    """Groups by ``group_by``; built-in and user-defined aggregates may stand side by side."""
    keys = [to_named(k) for k in group_by]
    own = [a for a in aggs if isinstance(a, UDAFCall)]
    rest = [to_column(a) for a in aggs if not isinstance(a, UDAFCall)]
    if not own:
        return df.groupBy(*keys).agg(*rest) if rest else df.select(*keys).distinct()
    made = aggregate_with_udafs(df, keys, own)
    if not rest:
        return made
    base = df.groupBy(*keys).agg(*rest)
    n = len(keys)
    if not n:
        return base.crossJoin(F.broadcast(made))  # one row each
    a, b = base.toDF(*[f"a{i}" for i in range(len(base.columns))]), made.toDF(*[f"b{i}" for i in range(len(made.columns))])
    cond = F.lit(True)
    for i in range(n):
        cond = cond & a[f"a{i}"].eqNullSafe(b[f"b{i}"])
    j = a.join(b, cond)
    order = [f"a{i}" for i in range(n)]
    names = list(base.columns[:n])
    plain, mine = iter(range(n, len(base.columns))), iter(range(n, len(made.columns)))
    for x in aggs:
        i = next(mine) if isinstance(x, UDAFCall) else next(plain)
        order.append(f"b{i}" if isinstance(x, UDAFCall) else f"a{i}")
        names.append(made.columns[i] if isinstance(x, UDAFCall) else base.columns[i])
    return j.select(*order).toDF(*names)


class DataFrame:
    """Wraps a Spark DataFrame; every method leaves it as it is."""

    def __init__(self, df: SparkDataFrame) -> None:
        self.df = df

    def _new(self, df: SparkDataFrame) -> DataFrame:
        return type(self)(df)

    def __getitem__(self, key: str | list[str]) -> DataFrame:
        return self._new(self.df.select(*([key] if isinstance(key, str) else key)))

    def __repr__(self) -> str:
        return self.df._show_string(20, True, False)

    def _repr_html_(self) -> str:
        return self.df.limit(20).toPandas().to_html()

    def describe(self) -> DataFrame:
        return self._new(self.df.describe())

    def schema(self) -> pa.Schema:
        return to_arrow_schema(self.df.schema)

    def select_columns(self, *args: str) -> DataFrame:
        return self._new(self.df.select(*[F.col(a) for a in args]))

    def select(self, *exprs: Any) -> DataFrame:
        added, rest = grouped_frames(exprs)
        base = self.df
        for name, c in added:
            base = base.withColumn(name, c)
        return self._new(base.select(*[to_named(e) for e in rest]))

    def filter(self, *predicates: Any) -> DataFrame:
        df = self.df
        for p in predicates:
            df = df.filter(to_column(p))
        return self._new(df)

    def with_column(self, name: str, expr: Any) -> DataFrame:
        added, (one,) = grouped_frames([expr])
        df = self.df
        for n, c in added:
            df = df.withColumn(n, c)
        return self._new(df.withColumn(name, to_column(one)).drop(*[n for n, _ in added]))

    def with_column_renamed(self, old_name: str, new_name: str) -> DataFrame:
        return self._new(self.df.withColumnRenamed(old_name, new_name))

    def aggregate(self, group_by: Sequence[Any] | Any, aggs: Sequence[Any] | Any) -> DataFrame:
        one = (str, Expr, ExprFuncBuilder, UDAFCall)
        groups = [group_by] if isinstance(group_by, one) else list(group_by or [])
        return self._new(aggregated(self.df, groups, [aggs] if isinstance(aggs, one) else list(aggs)))

    def sort(self, *exprs: Any) -> DataFrame:
        return self._new(self.df.orderBy(*[to_sort(e) for e in exprs]))

    def limit(self, count: int, offset: int = 0) -> DataFrame:
        return self._new((self.df.offset(offset) if offset else self.df).limit(count))

    def collect(self) -> list[pa.RecordBatch]:
        return self.df.toArrow().to_batches()

    def cache(self) -> DataFrame:
        return self._new(self.df.cache())

    def collect_partitioned(self) -> list[list[pa.RecordBatch]]:
        """The batches of each partition; like :meth:`collect` for results that fit the driver."""
        t = self.df.withColumn("_partition", F.spark_partition_id()).toArrow()
        at = t["_partition"].to_pylist()
        data = t.drop_columns(["_partition"])
        return [data.take([i for i, p in enumerate(at) if p == k]).to_batches() for k in sorted(set(at))]

    def show(self, num: int = 20) -> None:
        self.df.show(num)

    def distinct(self) -> DataFrame:
        return self._new(self.df.distinct())

    def join(self, right: DataFrame, join_keys: tuple[Sequence[str], Sequence[str]], how: str = "inner") -> DataFrame:
        """Joins on pairs of key columns; keys of the same name stay apart, as columns of either side."""
        if how not in JOINS:
            raise ValueError(f"unknown join type {how}: one of {', '.join(JOINS)}")
        left_keys, right_keys = ([k] if isinstance(k, str) else list(k) for k in join_keys)
        if len(left_keys) != len(right_keys):
            raise ValueError("as many keys on the left as on the right are needed")
        l, r = self.df.alias("_l"), right.df.alias("_r")
        cond = [F.col(f"_l.{a}") == F.col(f"_r.{b}") for a, b in zip(left_keys, right_keys)]
        return self._new(l.join(r, cond, JOINS[how]))

    def cross_join(self, right: DataFrame) -> DataFrame:
        return self._new(self.df.crossJoin(right.df))

    def explain(self, verbose: bool = False, analyze: bool = False) -> None:
        """Prints the plan; ``analyze`` runs it first, so that the plan is the adapted one."""
        if analyze:
            self.df.write.format("noop").mode("overwrite").save()
        self.df.explain("extended" if verbose else "formatted")

    def _plan(self, kind: str) -> str:
        return getattr(self.df._jdf.queryExecution(), kind)().toString()

    def logical_plan(self) -> str:
        return self._plan("logical")

    def optimized_logical_plan(self) -> str:
        return self._plan("optimizedPlan")

    def execution_plan(self) -> str:
        return self._plan("executedPlan")

    def repartition(self, num: int) -> DataFrame:
        return self._new(self.df.repartition(num))

    def repartition_by_hash(self, *exprs: Any, num: int) -> DataFrame:
        return self._new(self.df.repartition(num, *[to_named(e) for e in exprs]))

    def union(self, other: DataFrame, distinct: bool = False) -> DataFrame:
        u = self.df.union(other.df)
        return self._new(u.distinct() if distinct else u)

    def union_distinct(self, other: DataFrame) -> DataFrame:
        return self.union(other, distinct=True)

    def intersect(self, other: DataFrame) -> DataFrame:
        return self._new(self.df.intersect(other.df))

    def except_all(self, other: DataFrame) -> DataFrame:
        return self._new(self.df.exceptAll(other.df))

    def write_csv(self, path: str, with_header: bool = False) -> None:
        self.df.write.option("header", with_header).csv(str(path))

    def write_parquet(self, path: str, compression: str = "snappy", compression_level: int | None = None) -> None:
        w = self.df.write.option("compression", "none" if compression == "uncompressed" else compression)
        if compression_level is not None:
            w = w.option(f"parquet.compression.codec.{compression}.level", compression_level)
        w.parquet(str(path))

    def write_json(self, path: str) -> None:
        self.df.write.json(str(path))

    def to_arrow_table(self) -> pa.Table:
        return self.df.toArrow()

    def execute_stream(self) -> RecordBatchStream:
        """The result batch by batch, one partition at a time on the driver."""
        schema = self.schema()
        rows = self.df.toLocalIterator(prefetchPartitions=True)

        def batches() -> Iterator[pa.RecordBatch]:
            while part := list(itertools.islice(rows, 8192)):
                yield pa.RecordBatch.from_pylist([r.asDict(recursive=True) for r in part], schema)

        return RecordBatchStream(batches())

    def partition(self, k: int) -> RecordBatchStream:
        """The batches of partition ``k``, fetched when the first is asked for; none if there is no such partition."""
        rows = self.df

        def only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            return batches if TaskContext.get().partitionId() == k else iter(())

        def fetch() -> Iterator[pa.RecordBatch]:
            yield from rows.mapInArrow(only, rows.schema).toArrow().to_batches()

        return RecordBatchStream(fetch())

    def execute_stream_partitioned(self) -> list[RecordBatchStream]:
        """A stream for each partition; the driver holds those that are read.  The rows are kept on the executors meanwhile."""
        kept = DataFrame(self.df.persist())
        return [kept.partition(k) for k in range(kept.df.rdd.getNumPartitions())]

    def to_pandas(self) -> Any:
        return self.df.toPandas()

    def to_pylist(self) -> list[dict[str, Any]]:
        return self.df.toArrow().to_pylist()

    def to_pydict(self) -> dict[str, list[Any]]:
        return self.df.toArrow().to_pydict()

    def to_polars(self) -> Any:
        import polars

        return polars.from_arrow(self.df.toArrow())

    def count(self) -> int:
        return self.df.count()

    def unnest_column(self, column: str, preserve_nulls: bool = True) -> DataFrame:
        return self.unnest_columns(column, preserve_nulls=preserve_nulls)

    def unnest_columns(self, *columns: str, preserve_nulls: bool = True) -> DataFrame:
        """A row for each element; several arrays side by side, the shorter ones filled with nulls.  Rows whose arrays are null or
        empty stay, with a null, if ``preserve_nulls``."""
        if len(columns) == 1:
            f = F.explode_outer if preserve_nulls else F.explode
            return self._new(self.df.select(*[f(c).alias(c) if c == columns[0] else F.col(c) for c in self.df.columns]))
        zipped = F.arrays_zip(*[F.coalesce(F.col(c), F.slice(F.array(F.get(F.col(c), F.lit(0))), 1, 0)).alias(c) for c in columns])
        each = (F.explode_outer if preserve_nulls else F.explode)(zipped).alias("_each")
        out = self.df.select("*", each)
        return self._new(out.select(*[F.col("_each")[c].alias(c) if c in columns else F.col(c) for c in self.df.columns]))

    def __arrow_c_stream__(self, requested_schema: object | None = None) -> object:
        return self.df.toArrow().__arrow_c_stream__(requested_schema)

    def transform(self, func: Callable[..., DataFrame], *args: Any) -> DataFrame:
        return func(self, *args)
