"""Streams: the fluent interface over bounded and unbounded data with an event time."""

from __future__ import annotations

import dataclasses
import logging
from collections.abc import Callable, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import DataFrame as SparkDataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from millrace.expr import Expr, ExprFuncBuilder, to_column, to_named
from millrace.frame import JOINS, DataFrame, aggregated
from millrace.sources.kafka import sink_options, encoded
from millrace.sources.timeunits import EVENT_TIME
from millrace.streaming.stateful import windowed_udafs
from millrace.udf import UDAFCall

log = logging.getLogger(__name__)

WINDOW = "_window"
HIDDEN = (EVENT_TIME, WINDOW)


def _for_stream(a: Any) -> Any:
    """The form of an aggregate that a stream can keep."""
    a = a.build() if isinstance(a, ExprFuncBuilder) else a
    if isinstance(a, Expr) and a.spec is not None:
        return Expr(spec=dataclasses.replace(a.spec, streaming=True), name=a._name, variant=a._variant)
    return a


def _ms(ms: int, what: str) -> str:
    if ms <= 0:
        raise ValueError(f"the {what} of a window must be positive")
    return f"{ms} milliseconds"


class DataStream:
    """An immutable description of a stream.  The event time travels in a hidden column through every step."""

    def __init__(self, df: SparkDataFrame, context: Any = None, lateness: str | None = None) -> None:
        """``lateness`` is set where the watermark still has to be declared."""
        self._df = df.withWatermark(EVENT_TIME, lateness) if lateness is not None and df.isStreaming else df
        self._context = context

    def _new(self, df: SparkDataFrame) -> DataStream:
        return type(self)(df, self._context)

    @property
    def visible(self) -> SparkDataFrame:
        """The rows without hidden columns."""
        return self._df.drop(*HIDDEN)

    @property
    def is_streaming(self) -> bool:
        return self._df.isStreaming

    def __repr__(self) -> str:
        return "DataStream"

    __str__ = __repr__

    # what it is
    def schema(self) -> pa.Schema:
        return to_arrow_schema(self.visible.schema)

    def print_schema(self) -> DataStream:
        self.visible.printSchema()
        return self

    def print_plan(self) -> DataStream:
        self._df.explain("extended")
        return self

    def print_physical_plan(self) -> DataStream:
        self._df.explain("formatted")
        return self

    # rows
    def _hidden(self) -> list[Column]:
        return [F.col(c) for c in HIDDEN if c in self._df.columns]

    def select(self, exprs: Sequence[Any] | Any) -> DataStream:
        one = isinstance(exprs, (str, Expr, Column))
        return self._new(self._df.select(*[to_named(e) for e in ([exprs] if one else exprs)], *self._hidden()))

    def filter(self, predicate: Any) -> DataStream:
        return self._new(self._df.filter(to_column(predicate)))

    def with_column(self, name: str, predicate: Any) -> DataStream:
        return self._new(self._df.withColumn(name, to_column(predicate)))

    def with_column_renamed(self, old: str, new: str) -> DataStream:
        return self._new(self._df.withColumnRenamed(old, new))

    def drop_columns(self, columns: Sequence[str]) -> DataStream:
        return self._new(self._df.drop(*columns))

    # joins
    def _pair(self, right: Any) -> tuple[SparkDataFrame, SparkDataFrame]:
        if isinstance(right, DataStream):
            r = right._df
        elif isinstance(right, DataFrame):
            r = right.df
        else:
            r = right
        for h in HIDDEN:
            if h in r.columns:
                r = r.withColumnRenamed(h, f"{h}_r")
        return self._df.alias("_l"), r.alias("_r")

    def _joined(self, l: SparkDataFrame, r: SparkDataFrame, cond: Column, how: str) -> DataStream:
        if how not in JOINS:
            raise ValueError(f"unknown join type {how}: one of {', '.join(JOINS)}")
        drop = [f"{h}_r" for h in HIDDEN if f"{h}_r" in r.columns]
        if how == "anti" and l.isStreaming and r.isStreaming:
            # streams know no anti join: an outer one, of which the unmatched rows stay
            marked = r.withColumn("_there", F.lit(True)).alias("_r")
            out = l.join(marked, cond, "left").filter(F.col("_there").isNull()).select("_l.*")
        else:
            out = l.join(r, cond, JOINS[how])
        return self._new(out.drop(*[c for c in drop if c in out.columns]))

    def join(self, right: Any, join_type: str, left_cols: Sequence[str], right_cols: Sequence[str], filter: Any = None) -> DataStream:
        """Joins on pairs of columns, and ``filter`` if given.  ``right`` is a stream or a table.

        Windows are joined as such where both bounds are among the columns, so that the state of closed ones is let go."""
        if len(left_cols) != len(right_cols):
            raise ValueError("as many columns on the left as on the right are needed")
        l, r = self._pair(right)
        pairs = list(zip(left_cols, right_cols))
        cond: Column | None = None
        both = WINDOW in l.columns and f"{WINDOW}_r" in r.columns and any(a == "window_start_time" for a, _ in pairs)
        if both:
            cond = F.col(f"_l.{WINDOW}") == F.col(f"_r.{WINDOW}_r")
            pairs = [(a, b) for a, b in pairs if a not in ("window_start_time", "window_end_time")]
        for a, b in pairs:
            one = F.col(f"_l.{a}") == F.col(f"_r.{b}")
            cond = one if cond is None else cond & one
        if filter is not None:
            cond = to_column(filter) if cond is None else cond & to_column(filter)
        return self._joined(l, r, cond if cond is not None else F.lit(True), join_type)

    def join_on(self, right: Any, join_type: str, on_exprs: Sequence[Any]) -> DataStream:
        """Joins where all of ``on_exprs`` hold; equalities among them are the keys."""
        l, r = self._pair(right)
        cond: Column | None = None
        for e in on_exprs:
            cond = to_column(e) if cond is None else cond & to_column(e)
        return self._joined(l, r, cond if cond is not None else F.lit(True), join_type)

    # windows
    def window(self, group_exprs: Sequence[Any], aggregate_exprs: Sequence[Any], window_length_millis: int, slide_millis: int | None = None, closed_only: bool = False) -> DataStream:
        """Aggregates over windows of event time: the group columns, the aggregates, window_start_time and window_end_time.

        Windows are half open and tumble, or slide by ``slide_millis``; they are aligned to multiples of the slide.  On a stream a window comes
        out once the watermark has reached its end, and later rows are dropped.  Over a table all come out, or with ``closed_only`` those
        that end at or before the latest event time."""
        length = _ms(window_length_millis, "length")
        w = F.window(EVENT_TIME, length, _ms(slide_millis, "slide") if slide_millis is not None else None)
        return self._windowed(w, group_exprs, aggregate_exprs, closed_only)

    def session_window(self, group_exprs: Sequence[Any], aggregate_exprs: Sequence[Any], gap_millis: int) -> DataStream:
        """As :meth:`window`, over sessions parted by ``gap_millis`` without events."""
        return self._windowed(F.session_window(EVENT_TIME, _ms(gap_millis, "gap")), group_exprs, aggregate_exprs, False)

    def _windowed(self, w: Column, group_exprs: Sequence[Any], aggregate_exprs: Sequence[Any], closed_only: bool) -> DataStream:
        keys = [to_named(g) for g in group_exprs]
        own = [a for a in aggregate_exprs if isinstance(a, UDAFCall)]
        streaming = self._df.isStreaming
        # rows without an event time belong to no window
        df = self._df.filter(F.col(EVENT_TIME).isNotNull())
        if streaming and own:
            if len(own) < len(aggregate_exprs):
                raise ValueError("on a stream, user-defined aggregates stand alone in a window")
            out = windowed_udafs(df, keys, own, w)
            return self._new(out.withColumn(EVENT_TIME, F.col("window_end_time") - F.expr("INTERVAL 1 MICROSECOND")))
        if own:
            wide = df.withColumn(WINDOW, w)
            out = aggregated(wide, [*[Expr(k) for k in keys], WINDOW], aggregate_exprs)
        else:
            aggs = [to_column(_for_stream(a)) if streaming else to_column(a) for a in aggregate_exprs]
            out = df.groupBy(w.alias(WINDOW), *keys).agg(*aggs)
        plain = [c for c in out.columns if c != WINDOW]
        out = out.select(*[F.col(f"`{c}`") for c in plain], F.col(f"{WINDOW}.start").alias("window_start_time"), F.col(f"{WINDOW}.end").alias("window_end_time"), *([F.col(WINDOW), F.window_time(WINDOW).alias(EVENT_TIME)] if not own else [F.col(WINDOW), (F.col(f"{WINDOW}.end") - F.expr("INTERVAL 1 MICROSECOND")).alias(EVENT_TIME)]))
        if closed_only and not streaming:
            last = self._df.agg(F.max(EVENT_TIME).alias("_last"))  # a single row
            out = out.crossJoin(F.broadcast(last)).filter(F.col("window_end_time") <= F.col("_last")).drop("_last")
        return self._new(out)

    # sinks
    def _start(self, writer: Any, trigger: dict[str, Any] | None, name: str) -> Any:
        ctx = self._context
        if ctx is not None and ctx.checkpoint_dir:
            writer = writer.option("checkpointLocation", f"{ctx.checkpoint_dir.rstrip('/')}/{name}")
        if trigger:
            writer = writer.trigger(**trigger)
        q = writer.start()
        if ctx is not None:
            ctx.running.append(q)
        return q

    def _each_batch(self, func: Callable[[SparkDataFrame], None], trigger: dict[str, Any] | None, name: str, wait: bool) -> Any:
        out = self.visible
        if not out.isStreaming:
            func(out)
            return None
        q = self._start(out.writeStream.outputMode("append").foreachBatch(lambda df, _: func(df)), trigger, name)
        if wait:
            q.awaitTermination()
        return q

    def print_stream(self, trigger: dict[str, Any] | None = None, wait: bool = True, name: str = "print") -> Any:
        """Prints the rows of every batch that has any."""

        def show(df: SparkDataFrame) -> None:
            if not df.isEmpty():
                df.show(truncate=False)

        return self._each_batch(show, trigger, name, wait)

    def sink(self, func: Callable[[pa.RecordBatch], None], trigger: dict[str, Any] | None = None, wait: bool = True, name: str = "sink") -> Any:
        """Calls ``func`` on the driver with the batches of the result, which should be small; see :meth:`sink_partitions` for large ones."""

        def call(df: SparkDataFrame) -> None:
            for b in df.toArrow().to_batches():
                if b.num_rows:
                    func(b)

        return self._each_batch(call, trigger, name, wait)

    def sink_partitions(self, func: Callable[[pa.RecordBatch], None], trigger: dict[str, Any] | None = None, wait: bool = True, name: str = "sink_partitions") -> Any:
        """Calls ``func`` on the executors, where the rows are."""

        def run(batches):
            for b in batches:
                if b.num_rows:
                    func(b)
            return iter(())

        def call(df: SparkDataFrame) -> None:
            df.mapInArrow(run, T.StructType([T.StructField("n", T.LongType())])).write.format("noop").mode("overwrite").save()

        return self._each_batch(call, trigger, name, wait)

    def sink_kafka(self, bootstrap_servers: str, topic: str, trigger: dict[str, Any] | None = None, wait: bool = True, format: str = "kafka") -> Any:
        """Writes every row as a JSON message without a key."""
        rows = encoded(self.visible)
        if not rows.isStreaming:
            rows.write.format(format).options(**sink_options(bootstrap_servers, topic)).save()
            return None
        q = self._start(rows.writeStream.outputMode("append").format(format).options(**sink_options(bootstrap_servers, topic)), trigger, topic)
        if wait:
            q.awaitTermination()
        return q


class FeastDataStream(DataStream):
    """A stream whose batches can be pushed to a feature store; every step keeps the kind."""

    def get_feast_schema(self) -> list[tuple[str, str]]:
        """(column, feature type) pairs."""
        names = {"bigint": "Int64", "int": "Int32", "double": "Float64", "float": "Float32", "string": "String", "boolean": "Bool", "binary": "Bytes", "timestamp": "UnixTimestamp", "timestamp_ntz": "UnixTimestamp"}
        out = []
        for f in self.visible.schema:
            t = f.dataType
            inner = t.elementType if isinstance(t, T.ArrayType) else t
            kind = names.get(inner.simpleString())
            if kind is None:
                raise ValueError(f"no feature type for {f.name}: {t.simpleString()}")
            out.append((f.name, f"Array({kind})" if inner is not t else kind))
        return out

    def write_feast_feature(self, feature_store: Any, source_name: str, trigger: dict[str, Any] | None = None, wait: bool = True) -> Any:
        """Pushes every batch to the online store; a push that fails is logged and the stream goes on."""
        try:
            from feast.data_source import PushMode

            to = PushMode.ONLINE
        except ImportError:
            to = "online"

        def push(df: SparkDataFrame) -> None:
            try:
                feature_store.push(source_name, df.toPandas(), to=to)
            except Exception:
                log.exception("the push to %s failed", source_name)

        return self._each_batch(push, trigger, f"feast_{source_name}", wait)
