"""Where streams begin."""

from __future__ import annotations

import signal
from typing import Any

from pyspark.sql import DataFrame as SparkDataFrame
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.frame import DataFrame
from millrace.sources.kafka import KafkaTopicBuilder, TopicReader
from millrace.sources.timeunits import EVENT_TIME, MILLIS, TimestampUnit
from millrace.stream import DataStream


class Context:
    """Makes streams of topics, files and tables, over one Spark session."""

    def __init__(self, spark: SparkSession | None = None, stream_class: type[DataStream] = DataStream) -> None:
        self.spark = spark or SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
        self.checkpoint_dir: str | None = None
        self.running: list[Any] = []
        self._stream_class = stream_class

    def __repr__(self) -> str:
        return "Context"

    __str__ = __repr__

    def with_checkpoint(self, path: str, rocksdb: bool = True) -> Context:
        """Keeps offsets and states under ``path``, so that a stream started again goes on where it was; states in RocksDB."""
        self.checkpoint_dir = str(path)
        if rocksdb:
            self.spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        return self

    def _stream(self, df: SparkDataFrame, allowed_lateness: str) -> DataStream:
        return self._stream_class(df, self, allowed_lateness)

    def from_topic(
        self, topic: str | TopicReader, sample_json: str | None = None, bootstrap_servers: str | None = None, timestamp_column: str | None = None,
        group_id: str = "default_group", messages: SparkDataFrame | None = None, allowed_lateness: str = "0 seconds",
    ) -> DataStream:
        """A stream of a topic described by a reader, or of JSON messages like ``sample_json`` from the latest offset on.

        ``messages`` (value, timestamp) may stand in for the broker.  The topic is also registered as a table."""
        if isinstance(topic, TopicReader):
            reader = topic
        else:
            if sample_json is None:
                raise ValueError("a sample is needed to infer the schema")
            b = KafkaTopicBuilder(bootstrap_servers or "").with_topic(topic).infer_schema_from_json(sample_json).with_encoding("json")
            if timestamp_column:
                b = b.with_timestamp(timestamp_column, MILLIS)
            reader = b.build_reader({"auto.offset.reset": "latest", "group.id": group_id})
        df = reader.load(self.spark, messages)
        df.drop(EVENT_TIME).createOrReplaceTempView(reader.topic)
        return self._stream(df, allowed_lateness)

    def from_files(self, path: str, schema: T.StructType, timestamp_column: str, unit: TimestampUnit = MILLIS, format: str = "json", max_files_per_trigger: int | None = None, allowed_lateness: str = "0 seconds") -> DataStream:
        """A stream of the files that appear in a folder, the oldest first."""
        r = self.spark.readStream.schema(schema).format(format)
        if max_files_per_trigger:
            r = r.option("maxFilesPerTrigger", max_files_per_trigger)
        return self._stream(r.load(str(path)).withColumn(EVENT_TIME, unit.event_time(F.col(timestamp_column))), allowed_lateness)

    def from_table(self, table: SparkDataFrame | DataFrame, timestamp_column: str, unit: TimestampUnit, allowed_lateness: str = "0 seconds") -> DataStream:
        """A bounded or unbounded table as a stream."""
        df = table.df if isinstance(table, DataFrame) else table
        return self._stream(df.withColumn(EVENT_TIME, unit.event_time(F.col(timestamp_column))), allowed_lateness)

    def register_table(self, name: str, table: SparkDataFrame | DataFrame) -> None:
        (table.df if isinstance(table, DataFrame) else table).createOrReplaceTempView(name)

    def sql(self, query: str) -> DataFrame:
        """SQL over what is registered, streams included."""
        return DataFrame(self.spark.sql(query))

    def stop_on_signals(self, *signals: int) -> None:
        """Stops the streams started from here when the process is interrupted or asked to end; what handled the signal before goes on
        afterwards.  For the main thread."""
        for s in signals or (signal.SIGINT, signal.SIGTERM):
            before = signal.getsignal(s)

            def handle(number: int, frame: Any, before: Any = before) -> None:
                self.shutdown()
                if callable(before):
                    before(number, frame)
                elif before == signal.SIG_DFL:
                    signal.signal(number, signal.SIG_DFL)
                    signal.raise_signal(number)

            signal.signal(s, handle)

    def shutdown(self) -> None:
        """Stops the streams started from here."""
        for q in self.running:
            if q.isActive:
                q.stop()
        self.running.clear()
