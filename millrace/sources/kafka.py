"""Topics as sources and sinks of streams."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame as SparkDataFrame
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_schema

from millrace.sources import schemas
from millrace.sources.timeunits import EVENT_TIME, MILLIS, TIMESTAMP, TimestampUnit

ENCODINGS = ("json", "avro")


def encoding(name: str) -> str:
    """The encoding of that name, in any case."""
    if name.lower() not in ENCODINGS:
        raise ValueError(f"unsupported encoding {name}: json or avro")
    return name.lower()


#: The options of Spark's own topic reader; all others are the consumer's and get its prefix.
READER_OPTIONS = (
    "assign", "endingOffsets", "endingOffsetsByTimestamp", "endingTimestamp", "failOnDataLoss", "fetchOffset.numRetries", "fetchOffset.retryIntervalMs", "groupIdPrefix",
    "includeHeaders", "kafkaConsumer.pollTimeoutMs", "maxOffsetsPerTrigger", "maxRecordsPerPartition", "maxTriggerDelay", "minOffsetsPerTrigger", "minPartitions", "startingOffsets",
    "startingOffsetsByTimestamp", "startingOffsetsByTimestampStrategy", "startingTimestamp", "subscribe", "subscribePattern",
)
_READER = {k.lower(): k for k in READER_OPTIONS}


def source_options(bootstrap_servers: str, topic: str, opts: dict[str, str] | None = None) -> dict[str, str]:
    """Options of the reader.  ``auto.offset.reset`` (earliest) becomes the starting offsets; where a checkpoint has offsets they
    win, and nothing is committed to the broker.  Offsets that the broker no longer has fail the stream unless ``failOnDataLoss``
    is set to false."""
    o = dict(opts or {})
    start = o.pop("auto.offset.reset", "earliest")
    o.pop("enable.auto.commit", None)
    group = o.pop("group.id", None)
    out = {"kafka.bootstrap.servers": bootstrap_servers, "subscribe": topic, "startingOffsets": start, "failOnDataLoss": "true"}
    if group:
        out["groupIdPrefix"] = group
    given = {_READER.get(k.lower(), k if k.startswith("kafka.") else f"kafka.{k}"): v for k, v in o.items()}
    if {"assign", "subscribePattern"} & given.keys():  # instead of the topic
        del out["subscribe"]
    return out | given


def sink_options(bootstrap_servers: str, topic: str, opts: dict[str, str] | None = None) -> dict[str, str]:
    o = {"message.timeout.ms": "60000"} | dict(opts or {})
    o["delivery.timeout.ms"] = o.pop("message.timeout.ms")
    return {"kafka.bootstrap.servers": bootstrap_servers, "topic": topic} | {f"kafka.{k}": v for k, v in o.items()}


def encoded(df: SparkDataFrame) -> SparkDataFrame:
    """Rows as un-keyed messages: one JSON object each, nulls left out."""
    return df.select(F.to_json(F.struct("*")).alias("value"))


@dataclass(frozen=True)
class TopicReader:
    """A topic with its schema, encoding and event time."""

    topic: str
    schema: T.StructType
    encoding: str
    bootstrap_servers: str = ""
    timestamp_column: str | None = None
    unit: TimestampUnit = MILLIS
    options: dict[str, str] = field(default_factory=dict)
    strict: bool = False

    def decode(self, messages: SparkDataFrame) -> SparkDataFrame:
        """Messages (value and timestamp, as the Kafka reader gives them) to rows with the hidden event time.

        Without a timestamp column the event time is the message's.  Values that cannot be parsed give nulls, or
        an error if ``strict``."""
        if self.encoding == "json":
            mode = "FAILFAST" if self.strict else "PERMISSIVE"
            rows = messages.select(F.from_json(F.col("value").cast("string"), self.schema, {"mode": mode}).alias("_row"), F.col("timestamp").alias("_arrived"))
            rows = rows.select("_row.*", "_arrived")
        else:
            rows = self._avro(messages)
        at = self.unit.event_time(F.col(self.timestamp_column)) if self.timestamp_column else TIMESTAMP.event_time(F.col("_arrived"))
        return rows.withColumn(EVENT_TIME, at).drop("_arrived")

    def _avro(self, messages: SparkDataFrame) -> SparkDataFrame:
        from millrace.sources.avro import read_container

        schema = T.StructType([*self.schema.fields, T.StructField("_arrived", T.TimestampType())])
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)

        def run(batches):
            for b in batches:
                rows = [r | {"_arrived": t} for v, t in zip(b["value"].to_pylist(), b["_arrived"].to_pylist()) if v is not None for r in read_container(v)]
                yield pa.RecordBatch.from_pylist(rows, arrow)

        return messages.select("value", F.col("timestamp").alias("_arrived")).mapInArrow(run, schema)

    def load(self, spark: SparkSession, messages: SparkDataFrame | None = None) -> SparkDataFrame:
        """The decoded stream of the topic, or of ``messages`` given in its place."""
        if messages is None:
            messages = spark.readStream.format("kafka").options(**source_options(self.bootstrap_servers, self.topic, self.options)).load()
        return self.decode(messages)


@dataclass(frozen=True)
class TopicWriter:
    """A topic to write to."""

    topic: str
    bootstrap_servers: str
    options: dict[str, str] = field(default_factory=dict)

    def stream_writer(self, df: SparkDataFrame) -> Any:
        return encoded(df).writeStream.format("kafka").options(**sink_options(self.bootstrap_servers, self.topic, self.options))


class KafkaTopicBuilder:
    """Describes a topic step by step."""

    def __init__(self, bootstrap_servers: str) -> None:
        self._servers = bootstrap_servers
        self._topic: str | None = None
        self._schema: T.StructType | None = None
        self._encoding: str | None = None
        self._column: str | None = None
        self._unit: TimestampUnit | None = None

    def with_topic(self, topic: str) -> KafkaTopicBuilder:
        self._topic = topic
        return self

    def with_schema(self, schema: T.StructType | pa.Schema) -> KafkaTopicBuilder:
        self._schema = from_arrow_schema(schema) if isinstance(schema, pa.Schema) else schema
        return self

    def infer_schema(self) -> KafkaTopicBuilder:
        return self  # takes effect with a sample or a schema

    def infer_schema_from_json(self, sample_json: str) -> KafkaTopicBuilder:
        self._schema = schemas.from_json_sample(sample_json)
        return self

    def infer_schema_from_avro(self, avro_schema: str) -> KafkaTopicBuilder:
        self._schema = schemas.from_avro_schema(avro_schema)
        return self

    def with_timestamp(self, column: str, unit: TimestampUnit = MILLIS) -> KafkaTopicBuilder:
        self._column, self._unit = column, unit
        return self

    def with_encoding(self, name: str) -> KafkaTopicBuilder:
        self._encoding = encoding(name)
        return self

    def _need(self, **parts: Any) -> None:
        for name, v in parts.items():
            if v is None:
                raise ValueError(f"{name} required")

    def build_reader(self, opts: dict[str, str] | None = None) -> TopicReader:
        self._need(topic=self._topic, Schema=self._schema, encoding=self._encoding)
        return TopicReader(self._topic, self._schema, self._encoding, self._servers, self._column, self._unit or MILLIS, dict(opts or {}))

    def build_writer(self, opts: dict[str, str] | None = None) -> TopicWriter:
        self._need(topic=self._topic, Schema=self._schema, encoding=self._encoding, timestamp_column=self._column, timestamp_unit=self._unit)
        return TopicWriter(self._topic, self._servers, dict(opts or {}))
