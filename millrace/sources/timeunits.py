"""Event-time columns and their units."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.scalar import chrono_pattern

#: The hidden column that carries the event time.
EVENT_TIME = "_event_time"


@dataclass(frozen=True)
class TimestampUnit:
    """``Int64Millis``, ``Int64Seconds`` or ``StringIso8601`` with a strftime format, read as UTC."""

    kind: str
    format: str | None = None

    def __post_init__(self) -> None:
        if self.kind not in ("Int64Millis", "Int64Seconds", "StringIso8601", "Timestamp"):
            raise ValueError(f"unknown timestamp unit {self.kind}")

    def event_time(self, c: Column) -> Column:
        """A timestamp cut to milliseconds; null where there is none."""
        if self.kind == "Int64Millis":
            return F.timestamp_millis(c.cast("bigint"))
        if self.kind == "Int64Seconds":
            return F.timestamp_seconds(c.cast("bigint"))
        if self.kind == "StringIso8601":
            got = F.try_to_timestamp(c, F.lit(chrono_pattern(self.format))) if self.format else F.try_to_timestamp(c)
            return F.date_trunc("millisecond", got)
        return F.date_trunc("millisecond", c.cast("timestamp"))


MILLIS, SECONDS, TIMESTAMP = TimestampUnit("Int64Millis"), TimestampUnit("Int64Seconds"), TimestampUnit("Timestamp")


def iso8601(format: str | None = None) -> TimestampUnit:
    return TimestampUnit("StringIso8601", format)
