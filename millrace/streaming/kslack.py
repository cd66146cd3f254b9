"""K-slack over a stream: late and out-of-order events reordered before an order-sensitive aggregation.

Events wait in a buffer until the watermark, which lags by the slack, has passed them; then they leave in event-time order into the
final aggregate of their period.  Meanwhile every batch publishes provisional values of the periods it touched, made of what
was released and what still waits.  Events behind the watermark are dropped; the progress of the query counts them.

Each period of a key has a state of its own, so a hot key is spread by time; events are handled as arrays, a batch at a time.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: What an aggregate begins with: count, sum, first, last, largest rise from one event to the next.
EMPTY = (0, 0.0, None, None, 0.0)


def fold(agg: tuple[Any, ...], v: np.ndarray) -> tuple[Any, ...]:
    """The aggregate after the events ``v``, in order."""
    if not len(v):
        return agg
    n, s, first, last, rise = agg
    steps = np.diff(v if n == 0 else np.r_[last, v])
    return n + len(v), s + float(v.sum()), float(v[0]) if n == 0 else first, float(v[-1]), max(rise, float(steps.max())) if len(steps) else rise


def kslack(events: DataFrame, keys: Sequence[str], time: str, value: str, period_ms: int, slack: str = "6 hours") -> DataFrame:
    """A stream of (keys, window_start_ms, kind, n, total, first, last, rise).

    ``kind`` is ``provisional`` or ``final``; for each period the last provisional row holds until the final one, which comes once, when
    the watermark has passed the period's end.  Events at one time are taken in order of their value.  ``time`` is a timestamp; rows
    without it or without a value are ignored.  A buffer holds what arrives within the slack, so its size is that of the slack, not of
    the stream.
    """
    src = events.select(*keys, F.col(time).alias("_t"), F.col(value).cast("double").alias("_v")).filter(F.col("_t").isNotNull() & F.col("_v").isNotNull())
    src = src.withWatermark("_t", slack).withColumn("_ms", F.unix_millis("_t")).withColumn("_start", F.col("_ms") - F.pmod("_ms", F.lit(period_ms)))
    kf = [src.schema[k] for k in keys]
    names = [k.name for k in kf]

    def step(key: tuple[Any, ...], parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        agg, ms, v = pickle.loads(state.get[0]) if state.exists else (EMPTY, np.zeros(0, np.int64), np.zeros(0))  # noqa: S301 - written below
        mark, end = state.getCurrentWatermarkMs(), int(key[-1]) + period_ms
        fresh = [] if state.hasTimedOut else [(p["_ms"].to_numpy(), p["_v"].to_numpy()) for p in parts]
        new_ms = np.concatenate([a for a, _ in fresh]) if fresh else ms[:0]
        new_v = np.concatenate([b for _, b in fresh]) if fresh else v[:0]
        ms, v = np.r_[ms, new_ms[new_ms >= mark]], np.r_[v, new_v[new_ms >= mark]]
        by = np.lexsort((v, ms))
        ms, v = ms[by], v[by]
        out = int(np.searchsorted(ms, mark))
        agg, ms, v = fold(agg, v[:out]), ms[out:], v[out:]
        row: tuple[Any, ...] | None = None
        if end <= mark:
            row = ("final", *agg) if agg[0] else None
            if state.exists:
                state.remove()
        elif agg[0] or len(ms):
            row = ("provisional", *fold(agg, v)) if (new_ms >= mark).any() else None
            state.update((pickle.dumps((agg, ms, v)),))
            state.setTimeoutTimestamp(max(end, mark + 1))
        if row:
            yield pd.DataFrame([(*key, *row)], columns=[*names, "window_start_ms", "kind", "n", "total", "first", "last", "rise"])

    fields = [("window_start_ms", T.LongType()), ("kind", T.StringType()), ("n", T.LongType()), ("total", T.DoubleType()), ("first", T.DoubleType()), ("last", T.DoubleType()), ("rise", T.DoubleType())]
    schema = T.StructType([*kf, *[T.StructField(n, t) for n, t in fields]])
    return src.groupBy(*keys, "_start").applyInPandasWithState(step, schema, T.StructType([T.StructField("s", T.BinaryType())]), "append", GroupStateTimeout.EventTimeTimeout)
