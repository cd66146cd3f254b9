"""User-defined aggregates over the windows of a stream, with their states kept between batches."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from millrace.expr import to_column
from millrace.udf import UDAFCall, _arrow, _plain, merge_states, spark_type


def _for_rows(v: Any, t: T.DataType) -> Any:
    """A value as rows take it: maps as dicts, which Arrow gives as pairs."""
    if v is None:
        return None
    if isinstance(t, T.MapType):
        pairs = v.items() if isinstance(v, dict) else v
        return {k: _for_rows(x, t.valueType) for k, x in pairs}
    if isinstance(t, T.StructType):
        return {f.name: _for_rows(v[f.name], f.dataType) for f in t}
    if isinstance(t, T.ArrayType):
        return [_for_rows(x, t.elementType) for x in v]
    return v


def windowed_udafs(df: DataFrame, keys: list[Column], calls: list[UDAFCall], window: Column) -> DataFrame:
    """One row for each key and window once the watermark has passed its end: keys, results, window.

    The state of a group is that of its accumulators, not its rows."""
    named = df.select(*keys)
    nk = len(keys)
    cols = [k.alias(f"k{i}") for i, k in enumerate(keys)] + [window.alias("w")]
    cols += [to_column(a).cast(spark_type(t)).alias(f"a{i}_{j}") for i, u in enumerate(calls) for j, (a, t) in enumerate(zip(u.args, u.udaf.input_types))]
    # the time of the window goes along: a row is late when its window is closed
    wide = df.select(*cols).select("*", F.window_time("w").alias("_time"), F.col("w.start").alias("w0"), F.col("w.end").alias("w1")).drop("w")

    # what the tasks need, without the expressions of the driver
    specs = [(u.udaf.accumulator, [_arrow(t) for t in u.udaf.input_types], u.udaf.state_type) for u in calls]
    results = [spark_type(u.udaf.return_type) for u in calls]

    def step(key: tuple[Any, ...], parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        accs = [make() for make, *_ in specs]
        if state.exists:
            for (_, _, kinds), acc, s in zip(specs, accs, pickle.loads(state.get[0])):  # noqa: S301 - written below
                merge_states(acc, [s], kinds)
        if state.hasTimedOut:
            state.remove()
            row = {f"k{i}": [v] for i, v in enumerate(key[:nk])}
            row |= {f"r{i}": [_for_rows(_plain(acc.evaluate()), results[i])] for i, acc in enumerate(accs)}
            yield pd.DataFrame(row | {"w0": [key[nk]], "w1": [key[nk + 1]]})
            return
        for p in parts:
            for i, ((_, kinds, _), acc) in enumerate(zip(specs, accs)):
                acc.update(*[pa.array(p[f"a{i}_{j}"], t, from_pandas=True) for j, t in enumerate(kinds)])
        state.update((pickle.dumps([[_plain(x) for x in a.state()] for a in accs]),))
        end = pd.Timestamp(key[nk + 1])
        end = int((end.tz_localize("UTC") if end.tzinfo is None else end).timestamp() * 1000)
        state.setTimeoutTimestamp(max(end - 1, state.getCurrentWatermarkMs() + 1))

    kf = [T.StructField(f"k{i}", wide.schema[f"k{i}"].dataType) for i in range(nk)]
    rf = [T.StructField(f"r{i}", spark_type(u.udaf.return_type)) for i, u in enumerate(calls)]
    wf = [T.StructField("w0", T.TimestampType()), T.StructField("w1", T.TimestampType())]
    out = wide.groupBy(*[f"k{i}" for i in range(nk)], "w0", "w1").applyInPandasWithState(
        step, T.StructType([*kf, *rf, *wf]), T.StructType([T.StructField("s", T.BinaryType())]), "append", GroupStateTimeout.EventTimeTimeout
    )
    return out.toDF(*named.columns, *[u.name for u in calls], "window_start_time", "window_end_time")
