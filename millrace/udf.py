"""User-defined scalar and aggregate functions over Arrow arrays."""

from __future__ import annotations

import pickle
from abc import ABCMeta, abstractmethod
from collections.abc import Callable, Iterator
from enum import Enum
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.expr import Expr, to_column, to_spark_type


class Volatility(Enum):
    """How often a function may be called anew: a volatile one for every row, others once for equal arguments."""

    Immutable = 1
    Stable = 2
    Volatile = 3

    def __str__(self) -> str:
        return self.name.lower()


def _volatility(v: Volatility | str) -> Volatility:
    return v if isinstance(v, Volatility) else Volatility[str(v).capitalize()]


def _types(types: Any) -> list[Any]:
    return list(types) if isinstance(types, (list, tuple)) else [types]


def spark_type(t: Any) -> T.DataType:
    got = to_spark_type(t)
    return T._parse_datatype_string(got) if isinstance(got, str) else got


class ScalarUDF:
    """A function from Arrow arrays to an Arrow array of the same length."""

    def __init__(self, name: str | None, func: Callable[..., pa.Array], input_types: Any, return_type: Any, volatility: Volatility | str) -> None:
        self.name = name or getattr(func, "__qualname__", type(func).__name__).lower()
        self.input_types, self.return_type, self.volatility = _types(input_types), return_type, _volatility(volatility)

        def run(*arrays: pa.Array) -> pa.Array:
            out = func(*arrays)
            return out.combine_chunks() if isinstance(out, pa.ChunkedArray) else out

        n = len(self.input_types)
        # Spark reads the kind of function off the number of arguments and their types
        params = ", ".join(f"a{i}: pa.Array" for i in range(n))
        scope: dict[str, Any] = {"pa": pa, "run": run}
        exec(f"def call({params}) -> pa.Array:\n    return run({', '.join(f'a{i}' for i in range(n))})", scope)  # noqa: S102
        made = F.arrow_udf(scope["call"], spark_type(return_type))
        self.spark = made.asNondeterministic() if self.volatility is Volatility.Volatile else made

    def __call__(self, *args: Any) -> Expr:
        if len(args) != len(self.input_types):
            raise TypeError(f"{self.name} takes {len(self.input_types)} arguments")
        cols = [to_column(a).cast(spark_type(t)) for a, t in zip(args, self.input_types)]
        return Expr(self.spark(*cols), variant="ScalarUDF", operands=args, operator=self.name)

    @staticmethod
    def udf(func: Callable[..., Any], input_types: Any, return_type: Any, volatility: Volatility | str, name: str | None = None) -> ScalarUDF:
        if not callable(func):
            raise TypeError("`func` argument must be callable")
        return ScalarUDF(name, func, input_types, return_type, volatility)


class Accumulator(metaclass=ABCMeta):
    """What an aggregate function keeps for a group."""

    @abstractmethod
    def state(self) -> list[pa.Scalar]:
        """The state as scalars that can be merged elsewhere."""

    @abstractmethod
    def update(self, *values: pa.Array) -> None:
        """Takes in rows."""

    @abstractmethod
    def merge(self, states: list[pa.Array]) -> None:
        """Takes in states of others, an array for each part of the state."""

    @abstractmethod
    def evaluate(self) -> pa.Scalar:
        """The result."""


def _plain(v: Any) -> Any:
    return v.as_py() if isinstance(v, pa.Scalar) else v


def merge_states(acc: Accumulator, states: list[list[Any]], types: list[Any]) -> None:
    """Merges plain states into ``acc``."""
    if states:
        acc.merge([pa.array([s[i] for s in states], _arrow(t)) for i, t in enumerate(types)])


def _arrow(t: Any) -> pa.DataType | None:
    return t if isinstance(t, pa.DataType) else None


class AggregateUDF:
    """An aggregate function made of an accumulator class.

    Over tables it runs in two stages: partial states for each task and group, then a merge for each group, so the rows of a
    group never meet in one place.  Over streams the states are kept between batches.
    """

    def __init__(self, name: str | None, accumulator: type[Accumulator], input_types: Any, return_type: Any, state_type: Any, volatility: Volatility | str) -> None:
        self.name = name or getattr(accumulator, "__qualname__", "udaf").lower()
        self.accumulator, self.input_types, self.return_type = accumulator, _types(input_types), return_type
        self.state_type, self.volatility = _types(state_type), _volatility(volatility)

    def __call__(self, *args: Any) -> UDAFCall:
        if len(args) != len(self.input_types):
            raise TypeError(f"{self.name} takes {len(self.input_types)} arguments")
        return UDAFCall(self, args)

    @staticmethod
    def udaf(accum: type[Accumulator], input_types: Any, return_type: Any, state_type: Any, volatility: Volatility | str, name: str | None = None) -> AggregateUDF:
        if not isinstance(accum, type) or not issubclass(accum, Accumulator):
            raise TypeError("`accum` must implement the abstract base class Accumulator")
        return AggregateUDF(name, accum, input_types, return_type, state_type, volatility)


class UDAFCall:
    """A call of an aggregate function, resolved by the aggregation it stands in."""

    def __init__(self, udaf: AggregateUDF, args: tuple[Any, ...], name: str | None = None) -> None:
        self.udaf, self.args, self.name = udaf, args, name or udaf.name

    def alias(self, name: str) -> UDAFCall:
        return UDAFCall(self.udaf, self.args, name)


def _flat(columns: list[Any]) -> Iterator[Any]:
    """Columns that compare as these do and can be encoded: of a struct its fields and whether it is there, of other nested values their text."""
    for c in columns:
        c = c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
        if pa.types.is_struct(c.type):
            yield c.is_null()
            yield from _flat(c.flatten())
        else:
            yield pa.array([repr(x) for x in c.to_pylist()]) if pa.types.is_nested(c.type) else c


def _groups(t: pa.Table, nk: int) -> Iterator[tuple[tuple[Any, ...], pa.Table]]:
    """The groups of a batch by its columns k0, k1, ...: the values and the rows.  Sorted once by numbers that stand for the keys."""
    if not nk or not t.num_rows:
        if t.num_rows:
            yield (), t
        return
    code = np.zeros(t.num_rows, np.int64)
    for c in _flat([t[f"k{i}"].combine_chunks() for i in range(nk)]):
        enc = c if pa.types.is_dictionary(c.type) else c.dictionary_encode(null_encoding="encode")
        _, code = np.unique(code * max(1, len(enc.dictionary)) + enc.indices.to_numpy(zero_copy_only=False), return_inverse=True)
    by = np.argsort(code, kind="stable")
    t, code = t.take(pa.array(by)), code[by]
    starts = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
    keys = zip(*[t[f"k{i}"].take(pa.array(starts)).to_pylist() for i in range(nk)])
    for key, a, b in zip(keys, starts, [*starts[1:], len(code)]):
        yield key, t.slice(a, b - a)


def aggregate_with_udafs(df: DataFrame, keys: list[Column], calls: list[UDAFCall]) -> DataFrame:
    """One row for each group: the keys and the results of ``calls``.  Keys compare null-safe, as in a group by."""
    names = [df.select(k).columns[0] for k in keys]
    cols = [k.alias(f"k{i}") for i, k in enumerate(keys)]
    cols += [to_column(a).cast(spark_type(t)).alias(f"a{i}_{j}") for i, u in enumerate(calls) for j, (a, t) in enumerate(zip(u.args, u.udaf.input_types))]
    wide = df.select(*cols)
    key_fields = [wide.schema[f"k{i}"] for i in range(len(keys))]
    nk = len(keys)
    # what the tasks need, without the expressions of the driver
    specs = [(u.udaf.accumulator, len(u.args), u.udaf.state_type, _arrow(u.udaf.return_type)) for u in calls]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[Any, list[Accumulator]] = {}
        kinds = None
        for b in batches:
            kinds = [b.schema.field(f"k{i}").type for i in range(nk)]
            for k, part in _groups(pa.Table.from_batches([b]), nk):
                key = repr(k) if any(isinstance(x, (dict, list)) for x in k) else k
                if key not in held:
                    held[key] = [k, [make() for make, *_ in specs]]
                for i, ((_, n, *_), acc) in enumerate(zip(specs, held[key][1])):
                    acc.update(*[part[f"a{i}_{j}"].combine_chunks() for j in range(n)])
            if len(held) > 100_000:
                yield emit(held, kinds)
                held.clear()
        if held:
            yield emit(held, kinds)

    def emit(held: dict[Any, Any], kinds: Any) -> pa.RecordBatch:
        ks = [pa.array([v[0][i] for v in held.values()], kinds[i]) for i in range(nk)]
        state = pa.array([pickle.dumps([[_plain(x) for x in a.state()] for a in v[1]]) for v in held.values()], pa.binary())
        return pa.RecordBatch.from_arrays([*ks, state], [*[f"k{i}" for i in range(nk)], "state"])

    def final(t: pa.Table) -> pa.Table:
        states = [pickle.loads(s) for s in t["state"].to_pylist()]  # noqa: S301 - written by partial above
        out = {f"k{i}": t[f"k{i}"].slice(0, 1) for i in range(nk)}
        for i, (make, _, state_type, kind) in enumerate(specs):
            acc = make()
            merge_states(acc, [s[i] for s in states], state_type)
            out[f"r{i}"] = pa.array([_plain(acc.evaluate())], kind)
        return pa.table(out)

    schema = T.StructType([*[T.StructField(f.name, f.dataType, True) for f in key_fields], T.StructField("state", T.BinaryType())])
    done = T.StructType([*[T.StructField(f.name, f.dataType, True) for f in key_fields], *[T.StructField(f"r{i}", spark_type(u.udaf.return_type)) for i, u in enumerate(calls)]])
    states = wide.mapInArrow(partial, schema)
    grouped = states.groupBy(*[f"k{i}" for i in range(nk)]).applyInArrow(final, done)
    return grouped.toDF(*names, *[u.name for u in calls])


udf, udaf = ScalarUDF.udf, AggregateUDF.udaf
