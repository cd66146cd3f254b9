"""Expressions: a thin layer over Column that can still be refined (filter, order, frame) before it is built."""

from __future__ import annotations

import dataclasses
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from enum import Enum
from typing import Any

import pyarrow as pa
from pyspark import SparkContext
from pyspark.sql import Column, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Arrow types that may be cast to, and the Python types that stand for some.
_PYTHON_TYPES = {float: "double", int: "bigint", str: "string", bool: "boolean"}


class NullTreatment(Enum):
    RESPECT_NULLS = 0
    IGNORE_NULLS = 1


class WindowFrameBound:
    """One end of a frame: None is unbounded, 0 the current row, else an offset before or after."""

    def __init__(self, offset: int | None, preceding: bool) -> None:
        self._offset, self._preceding = offset, preceding

    def get_offset(self) -> int | None:
        return self._offset

    def is_current_row(self) -> bool:
        return self._offset == 0

    def is_following(self) -> bool:
        return not self._preceding

    def is_preceding(self) -> bool:
        return self._preceding

    def is_unbounded(self) -> bool:
        return self._offset is None

    def signed(self) -> int:
        """The bound as Spark counts it."""
        if self._offset is None:
            return Window.unboundedPreceding if self._preceding else Window.unboundedFollowing
        return -self._offset if self._preceding else self._offset


class WindowFrame:
    """``units`` is rows, range or groups; the bounds count rows, values or groups before and after, None without end."""

    def __init__(self, units: str, start_bound: int | None, end_bound: int | None) -> None:
        if units.lower() not in ("rows", "range", "groups"):
            raise ValueError(f"unknown frame units: {units}")
        self._units = units.lower()
        self._start, self._end = WindowFrameBound(start_bound, True), WindowFrameBound(end_bound, False)

    def get_frame_units(self) -> str:
        return self._units

    def get_lower_bound(self) -> WindowFrameBound:
        return self._start

    def get_upper_bound(self) -> WindowFrameBound:
        return self._end


@dataclass(frozen=True)
class Spec:
    """A call of an aggregate or window function with what refines it.

    ``make`` gives the Column of the plain call; it sees the spec, so filter, distinct and order are its own business.
    """

    name: str
    make: Callable[[Spec], Column]
    args: tuple[Any, ...] = ()
    distinct: bool = False
    filter: Any = None
    order_by: tuple[Any, ...] = ()
    nulls: NullTreatment | None = None
    partition_by: tuple[Any, ...] = ()
    frame: WindowFrame | None = None
    window_only: bool = False
    windowed: bool = False
    streaming: bool = False

    def kept(self, value: Column) -> Column:
        """``value`` where the filter holds, else null."""
        return value if self.filter is None else F.when(to_column(self.filter), value)

    def ignore_nulls(self) -> bool:
        return self.nulls is NullTreatment.IGNORE_NULLS

    def over(self) -> Any:
        w = Window.partitionBy(*[to_column(p) for p in self.partition_by])
        order = [to_sort(o) for o in self.order_by]
        if order:
            w = w.orderBy(*order)
        elif self.window_only or (self.frame and self.frame.get_frame_units() == "rows"):
            w = w.orderBy(F.lit(0))
        if self.frame is not None:
            units, lo, hi = self.frame.get_frame_units(), self.frame.get_lower_bound().signed(), self.frame.get_upper_bound().signed()
            if units == "groups":
                raise ValueError("a frame of groups needs a table: use it in select or with_column")
            w = w.rowsBetween(lo, hi) if units == "rows" else w.rangeBetween(lo, hi)
        return w

    def column(self) -> Column:
        if self.window_only or self.windowed:
            return self.make(dataclasses.replace(self, windowed=True)).over(self.over())
        return self.make(self)


class _ColumnOf:
    """On an expression its Column; on the class a maker of column references."""

    def __get__(self, e: Expr | None, owner: type) -> Any:
        return col if e is None else e._built()


class Expr:
    """An expression.  Comparisons and arithmetic give expressions; so ``==`` is no equality of objects."""

    __hash__ = object.__hash__

    def __init__(self, column: Column | None = None, *, spec: Spec | None = None, variant: str = "ScalarFunction", name: str | None = None, operands: Sequence[Any] = (), operator: str | None = None, value: Any = None, is_literal: bool = False) -> None:
        self._column, self.spec, self._variant = column, spec, variant
        self._name, self._operands, self._operator = name, list(operands), operator
        self._value, self.is_literal = value, is_literal

    column = _ColumnOf()

    def _built(self) -> Column:
        c = self.spec.column() if self.spec is not None else self._column
        return c.alias(self._name) if self.spec is not None and self._name else c

    # what it is
    def to_variant(self) -> Any:
        return self._value if self.is_literal else self

    def schema_name(self) -> str:
        return self._name or str(self.column).removeprefix("Column<'").removesuffix("'>")

    display_name = schema_name

    def canonical_name(self) -> str:
        return str(self.column)

    def variant_name(self) -> str:
        return self._variant

    def rex_type(self) -> str:
        return {"Column": "Reference", "Literal": "Literal"}.get(self._variant, "Call")

    def types(self) -> Any:
        if not self.is_literal:
            raise TypeError("only a literal has a type of its own")
        return pa.scalar(self._value).type

    def python_value(self) -> Any:
        if not self.is_literal:
            raise TypeError("not a literal")
        return self._value

    def rex_call_operands(self) -> list[Expr]:
        return [o if isinstance(o, Expr) else lit(o) for o in self._operands] or [self]

    def rex_call_operator(self) -> str:
        if self._operator is None and self.spec is None:
            raise TypeError("not a call")
        return self._operator or self.spec.name

    def column_name(self, plan: Any = None) -> str:
        return self.schema_name()

    def __repr__(self) -> str:
        return f"Expr({self.canonical_name()})"

    def __bool__(self) -> bool:
        raise ValueError("an expression has no truth value; combine conditions with &, | and ~")

    def __richcmp__(self, other: Any, op: int) -> Expr:
        return [self.__lt__, self.__le__, self.__eq__, self.__ne__, self.__gt__, self.__ge__][op](other)

    # operators
    def _two(self, op: str, other: Any, make: Callable[[Column, Column], Column]) -> Expr:
        return Expr(make(self.column, to_column(other)), variant="BinaryExpr", operands=[self, other], operator=op)

    def __add__(self, rhs: Any) -> Expr:
        return self._two("+", rhs, lambda a, b: a + b)

    def __radd__(self, lhs: Any) -> Expr:
        return lit(lhs) + self

    def __sub__(self, rhs: Any) -> Expr:
        return self._two("-", rhs, lambda a, b: a - b)

    def __rsub__(self, lhs: Any) -> Expr:
        return lit(lhs) - self

    def __mul__(self, rhs: Any) -> Expr:
        return self._two("*", rhs, lambda a, b: a * b)

    def __rmul__(self, lhs: Any) -> Expr:
        return lit(lhs) * self

    def __truediv__(self, rhs: Any) -> Expr:
        return self._two("/", rhs, lambda a, b: a / b)

    def __rtruediv__(self, lhs: Any) -> Expr:
        return lit(lhs) / self

    def __mod__(self, rhs: Any) -> Expr:
        return self._two("%", rhs, lambda a, b: a % b)

    def __rmod__(self, lhs: Any) -> Expr:
        return lit(lhs) % self

    def __and__(self, rhs: Any) -> Expr:
        return self._two("AND", rhs, lambda a, b: a & b)

    def __rand__(self, lhs: Any) -> Expr:
        return lit(lhs) & self

    def __or__(self, rhs: Any) -> Expr:
        return self._two("OR", rhs, lambda a, b: a | b)

    def __ror__(self, lhs: Any) -> Expr:
        return lit(lhs) | self

    def __invert__(self) -> Expr:
        return Expr(~self.column, variant="Not", operands=[self], operator="NOT")

    def __neg__(self) -> Expr:
        return Expr(-self.column, variant="Negative", operands=[self], operator="-")

    def __eq__(self, rhs: Any) -> Expr:  # type: ignore[override]
        return self._two("=", rhs, lambda a, b: a == b)

    def __ne__(self, rhs: Any) -> Expr:  # type: ignore[override]
        return self._two("!=", rhs, lambda a, b: a != b)

    def __ge__(self, rhs: Any) -> Expr:
        return self._two(">=", rhs, lambda a, b: a >= b)

    def __gt__(self, rhs: Any) -> Expr:
        return self._two(">", rhs, lambda a, b: a > b)

    def __le__(self, rhs: Any) -> Expr:
        return self._two("<=", rhs, lambda a, b: a <= b)

    def __lt__(self, rhs: Any) -> Expr:
        return self._two("<", rhs, lambda a, b: a < b)

    def __getitem__(self, key: str | int) -> Expr:
        """A field by name, or an element by position from 0 (null beyond the end)."""
        c = self.column.getField(key) if isinstance(key, str) else F.get(self.column, F.lit(key))
        return Expr(c, operands=[self, key], operator="get")

    def field(self, name: str) -> Expr:
        return self[name]

    # makers
    @staticmethod
    def literal(value: Any) -> Expr:
        return lit(value)

    def alias(self, name: str) -> Expr:
        if self.spec is not None:
            return Expr(spec=self.spec, variant="Alias", name=name, operands=[self])
        return Expr(self._column.alias(name), variant="Alias", name=name, operands=[self], value=self._value, is_literal=self.is_literal)

    def sort(self, ascending: bool = True, nulls_first: bool = True) -> SortExpr:
        return SortExpr(self, ascending, nulls_first)

    def is_null(self) -> Expr:
        return Expr(self.column.isNull(), variant="IsNull", operands=[self], operator="IS NULL")

    def is_not_null(self) -> Expr:
        return Expr(self.column.isNotNull(), variant="IsNotNull", operands=[self], operator="IS NOT NULL")

    def cast(self, to: Any) -> Expr:
        return Expr(self.column.cast(to_spark_type(to)), variant="Cast", operands=[self], operator="CAST")

    def try_cast(self, to: Any) -> Expr:
        return Expr(self.column.try_cast(to_spark_type(to)), variant="TryCast", operands=[self], operator="TRY_CAST")

    def between(self, low: Any, high: Any, negated: bool = False) -> Expr:
        c = self.column.between(to_column(low), to_column(high))
        return Expr(~c if negated else c, variant="Between", operands=[self, low, high], operator="BETWEEN")

    def like(self, pattern: str) -> Expr:
        return Expr(self.column.like(pattern), variant="Like", operands=[self, pattern], operator="LIKE")

    def ilike(self, pattern: str) -> Expr:
        return Expr(self.column.ilike(pattern), variant="ILike", operands=[self, pattern], operator="ILIKE")

    def similar_to(self, pattern: str) -> Expr:
        return Expr(self.column.rlike(similar_to_regex(pattern)), variant="SimilarTo", operands=[self, pattern], operator="SIMILAR TO")

    # refinements of aggregates and window functions
    def _refine(self, **kw: Any) -> Expr:
        if self.spec is None:
            raise TypeError("only an aggregate or window function can be refined")
        return Expr(spec=dataclasses.replace(self.spec, **kw), variant="WindowFunction" if kw.keys() & {"partition_by", "frame"} else self._variant, name=self._name)

    def order_by(self, *exprs: Any) -> ExprFuncBuilder:
        return ExprFuncBuilder(self).order_by(*exprs)

    def filter(self, filter: Any) -> ExprFuncBuilder:
        return ExprFuncBuilder(self).filter(filter)

    def distinct(self) -> ExprFuncBuilder:
        return ExprFuncBuilder(self).distinct()

    def null_treatment(self, null_treatment: NullTreatment) -> ExprFuncBuilder:
        return ExprFuncBuilder(self).null_treatment(null_treatment)

    def partition_by(self, *partition_by: Any) -> ExprFuncBuilder:
        return ExprFuncBuilder(self).partition_by(*partition_by)

    def window_frame(self, window_frame: WindowFrame) -> ExprFuncBuilder:
        return ExprFuncBuilder(self).window_frame(window_frame)

    def over(self, partition_by: Sequence[Any] = (), order_by: Sequence[Any] = (), window_frame: WindowFrame | None = None) -> Expr:
        """The function over a window."""
        return self._refine(windowed=True, partition_by=tuple(partition_by), order_by=tuple(order_by), frame=window_frame)


class ExprFuncBuilder:
    """Collects refinements; ``build`` gives the expression."""

    def __init__(self, expr: Expr) -> None:
        self._expr = expr

    def order_by(self, *exprs: Any) -> ExprFuncBuilder:
        return ExprFuncBuilder(self._expr._refine(order_by=tuple(exprs)))

    def filter(self, filter: Any) -> ExprFuncBuilder:
        return ExprFuncBuilder(self._expr._refine(filter=filter))

    def distinct(self) -> ExprFuncBuilder:
        return ExprFuncBuilder(self._expr._refine(distinct=True))

    def null_treatment(self, null_treatment: NullTreatment) -> ExprFuncBuilder:
        return ExprFuncBuilder(self._expr._refine(nulls=null_treatment))

    def partition_by(self, *partition_by: Any) -> ExprFuncBuilder:
        return ExprFuncBuilder(self._expr._refine(partition_by=tuple(partition_by), windowed=True))

    def window_frame(self, window_frame: WindowFrame) -> ExprFuncBuilder:
        return ExprFuncBuilder(self._expr._refine(frame=window_frame, windowed=True))

    def build(self) -> Expr:
        return self._expr


class SortExpr:
    """An expression with its direction and the place of nulls; ascending with nulls first by default."""

    def __init__(self, expr: Any, ascending: bool = True, nulls_first: bool = True) -> None:
        self._expr, self._ascending, self._nulls_first = expr, ascending, nulls_first

    def expr(self) -> Any:
        return self._expr

    def ascending(self) -> bool:
        return self._ascending

    def nulls_first(self) -> bool:
        return self._nulls_first

    @property
    def column(self) -> Column:
        c = to_column(self._expr)
        if self._ascending:
            return c.asc_nulls_first() if self._nulls_first else c.asc_nulls_last()
        return c.desc_nulls_first() if self._nulls_first else c.desc_nulls_last()

    def __repr__(self) -> str:
        return f"SortExpr({self._expr!r}, ascending={self._ascending}, nulls_first={self._nulls_first})"


class CaseBuilder:
    """A CASE, with or without a base expression; without ``otherwise`` it ends in null."""

    def __init__(self, base: Any = None, cases: Sequence[tuple[Any, Any]] = ()) -> None:
        self._base, self._cases = base, list(cases)

    def when(self, when_expr: Any, then_expr: Any) -> CaseBuilder:
        return CaseBuilder(self._base, [*self._cases, (when_expr, then_expr)])

    def _chain(self) -> Column:
        if not self._cases:
            raise ValueError("a CASE needs a WHEN")
        c = None
        for w, t in self._cases:
            cond = to_column(w) if self._base is None else to_column(self._base) == to_column(w)
            c = F.when(cond, to_column(t)) if c is None else c.when(cond, to_column(t))
        return c

    def otherwise(self, else_expr: Any) -> Expr:
        return Expr(self._chain().otherwise(to_column(else_expr)), variant="Case", operator="CASE")

    def end(self) -> Expr:
        return Expr(self._chain(), variant="Case", operator="CASE")


def _session() -> None:
    """Expressions are Spark's from the start, so the first one starts a session if there is none."""
    from pyspark.sql import SparkSession

    if SparkSession.getActiveSession() is None and SparkContext._active_spark_context is None:
        SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()


def col(name: str) -> Expr:
    _session()
    return Expr(F.col(name), variant="Column", name=None, operands=[], value=name)


column = col


def lit(value: Any) -> Expr:
    if isinstance(value, Expr):
        return value
    if isinstance(value, pa.Scalar):
        value = value.as_py()
    _session()
    return Expr(F.lit(value), variant="Literal", value=value, is_literal=True)


literal = lit


def to_column(x: Any) -> Column:
    """A Column of whatever stands for an expression; plain values are literals."""
    if isinstance(x, ExprFuncBuilder):
        x = x.build()
    if isinstance(x, CaseBuilder):
        return x.end().column
    if isinstance(x, Expr):
        return x.column
    if isinstance(x, Column):
        return x
    return F.lit(x)


def to_named(x: Any) -> Column:
    """As :func:`to_column`, but a string names a column."""
    return F.col(x) if isinstance(x, str) else to_column(x)


def to_sort(x: Any) -> Column:
    """A sort key; without a direction ascending with nulls first."""
    if isinstance(x, SortExpr):
        return x.column
    return to_named(x).asc_nulls_first()


def as_sort(x: Any) -> SortExpr:
    return x if isinstance(x, SortExpr) else SortExpr(col(x) if isinstance(x, str) else x)


def to_spark_type(to: Any) -> Any:
    if isinstance(to, type) and to in _PYTHON_TYPES:
        return _PYTHON_TYPES[to]
    if isinstance(to, pa.DataType):
        from pyspark.sql.pandas.types import from_arrow_type

        if pa.types.is_unsigned_integer(to):  # the next type that holds all its values
            return {8: T.ShortType(), 16: T.IntegerType(), 32: T.LongType(), 64: T.DecimalType(20, 0)}[to.bit_width]
        if pa.types.is_float16(to):
            return T.FloatType()
        if pa.types.is_timestamp(to) and to.unit != "us":
            to = pa.timestamp("us", to.tz)
        return from_arrow_type(to)
    return to


def similar_to_regex(pattern: str) -> str:
    """The regular expression of a SIMILAR TO pattern: % and _ as in LIKE; | * + ? {} () [] as they are; others literal."""
    out, i, inside = [], 0, False
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\" and i + 1 < len(pattern):
            i += 1
            out.append("\\" + pattern[i])
        elif inside:
            inside = ch != "]"
            out.append(ch)
        elif ch == "%":
            out.append(".*")
        elif ch == "_":
            out.append(".")
        elif ch in ".^$\\":
            out.append("\\" + ch)
        else:
            inside = ch == "["
            out.append(ch)
        i += 1
    return "(?s)^(?:" + "".join(out) + ")$"


def grouped_frames(exprs: Sequence[Any]) -> tuple[list[tuple[str, Column]], list[Any]]:
    """Rewrites frames of groups: the rank columns to add to the table, and the expressions over ranges of ranks."""
    added: list[tuple[str, Column]] = []
    out: list[Any] = []
    for e in exprs:
        e = e.build() if isinstance(e, ExprFuncBuilder) else e
        f = e.spec.frame if isinstance(e, Expr) and e.spec is not None else None
        if f is None or f.get_frame_units() != "groups":
            out.append(e)
            continue
        name = f"_group_{len(added)}"
        added.append((name, dataclasses.replace(e.spec, make=lambda s: F.dense_rank(), frame=None, window_only=True).column()))
        lo, hi = f.get_lower_bound(), f.get_upper_bound()
        out.append(e._refine(order_by=(F.col(name),), frame=WindowFrame("range", lo.get_offset(), hi.get_offset())))
    return added, out
