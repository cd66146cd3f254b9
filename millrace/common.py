"""Names of types and plan nodes, and what they come to in Spark."""

from __future__ import annotations

from dataclasses import dataclass, field
from enum import Enum
from typing import Any

import pyarrow as pa

from millrace.expr import Expr, SortExpr, as_sort, to_column, to_sort


class RexType(Enum):
    Reference = 0
    Literal = 1
    Call = 2
    Alias = 3
    Other = 4


class PythonType(Enum):
    Array = 0
    Bool = 1
    Bytes = 2
    Datetime = 3
    Float = 4
    Int = 5
    List = 6
    Object = 7
    Str = 8


class SqlType(Enum):
    ARRAY = 0
    BIGINT = 1
    BINARY = 2
    BOOLEAN = 3
    DATE = 4
    DECIMAL = 5
    DOUBLE = 6
    FLOAT = 7
    INTEGER = 8
    MAP = 9
    SMALLINT = 10
    STRUCT = 11
    TIMESTAMP = 12
    TINYINT = 13
    VARCHAR = 14


@dataclass(frozen=True)
class DataTypeMap:
    """One type under its three names."""

    arrow_type: pa.DataType
    python_type: PythonType
    sql_type: SqlType

    @staticmethod
    def of(t: pa.DataType) -> DataTypeMap:
        for test, py, sql in _KINDS:
            if test(t):
                return DataTypeMap(t, py, sql)
        return DataTypeMap(t, PythonType.Object, SqlType.BINARY)


_P, _Q = PythonType, SqlType
_KINDS = [
    (pa.types.is_boolean, _P.Bool, _Q.BOOLEAN), (pa.types.is_int8, _P.Int, _Q.TINYINT), (pa.types.is_int16, _P.Int, _Q.SMALLINT), (pa.types.is_int32, _P.Int, _Q.INTEGER), (pa.types.is_integer, _P.Int, _Q.BIGINT),
    (pa.types.is_float32, _P.Float, _Q.FLOAT), (pa.types.is_floating, _P.Float, _Q.DOUBLE), (pa.types.is_decimal, _P.Float, _Q.DECIMAL), (pa.types.is_string, _P.Str, _Q.VARCHAR), (pa.types.is_large_string, _P.Str, _Q.VARCHAR),
    (pa.types.is_binary, _P.Bytes, _Q.BINARY), (pa.types.is_date, _P.Datetime, _Q.DATE), (pa.types.is_timestamp, _P.Datetime, _Q.TIMESTAMP), (pa.types.is_map, _P.Object, _Q.MAP), (pa.types.is_list, _P.List, _Q.ARRAY), (pa.types.is_struct, _P.Object, _Q.STRUCT),
]
DataType = pa.DataType


@dataclass
class SqlFunction:
    name: str
    return_type: Any = None
    input_types: list[Any] = field(default_factory=list)


@dataclass
class SqlStatistics:
    row_count: float


@dataclass
class SqlTable:
    name: str
    columns: list[tuple[str, Any]] = field(default_factory=list)
    statistics: SqlStatistics | None = None


@dataclass
class SqlView:
    name: str
    definition: str


@dataclass
class SqlSchema:
    name: str
    tables: list[SqlTable] = field(default_factory=list)
    views: list[SqlView] = field(default_factory=list)
    functions: list[SqlFunction] = field(default_factory=list)


DFSchema = pa.Schema

#: Names of plan nodes and expressions, and Spark's for the same.
VARIANTS = {
    "Alias": "Alias", "Analyze": "EXPLAIN with metrics", "Aggregate": "Aggregate", "AggregateFunction": "AggregateExpression", "Between": "Between", "BinaryExpr": "BinaryOperator", "Case": "CaseWhen", "Cast": "Cast",
    "Column": "AttributeReference", "CreateMemoryTable": "CreateViewCommand", "CreateView": "CreateViewCommand", "CrossJoin": "Join Cross", "Distinct": "Distinct", "DropTable": "DropTableCommand", "EmptyRelation": "LocalRelation <empty>",
    "Exists": "Exists", "Explain": "ExplainCommand", "Extension": "EventTimeWatermark", "Filter": "Filter", "GroupingSet": "Expand", "Join": "Join", "ILike": "ILike", "InList": "In", "InSubquery": "InSubquery", "IsFalse": "IS FALSE",
    "IsNotTrue": "IS NOT TRUE", "IsNull": "IsNull", "IsTrue": "IS TRUE", "IsUnknown": "IS UNKNOWN", "IsNotFalse": "IS NOT FALSE", "IsNotNull": "IsNotNull", "IsNotUnknown": "IS NOT UNKNOWN", "JoinConstraint": "UsingJoin", "JoinType": "JoinType",
    "Like": "Like", "Limit": "GlobalLimit", "Literal": "Literal", "Negative": "UnaryMinus", "Not": "Not", "Partitioning": "RepartitionByExpression", "Placeholder": "NamedParameter", "Projection": "Project", "Repartition": "Repartition",
    "ScalarSubquery": "ScalarSubquery", "ScalarVariable": "VariableReference", "SimilarTo": "RLike", "Sort": "Sort", "Subquery": "SubqueryExpression", "SubqueryAlias": "SubqueryAlias", "TableScan": "Relation", "TryCast": "TryCast", "Union": "Union",
    "Unnest": "Generate", "UnnestExpr": "Explode", "Window": "Window",
}


def plan_nodes(frame: Any) -> list[str]:
    """The names of the nodes of the optimized plan, from the root down."""
    known = {v.split()[0]: k for k, v in reversed(list(VARIANTS.items()))}
    out = []

    def walk(p: Any) -> None:
        out.append(known.get(p.nodeName().split()[0], p.nodeName()))
        kids = p.children()
        for i in range(kids.size()):
            walk(kids.apply(i))

    walk(frame.df._jdf.queryExecution().optimizedPlan())
    return out


def expr_list_to_raw_expr_list(exprs: list[Any] | Any | None) -> list[Any] | None:
    """Columns of one or several expressions."""
    if exprs is None:
        return None
    return [to_column(e) for e in (exprs if isinstance(exprs, list) else [exprs])]


def sort_or_default(e: Expr | SortExpr) -> Any:
    """A sort key; ascending with nulls first if it says nothing."""
    return as_sort(e).column


def sort_list_to_raw_sort_list(keys: list[Any] | None) -> list[Any] | None:
    return None if keys is None else [to_sort(k) for k in keys]
