"""Event-time analytics on PySpark: streams and tables under one fluent interface."""

from millrace import functions
from millrace.context import Context
from millrace.expr import CaseBuilder, Expr, NullTreatment, SortExpr, WindowFrame, col, column, lit, literal
from millrace.frame import DataFrame
from millrace.session import RuntimeConfig, SessionConfig, SessionContext, SQLOptions
from millrace.sources.kafka import KafkaTopicBuilder
from millrace.sources.timeunits import TimestampUnit
from millrace.stream import DataStream, FeastDataStream
from millrace.udf import Accumulator, AggregateUDF, ScalarUDF, Volatility, udaf, udf

__all__ = [
    "Accumulator", "AggregateUDF", "CaseBuilder", "Context", "DataFrame", "DataStream", "Expr", "FeastDataStream", "KafkaTopicBuilder", "NullTreatment", "RuntimeConfig",
    "SQLOptions", "ScalarUDF", "SessionConfig", "SessionContext", "SortExpr", "TimestampUnit", "Volatility", "WindowFrame", "col", "column", "functions", "lit", "literal", "udaf", "udf",
]
