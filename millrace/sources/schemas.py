"""Schemas from one sample JSON document or from an Avro schema."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import types as T


def from_json_sample(sample: str | dict[str, Any]) -> T.StructType:
    """The schema of a sample document: whole numbers are long, others double, texts string; nulls and empty arrays count as
    string; arrays take the type of their first element.  All fields may be null and keep their order."""
    doc = json.loads(sample) if isinstance(sample, (str, bytes)) else sample
    if not isinstance(doc, dict):
        raise ValueError("the sample must be a JSON object")
    return _of_json(doc)


def _of_json(v: Any) -> T.DataType:
    if isinstance(v, bool):
        return T.BooleanType()
    if isinstance(v, int):
        return T.LongType() if -(1 << 63) <= v < 1 << 63 else T.DoubleType()
    if isinstance(v, float):
        return T.DoubleType()
    if isinstance(v, list):
        return T.ArrayType(_of_json(v[0]) if v else T.StringType())
    if isinstance(v, dict):
        return T.StructType([T.StructField(k, _of_json(x)) for k, x in v.items()])
    return T.StringType()


#: Avro's plain and logical types.
_AVRO = {"null": T.StringType, "boolean": T.BooleanType, "int": T.IntegerType, "long": T.LongType, "float": T.FloatType, "double": T.DoubleType, "bytes": T.BinaryType, "string": T.StringType}
_LOGICAL = {
    "date": T.DateType, "time-millis": T.IntegerType, "time-micros": T.LongType, "timestamp-millis": T.TimestampType, "timestamp-micros": T.TimestampType,
    "local-timestamp-millis": T.TimestampNTZType, "local-timestamp-micros": T.TimestampNTZType, "uuid": T.StringType, "duration": T.BinaryType,
}


def from_avro_schema(schema: str | dict[str, Any]) -> T.StructType:
    """The schema of an Avro record; a union with null may be null, other unions are structs of their members."""
    s = json.loads(schema) if isinstance(schema, str) else schema
    got, _ = _of_avro(s, {})
    if not isinstance(got, T.StructType):
        raise ValueError("the schema must be a record")
    return got


def _of_avro(s: Any, named: dict[str, Any]) -> tuple[T.DataType, bool]:
    """The type, and whether it may be null."""
    if isinstance(s, str):
        if s in named:
            return named[s]
        if s not in _AVRO:
            raise ValueError(f"unknown Avro type {s}")
        return _AVRO[s](), s == "null"
    if isinstance(s, list):
        rest = [x for x in s if x != "null"]
        if len(rest) == 1:
            return _of_avro(rest[0], named)[0], True
        return T.StructType([T.StructField(f"member{i}", _of_avro(x, named)[0]) for i, x in enumerate(rest)]), "null" in s
    kind, logical = s["type"], s.get("logicalType")
    if logical == "decimal":
        return T.DecimalType(s["precision"], s.get("scale", 0)), False
    if logical in _LOGICAL and kind != "record":
        return _LOGICAL[logical](), False
    if kind == "record":
        fields = []
        for f in s["fields"]:
            t, null = _of_avro(f["type"], named)
            meta = {f"avro::{k}": json.dumps(f[k]) if not isinstance(f[k], str) else f[k] for k in ("doc", "aliases") if k in f}
            fields.append(T.StructField(f["name"], t, null, meta))
        out = T.StructType(fields)
        named[s["name"]] = (out, False)
        return out, False
    if kind == "enum":
        named[s["name"]] = (T.StringType(), False)
        return T.StringType(), False
    if kind == "fixed":
        named[s["name"]] = (T.BinaryType(), False)
        return T.BinaryType(), False
    if kind == "array":
        t, null = _of_avro(s["items"], named)
        return T.ArrayType(t, null), False
    if kind == "map":
        t, null = _of_avro(s["values"], named)
        return T.MapType(T.StringType(), t, null), False
    return _of_avro(kind, named)
