"""Reading Avro object containers, for messages that hold one each.

Spark's own reader wants bare datums and a package that may be missing; this one needs nothing.
"""

from __future__ import annotations

import datetime
import decimal
import io
import json
import struct
import zlib
from typing import Any

MAGIC = b"Obj\x01"


class AvroError(ValueError):
    """Bytes that are no Avro container of the expected kind."""


def _long(f: io.BytesIO) -> int:
    shift = value = 0
    while True:
        b = f.read(1)
        if not b:
            raise AvroError("unexpected end")
        value |= (b[0] & 0x7F) << shift
        if not b[0] & 0x80:
            return (value >> 1) ^ -(value & 1)
        shift += 7


def _bytes(f: io.BytesIO) -> bytes:
    n = _long(f)
    got = f.read(n) if n >= 0 else b""
    if n < 0 or len(got) != n:
        raise AvroError("unexpected end")
    return got


def _unpacked(f: io.BytesIO, kind: str) -> Any:
    size = struct.calcsize(kind)
    got = f.read(size)
    if len(got) != size:
        raise AvroError("unexpected end")
    return struct.unpack(kind, got)[0]


def _blocks(f: io.BytesIO):
    while n := _long(f):
        if n < 0:
            _long(f)  # the size of the block
            n = -n
        yield from range(n)


def read_datum(f: io.BytesIO, s: Any, named: dict[str, Any]) -> Any:
    """One value of the schema ``s`` as plain Python."""
    if isinstance(s, list):
        i = _long(f)
        if not 0 <= i < len(s):
            raise AvroError("no such member of a union")
        v = read_datum(f, s[i], named)
        rest = [x for x in s if x != "null"]
        if len(rest) < 2 or s[i] == "null":
            return v
        return {f"member{k}": v if x is s[i] else None for k, x in enumerate(rest)}
    if isinstance(s, str):
        s = named.get(s, {"type": s})
    kind, logical = s["type"], s.get("logicalType")
    if isinstance(kind, (list, dict)):
        return read_datum(f, kind, named)
    if "name" in s:
        named[s["name"]] = s
    if kind == "null":
        return None
    if kind == "boolean":
        return _unpacked(f, "?")
    if kind in ("int", "long"):
        n = _long(f)
        if logical == "date":
            return datetime.date(1970, 1, 1) + datetime.timedelta(n)
        if logical and "timestamp" in logical:
            zone = None if logical.startswith("local") else datetime.UTC
            return datetime.datetime(1970, 1, 1, tzinfo=zone) + datetime.timedelta(microseconds=n * (1000 if logical.endswith("millis") else 1))
        return n
    if kind == "float":
        return _unpacked(f, "<f")
    if kind == "double":
        return _unpacked(f, "<d")
    if kind in ("bytes", "fixed"):
        if kind == "bytes":
            b = _bytes(f)
        elif len(b := f.read(s["size"])) != s["size"]:
            raise AvroError("unexpected end")
        if logical == "decimal":
            return decimal.Decimal(int.from_bytes(b, "big", signed=True)).scaleb(-s.get("scale", 0))
        return b
    if kind == "string":
        return _bytes(f).decode()
    if kind == "enum":
        return s["symbols"][_long(f)]
    if kind == "array":
        return [read_datum(f, s["items"], named) for _ in _blocks(f)]
    if kind == "map":
        return {_bytes(f).decode(): read_datum(f, s["values"], named) for _ in _blocks(f)}
    if kind == "record":
        return {x["name"]: read_datum(f, x["type"], named) for x in s["fields"]}
    if kind in named:
        return read_datum(f, named[kind], named)
    raise AvroError(f"unknown type {kind}")


def read_container(data: bytes) -> list[dict[str, Any]]:
    """The records of an object container; null and deflate codecs."""
    f = io.BytesIO(data)
    if f.read(4) != MAGIC:
        raise AvroError("no Avro object container")
    meta: dict[str, bytes] = {}
    for _ in _blocks(f):
        k = _bytes(f).decode()
        meta[k] = _bytes(f)
    schema, codec = json.loads(meta["avro.schema"]), meta.get("avro.codec", b"null").decode()
    sync, out = f.read(16), []
    while f.tell() < len(data):
        n, block = _long(f), _bytes(f)
        if codec == "deflate":
            block = zlib.decompress(block, -15)
        elif codec != "null":
            raise AvroError(f"unsupported codec {codec}")
        b = io.BytesIO(block)
        named: dict[str, Any] = {}
        out += [read_datum(b, schema, named) for _ in range(n)]
        if f.read(16) != sync:
            raise AvroError("a block ends without its mark")
    return out
