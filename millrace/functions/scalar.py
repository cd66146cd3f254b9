"""Scalar functions: conditional, numeric, text, regular expressions, hashes, dates and times.

All are built-in expressions, so they stay inside generated code; where Spark's function of the name means something else, the
meaning here is composed from others.  The choices are listed in SEMANTICS.md.
"""

from __future__ import annotations

import datetime
import re
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.expr import CaseBuilder, Expr, SortExpr, to_column

c = to_column


def _e(column: Column, *operands: Any, name: str = "") -> Expr:
    return Expr(column, operands=operands, operator=name or None)


def _call(name: str, *args: Any) -> Expr:
    return Expr(F.call_function(name, *[c(a) for a in args]), operands=args, operator=name)


def _value(x: Any) -> Any:
    """The Python value of a literal or plain value, None for other expressions."""
    if isinstance(x, Expr):
        return x.python_value() if x.is_literal else None
    return None if isinstance(x, Column) else x


#: name -> (Spark's function, argument names): the functions that mean the same in Spark.
SAME = {
    "nullif": ("nullif", "expr1 expr2"), "abs": ("abs", "arg"), "acos": ("acos", "arg"), "acosh": ("acosh", "arg"), "ascii": ("ascii", "arg"),
    "asin": ("asin", "arg"), "asinh": ("asinh", "arg"), "atan": ("atan", "arg"), "atanh": ("atanh", "arg"), "atan2": ("atan2", "y x"),
    "bit_length": ("bit_length", "arg"), "btrim": ("btrim", "arg"), "cbrt": ("cbrt", "arg"), "character_length": ("char_length", "arg"),
    "length": ("char_length", "string"), "char_length": ("char_length", "string"), "cos": ("cos", "arg"), "cosh": ("cosh", "arg"), "cot": ("cot", "arg"),
    "degrees": ("degrees", "arg"), "ends_with": ("endswith", "arg suffix"), "exp": ("exp", "arg"), "factorial": ("factorial", "arg"),
    "find_in_set": ("find_in_set", "string string_list"), "levenshtein": ("levenshtein", "string1 string2"), "ln": ("ln", "arg"), "log10": ("log10", "arg"),
    "log2": ("log2", "arg"), "lower": ("lower", "arg"), "ltrim": ("ltrim", "arg"), "md5": ("md5", "arg"), "nanvl": ("nanvl", "x y"),
    "octet_length": ("octet_length", "arg"), "pi": ("pi", ""), "power": ("power", "base exponent"), "pow": ("power", "base exponent"), "radians": ("radians", "arg"),
    "repeat": ("repeat", "string n"), "replace": ("replace", "string from_val to_val"), "reverse": ("reverse", "arg"), "rtrim": ("rtrim", "arg"),
    "signum": ("signum", "arg"), "sin": ("sin", "arg"), "sinh": ("sinh", "arg"), "split_part": ("split_part", "string delimiter index"), "sqrt": ("sqrt", "arg"),
    "starts_with": ("startswith", "string prefix"), "substr_index": ("substring_index", "string delimiter count"), "tan": ("tan", "arg"), "tanh": ("tanh", "arg"),
    "translate": ("translate", "string from_val to_val"), "trim": ("trim", "arg"), "upper": ("upper", "arg"), "current_date": ("current_date", ""), "now": ("current_timestamp", ""),
    "random": ("rand", ""), "make_date": ("make_date", "year month day"),
}


def _same(name: str, spark: str, args: list[str]):
    def f(*values: Any) -> Expr:
        if len(values) != len(args):
            raise TypeError(f"{name} takes {len(args)} arguments: {', '.join(args)}")
        return _call(spark, *values)

    f.__name__ = f.__qualname__ = name
    f.__doc__ = f"{name}({', '.join(args)}): Spark's ``{spark}``."
    return f


for _name, (_spark, _args) in SAME.items():
    globals()[_name] = _same(_name, _spark, _args.split())


# conditional and general


def isnan(expr: Any) -> Expr:
    """Whether a number is not-a-number; null for null."""
    return _e(F.when(c(expr).isNotNull(), F.isnan(c(expr))), expr, name="isnan")


def iszero(arg: Any) -> Expr:
    """Whether a number is +0.0 or -0.0; null for null."""
    return _e(c(arg) == 0, arg, name="iszero")


def coalesce(*args: Any) -> Expr:
    """The first argument that is not null."""
    return _e(F.coalesce(*[c(a) for a in args]), *args, name="coalesce")


def in_list(arg: Any, values: list[Any], negated: bool = False) -> Expr:
    """Whether ``arg`` is one of ``values``."""
    got = c(arg).isin(*[c(v) for v in values])
    return Expr(~got if negated else got, variant="InList", operands=[arg, *values], operator="IN")


def order_by(expr: Any, ascending: bool = True, nulls_first: bool = True) -> SortExpr:
    """A sort key."""
    return SortExpr(expr, ascending, nulls_first)


def alias(expr: Any, name: str) -> Expr:
    """``expr`` under another name."""
    return (expr if isinstance(expr, Expr) else Expr(c(expr))).alias(name)


def col(name: str) -> Expr:
    """A column by name."""
    from millrace.expr import col as make

    return make(name)


def case(expr: Any) -> CaseBuilder:
    """A CASE over the values of ``expr``."""
    return CaseBuilder(expr)


def when(when: Any, then: Any) -> CaseBuilder:
    """A CASE over conditions."""
    return CaseBuilder().when(when, then)


def arrow_typeof(arg: Any) -> Expr:
    """The Arrow name of the argument's type; nested types keep Spark's name."""
    names = {"tinyint": "Int8", "smallint": "Int16", "int": "Int32", "bigint": "Int64", "float": "Float32", "double": "Float64", "string": "Utf8", "binary": "Binary", "boolean": "Boolean", "date": "Date32", "void": "Null"}
    kind = F.typeof(c(arg))
    out = F.when(F.lit(False), F.lit(""))
    for spark, arrow in names.items():
        out = out.when(kind == spark, F.lit(arrow))
    out = out.when(kind == "timestamp", F.lit('Timestamp(Microsecond, Some("UTC"))')).when(kind == "timestamp_ntz", F.lit("Timestamp(Microsecond, None)"))
    return _e(out.when(kind.startswith("decimal"), F.concat(F.lit("Decimal128"), F.replace(F.substring(kind, 8, 20), F.lit(","), F.lit(", ")))).otherwise(kind), arg)


def uuid(arg: Any = None) -> Expr:
    """A random version 4 UUID as text; the argument is not used."""
    return _e(F.expr("uuid()"), name="uuid")


def struct(*args: Any) -> Expr:
    """A struct of the arguments, named c0, c1, ..."""
    return _e(F.struct(*[c(a).alias(f"c{i}") for i, a in enumerate(args)]), *args, name="struct")


def named_struct(name_pairs: list[tuple[str, Any]]) -> Expr:
    """A struct of (name, expression) pairs."""
    return _e(F.struct(*[c(v).alias(n) for n, v in name_pairs]), *[v for _, v in name_pairs], name="named_struct")


# numbers


def ceil(arg: Any) -> Expr:
    """The nearest integer at or above, as a double."""
    return _e(F.ceil(c(arg)).cast("double"), arg, name="ceil")


def floor(arg: Any) -> Expr:
    """The nearest integer at or below, as a double."""
    return _e(F.floor(c(arg)).cast("double"), arg, name="floor")


def round(value: Any, decimal_places: Any = 0) -> Expr:
    """Rounded half away from zero."""
    return _call("round", value, F.lit(_value(decimal_places)) if _value(decimal_places) is not None else decimal_places)


def trunc(num: Any, precision: Any = 0) -> Expr:
    """Cut towards zero at ``precision`` decimal places."""
    k = F.pow(F.lit(10.0), c(precision))
    x = c(num)
    return _e(F.signum(x) * F.floor(F.abs(x) * k) / k, num, precision, name="trunc")


def log(base: Any, num: Any) -> Expr:
    """The logarithm of ``num`` to ``base``."""
    return _call("log", base, num)


def gcd(x: Any, y: Any) -> Expr:
    """The greatest common divisor, never negative: Euclid's steps, at most 93 for 64 bits, as one fold."""
    a, b = F.abs(c(x).cast("bigint")), F.abs(c(y).cast("bigint"))
    start = F.struct(a.alias("a"), b.alias("b"))
    step = F.aggregate(F.sequence(F.lit(1), F.lit(93)), start, lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), F.try_mod(s["a"], s["b"]).alias("b"))))
    return _e(F.when(a.isNotNull() & b.isNotNull(), step["a"]), x, y, name="gcd")


def lcm(x: Any, y: Any) -> Expr:
    """The least common multiple, 0 if either is 0."""
    a, b = F.abs(c(x).cast("bigint")), F.abs(c(y).cast("bigint"))
    return _e(F.when((a == 0) | (b == 0), F.lit(0).cast("bigint")).otherwise(a * _div(b, c(gcd(x, y)))), x, y, name="lcm")


def _div(a: Column, b: Column) -> Column:
    """Whole division of non-negative integers that divide evenly."""
    return F.floor(a.cast("decimal(38,0)") / F.when(b != 0, b).cast("decimal(20,0)")).cast("bigint")


# text


def chr(arg: Any) -> Expr:
    """The character of a code point."""
    code = F.lpad(F.hex(c(arg).cast("bigint")), 8, "0")
    return _e(F.decode(F.unhex(code), "UTF-32"), arg, name="chr")


def concat(*args: Any) -> Expr:
    """The texts of all arguments in a row; nulls are left out."""
    return _e(F.concat(*[F.coalesce(c(a).cast("string"), F.lit("")) for a in args]), *args, name="concat")


def concat_ws(separator: str, *args: Any) -> Expr:
    """The texts of the arguments that are not null, with ``separator`` between them."""
    return _e(F.call_function("concat_ws", c(separator), *[c(a).cast("string") for a in args]), *args, name="concat_ws")


def initcap(string: Any) -> Expr:
    """Each run of letters and digits with its first letter in upper case and the rest in lower case."""
    runs = F.regexp_extract_all(c(string), F.lit(r"([\p{L}\p{N}]+|[^\p{L}\p{N}]+)"), F.lit(1))
    cased = F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.lower(F.substr(r, F.lit(2)))))
    return _e(F.array_join(cased, ""), string, name="initcap")


def left(string: Any, n: Any) -> Expr:
    """The first ``n`` characters; a negative ``n`` leaves out so many at the end."""
    s, k = c(string), c(n)
    return _e(F.substr(s, F.lit(1), F.when(k >= 0, k).otherwise(F.greatest(F.char_length(s) + k, F.lit(0))).cast("int")), string, n, name="left")


def right(string: Any, n: Any) -> Expr:
    """The last ``n`` characters; a negative ``n`` leaves out so many at the start."""
    s, k = c(string), c(n)
    size = F.char_length(s)
    keep = F.least(F.when(k >= 0, k).otherwise(F.greatest(size + k, F.lit(0))), size)
    return _e(F.substr(s, (size - keep + 1).cast("int"), keep.cast("int")), string, n, name="right")


def lpad(string: Any, count: Any, characters: Any = None) -> Expr:
    """Filled up on the left to ``count`` characters, or cut on the right."""
    return _call("lpad", string, count, " " if characters is None else characters)


def rpad(string: Any, count: Any, characters: Any = None) -> Expr:
    """Filled up on the right to ``count`` characters, or cut."""
    return _call("rpad", string, count, " " if characters is None else characters)


def overlay(string: Any, substring: Any, start: Any, length: Any = None) -> Expr:
    """``substring`` put over ``length`` characters (as many as it has) from ``start``."""
    size = F.char_length(c(substring)) if length is None else c(length)
    return _call("overlay", string, substring, c(start).cast("int"), size.cast("int"))


def strpos(string: Any, substring: Any) -> Expr:
    """The place of ``substring`` from 1, or 0."""
    return _e(F.position(c(substring), c(string)), string, substring, name="strpos")


def substr(string: Any, position: Any) -> Expr:
    """From ``position`` (from 1; less counts as 1) to the end."""
    return _e(F.substr(c(string), F.greatest(c(position), F.lit(1)).cast("int")), string, position, name="substr")


def substring(string: Any, position: Any, length: Any) -> Expr:
    """``length`` characters from ``position``; places before 1 are counted but empty."""
    p = c(position)
    start = F.greatest(p, F.lit(1))
    return _e(F.substr(c(string), start.cast("int"), F.greatest(p + c(length) - start, F.lit(0)).cast("int")), string, position, length, name="substring")


def to_hex(arg: Any) -> Expr:
    """An integer in lower-case hexadecimal, negative ones in two's complement of 64 bits."""
    return _e(F.lower(F.hex(c(arg).cast("bigint"))), arg, name="to_hex")


instr = position = strpos


# binary texts and hashes


def encode(input: Any, encoding: Any) -> Expr:
    """Bytes as base64 without padding or as lower-case hex, by ``encoding``."""
    kind = str(_value(encoding)).lower()
    data = c(input).cast("binary")
    if kind == "base64":  # without the line breaks and padding that other writers add
        return _e(F.rtrim(F.regexp_replace(F.base64(data), "\r?\n", ""), F.lit("=")), input, name="encode")
    if kind == "hex":
        return _e(F.lower(F.hex(data)), input, name="encode")
    raise ValueError(f"unknown encoding {kind}: base64 or hex")


def decode(input: Any, encoding: Any) -> Expr:
    """The bytes of base64 (padded or not) or hex text."""
    kind = str(_value(encoding)).lower()
    text = c(input).cast("string")
    if kind == "base64":
        size = F.char_length(text)
        return _e(F.unbase64(F.rpad(text, F.ceil(size / 4).cast("int") * 4, F.lit("="))), input, name="decode")
    if kind == "hex":
        return _e(F.unhex(text), input, name="decode")
    raise ValueError(f"unknown encoding {kind}: base64 or hex")


def _sha(bits: int):
    def f(arg: Any) -> Expr:
        return _e(F.unhex(F.sha2(c(arg).cast("binary"), bits)), arg, name=f"sha{bits}")

    f.__name__ = f.__qualname__ = f"sha{bits}"
    f.__doc__ = f"The SHA-{bits} hash, as bytes."
    return f


sha224, sha256, sha384, sha512 = map(_sha, (224, 256, 384, 512))


def digest(value: Any, method: Any) -> Expr:
    """The hash of a text or bytes by ``method``: md5, sha224, sha256, sha384, sha512, blake2s or blake2b; as bytes.

    The blake2 hashes run in Arrow batches; blake3 is in no library at hand and is refused.
    """
    kind = str(_value(method)).lower()
    data = c(value).cast("binary")
    if kind == "md5":
        return _e(F.unhex(F.md5(data)), value, name="digest")
    if kind in ("sha224", "sha256", "sha384", "sha512"):
        return _e(F.unhex(F.sha2(data, int(kind[3:]))), value, name="digest")
    if kind in ("blake2s", "blake2b"):
        import hashlib

        import pandas as pd

        make = getattr(hashlib, kind)

        def hashed(v):
            return v.map(lambda b: None if b is None else make(b).digest())

        hashed.__annotations__ = {"v": pd.Series, "return": pd.Series}
        return _e(F.pandas_udf(hashed, "binary")(data), value, name="digest")
    raise ValueError(f"unknown digest {kind}")


# regular expressions


def _flagged(regex: Any, flags: Any) -> Column:
    f = _value(flags) if flags is not None else ""
    if flags is None or f == "":
        return c(regex)
    if f is None:
        return F.concat(F.lit("(?"), F.regexp_replace(c(flags), "g", ""), F.lit(")"), c(regex))
    f = f.replace("g", "")
    return F.concat(F.lit(f"(?{f})"), c(regex)) if f else c(regex)


def regexp_like(string: Any, regex: Any, flags: Any = None) -> Expr:
    """Whether the pattern matches anywhere."""
    return _e(F.regexp_like(c(string), _flagged(regex, flags)), string, regex, name="regexp_like")


def regexp_match(string: Any, regex: Any, flags: Any = None) -> Expr:
    """The groups of the first match, or the whole match if the pattern has none, as an array; null without a match.

    The pattern must be a literal."""
    pattern = _value(regex)
    if pattern is None:
        raise ValueError("regexp_match needs a literal pattern")
    n = re.compile(pattern).groups
    s, r = c(string), _flagged(regex, flags)
    groups = [F.call_function("regexp_extract", s, r, F.lit(i)) for i in (range(1, n + 1) if n else [0])]
    return _e(F.when(F.regexp_like(s, r), F.array(*groups)), string, regex, name="regexp_match")


def regexp_replace(string: Any, pattern: Any, replacement: Any, flags: Any = None) -> Expr:
    r"""The first match replaced, or all with the flag g; groups as ``\1`` or ``${1}``."""
    s, r = c(string), _flagged(pattern, flags)
    text = _value(replacement)
    new = F.lit(re.sub(r"\\(\d)|\$\{(\d+)\}", lambda m: "$" + (m[1] or m[2]), text)) if text is not None else c(replacement)
    if flags is not None and "g" in (_value(flags) or ""):
        return _e(F.regexp_replace(s, r, new), string, pattern, replacement, name="regexp_replace")
    at, hit = F.regexp_instr(s, r), F.regexp_substr(s, r)
    first = F.concat(F.substr(s, F.lit(1), at - 1), F.regexp_replace(hit, r, new), F.substr(s, at + F.char_length(hit)))
    return _e(F.when(at > 0, first).otherwise(s), string, pattern, replacement, name="regexp_replace")


# dates and times

#: Conversion letters of strftime and the letters of Spark's patterns.
_CHRONO = {
    "Y": "yyyy", "y": "yy", "m": "MM", "d": "dd", "e": "d", "H": "HH", "I": "hh", "M": "mm", "S": "ss", "f": "SSSSSS", "3f": "SSS", "6f": "SSSSSS", "9f": "SSSSSSSSS",
    "b": "MMM", "h": "MMM", "B": "MMMM", "a": "EEE", "A": "EEEE", "j": "DDD", "p": "a", "z": "xx", ":z": "xxx", "Z": "z", "F": "yyyy-MM-dd", "T": "HH:mm:ss",
    "R": "HH:mm", "D": "MM/dd/yy", ".f": "[.SSSSSSSSS][.SSSSSS][.SSS]", ".3f": ".SSS", ".6f": ".SSSSSS", ".9f": ".SSSSSSSSS", "+": "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]xxx",
}


def chrono_pattern(pattern: str) -> str:
    """Spark's date pattern of a strftime one."""
    out, i = [], 0
    while i < len(pattern):
        if pattern[i] == "%":
            m = re.match(r"%(\.?\d?f|:z|[A-Za-z+%])", pattern[i:])
            key = m[1] if m else ""
            if key == "%":
                out.append("%")
            elif key in _CHRONO:
                out.append(_CHRONO[key])
            else:
                raise ValueError(f"unsupported conversion in {pattern!r}")
            i += len(m[0])
        else:
            ch = pattern[i]
            out.append(f"'{ch}'" if ch.isalpha() else "''" if ch == "'" else ch)
            i += 1
    return "".join(out)


def _timestamp(arg: Any, formatters: tuple[Any, ...], per_second: int) -> Column:
    """A timestamp of a text, date or timestamp, or of a count of 1 / ``per_second`` seconds."""
    x = c(arg)
    s = x.cast("string")
    if formatters:
        tries = []
        for f in formatters:
            p = _value(f)
            if p is None:
                raise ValueError("formats must be literals")
            tries.append(F.try_to_timestamp(s, F.lit(chrono_pattern(p))))
        return F.coalesce(*tries)
    number = s.try_cast("decimal(38,9)")
    from_number = F.timestamp_micros((number * F.lit(1_000_000 // per_second) if per_second <= 1_000_000 else F.floor(number / F.lit(per_second // 1_000_000))).cast("bigint"))
    return F.when(s.rlike(r"^[+-]?\d{5,}(\.\d*)?$|^[+-]?\d{1,3}(\.\d*)?$|^-\d+$"), from_number).otherwise(F.try_to_timestamp(s))


def to_timestamp(arg: Any, *formatters: Any) -> Expr:
    """A timestamp of a text (by the first format that fits) or of seconds since 1970; microseconds at most."""
    return _e(_timestamp(arg, formatters, 1), arg, name="to_timestamp")


def to_timestamp_seconds(arg: Any, *formatters: Any) -> Expr:
    """As :func:`to_timestamp`, cut to whole seconds."""
    return _e(F.date_trunc("second", _timestamp(arg, formatters, 1)), arg, name="to_timestamp_seconds")


def to_timestamp_millis(arg: Any, *formatters: Any) -> Expr:
    """A timestamp of a text or of milliseconds since 1970, cut to milliseconds."""
    return _e(F.date_trunc("millisecond", _timestamp(arg, formatters, 1_000)), arg, name="to_timestamp_millis")


def to_timestamp_micros(arg: Any, *formatters: Any) -> Expr:
    """A timestamp of a text or of microseconds since 1970."""
    return _e(_timestamp(arg, formatters, 1_000_000), arg, name="to_timestamp_micros")


def to_timestamp_nanos(arg: Any, *formatters: Any) -> Expr:
    """A timestamp of a text or of nanoseconds since 1970, cut to microseconds."""
    return _e(_timestamp(arg, formatters, 1_000_000_000), arg, name="to_timestamp_nanos")


def to_unixtime(string: Any, *format_arguments: Any) -> Expr:
    """Whole seconds since 1970 of a text, date or timestamp."""
    return _e(F.unix_seconds(_timestamp(string, format_arguments, 1)), string, name="to_unixtime")


def from_unixtime(arg: Any) -> Expr:
    """The timestamp of seconds since 1970."""
    return _e(F.timestamp_seconds(c(arg)), arg, name="from_unixtime")


def current_time() -> Expr:
    """The time of day in UTC as text, HH:mm:ss.ffffff."""
    return _e(F.date_format(F.current_timestamp(), "HH:mm:ss.SSSSSS"), name="current_time")


def date_part(part: Any, date: Any) -> Expr:
    """A field of a date or timestamp, as a double: year, quarter, month, week, day, hour, minute, second, millisecond, microsecond,
    nanosecond, dow (Sunday 0), doy or epoch."""
    p = str(_value(part)).lower()
    x = c(date)
    ts = x.cast("timestamp")
    inside = F.pmod(F.unix_micros(ts), F.lit(60_000_000))
    made = {
        "dow": lambda: F.dayofweek(x) - 1, "epoch": lambda: F.unix_micros(ts) / 1_000_000, "second": lambda: F.second(ts),
        "millisecond": lambda: F.floor(inside / 1_000), "microsecond": lambda: inside, "nanosecond": lambda: inside * 1_000,
    }
    got = made[p]() if p in made else F.date_part(F.lit(p), x)
    return _e(got.cast("double"), part, date, name="date_part")


datepart = date_part


def date_trunc(part: Any, date: Any) -> Expr:
    """Cut to year, quarter, month, week (Monday), day, hour, minute, second, millisecond or microsecond."""
    return _e(F.date_trunc(str(_value(part)), c(date)), part, date, name="date_trunc")


datetrunc = date_trunc

#: Microseconds of the units of a stride.
_UNITS = {"microsecond": 1, "millisecond": 1_000, "second": 1_000_000, "minute": 60_000_000, "hour": 3_600_000_000, "day": 86_400_000_000, "week": 604_800_000_000}


def stride_micros(stride: Any) -> int:
    """Microseconds of a timedelta or a text such as '15 minutes' or '1 day 2 hours'."""
    v = _value(stride)
    if isinstance(v, datetime.timedelta):
        return v // datetime.timedelta(microseconds=1)
    total = 0
    for n, unit in re.findall(r"(-?\d+)\s*([a-z]+)", str(v).lower()):
        key = unit.removesuffix("s")
        if key not in _UNITS:
            raise ValueError(f"unsupported stride {v!r}")
        total += int(n) * _UNITS[key]
    if total <= 0:
        raise ValueError(f"a stride must be positive: {v!r}")
    return total


def date_bin(stride: Any, source: Any, origin: Any = None) -> Expr:
    """The start of the interval of length ``stride`` from ``origin`` (1970) that ``source`` lies in."""
    us = stride_micros(stride)
    at = F.unix_micros(c(source).cast("timestamp"))
    zero = F.lit(0).cast("bigint") if origin is None else F.unix_micros(c(origin).cast("timestamp"))
    return _e(F.timestamp_micros(at - F.pmod(at - zero, F.lit(us))), stride, source, name="date_bin")
