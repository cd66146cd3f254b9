"""Functions on arrays.  Places count from 1, negative ones from the end.  Null arrays give null."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.expr import Expr, to_column
from millrace.functions.scalar import _call, _e

c = to_column
range_ = range  # the name is a function of the library below


def make_array(*args: Any) -> Expr:
    """An array of the arguments."""
    return _e(F.array(*[c(a) for a in args]), *args, name="make_array")


def range(start: Any, stop: Any, step: Any = 1) -> Expr:
    """The integers from ``start`` to before ``stop``; empty where there are none."""
    a, b, s = (c(x).cast("bigint") for x in (start, stop, step))
    last = b - F.signum(s).cast("bigint")
    some = ((s > 0) & (a < b)) | ((s < 0) & (a > b))
    safe = F.sequence(F.when(some, a).otherwise(F.lit(0)), F.when(some, last).otherwise(F.lit(0)), F.when(some, s).otherwise(F.lit(1)))
    return _e(F.when(some, safe).when(a.isNotNull() & b.isNotNull() & s.isNotNull(), F.array().cast("array<bigint>")), start, stop, step, name="range")


def array_to_string(expr: Any, delimiter: Any) -> Expr:
    """The texts of the elements that are not null, with ``delimiter`` between them."""
    return _e(F.call_function("array_join", F.transform(c(expr), lambda x: x.cast("string")), c(delimiter)), expr, delimiter, name="array_to_string")


def array_append(array: Any, element: Any) -> Expr:
    """``element`` added at the end."""
    return _call("array_append", array, element)


def array_prepend(element: Any, array: Any) -> Expr:
    """``element`` added at the start."""
    return _call("array_prepend", array, element)


def array_concat(*args: Any) -> Expr:
    """The arrays in a row; null arrays are left out."""
    if not args:
        raise TypeError("array_concat needs an array")
    one = F.coalesce(*[c(a) for a in args])
    return _e(F.concat(*[F.coalesce(c(a), F.slice(one, F.lit(1), F.lit(0))) for a in args]), *args, name="array_concat")


def array_ndims(array: Any) -> Expr:
    """How deeply arrays are nested."""
    kind = F.typeof(c(array))
    return _e(F.when(c(array).isNotNull(), (F.length(F.regexp_substr(kind, F.lit("^(array<)+"))) / 6).cast("bigint")), array, name="array_ndims")


def array_dims(array: Any) -> Expr:
    """The length in each dimension, taken from first elements, up to six dimensions."""
    a = c(array)
    # the depth is in the type, so branches beyond it are folded away; deeper levels are read from the first element as text
    depth = F.length(F.regexp_substr(F.typeof(a), F.lit("^(array<)+"))) / 6
    first = F.to_json(F.slice(a, F.lit(1), F.lit(1)))
    levels = [F.size(a).cast("bigint"), *[F.when(depth > i, F.json_array_length(F.get_json_object(first, "$" + "[0]" * i)).cast("bigint")) for i in range_(1, 6)]]
    return _e(F.when(a.isNotNull(), F.slice(F.array(*levels), F.lit(1), depth.cast("int"))), array, name="array_dims")


def array_distinct(array: Any) -> Expr:
    """Each element once, in the order of first occurrence."""
    return _call("array_distinct", array)


def array_element(array: Any, n: Any) -> Expr:
    """The element at place ``n``, null beyond either end or at 0."""
    i = c(n).cast("int")
    a = c(array)
    return _e(F.get(a, F.when(i > 0, i - 1).when(i < 0, F.size(a) + i)), array, n, name="array_element")


def array_length(array: Any) -> Expr:
    """The number of elements."""
    return _e(F.array_size(c(array)).cast("bigint"), array, name="array_length")


def array_has(first_array: Any, second_array: Any) -> Expr:
    """Whether an element is in the array."""
    return _e(F.call_function("array_contains", c(first_array), c(second_array)), first_array, second_array, name="array_has")


def array_has_all(first_array: Any, second_array: Any) -> Expr:
    """Whether all elements of the second array are in the first."""
    return _e(F.size(F.array_except(c(second_array), c(first_array))) == 0, first_array, second_array, name="array_has_all")


def array_has_any(first_array: Any, second_array: Any) -> Expr:
    """Whether the arrays share an element other than null."""
    a, b = c(first_array), c(second_array)
    return _e(F.when(a.isNotNull() & b.isNotNull(), F.coalesce(F.arrays_overlap(a, b), F.lit(False))), a, b, name="array_has_any")


def array_position(array: Any, element: Any, index: Any = 1) -> Expr:
    """The place of the first occurrence at or after ``index``, null if there is none."""
    a, i = c(array), c(index).cast("int")
    rest = F.slice(a, i, F.greatest(F.size(a) - i + 1, F.lit(0)))
    at = F.call_function("array_position", rest, c(element))
    return _e(F.when(at > 0, at + i - 1), array, element, name="array_position")


def array_positions(array: Any, element: Any) -> Expr:
    """The places of all occurrences."""
    at = F.transform(c(array), lambda x, i: F.when(x.eqNullSafe(c(element)), (i + 1).cast("bigint")))
    return _e(F.filter(at, lambda x: x.isNotNull()), array, element, name="array_positions")


def array_pop_back(array: Any) -> Expr:
    """Without the last element."""
    a = c(array)
    return _e(F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0))), array, name="array_pop_back")


def array_pop_front(array: Any) -> Expr:
    """Without the first element."""
    a = c(array)
    return _e(F.slice(a, F.lit(2), F.greatest(F.size(a), F.lit(0))), array, name="array_pop_front")


def _nth_hits(a: Column, element: Column) -> Column:
    """(element, its number among the occurrences of ``element``, 0 if it is another) for each place."""
    none = F.slice(F.transform(a, lambda x: F.struct(x.alias("x"), F.lit(0).alias("k"))), F.lit(1), F.lit(0))
    start = F.struct(none.alias("out"), F.lit(0).alias("n"))

    def step(s: Column, x: Column) -> Column:
        hit = x.eqNullSafe(element)
        n = s["n"] + F.when(hit, F.lit(1)).otherwise(F.lit(0))
        return F.struct(F.array_append(s["out"], F.struct(x.alias("x"), F.when(hit, n).otherwise(F.lit(0)).alias("k"))).alias("out"), n.alias("n"))

    return F.aggregate(a, start, step)["out"]


def array_remove_n(array: Any, element: Any, max: Any) -> Expr:
    """Without the first ``max`` occurrences."""
    most = c(max)
    kept = F.filter(_nth_hits(c(array), c(element)), lambda p: (p["k"] == 0) | (p["k"] > most))
    return _e(F.transform(kept, lambda p: p["x"]), array, element, max, name="array_remove_n")


def array_remove(array: Any, element: Any) -> Expr:
    """Without the first occurrence."""
    return array_remove_n(array, element, 1)


def array_remove_all(array: Any, element: Any) -> Expr:
    """Without any occurrence."""
    return _e(F.filter(c(array), lambda x: ~x.eqNullSafe(c(element))), array, element, name="array_remove_all")


def array_repeat(element: Any, count: Any) -> Expr:
    """``element`` so many times."""
    return _e(F.call_function("array_repeat", c(element), c(count).cast("int")), element, count, name="array_repeat")


def array_replace_n(array: Any, from_val: Any, to_val: Any, max: Any) -> Expr:
    """The first ``max`` occurrences replaced."""
    most, new = c(max), c(to_val)
    return _e(F.transform(_nth_hits(c(array), c(from_val)), lambda p: F.when((p["k"] > 0) & (p["k"] <= most), new).otherwise(p["x"])), array, from_val, to_val, name="array_replace_n")


def array_replace(array: Any, from_val: Any, to_val: Any) -> Expr:
    """The first occurrence replaced."""
    return array_replace_n(array, from_val, to_val, 1)


def array_replace_all(array: Any, from_val: Any, to_val: Any) -> Expr:
    """All occurrences replaced."""
    return _e(F.transform(c(array), lambda x: F.when(x.eqNullSafe(c(from_val)), c(to_val)).otherwise(x)), array, from_val, to_val, name="array_replace_all")


def array_sort(array: Any, descending: bool = False, null_first: bool = False) -> Expr:
    """Sorted, nulls last unless told otherwise."""
    a = c(array)
    there = F.sort_array(F.filter(a, lambda x: x.isNotNull()), asc=not descending)
    nulls = F.filter(a, lambda x: x.isNull())
    return _e(F.concat(nulls, there) if null_first else F.concat(there, nulls), array, name="array_sort")


def array_slice(array: Any, begin: Any, end: Any, stride: Any = None) -> Expr:
    """The elements from place ``begin`` to ``end``, both included, every ``stride``-th."""
    a = c(array)
    n = F.size(a)
    lo, hi = c(begin).cast("int"), c(end).cast("int")
    lo = F.greatest(F.when(lo < 0, n + lo + 1).otherwise(lo), F.lit(1))
    hi = F.least(F.when(hi < 0, n + hi + 1).otherwise(hi), n)
    got = F.slice(a, lo, F.greatest(hi - lo + 1, F.lit(0)))
    if stride is not None:
        k = c(stride).cast("int")
        got = F.filter(got, lambda x, i: F.pmod(i, k) == 0)
    return _e(got, array, begin, end, name="array_slice")


def array_intersect(array1: Any, array2: Any) -> Expr:
    """The elements in both, each once."""
    return _call("array_intersect", array1, array2)


def array_union(array1: Any, array2: Any) -> Expr:
    """The elements in either, each once."""
    return _call("array_union", array1, array2)


def array_except(array1: Any, array2: Any) -> Expr:
    """The elements of the first that are not in the second, each once."""
    return _call("array_except", array1, array2)


def array_resize(array: Any, size: Any, value: Any = None) -> Expr:
    """Cut, or filled up with ``value``, to ``size`` elements."""
    n = c(size).cast("int")
    return _e(F.slice(F.concat(c(array), F.array_repeat(c(value), F.greatest(n, F.lit(0)))), F.lit(1), n), array, size, value, name="array_resize")


def flatten(array: Any) -> Expr:
    """The elements of an array of arrays in a row; one level."""
    return _call("flatten", array)


#: Other names of the functions above.
ALIASES = {
    "array": "make_array", "array_join": "array_to_string", "list_to_string": "array_to_string", "list_join": "array_to_string", "array_push_back": "array_append",
    "list_append": "array_append", "list_push_back": "array_append", "array_cat": "array_concat", "list_distinct": "array_distinct", "list_dims": "array_dims",
    "array_extract": "array_element", "list_element": "array_element", "list_extract": "array_element", "list_length": "array_length", "array_indexof": "array_position",
    "list_position": "array_position", "list_indexof": "array_position", "list_positions": "array_positions", "list_ndims": "array_ndims", "array_push_front": "array_prepend",
    "list_prepend": "array_prepend", "list_push_front": "array_prepend", "list_remove": "array_remove", "list_remove_n": "array_remove_n", "list_remove_all": "array_remove_all",
    "list_replace": "array_replace", "list_replace_n": "array_replace_n", "list_replace_all": "array_replace_all", "list_sort": "array_sort", "list_slice": "array_slice",
    "list_intersect": "array_intersect", "list_union": "array_union", "list_except": "array_except", "list_resize": "array_resize",
}
for _alias, _target in ALIASES.items():
    globals()[_alias] = globals()[_target]
