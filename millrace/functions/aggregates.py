"""Aggregate functions.  Each may be refined by a filter, distinct, an order or the treatment of nulls, and used over a window."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.expr import Expr, NullTreatment, SortExpr, Spec, as_sort, to_column

c = to_column


def _agg(name: str, make: Callable[[Spec], Column], *args: Any, filter: Any = None, distinct: bool = False, order_by: Sequence[Any] | None = None, nulls: NullTreatment | None = None) -> Expr:
    return Expr(spec=Spec(name, make, args, distinct=distinct, filter=filter, order_by=tuple(order_by or ()), nulls=nulls), variant="AggregateFunction", operands=args)


def _plain(name: str, spark: str, n: int = 1):
    """A function of ``n`` columns that means the same in Spark; the filter makes the first one null."""

    def f(*args: Any, filter: Any = None) -> Expr:
        if len(args) == n + 1 and filter is None:
            *args, filter = args
        if len(args) != n:
            raise TypeError(f"{name} takes {n} arguments")
        return _agg(name, lambda s: F.call_function(spark, s.kept(c(s.args[0])), *[c(a) for a in s.args[1:]]), *args, filter=filter)

    f.__name__ = f.__qualname__ = name
    f.__doc__ = f"{name}: Spark's ``{spark}`` over the rows that pass ``filter``."
    return f


avg, max, min, sum = _plain("avg", "avg"), _plain("max", "max"), _plain("min", "min"), _plain("sum", "sum")
stddev, stddev_pop, var_pop, var_samp = _plain("stddev", "stddev_samp"), _plain("stddev_pop", "stddev_pop"), _plain("var_pop", "var_pop"), _plain("var_samp", "var_samp")
corr, covar_pop, covar_samp = _plain("corr", "corr", 2), _plain("covar_pop", "covar_pop", 2), _plain("covar_samp", "covar_samp", 2)
regr_avgx, regr_avgy, regr_count = _plain("regr_avgx", "regr_avgx", 2), _plain("regr_avgy", "regr_avgy", 2), _plain("regr_count", "regr_count", 2)
regr_intercept, regr_r2, regr_slope = _plain("regr_intercept", "regr_intercept", 2), _plain("regr_r2", "regr_r2", 2), _plain("regr_slope", "regr_slope", 2)
regr_sxx, regr_sxy, regr_syy = _plain("regr_sxx", "regr_sxx", 2), _plain("regr_sxy", "regr_sxy", 2), _plain("regr_syy", "regr_syy", 2)
bit_and, bit_or = _plain("bit_and", "bit_and"), _plain("bit_or", "bit_or")
bool_and, bool_or = _plain("bool_and", "bool_and"), _plain("bool_or", "bool_or")
approx_distinct = _plain("approx_distinct", "approx_count_distinct")
mean, stddev_samp, var, var_sample, covar = avg, stddev, var_samp, var_samp, covar_samp


def count(expressions: Any = None, distinct: bool = False, filter: Any = None) -> Expr:
    """The rows in which all of ``expressions`` are not null; distinct ones if asked.  Exact on streams too."""
    args = expressions if isinstance(expressions, (list, tuple)) else [1 if expressions is None else expressions]

    def make(s: Spec) -> Column:
        cols = [c(a) for a in s.args]
        whole = cols[0].isNotNull()
        for x in cols[1:]:
            whole = whole & x.isNotNull()
        if not s.distinct:
            return F.count(s.kept(F.when(whole, F.lit(1))))
        one = cols[0] if len(cols) == 1 else F.struct(*[x.alias(f"c{i}") for i, x in enumerate(cols)])
        kept = s.kept(F.when(whole, one))
        # a stream or a window takes no distinct count
        return F.size(F.collect_set(kept)).cast("bigint") if s.streaming or s.windowed else F.count_distinct(kept)

    return _agg("count", make, *args, filter=filter, distinct=distinct)


def count_star(filter: Any = None) -> Expr:
    """The rows."""
    return _agg("count_star", lambda s: F.count(s.kept(F.lit(1))), filter=filter)


def median(expression: Any, distinct: bool = False, filter: Any = None) -> Expr:
    """The exact median, interpolated."""

    def make(s: Spec) -> Column:
        kept = s.kept(c(s.args[0]))
        if not s.distinct:
            return F.median(kept)
        a = F.sort_array(F.collect_set(kept))
        n = F.size(a)
        lo, hi = F.floor((n + 1) / 2).cast("int"), F.floor(n / 2).cast("int") + 1
        return F.when(n > 0, (F.get(a, lo - 1) + F.get(a, hi - 1)) / 2)

    return _agg("median", make, expression, filter=filter, distinct=distinct)


def approx_median(expression: Any, filter: Any = None) -> Expr:
    """A median by a mergeable sketch."""
    return _agg("approx_median", lambda s: F.percentile_approx(s.kept(c(s.args[0])), 0.5), expression, filter=filter)


def approx_percentile_cont(expression: Any, percentile: float, num_centroids: int | None = None, filter: Any = None) -> Expr:
    """The value of rank ``percentile`` by a mergeable sketch; ``num_centroids`` is taken as its accuracy."""
    accuracy = 10000 if num_centroids is None else num_centroids
    return _agg("approx_percentile_cont", lambda s: F.percentile_approx(s.kept(c(s.args[0])), percentile, accuracy), expression, filter=filter)


def approx_percentile_cont_with_weight(expression: Any, weight: Any, percentile: float, filter: Any = None) -> Expr:
    """The percentile of values counted ``weight`` times, exact; weights are whole numbers."""
    return _agg("approx_percentile_cont_with_weight", lambda s: F.percentile(s.kept(c(s.args[0])), percentile, c(s.args[1]).cast("bigint")), expression, weight, filter=filter)


# ordered collections


def _compare(keys: Sequence[SortExpr]) -> Callable[[Column, Column], Column]:
    def one(a: Column, b: Column, i: int) -> Column:
        if i == len(keys):
            return F.lit(0)
        x, y = a[f"k{i}"], b[f"k{i}"]
        up = keys[i].ascending()
        null = -1 if keys[i].nulls_first() else 1
        return (
            F.when(x.isNull() & y.isNull(), one(a, b, i + 1))
            .when(x.isNull(), F.lit(null))
            .when(y.isNull(), F.lit(-null))
            .when(x < y, F.lit(-1 if up else 1))
            .when(x > y, F.lit(1 if up else -1))
            .otherwise(one(a, b, i + 1))
        )

    return lambda a, b: one(a, b, 0)


def _collected(s: Spec, value: Column, skip_nulls: bool = False) -> Column:
    """The values of the group as an array in the asked order, nulls kept unless told otherwise."""
    keys = [as_sort(o) for o in s.order_by]
    item = F.struct(value.alias("v"), *[c(k.expr()).alias(f"k{i}") for i, k in enumerate(keys)])
    keep = value.isNotNull() if skip_nulls else None
    if s.filter is not None:
        keep = c(s.filter) if keep is None else keep & c(s.filter)
    item = item if keep is None else F.when(keep, item)
    got = F.collect_set(item) if s.distinct else F.collect_list(item)
    if keys:
        got = F.array_sort(got, _compare(keys))
    return F.transform(got, lambda x: x["v"])


def array_agg(expression: Any, distinct: bool = False, filter: Any = None, order_by: Sequence[Any] | None = None) -> Expr:
    """The values as an array, nulls included."""
    return _agg("array_agg", lambda s: _collected(s, c(s.args[0])), expression, filter=filter, distinct=distinct, order_by=order_by)


def string_agg(expression: Any, delimiter: str, filter: Any = None, order_by: Sequence[Any] | None = None) -> Expr:
    """The texts that are not null with ``delimiter`` between them; null if there are none."""

    def make(s: Spec) -> Column:
        a = _collected(s, c(s.args[0]).cast("string"), skip_nulls=True)
        return F.when(F.size(a) > 0, F.array_join(a, delimiter))

    return _agg("string_agg", make, expression, filter=filter, order_by=order_by)


def _extreme(s: Spec, x: Column, keys: Sequence[SortExpr], last: bool) -> Column:
    """The value at one end of an order whose keys all go one way: the least or greatest key wins, no row is collected."""
    up = keys[0].ascending()
    parts = []
    for i, k in enumerate(keys):
        null = c(k.expr()).isNull()
        parts += [F.when(null, F.lit(0 if k.nulls_first() == up else 1)).otherwise(F.lit(1 if k.nulls_first() == up else 0)).alias(f"n{i}"), c(k.expr()).alias(f"k{i}")]
    keep = x.isNotNull() if s.ignore_nulls() else None
    if s.filter is not None:
        keep = c(s.filter) if keep is None else keep & c(s.filter)
    at = F.struct(*parts) if keep is None else F.when(keep, F.struct(*parts))
    return F.max_by(x, at) if up == last else F.min_by(x, at)


def _edge(name: str, last: bool):
    def f(expression: Any, filter: Any = None, order_by: Sequence[Any] | None = None, null_treatment: NullTreatment | None = None) -> Expr:
        def make(s: Spec) -> Column:
            x = c(s.args[0])
            pick = F.last_value if last else F.first_value
            if s.windowed:
                return pick(s.kept(x), F.lit(s.ignore_nulls()))
            keys = [as_sort(o) for o in s.order_by]
            if not keys:
                if s.filter is None:
                    return pick(x, F.lit(s.ignore_nulls()))
                boxed = F.when(c(s.filter) & (x.isNotNull() if s.ignore_nulls() else F.lit(True)), F.struct(x.alias("v")))
                return pick(boxed, F.lit(True))["v"]
            if len({k.ascending() for k in keys}) == 1:
                return _extreme(s, x, keys, last)
            a = _collected(s, x, skip_nulls=s.ignore_nulls())
            return F.try_element_at(a, F.lit(-1 if last else 1))

        return _agg(name, make, expression, filter=filter, order_by=order_by, nulls=null_treatment)

    f.__name__ = f.__qualname__ = name
    f.__doc__ = f"The {'last' if last else 'first'} value of the group in the asked order; without an order any."
    return f


first_value, last_value = _edge("first_value", False), _edge("last_value", True)


def nth_value(expression: Any, n: int, filter: Any = None, order_by: Sequence[Any] | None = None, null_treatment: NullTreatment | None = None) -> Expr:
    """The ``n``-th value of the group in the asked order, from 1."""

    def make(s: Spec) -> Column:
        x = c(s.args[0])
        if s.windowed:
            return F.nth_value(s.kept(x), n, s.ignore_nulls())
        return F.try_element_at(_collected(s, x, skip_nulls=s.ignore_nulls()), F.lit(n))

    return _agg("nth_value", make, expression, filter=filter, order_by=order_by, nulls=null_treatment)


def bit_xor(expression: Any, distinct: bool = False, filter: Any = None) -> Expr:
    """The exclusive or of the bits; of each value once if distinct."""

    def make(s: Spec) -> Column:
        kept = s.kept(c(s.args[0]))
        if not s.distinct:
            return F.bit_xor(kept)
        a = F.collect_set(kept.cast("bigint"))
        return F.when(F.size(a) > 0, F.aggregate(a, F.lit(0).cast("bigint"), lambda x, y: x.bitwiseXOR(y)))

    return _agg("bit_xor", make, expression, filter=filter, distinct=distinct)


# window functions


def _over(name: str, make: Callable[[Spec], Column], partition_by: Sequence[Any] | None, order_by: Sequence[Any] | None, *args: Any) -> Expr:
    return Expr(spec=Spec(name, make, args, partition_by=tuple(partition_by or ()), order_by=tuple(order_by or ()), window_only=True), variant="WindowFunction", operands=args)


def _shift(name: str, spark: Callable[..., Column]):
    def f(arg: Any, shift_offset: int = 1, default_value: Any = None, partition_by: Sequence[Any] | None = None, order_by: Sequence[Any] | None = None) -> Expr:
        def make(s: Spec) -> Column:
            if not s.ignore_nulls():
                return spark(c(s.args[0]), shift_offset, default_value)
            # only the JVM's function can skip nulls
            from pyspark import SparkContext

            call = getattr(SparkContext._active_spark_context._jvm.org.apache.spark.sql.functions, name)
            return Column(call(c(s.args[0])._jc, shift_offset, default_value, True))

        return _over(name, make, partition_by, order_by, arg)

    f.__name__ = f.__qualname__ = name
    f.__doc__ = f"The value ``shift_offset`` rows {'ahead' if name == 'lead' else 'back'}, or ``default_value``."
    return f


lead, lag = _shift("lead", F.lead), _shift("lag", F.lag)


def _rank(name: str, spark: Callable[[], Column]):
    def f(partition_by: Sequence[Any] | None = None, order_by: Sequence[Any] | None = None) -> Expr:
        return _over(name, lambda s: spark(), partition_by, order_by)

    f.__name__ = f.__qualname__ = name
    f.__doc__ = f"Spark's ``{name}`` over a window."
    return f


row_number, rank, dense_rank = _rank("row_number", F.row_number), _rank("rank", F.rank), _rank("dense_rank", F.dense_rank)
percent_rank, cume_dist = _rank("percent_rank", F.percent_rank), _rank("cume_dist", F.cume_dist)


def ntile(groups: int, partition_by: Sequence[Any] | None = None, order_by: Sequence[Any] | None = None) -> Expr:
    """The number of the group, of ``groups`` nearly equal ones."""
    return _over("ntile", lambda s: F.ntile(groups), partition_by, order_by)
