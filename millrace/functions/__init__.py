"""The function library: every function takes expressions, columns or plain values and gives an expression."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from millrace.expr import Expr, WindowFrame, to_column
from millrace.functions import aggregates as _aggregates
from millrace.functions import arrays as _arrays
from millrace.functions import scalar as _scalar
from millrace.functions.aggregates import *  # noqa: F403
from millrace.functions.arrays import *  # noqa: F403
from millrace.functions.scalar import *  # noqa: F403

_HIDDEN = {"c", "F", "re", "datetime", "Any", "Callable", "Sequence", "Column", "Expr", "Spec", "SortExpr", "CaseBuilder", "NullTreatment", "to_column", "as_sort", "annotations", "SAME", "ALIASES", "chrono_pattern", "stride_micros", "range_"}


def window(name: str, args: Sequence[Any], partition_by: Sequence[Any] | None = None, order_by: Sequence[Any] | None = None, window_frame: WindowFrame | None = None, ctx: Any = None) -> Expr:
    """The function ``name``, of this library or an aggregate registered with ``ctx``, over a window."""
    makes = {**vars(_aggregates)}
    if name in makes and name not in _HIDDEN:
        e = makes[name](*args)
        return e._refine(partition_by=tuple(partition_by or ()), order_by=tuple(order_by or ()), frame=window_frame, windowed=True)
    from pyspark.sql import functions as F

    from millrace.expr import Spec

    spec = Spec(name, lambda s: F.call_function(name, *[to_column(a) for a in s.args]), tuple(args), partition_by=tuple(partition_by or ()), order_by=tuple(order_by or ()), frame=window_frame, windowed=True)
    return Expr(spec=spec, variant="WindowFunction")


__all__ = sorted({n for m in (_scalar, _arrays, _aggregates) for n in vars(m) if not n.startswith("_") and n not in _HIDDEN} | {"window"})
