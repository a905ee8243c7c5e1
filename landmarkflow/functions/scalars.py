"""Numeric helpers shared by evaluation, models and score sheets."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clip(c, lo: float, hi: float) -> Column:
    return F.least(F.greatest(_col(c), F.lit(float(lo))), F.lit(float(hi)))


def logit(c, eps: float = 1e-9) -> Column:
    p = clip(c, eps, 1.0 - eps)
    return F.ln(p / (F.lit(1.0) - p))


def raw_logit(c) -> Column:
    """Log-odds without clipping: -inf at 0, inf at 1 and NaN outside of [0, 1]."""
    p = _col(c)
    inner = F.when((p > 0.0) & (p < 1.0), p)
    return (F.when((p < 0.0) | (p > 1.0), F.lit(float("nan")))
            .when(p == 0.0, F.lit(float("-inf"))).when(p == 1.0, F.lit(float("inf")))
            .otherwise(F.ln(inner / (F.lit(1.0) - inner))))


def scaled_round(c, digits: int) -> Column:
    """Half away from zero of the scaled double, as SQL in doubles has it. ``F.round`` goes by
    the shortest decimal form, which puts the double next below a tie on its other side.
    NaN, and what overflows when scaled, stays as it is."""
    c = _col(c)
    return F.when(F.abs(c) < 1e290, F.round(c * 10.0 ** digits) / 10.0 ** digits).otherwise(c)


def safe_ratio(num, den) -> Column:
    """``num / den`` as doubles, NULL when the denominator is 0."""
    return _col(num).cast("double") / F.nullif(_col(den).cast("double"), F.lit(0.0))


#: Cells per doubling of :func:`order_cell`, and doublings on either side of 1.
PER_DOUBLING, DOUBLINGS = 2048, 1100
HALF_CELL = (DOUBLINGS - 1) * PER_DOUBLING + 1


def order_cell(v) -> Column:
    """Integer that never falls as a double grows, with cells of equal relative width.

    Small values and far outliers get cells of their own whatever the range is.
    """
    v = _col(v)
    steps = F.floor(F.least(F.greatest(F.log2(F.abs(v)) * PER_DOUBLING,
                                       F.lit(-float(DOUBLINGS * PER_DOUBLING))),
                            F.lit(float(DOUBLINGS * PER_DOUBLING))))
    place = (steps + DOUBLINGS * PER_DOUBLING + 1).cast("int")
    return F.when(v > 0, place).when(v < 0, -place).otherwise(F.lit(0))


def share_cell(p) -> Column:
    """:func:`order_cell` for probabilities: fine near 0 and near 1."""
    p = _col(p)
    return F.when(p < 0.5, order_cell(p)).otherwise(2 * HALF_CELL - order_cell(F.lit(1.0) - p))


def bin_index(c, edges) -> Column:
    """Number of edges at or below the value: left-closed bins 0..len(edges)."""
    c = _col(c)
    return reduce(lambda a, b: a + b,
                  [(c >= F.lit(float(e))).cast("int") for e in edges], F.lit(0))


def range_label(lower: float, upper: float) -> str:
    """``< a``, ``a to < b`` or ``>= b`` with trailing zeros dropped."""
    if math.isinf(lower):
        return f"< {_short(upper)}"
    if math.isinf(upper):
        return f">= {_short(lower)}"
    return f"{_short(lower)} to < {_short(upper)}"


def _short(v: float) -> str:
    return str(int(v)) if float(v).is_integer() else f"{v:.2f}".rstrip("0").rstrip(".")


def range_label_column(lower, upper) -> Column:
    """Column form of :func:`range_label`; open ends are NULL or infinite."""
    lower, upper = _col(lower), _col(upper)
    lo_open = lower.isNull() | (lower == F.lit(float("-inf")))
    hi_open = upper.isNull() | (upper == F.lit(float("inf")))
    return (F.when(lo_open, F.concat(F.lit("< "), _short_column(upper)))
            .when(hi_open, F.concat(F.lit(">= "), _short_column(lower)))
            .otherwise(F.concat(_short_column(lower), F.lit(" to < "), _short_column(upper))))


def _short_column(c: Column) -> Column:
    fixed = F.format_string("%.2f", c)
    return F.regexp_replace(F.regexp_replace(fixed, r"0+$", ""), r"\.$", "")
