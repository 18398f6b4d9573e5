"""Numeric semantics of the dashboard, as Spark Column expressions.

The dashboard computes in JS doubles: ``Math.round`` rounds ties toward +inf,
``toFixed(2)`` rounds the binary double, ``a || b`` skips 0/''/null/NaN and
``x > 0 ? a / x : d`` guards divisions.  Spark's ``round`` is HALF_UP on the
decimal value (``round(-2.5) = -3``), so every rounding here is ``floor(x+.5)``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def _c(x) -> Column:
    if isinstance(x, Column):
        return x
    if isinstance(x, str):
        return F.col(x)
    return F.lit(x)


def js_round(x) -> Column:
    """``Math.round``: nearest integer, ties toward +inf; result is a long."""
    return F.floor(_c(x) + F.lit(0.5)).cast("long")


def fixed2(x) -> Column:
    """``Number(x.toFixed(2))`` exactly as JS computes it.

    ``toFixed`` rounds the *exact* binary value, so 1.005 -> 1.00 and
    8.345 -> 8.34, while ``floor(x*100+.5)`` sees the rounded product 834.5.
    A tie in the rounded product is settled by the sign of the product's
    rounding error, obtained error-free with Dekker's split (Veltkamp,
    2^27+1).  Negative inputs round by magnitude, as ``toFixed`` does.
    """
    v = _c(x).cast("double")
    a = F.abs(v)
    p = a * F.lit(100.0)
    c = a * F.lit(134217729.0)
    hi = c - (c - a)
    lo = a - hi
    err = (hi * F.lit(100.0) - p) + lo * F.lit(100.0)
    n = F.floor(p + F.lit(0.5))
    n = F.when((p - F.floor(p) == F.lit(0.5)) & (err < 0), n - F.lit(1)).otherwise(n)
    return F.when(v < 0, -n / F.lit(100)).otherwise(n / F.lit(100))


def fixed1(x) -> Column:
    """``Math.round(x * 10) / 10``."""
    return F.floor(_c(x) * F.lit(10) + F.lit(0.5)) / F.lit(10)


def fixed6(x) -> Column:
    """Six-decimal presentation of an unrounded ratio (stable across engines)."""
    return F.floor(_c(x) * F.lit(1000000) + F.lit(0.5)) / F.lit(1000000)


def safe_div(a, b, default=None) -> Column:
    """``b > 0 ? a / b : default`` without ever evaluating a zero division."""
    d = F.lit(default) if not isinstance(default, Column) else default
    return F.when(_c(b) > 0, _c(a) / _c(b)).otherwise(d)


def pct(a, b) -> Column:
    """``b > 0 ? Math.round(a / b * 100) : 0`` as a long."""
    return F.when(_c(b) > 0, js_round(_c(a) / _c(b) * F.lit(100))).otherwise(F.lit(0).cast("long"))


def truthy_or(x, default) -> Column:
    """``x || default`` for a number: 0, NaN and null fall through."""
    c = _c(x)
    return F.when(c.isNull() | (c == 0) | F.isnan(c.cast("double")), _c(default)).otherwise(c)


def first_truthy(*cols, default=0) -> Column:
    """``a || b || ... || default`` for numbers (0 and null skipped)."""
    return F.coalesce(*[F.nullif(_c(c), F.lit(0)) for c in cols], _c(default))


def first_truthy_str(*cols, default="") -> Column:
    """``a || b || ... || default`` for strings ('' and null skipped)."""
    return F.coalesce(*[F.nullif(_c(c), F.lit("")) for c in cols], F.lit(default))


def clamp(x, lo, hi) -> Column:
    return F.least(F.greatest(_c(x), _c(lo)), _c(hi))
