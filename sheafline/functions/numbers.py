"""Numeric expressions: safe division, exact decimal rounding, percentages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_div(num: Column, den: Column) -> Column:
    """``num / den`` as DOUBLE, 0.0 for a zero denominator."""
    return F.when(den > 0, num.cast("double") / den.cast("double")).otherwise(F.lit(0.0))


def round_exact(value: Column, digits: int) -> Column:
    """Round the *binary* value of a DOUBLE to ``digits`` decimals, ties to even.

    Spark's ``round`` and ``bround`` round the shortest decimal text of a double, so 201/400 (just
    below 0.5025 in binary) goes up there. Here the product with ``10**digits`` is split into a
    rounded part and its exact error (Dekker's two-product), so the comparison with one half is
    exact. Values of ``2**52 / 10**digits`` and more have no digits to round, so they (and
    infinities), null and NaN pass through.
    """
    scale = float(10**digits)

    def two_product(v: Column) -> Column:
        high = v * 134217729.0 - (v * 134217729.0 - v)
        product = v * scale
        error = (high * scale - product) + (v - high) * scale
        return F.struct(F.floor(product).cast("double").alias("base"), product.alias("product"), error.alias("error"))

    def decide(s: Column) -> Column:
        base, error = s["base"], s["error"]
        rest = s["product"] - base
        tie = rest == 0.5
        up = (rest > 0.5) | (tie & (error > 0.0)) | (tie & (error == 0.0) & (base % 2.0 != 0.0))
        return (base + F.when(up, F.lit(1.0)).otherwise(F.lit(0.0))) / scale

    def rounded(v: Column) -> Column:
        exact = F.abs(v) >= F.lit(2.0**52 / scale)
        return F.when(v.isNull() | F.isnan(v) | exact, v).otherwise(bind(two_product(v), decide))

    return bind(value.cast("double"), rounded)


def bind(value: Column, fn: Callable[[Column], Column]) -> Column:
    """``fn(value)`` with ``value`` evaluated once however often ``fn`` uses it.

    Nested roundings would otherwise multiply the size of the expression, and the branches of a CASE
    would each run the same regular expression again.
    """
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def harmonic(p: Column, r: Column) -> Column:
    """F1 of two rates; 0.0 when both are zero."""
    return F.when(p + r > 0, F.lit(2.0) * p * r / (p + r)).otherwise(F.lit(0.0))


def percent_text(value: Column, digits: int = 2) -> Column:
    """``12.34%`` from a ratio."""
    return F.format_string(f"%.{digits}f%%", value * 100.0)
