"""Exact decimal rounding of doubles.

The functions take a column name or a SQL expression as text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_exact(x: str, digits: int) -> Column:
    """Round the binary value of `x` to `digits` decimals, true ties to the even digit.

    Spark's `round` and `bround` work on the printed decimal, so 0.00625 counts as a tie although
    its binary value lies above it. Here the product with 2*10^digits is split into its rounded
    part and its exact error; the error decides what only looks like a tie.
    """
    x = f"CAST({x} AS DOUBLE)"
    scale, doubled = f"{float(10**digits)}D", f"{float(2 * 10**digits)}D"
    product = f"({x} * {doubled})"
    spread = f"({x} * 134217729D)"  # 2^27 + 1: splits a double into two exact halves
    high = f"({spread} - ({spread} - {x}))"
    error = f"(({high} * {doubled} - {product}) + ({x} - {high}) * {doubled})"
    towards = f"CASE WHEN abs({product}) % 2D = 1D THEN signum({error}) ELSE 0D END"
    return F.expr(f"rint(({product} + {towards}) / 2D) / {scale} + 0D")  # no negative zero


def ratio(part: str, whole: str) -> str:
    """SQL text of part / whole in doubles, 0.0 when the whole is zero or null."""
    return f"coalesce(CAST({part} AS DOUBLE) / nullif(CAST({whole} AS DOUBLE), 0D), 0D)"


def share(part: str, whole: str, digits: int = 4) -> Column:
    """`part / whole` rounded; 0.0 when the whole is empty."""
    return round_exact(ratio(part, whole), digits)
