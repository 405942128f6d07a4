"""A value that an expression names more than once, computed once a row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with `value` computed once.

    A column named twice is written out twice, and again wherever a filter on the result is pushed
    below it, so nested texts grow to expressions too large to compile. Here it stands once, as the
    only element of an array that `use` is applied to.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))
