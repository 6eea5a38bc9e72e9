"""Computing a value once inside a larger expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed a single time per row.

    A Column used in several places is computed in each of them, and inside a lambda once per
    element; the variable of a one-element array is not.
    """
    return F.get(F.transform(F.array(value), use), 0)
