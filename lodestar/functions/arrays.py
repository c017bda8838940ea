"""Arrays as columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def removed(array: Column, *values: object) -> Column:
    """The array without any of the values, and without nulls; in the order that it has. Null stays null."""
    return reduce(lambda a, v: F.array_remove(a, v), values, F.array_compact(array))
