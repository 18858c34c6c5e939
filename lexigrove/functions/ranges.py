"""Half-open ranges ``struct<begin:int,end:int>`` and their tests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RANGE = "struct<begin:int,end:int>"


def range_of(begin: Column, end: Column) -> Column:
    """A range, or null if a bound is null."""
    made = F.struct(begin.cast("int").alias("begin"), end.cast("int").alias("end"))
    return F.when(begin.isNotNull() & end.isNotNull(), made)


def in_range(outer: Column, inner: Column) -> Column:
    """Whether ``inner`` lies in ``outer``."""
    return (inner["begin"] >= outer["begin"]) & (inner["end"] <= outer["end"])


def overlaps(a: Column, b: Column) -> Column:
    """Whether two ranges meet. Both ends count, so [0, 5] overlaps [5, 9]."""
    return (a["begin"] <= b["end"]) & (b["begin"] <= a["end"])


def token_in_range(token: Column, outer: Column) -> Column:
    return in_range(outer, token["token_range"])
