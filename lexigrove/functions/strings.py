"""String expressions: hashes and feature names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexigrove.functions.arrays import let


def java_hash(text: Column) -> Column:
    """The JVM's hash of a string (31-polynomial, 32 bit, signed) for characters of the basic plane; null for null."""

    def of(t: Column) -> Column:
        codes = F.transform(F.sequence(F.lit(1), F.length(t)), lambda i: F.ascii(F.substring(t, i, F.lit(1))).cast("long"))
        total = F.aggregate(codes, F.lit(0).cast("long"), lambda a, c: (a * 31 + c) % F.lit(4294967296))
        signed = let(total, lambda x: F.when(x >= 2147483648, x - F.lit(4294967296)).otherwise(x))
        return F.when(F.length(t) == 0, F.lit(0).cast("long")).when(t.isNotNull(), signed)

    return let(text, of)


def feature_name(*parts: str) -> str:
    """A column name for a feature: lower case, with underscores."""
    return "_".join(parts).lower().replace("-", "_").replace(" ", "_")
