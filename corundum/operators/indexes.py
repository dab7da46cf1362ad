"""Index-shaped lookups as predicates that reach the Parquet scan."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class ColumnCountMismatch(ValueError):
    pass


def prefix(df: DataFrame, columns: Sequence[str], values: Sequence) -> DataFrame:
    """Rows with these values in the leading columns; all columns make it a point lookup."""
    if len(values) > len(columns):
        raise ColumnCountMismatch(f"{len(columns)} columns, {len(values)} values")
    return reduce(lambda d, cv: d.filter(F.col(cv[0]) == F.lit(cv[1])), zip(columns, values, strict=False), df)


def between(df: DataFrame, columns: Sequence[str], low=None, high=None) -> DataFrame:
    """Rows from low to high, both inclusive and either open (None).

    Several columns are compared as a tuple; the bound on the first column is
    stated by itself too, so that it reaches the scan.
    """
    one = len(columns) == 1
    key = F.col(columns[0]) if one else F.struct(*columns)

    def bound(v):
        if one:
            return F.lit(v[0] if isinstance(v, (tuple, list)) else v)
        if len(v) != len(columns):
            raise ColumnCountMismatch(f"{len(columns)} columns, {len(v)} values")
        return F.struct(*[F.lit(x).alias(c) for c, x in zip(columns, v, strict=True)])

    for v, above in ((low, True), (high, False)):
        if v is not None:
            if not one:
                df = df.filter(F.col(columns[0]) >= F.lit(v[0]) if above else F.col(columns[0]) <= F.lit(v[0]))
            df = df.filter(key >= bound(v) if above else key <= bound(v))
    return df


def violations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their number; keys holding a null never do."""
    some = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])
    return df.filter(some).groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
