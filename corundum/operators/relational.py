"""Relational operators as thin compositions of DataFrame operations.

Each takes and returns DataFrames and leaves the physical plan to Catalyst:
filters and column lists reach the scan, join strategies follow from sizes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import checkpoint, fresh

AGGREGATES = {"count": F.count, "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "count_distinct": F.count_distinct}
JOINS = {"inner", "left", "right", "full", "left_semi", "left_anti"}


def project(df: DataFrame, *columns: str, **aliases: str | Column) -> DataFrame:
    """Columns by name; keywords give aliases.  An unknown name raises."""
    named = [(F.col(c) if isinstance(c, str) else c).alias(a) for a, c in aliases.items()]
    return df.select(*columns, *named)


def where(df: DataFrame, *conditions: Column | str) -> DataFrame:
    """Rows for which all conditions are true (neither false nor null)."""
    return df.filter(reduce(lambda a, b: a & b, [F.expr(c) if isinstance(c, str) else c for c in conditions]))


def equi_join(left: DataFrame, right: DataFrame, keys: dict[str, str], how: str = "inner", null_safe: bool = False) -> DataFrame:
    """Join on equal keys; with ``null_safe`` nulls equal nulls.  Columns of the left come first."""
    if how not in JOINS:
        raise ValueError(f"unknown join {how}")
    same = [left[a].eqNullSafe(right[b]) if null_safe else left[a] == right[b] for a, b in keys.items()]
    return left.join(right, reduce(lambda a, b: a & b, same), how)


def block_join(left: DataFrame, right: DataFrame, keys: dict[str, str], null_safe: bool = False, rows_per_task: int = 8_000_000) -> DataFrame:
    """Inner ``equi_join`` for keys with many rows on both sides, whose result outgrows its input.

    A join sizes its tasks by what they read, and by key at most.  Here pairs
    are counted first; beyond ``rows_per_task`` the rows of a key are dealt into
    slices on both sides, and the pairs of slices go to as many tasks as the
    result needs.  A row is sent once a slice of the other side, which is a small
    part of the pairs, and a task keeps one slice at a time.
    """
    key, i, j, at, n, m = (fresh(left, fresh(right, c)) for c in ("key_", "i_", "j_", "at_", "n_", "m_"))
    ours, theirs = ([fresh(left, fresh(right, f"{side}_{k}_")) for k in range(len(keys))] for side in ("left", "right"))
    count = lambda df, by, names, out: df.groupBy(*[F.col(c).alias(a) for c, a in zip(by, names, strict=True)]).agg(F.count(F.lit(1)).alias(out))
    counts = equi_join(count(left, keys, ours, n), count(right, keys.values(), theirs, m), dict(zip(ours, theirs, strict=True)), null_safe=null_safe)
    counts = checkpoint(counts.withColumn(key, F.monotonically_increasing_id()))
    pairs, found = counts.agg(F.sum(F.col(n).cast("double") * F.col(m)), F.count(F.lit(1))).first()
    if (pairs or 0) <= rows_per_task:
        return equi_join(left, right, keys, null_safe=null_safe)
    parts, slice_ = -(-int(pairs) // rows_per_task), max(1, int((rows_per_task / 8) ** 0.5))
    slices = counts.select(*ours, *theirs, key, F.ceil(F.col(n) / slice_).alias(n), F.ceil(F.col(m) / slice_).alias(m))

    def dealt(df: DataFrame, by, names: list[str], own: tuple[str, str], other: tuple[str, str]) -> DataFrame:
        rows = checkpoint(df.withColumn(at, F.xxhash64(F.monotonically_increasing_id())))  # a task that runs again deals alike
        of = slices.select(*names, key, n, m)
        rows = equi_join(rows, F.broadcast(of) if found <= 100_000 else of, dict(zip(by, names, strict=True)), null_safe=True)
        each = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(other[1]) - 1))
        return rows.select(*df.columns, key, F.pmod(at, own[1]).alias(own[0]), each.alias(other[0])).repartition(parts, key, i, j)

    l, r = dealt(left, keys, ours, (i, n), (j, m)), dealt(right, keys.values(), theirs, (j, m), (i, n))
    return l.hint("merge").join(r, [key, i, j]).drop(key, i, j)


def theta_join(left: DataFrame, right: DataFrame, condition: Column, how: str = "inner") -> DataFrame:
    """Join on any condition.

    An inner or one-sided join broadcasts a side within Spark's threshold; there
    is no better way for an arbitrary condition.  For ranges use ``range_join``.
    """
    if how not in JOINS:
        raise ValueError(f"unknown join {how}")
    return left.join(right, condition, how)


def range_join(points: DataFrame, ranges: DataFrame, at: str, low: str, high: str, width: float) -> DataFrame:
    """Points with the ranges [low, high] that hold them; a null or NaN bound or point matches nothing.

    Ranges of up to ``width`` are filed under the bins of that width that they
    meet, wider ones under bins of twice, four times ... the width: two at most
    each, however wide.  Points look in one bin of each level that has ranges,
    so the join is an equi-join, and a pair meets in one bin only.  Unbounded
    ranges (infinities) share one bin that every point looks into.
    """
    level, bin_ = (fresh(points, fresh(ranges, c)) for c in ("level_", "bin_"))
    open_ = 2_000  # beyond any level of finite doubles
    number = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    place = lambda c, k: F.when(k == open_, F.lit(0)).otherwise(F.floor(c.cast("double") / (F.lit(float(width)) * F.pow(F.lit(2.0), k))))
    span = F.col(high).cast("double") - F.col(low).cast("double")
    rank = F.when(span == float("inf"), open_).when(span <= float(width), 0).otherwise(F.ceil(F.log2(span / float(width)) + 1e-9).cast("int"))
    filed = ranges.filter(number(low) & number(high) & (F.col(low) <= F.col(high))).withColumn(level, rank)
    filed = filed.withColumn(bin_, F.explode(F.array_distinct(F.array(place(F.col(low), F.col(level)), place(F.col(high), F.col(level))))))
    present = [r[0] for r in filed.select(level).distinct().collect()]  # one number a power of two
    looked = points.filter(number(at)).withColumn(level, F.explode(F.array(*map(F.lit, present)).cast("array<int>")))
    looked = looked.withColumn(bin_, place(F.col(at), F.col(level)))
    return looked.join(filed, [level, bin_]).filter((F.col(at) >= F.col(low)) & (F.col(at) <= F.col(high))).drop(level, bin_)


def aggregate(df: DataFrame, by: list[str] | None = None, having: Column | str | None = None, **columns: tuple[str, str | None]) -> DataFrame:
    """Grouped or global aggregates: ``total=("sum", "price")``, ``n=("count", None)`` for COUNT(*)."""
    if unknown := [f for f, _ in columns.values() if f not in AGGREGATES]:
        raise ValueError(f"unknown aggregate {unknown[0]}")
    out = [AGGREGATES[f](F.col(c) if c else F.lit(1)).alias(name) for name, (f, c) in columns.items()]
    done = df.groupBy(*(by or [])).agg(*out) if out else df.select(*(by or [])).distinct()
    return done if having is None else done.filter(having)


def order(df: DataFrame, *keys: str | tuple[str, str], limit: int | None = None, offset: int = 0) -> DataFrame:
    """Sorted rows, optionally a slice of them; ``("price", "desc")`` sorts downwards.  Nulls are lowest."""
    out = df.orderBy(*[F.col(k).asc() if isinstance(k, str) else getattr(F.col(k[0]), k[1])() for k in keys])
    out = out.offset(offset) if offset else out
    return out if limit is None else out.limit(limit)


def union(*parts: DataFrame, distinct: bool = False) -> DataFrame:
    out = reduce(lambda a, b: a.unionByName(b), parts)
    return out.distinct() if distinct else out


def as_of_join(left: DataFrame, right: DataFrame, by: str, at: str, columns: list[str], rows_per_task: int = 1_000_000) -> DataFrame:
    """Each left row with ``columns`` of the latest right row of its key up to its time; null keys and times match nothing.

    Both sides are stacked, dealt into ranges of (key, time) and one window
    carries the last right row forward within a range; where a range begins
    inside a key, the last right row of the ranges before comes in.  No pair
    of rows is formed, and a key with very many rows spans many ranges.
    """
    from pyspark.sql import Window

    known = F.col(by).isNotNull() & F.col(at).isNotNull()
    held = F.struct(*columns)
    of = right.filter(known).select(F.col(by).alias("_by"), F.col(at).alias("_at"), F.lit(0).alias("_side"), F.xxhash64(*columns).alias("_tie"), held.alias("_right"))
    mine = left.filter(known).select(F.struct(*left.columns).alias("_left"), F.col(by).alias("_by"), F.col(at).alias("_at"), F.lit(1).alias("_side"), F.monotonically_increasing_id().alias("_tie"), F.lit(None).cast(of.schema["_right"].dataType).alias("_right"))
    theirs = of.select(F.lit(None).cast(mine.schema["_left"].dataType).alias("_left"), *of.columns)
    rows = mine.unionByName(theirs)
    parts = max(1, -(-(left.count() + right.count()) // rows_per_task))
    order = ["_at", "_side", "_tie"]
    if parts == 1:  # no need to deal ranges
        past = Window.partitionBy("_by").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        rows = rows.withColumn("_last", F.last("_right", ignorenulls=True).over(past))
    else:
        rows = checkpoint(rows.repartitionByRange(parts, "_by", *order).withColumn("_range", F.spark_partition_id()))
        past = Window.partitionBy("_range", "_by").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        before = Window.partitionBy("_by").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
        ends = rows.filter("_side = 0").groupBy("_by", "_range").agg(F.max_by("_right", F.struct("_at", "_tie")).alias("_end"))
        asked = rows.select("_by", "_range").distinct().join(ends, ["_by", "_range"], "left")
        carried = asked.select("_by", "_range", F.last("_end", ignorenulls=True).over(before).alias("_carried"))
        rows = rows.withColumn("_own", F.last("_right", ignorenulls=True).over(past)).filter("_side = 1").join(carried, ["_by", "_range"], "left")
        rows = rows.withColumn("_last", F.coalesce("_own", "_carried"))
    right_ = [f"right_{c}" for c in columns]
    out = rows.filter("_side = 1").select("_left.*", *[F.col("_last")[c].alias(n) for c, n in zip(columns, right_, strict=True)])
    return out.union(left.filter(~known).select("*", *[F.lit(None).cast(out.schema[n].dataType).alias(n) for n in right_]))
