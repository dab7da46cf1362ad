"""Connected components by alternating large and small stars.

Edges are contracted by groupBy/join rounds only; each round is cut through
the checkpoint folder.  Neither edges nor labels ever reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint

ROWS_PER_TASK = 60_000
LEAST_TASKS = 8


def settled(edges: DataFrame) -> DataFrame:
    """A checkpoint without the size estimates of the plan before it.

    An estimate of a join is the product of both sides, and checkpoints keep
    estimates: over rounds of joins their digits would double again and again,
    until planning took longer than any work.
    """
    done, spark = checkpoint(edges), edges.sparkSession
    return DataFrame(spark._jsparkSession.createDataFrame(done._jdf.toJavaRDD(), done._jdf.schema()), spark)


def with_least(rows: DataFrame, key: str, least: DataFrame) -> DataFrame:
    """``rows`` with what an aggregate by ``key`` has for theirs.

    The aggregate is joined on another expression of its key, so both sides are
    dealt for the join alone: only then can adaptive execution split a key that
    very many rows share (a hub) over several tasks.
    """
    turned = least.select(F.bitwise_not(key).alias("turned_"), *[c for c in least.columns if c != key])
    return rows.join(turned, F.bitwise_not(rows[key]) == F.col("turned_")).drop("turned_")


def _large_star(edges: DataFrame, tasks: int) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")).coalesce(tasks)
    return with_least(both.filter("b > a"), "a", least).coalesce(tasks).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct().coalesce(tasks)


def _small_star(edges: DataFrame, tasks: int) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m")).coalesce(tasks)
    moved = with_least(edges, "a", least).coalesce(tasks).filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct().coalesce(tasks)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node with an edge other than the root itself.

    ``edges`` has two bigint columns a and b; order, repeats and loops do not
    matter.  The root is the smallest node of the component.

    A round has a task for ``ROWS_PER_TASK`` edges and ``LEAST_TASKS`` at least,
    however many shuffle partitions the session has: each task of each round
    leaves files of its own until the driver collects its garbage.
    """
    mark = lambda e: tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    edges = settled(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    before, now = None, mark(edges)
    while now[0] and now != before:
        before = now
        tasks = max(LEAST_TASKS, -(-2 * now[0] // ROWS_PER_TASK))
        edges = settled(_small_star(_large_star(edges, tasks), tasks))
        now = mark(edges)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
