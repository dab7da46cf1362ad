"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..scratch import checkpoint, fresh, shared_folder

__all__ = ["WORD", "checkpoint", "fresh", "give_back", "held_out", "lean", "placed", "shared_folder", "stratified", "table", "trainable", "unit_hash"]

#: Pattern of a word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def give_back() -> None:
    """Hands memory that is free within this process back to the system: Arrow's pool and the C heap keep it otherwise."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # C libraries other than glibc
        ctypes.CDLL(None).malloc_trim(0)


def lean(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same over batches, but what it held and freed does not stay with the Python worker, which is used again by later tasks."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b
            del b
            give_back()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(read(batches))
        finally:
            give_back()

    return run


def placed(df: DataFrame, keys: list[Column], name: str, rows_per_task: int) -> DataFrame:
    """The rows with their place, from 0, in the order of ``keys``; rows alike in all of them in any order.

    Rows are dealt into ranges of the keys, sorted there and numbered as they
    lie; the numbers of rows before each range come in by a join.  No window
    runs over rows, and a key that very many rows share spans many ranges.
    """
    n = df.count()
    tie, own, part, ahead = (fresh(df, c) for c in ("tie_", "own_", "part_", "ahead_"))
    order = [*keys, F.col(tie)]
    dealt = df.withColumn(tie, F.monotonically_increasing_id()).repartitionByRange(max(1, -(-n // rows_per_task)), *order)
    dealt = checkpoint(dealt.sortWithinPartitions(*order).drop(tie).withColumn(own, F.monotonically_increasing_id()))
    dealt = dealt.withColumn(part, F.shiftright(own, 33)).withColumn(own, F.col(own).bitwiseAND((1 << 33) - 1))
    sizes = dealt.groupBy(part).agg(F.count(F.lit(1)).alias(ahead))  # a row a range
    past = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(part, F.coalesce(F.sum(ahead).over(past), F.lit(0)).alias(ahead))
    return dealt.join(F.broadcast(sizes), part).withColumn(name, F.col(own) + F.col(ahead)).drop(part, own, ahead)


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text is divisible by 5; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def trainable(doc_id: Column) -> Column:
    """True where labels of the row may be learnt from; a null id never is."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 != 0, F.lit(False))


def unit_hash(*cols: Column) -> Column:
    """A repeatable pseudo-random number from 0 up to 1 for each row."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double") / float(1 << 53)


def stratified(ids: DataFrame, label: str, cap: int, seed: int, by: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """About ``cap`` rows for each value of ``label`` (all, where there are fewer).

    Rows are chosen by a hash of ``by``, so reruns agree; their number is
    binomial around ``cap`` where the rows differ in it.  The shares come in by
    a join, however many values there are.
    """
    of, n = fresh(ids, "of_"), fresh(ids, "n_")
    counts = ids.groupBy(F.col(label).alias(of)).agg(F.count(F.lit(1)).alias(n))
    return ids.join(counts, F.col(label) == F.col(of)).filter(unit_hash(*map(F.col, by), F.lit(seed)) * F.col(n) < cap).drop(of, n)
