"""Mixing sources to target weights by systematic sampling.

Every document of a source has the same expected number of copies: the
source's target over its size.  The documents of a source are put in order of
size class (16 an octave), the expected copies are prefix-summed, one random offset a source is
added, and a document is emitted once for each integer boundary that its
interval crosses.  Ordering by size keeps the taken words near the target:
neighbours differ by a few per cent, so what one takes beyond its share the
next ones lack.

Within a size class documents come in the order of a digest of id and text, so
the order, and with it the result, does not depend on the size of the table or
on how it is partitioned.  Places in that order come from ``placed``: ranges
are sorted and counted, and no task holds a whole source, class or group of
copies.  Targets are worked out from running sums over the sources, which are
neither collected nor limited in number.

Cases: a null or empty text has size 0 and is never taken in words; a null
source is a source of its own, last in order; ids may be null or repeated, and
rows with the same id, source and text share what the mix takes of them; an
empty table gives an empty result; extra columns pass through ``mix_rows``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, checkpoint, fresh, placed

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MOST = 2.0
SEED = 20_240_607
#: Rows that a task sorts, and sources up to which their table is broadcast.
ROWS_PER_TASK = 1_000_000
FEW = 100_000


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def offset(source: Column, seed: int = SEED) -> Column:
    """The random offset of a source, from 0 up to 1: 52 bits of an MD5 sum."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.concat(F.lit("="), source), F.lit("")))
    return F.conv(F.substring(F.md5(name), 1, 13), 16, 10).cast("bigint") / float(1 << 52)


def targets(sizes: DataFrame) -> DataFrame:
    """(source, size, n) with target and first: the number of documents in sources before.

    Targets by weight, none above ``MOST`` times its size; the excess goes to
    the rest by weight.  Sources fill up in the order of size by weight, so the
    first that does not, with running sums of those before it, fixes the level.
    The windows run over a row a source, in sorts that spill; documents are not
    in them.
    """
    by_name, before = Window.orderBy(F.col("source").asc_nulls_last()), lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.row_number().over(by_name) - 1) % len(WEIGHTS) + 1).cast("int"))
    named = sizes.select("*", weight.alias("weight"), F.coalesce(F.sum("n").over(before(by_name)), F.lit(0)).alias("first"))
    by_level = Window.orderBy(F.lit(MOST) * F.col("size") / F.col("weight"), F.col("source").asc_nulls_last())
    every = by_level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sums = {c: F.coalesce(F.sum(c).over(before(by_level)), F.lit(0)) for c in ("size", "weight")}
    rest = F.lit(SHARE) * F.sum("size").over(every) - F.lit(MOST) * sums["size"]
    filled = named.select("*", F.row_number().over(by_level).alias("k"), rest.alias("rest"), (F.sum("weight").over(every) - sums["weight"]).alias("open"))
    filled = checkpoint(filled)
    level = filled.filter(F.col("rest") * F.col("weight") / F.col("open") <= F.lit(MOST) * F.col("size")).orderBy("k").select("k", "rest", "open").first()
    own = F.lit(level["rest"]) * F.col("weight") / F.lit(level["open"]) if level else F.lit(None).cast("double")
    full = F.col("k") < (level["k"] if level else 1 << 62)
    return filled.select("source", "size", "n", "first", F.when(full, F.lit(MOST) * F.col("size")).otherwise(own).alias("target"))


def digest(doc_id: Column, text: Column) -> Column:
    return F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("|"), F.coalesce(text.cast("string"), F.lit(""))))


def sampled(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """Per document: doc_id, digest, source, size, source_size, target, copies."""
    base = docs.select(F.col("doc_id"), F.col("source").cast("string").alias("source"), words(F.col("text")).alias("size"), digest(F.col("doc_id"), F.col("text")).alias("digest"))
    bits = F.bin(F.col("size") + 1)
    base = checkpoint(base.withColumn("cls", F.concat(F.lpad(F.length(bits).cast("string"), 2, "0"), F.substring(bits, 1, 5))))  # the octave, then the leading bits
    rate = targets(base.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")))
    rate = rate.select(F.col("source").alias("source_"), F.col("size").alias("source_size"), "target", "first", F.when(F.col("size") > 0, F.col("target") / F.col("size")).otherwise(0.0).alias("rate"), offset(F.col("source"), seed).alias("offset"))
    rate = F.broadcast(rate) if rate.count() <= FEW else rate
    rows = placed(base, [F.col("source").asc_nulls_last(), F.col("cls").asc(), F.col("digest").asc()], "place", ROWS_PER_TASK)
    rows = rows.join(rate, rows["source"].eqNullSafe(rate["source_"]))
    k = F.col("place") - F.col("first")
    crossed = F.floor(F.col("offset") + F.col("rate") * (k + 1)) - F.floor(F.col("offset") + F.col("rate") * k)
    return rows.select("doc_id", "digest", "source", "size", "source_size", "target", crossed.cast("bigint").alias("copies"))


def mix(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken (words) and copies."""
    return sampled(docs).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def mix_rows(docs: DataFrame) -> DataFrame:
    """The mixed documents: each row once for every copy, with all its columns.

    Copies are joined back by source and digest of id and text.  Where rows
    share all of that, their copies are dealt out evenly among them.
    """
    key, src, n, total, salt, each = (fresh(docs, c) for c in ("key_", "src_", "rows_", "copies_", "salt_", "copy_"))
    taken = sampled(docs).groupBy(F.col("digest").alias(f"{key}r"), F.col("source").alias(src)).agg(F.count(F.lit(1)).alias(n), F.sum("copies").alias(total))
    taken = checkpoint(taken.filter(F.col(total) > 0))
    keyed = docs.withColumn(key, digest(F.col("doc_id"), F.col("text"))).withColumn(salt, F.spark_partition_id())
    same = (F.col(key) == F.col(f"{key}r")) & F.col("source").cast("string").eqNullSafe(F.col(src))
    out = keyed.join(taken.filter(F.col(n) == 1), same).select(*docs.columns, total)
    if not taken.filter(F.col(n) > 1).isEmpty():
        out = out.union(_dealt(keyed.join(taken.filter(F.col(n) > 1), same), [f"{key}r", src], salt, n, total).select(*docs.columns, total))
    return out.withColumn(each, F.explode(F.sequence(F.lit(1), F.col(total).cast("int")))).select(*docs.columns)


def _dealt(rows: DataFrame, key: list[str], salt: str, n: str, total: str) -> DataFrame:
    """Alike rows with the copies of each in ``total``: its even share, and one more for the first of them.

    Rows are counted by key and the partition that they were read in (``salt``)
    and numbered within that, so no task holds all that are alike.
    """
    before, k = fresh(rows, "before_"), fresh(rows, "place_")
    rows = checkpoint(rows)
    past = Window.partitionBy(*key).orderBy(salt).rowsBetween(Window.unboundedPreceding, -1)
    ahead = rows.groupBy(*key, salt).agg(F.count(F.lit(1)).alias(before)).withColumn(before, F.coalesce(F.sum(before).over(past), F.lit(0)))
    ahead = ahead.select(*[F.col(c).alias(f"{c}_") for c in (*key, salt)], before)
    rows = rows.withColumn(k, F.row_number().over(Window.partitionBy(*key, salt).orderBy(F.lit(0))))
    rows = rows.join(ahead, (F.col(key[0]) == F.col(f"{key[0]}_")) & F.col(key[1]).eqNullSafe(F.col(f"{key[1]}_")) & (F.col(salt) == F.col(f"{salt}_")))
    share = F.floor(F.col(total) / F.col(n)) + (F.col(k) + F.col(before) <= F.col(total) % F.col(n)).cast("bigint")
    return rows.withColumn(total, share).filter(F.col(total) > 0)


#: The same in SQL.  Targets: sources by size for their weight; the first that is not full fixes the level.
ORACLE = f"""
WITH d AS (SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(text, '')) AS digest, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS size FROM documents),
t AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM d GROUP BY source),
c AS (SELECT *, row_number() OVER o AS k, {SHARE} * sum(source_size) OVER () - {MOST} * (sum(source_size) OVER o - source_size) AS rest,
             sum(w) OVER () - (sum(w) OVER o - w) AS open FROM t WINDOW o AS (ORDER BY {MOST} * source_size / w, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
f AS (SELECT min(k) AS first FROM c WHERE rest * w / open <= {MOST} * source_size),
l AS (SELECT rest, open FROM c JOIN f ON c.k = f.first),
g AS (SELECT c.source, source_size, CAST(CASE WHEN k < first THEN {MOST} * source_size ELSE l.rest * w / l.open END AS DOUBLE) AS target,
             CAST('0x' || substr(md5('{SEED}:' || coalesce('=' || source, '')), 1, 13) AS BIGINT) / 4503599627370496.0 AS u FROM c, f, l),
r AS (SELECT doc_id, size, source_size, target, u, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate,
             row_number() OVER (PARTITION BY d.source ORDER BY length(bin(size + 1)), substr(bin(size + 1), 1, 5),
             digest) AS k FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
n AS (SELECT *, CAST(floor(u + rate * k) - floor(u + rate * (k - 1)) AS BIGINT) AS copies FROM r)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, copies * CAST(size AS BIGINT) AS taken, copies FROM n
"""
