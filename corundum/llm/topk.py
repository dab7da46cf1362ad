"""Exact top-k inner products by norm-sorted scanning.

Components become integers, floor(256 x).  Vectors are sorted by descending
length and cut into groups; each group is met by blocks of queries.  A task
scans a group's vectors in order: Cauchy-Schwarz ends the scan for a query once
|q||v| falls below its k-th best score, and before the full product a partial
sum over the leading axes of an SVD rotation plus the product of the residual
lengths prunes the rest.  What survives is scored in integers.  The group of
the longest vectors is scanned first and seeds each query's k-th best score.

Both sides grow with the table and neither is broadcast: groups and query
blocks have sizes bounded in bytes, a group is sent only to blocks with a query
that can reach it, and each pair of them is one task's work.

Cases: vectors that are null or hold null or non-finite components (256 times
as large) take no part, nor do rows without a ``vec_id``; shorter vectors are padded with zeros;
a repeated ``vec_id`` is another row, and only the query's own row is left out;
ties go to the smaller ``vec_id``; scores are exact whatever the components,
and one that a bigint cannot hold is given as the nearest bigint; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint

SCALE = 256
K = 5
#: Bounds of what one task holds: vectors of a group, queries of a block, and bytes of either.
GROUP = 65_536
BLOCK = 4_096
BYTES = 64 << 20
#: Vectors scored at a time, and the share of the axes in the partial sum.
CHUNK = 512
HEAD = 0.375
RESULT = "query_row bigint, query_id bigint, vec_id bigint, score bigint"


#: The ends of a bigint.
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def integers(vector: Column) -> Column:
    """floor(256 x) of the components, as doubles, which hold it exactly; null where the vector takes no part."""
    v = vector.cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x * SCALE) < float("inf")))
    return F.when(fine, F.transform(v, lambda x: F.when(F.abs(x) < float(1 << 44), F.floor(x * SCALE).cast("double")).otherwise(x * SCALE)))


def _matrix(column, width: int) -> np.ndarray:
    """The vectors as rows of doubles, short ones padded with zeros."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False)) if len(lists) else np.zeros(0, np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    sizes = np.diff(np.concatenate(([0], ends)))
    out = np.zeros((len(sizes), width))
    out[np.arange(width)[None, :] < sizes[:, None]] = flat
    return out


def _gram(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for b in batches:
            m = _matrix(b.column(0), width)
            total += m.T @ m
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width, dtype=np.int32)), pa.array(list(total), pa.list_(pa.float64()))], names=["axis", "products"])

    return run


def rotation(vectors: DataFrame, width: int) -> np.ndarray:
    """The right singular vectors of all vectors, from their Gram matrix (width x width, summed in the cluster)."""
    part = vectors.select("v").mapInArrow(_gram(width), "axis int, products array<double>")
    sums = part.select("axis", F.posexplode("products").alias("at", "p")).groupBy("axis", "at").agg(F.sum("p").alias("p")).collect()
    gram = np.zeros((width, width))
    for r in sums:
        gram[r["axis"], r["at"]] = r["p"]
    gram = (gram + gram.T) / 2
    return np.linalg.eigh(gram)[1][:, ::-1].copy() if np.isfinite(gram).all() else np.eye(width)


def products(a: np.ndarray, b: np.ndarray, most: float) -> np.ndarray:
    """Exact inner products of rows that lie side by side, none of a length beyond ``most``: in doubles, integers or Python's integers."""
    if most < 2.0**52:
        return np.einsum("ij,ij->i", a, b).astype(np.int64)
    if most < 2.0**62:
        return np.einsum("ij,ij->i", a.astype(np.int64), b.astype(np.int64))
    whole = [sum(int(x) * int(y) for x, y in zip(p, q, strict=True)) for p, q in zip(a.tolist(), b.tolist(), strict=True)]
    return np.array([min(max(s, LEAST), MOST) for s in whole], np.int64)


class Best:
    """The k best (score, id) of each query so far."""

    def __init__(self, n: int, k: int, floor: np.ndarray):
        self.k, self.floor = k, floor  # of each query: what a score must reach
        self.query, self.score, self.vec = (np.zeros(0, np.int64) for _ in range(3))
        self.n = n

    def add(self, query: np.ndarray, score: np.ndarray, vec: np.ndarray) -> None:
        q, s, v = (np.concatenate(p) for p in ((self.query, query), (self.score, score), (self.vec, vec)))
        order = np.lexsort((v, -s, q))
        q, s, v = q[order], s[order], v[order]
        start = np.searchsorted(q, q)
        top = np.arange(len(q)) - start < self.k
        self.query, self.score, self.vec = q[top], s[top], v[top]
        last = np.flatnonzero(np.arange(len(q)) - start == self.k - 1)
        self.floor[q[last]] = np.maximum(self.floor[q[last]], s[last])


def scan(queries: np.ndarray, query_rows: np.ndarray, floor: np.ndarray, vectors: np.ndarray, rows: np.ndarray, ids: np.ndarray, axes: np.ndarray, k: int) -> Best:
    """Top k of each query among ``vectors`` that can reach its floor (-inf: none yet)."""
    best = Best(len(queries), k, floor.copy())
    if not len(vectors) or not len(queries):
        return best
    vectors, queries = vectors.astype(float), queries.astype(float)
    lengths = np.sqrt((vectors**2).sum(axis=1))
    order = np.argsort(-lengths, kind="stable")
    vectors, rows, ids, lengths = vectors[order], rows[order], ids[order], lengths[order]
    own = np.sqrt((queries**2).sum(axis=1))
    head = max(1, round(axes.shape[1] * HEAD))
    qr, vr = queries @ axes[:, :head], vectors @ axes[:, :head]
    q_rest = np.sqrt(np.maximum(own**2 - (qr**2).sum(axis=1), 0))
    v_rest = np.sqrt(np.maximum(lengths**2 - (vr**2).sum(axis=1), 0))
    for at in range(0, len(vectors), CHUNK):
        end = min(at + CHUNK, len(vectors))
        slack = 1e-9 * own * lengths[at] + 1e-3  # rounding of the bounds; scores are integers
        live = np.flatnonzero(~(own * lengths[at] + slack < best.floor))  # lengths beyond doubles prune nothing
        if not len(live):
            break
        bound = qr[live] @ vr[at:end].T + q_rest[live, None] * v_rest[None, at:end] + slack[live, None]
        qi, vi = np.nonzero(~(bound < best.floor[live, None]) & (query_rows[live, None] != rows[None, at:end]))
        if not len(qi):
            continue
        most = float(own[live].max() * lengths[at])
        if most < 2.0**52 and len(qi) * 4 > bound.size:
            score = (queries[live] @ vectors[at:end].T)[qi, vi].astype(np.int64)
        else:
            score = np.concatenate([products(queries[live[qi[s : s + 65_536]]], vectors[at + vi[s : s + 65_536]], most) for s in range(0, len(qi), 65_536)])
        good = score >= best.floor[live[qi]]
        best.add(live[qi[good]], score[good], ids[at + vi[good]])
    return best


def _scanner(axes: np.ndarray, width: int, k: int):
    def run(queries: pa.Table, group: pa.Table) -> pa.Table:
        floor = np.array([-np.inf if f is None else f for f in queries["floor"].to_pylist()])
        whole = lambda t, c: t[c].to_numpy().astype(np.int64)
        row_no, ids = whole(queries, "row_no"), whole(queries, "vec_id")
        best = scan(_matrix(queries["v"], width), row_no, floor, _matrix(group["its_v"], width), whole(group, "its_row_no"), whole(group, "its_vec_id"), axes, k)
        return pa.table({"query_row": row_no[best.query], "query_id": ids[best.query], "vec_id": best.vec, "score": best.score})

    return run


def best_of(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query: found holds k rows of a query for each group at most."""
    order = F.array_sort(F.collect_list(F.struct(F.bitwise_not("score").alias("less"), "vec_id")))
    top = found.groupBy("query_row", "query_id").agg(F.slice(order, 1, k).alias("top"))
    return top.select("query_row", "query_id", F.posexplode("top").alias("at", "t")).select("query_row", "query_id", (F.col("at") + 1).alias("rank"), F.col("t.vec_id").alias("vec_id"), F.bitwise_not("t.less").alias("score"))


def top_k(embeddings: DataFrame, k: int = K, every: int = 50, group: int = GROUP, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score of rows whose id is divisible by ``every``."""
    rows = embeddings.select(F.col("vec_id").cast("bigint").alias("vec_id"), integers(F.col("embedding")).alias("v"), F.monotonically_increasing_id().alias("row_no"))
    rows = checkpoint(rows.filter(F.col("v").isNotNull() & F.col("vec_id").isNotNull()))
    n, width = rows.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    spark = rows.sparkSession
    if not n or not width:
        n, width = n or 0, 1
    axes = rotation(rows, width)
    group, block = (max(1, min(most, BYTES // (8 * width))) for most in (group, block))
    groups = max(1, math.ceil(n / group), min(12, n // 2048))
    length = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    dealt = rows.withColumn("length", length).repartitionByRange(groups, F.desc("length"), "row_no")
    dealt = checkpoint(dealt.select("row_no", "vec_id", "v", "length", F.spark_partition_id().alias("group")))
    held = [(r["group"], r["l"]) for r in dealt.groupBy("group").agg(F.max("length").alias("l")).collect()]
    if not held:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    held.sort(key=lambda g: (-g[1], g[0]))
    asked = dealt.filter(F.col("vec_id") % every == 0).select("row_no", "vec_id", "v", "length")
    blocks = max(1, math.ceil(n / every / block))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("row_no"), F.lit(blocks)).cast("int"))
    renamed = [F.col(c).alias(f"its_{c}") for c in ("row_no", "vec_id", "v")]
    # a group goes to the blocks that ask for it, and to no other
    of_group = lambda d, q: d.select(*renamed, F.col("group").alias("of")).join(q.select(F.col("group").alias("of"), F.col("block").alias("for_block")).distinct(), "of")
    run = _scanner(axes, width, k)
    pairs = lambda q, g: q.groupBy("group", "block").cogroup(g.groupBy("of", "for_block")).applyInArrow(run, RESULT)
    longest = held[0][0]
    first = asked.withColumn("group", F.lit(longest)).withColumn("floor", F.lit(None).cast("double"))
    found = checkpoint(pairs(first, of_group(dealt.filter(F.col("group") == longest), first)))
    if len(held) > 1:
        floors = found.groupBy("query_row").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).cast("double").alias("floor"))
        queries = asked.join(floors, asked["row_no"] == floors["query_row"], "left")
        # a query is sent only to groups whose longest vector could reach its floor
        rest = F.arrays_zip(F.lit([g for g, _ in held[1:]]).alias("g"), F.lit([x for _, x in held[1:]]).alias("l"))
        reach = lambda g: F.col("floor").isNull() | (F.sqrt(F.col("length") * g["l"]) * (1 + 1e-9) + 1e-3 >= F.col("floor"))
        queries = queries.withColumn("to", F.explode(F.filter(rest, reach))).select("row_no", "vec_id", "v", "block", "floor", F.col("to")["g"].alias("group"))
        found = found.union(pairs(queries, of_group(dealt.filter(F.col("group") != longest), queries)))
    return best_of(found, k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.r <> c.r),
t AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM t WHERE rank <= 5
"""
