"""Exact deduplication against a minimal perfect hash of historical digests.

Every text is reduced to its SHA-256 digest.  The distinct digests of the
history are dealt into shards by their leading bits; each shard gets a minimal
perfect hash (random 3-partite hypergraphs, peeled in vectorised rounds) whose
slots hold the full digest, the locator of the winning row and the group size.
New rows are first reduced to a row a digest, looked up in their shard and
compared with all 32 bytes in the slot: members are repeats of the history,
nonmembers form groups of their own.

Cases: a null text counts as empty; a null ``doc_id`` loses against any other;
of repeated rows with the same id and text one stays; an empty table gives an
empty result; extra columns are ignored by ``resolve`` and passed through by
``keep_winners``.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, fresh

KEYS_PER_SHARD = 32_768
INDEX = "shard int, seed int, width int, pilots binary, digests binary, docs array<bigint>, row_nos array<bigint>, sizes array<bigint>"
GROUPS = "digest binary, keep_id bigint, keep_row bigint, group_size bigint"


# ---------------------------------------------------------------- the hash
def points(words: np.ndarray, width: int, seed: int) -> np.ndarray:
    """Three vertices a digest, one in each third of the vertex range."""
    odd = np.uint64((0x9E3779B97F4A7C15 * (2 * seed + 1)) & 0xFFFFFFFFFFFFFFFF)
    mixed = words[:, :3] * odd
    mixed ^= mixed >> np.uint64(29)
    return (mixed % np.uint64(width)).astype(np.int64) + np.arange(3) * width


def peel(pts: np.ndarray, vertices: int) -> list[tuple[np.ndarray, np.ndarray]] | None:
    """Rounds of (keys, their free vertices), or None if a core remains."""
    keys = np.arange(len(pts))
    degree = np.bincount(pts.ravel(), minlength=vertices)
    mixed = np.zeros(vertices, np.int64)  # XOR of the keys at a vertex: the key itself where the degree is 1
    np.bitwise_xor.at(mixed, pts.ravel(), np.repeat(keys, 3))
    rounds, left = [], len(pts)
    while left:
        free = np.flatnonzero(degree == 1)
        if not len(free):
            return None
        gone, first = np.unique(mixed[free], return_index=True)
        rounds.append((gone, free[first]))
        at = pts[gone].ravel()
        np.subtract.at(degree, at, 1)
        np.bitwise_xor.at(mixed, at, np.repeat(gone, 3))
        left -= len(gone)
    return rounds


def build_hash(words: np.ndarray) -> tuple[int, int, np.ndarray]:
    """Seed, width and the pilot of each vertex (3: unused)."""
    for seed in range(1000):
        width = math.ceil(len(words) * 0.42) + 2 + seed // 4
        pts = points(words, width, seed)
        if (rounds := peel(pts, 3 * width)) is None:
            continue
        pilots = np.zeros(3 * width, np.int64)
        used = np.zeros(3 * width, bool)
        for keys, free in reversed(rounds):
            others = pilots[pts[keys]].sum(axis=1) - pilots[free]
            pilots[free] = (free // width - others) % 3
            used[free] = True
        return seed, width, np.where(used, pilots, 3).astype(np.uint8)
    raise ValueError("the digests are not distinct")


def slots_of(words: np.ndarray, seed: int, width: int, pilots: np.ndarray) -> np.ndarray:
    """The slot of each digest; any slot for digests the hash was not built on."""
    pts = points(words, width, seed)
    pick = (pilots[pts].astype(np.int64) % 3).sum(axis=1) % 3
    vertex = pts[np.arange(len(pts)), pick]
    rank = np.cumsum(pilots < 3) - 1
    return np.maximum(rank[vertex], 0)


def _words(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, 4)


def _build_shard(t: pa.Table) -> pa.Table:
    words = _words(t["digest"])
    seed, width, pilots = build_hash(words)
    order = np.argsort(slots_of(words, seed, width, pilots))
    t = t.take(pa.array(order))
    one = lambda c, kind: pa.array([t[c].to_pylist()], pa.list_(kind))
    return pa.table(
        {
            "shard": pa.array([t["shard"][0].as_py()], pa.int32()),
            "seed": pa.array([seed], pa.int32()),
            "width": pa.array([width], pa.int32()),
            "pilots": pa.array([pilots.tobytes()], pa.binary()),
            "digests": pa.array([words[order].tobytes()], pa.binary()),
            "docs": one("keep_id", pa.int64()),
            "row_nos": one("keep_row", pa.int64()),
            "sizes": one("group_size", pa.int64()),
        }
    )


def _resolve_shard(new: pa.Table, index: pa.Table) -> pa.Table:
    """Groups of a shard: those of the history, new rows merged in, then nonmembers."""
    schema = pa.schema([("digest", pa.binary()), ("keep_id", pa.int64()), ("keep_row", pa.int64()), ("group_size", pa.int64())])
    fresh_groups = new.select(schema.names).cast(schema)
    if not index.num_rows:
        return fresh_groups
    words = np.frombuffer(index["digests"][0].as_py(), np.uint64).reshape(-1, 4)
    raw = words.tobytes()
    docs, rows, sizes = (index[c][0].as_py() for c in ("docs", "row_nos", "sizes"))
    outside = fresh_groups
    if new.num_rows:
        asked = _words(new["digest"])
        pilots = np.frombuffer(index["pilots"][0].as_py(), np.uint8)
        slot = slots_of(asked, index["seed"][0].as_py(), index["width"][0].as_py(), pilots)
        member = (words[slot] == asked).all(axis=1)
        for s, doc, row, n in zip(slot[member].tolist(), *(fresh_groups.filter(pa.array(member))[c].to_pylist() for c in schema.names[1:]), strict=True):
            sizes[s] += n
            if doc is not None and (docs[s] is None or (doc, row) > (docs[s], rows[s])):
                docs[s], rows[s] = doc, row
        outside = fresh_groups.filter(pa.array(~member))
    history = pa.table([pa.array([raw[i : i + 32] for i in range(0, len(raw), 32)], pa.binary()), pa.array(docs, pa.int64()), pa.array(rows, pa.int64()), pa.array(sizes, pa.int64())], schema=schema)
    return pa.concat_tables([history, outside])


# ---------------------------------------------------------------- DataFrames
def digest(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, digest and a row number that tells repeated rows apart."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), digest(F.col("text")).alias("digest"), F.monotonically_increasing_id().alias("row_no"))


def grouped(rows: DataFrame, shards: int) -> DataFrame:
    """A row a distinct digest: winner, size and shard; combined before the shuffle."""
    best = F.max(F.struct("doc_id", "row_no"))
    return (
        rows.groupBy("digest")
        .agg(best.alias("best"), F.count(F.lit(1)).alias("group_size"))
        .select("digest", F.col("best.doc_id").alias("keep_id"), F.col("best.row_no").alias("keep_row"), "group_size", F.pmod(F.conv(F.hex(F.substring("digest", 25, 7)), 16, 10).cast("bigint"), F.lit(shards)).cast("int").alias("shard"))
    )


def shard_count(rows: int) -> int:
    return max(1, math.ceil(rows / KEYS_PER_SHARD))


def build_index(history: DataFrame, shards: int) -> DataFrame:
    """The index of ``history`` (rows of ``digests``): a row a shard; it can be written as a table."""
    return grouped(history, shards).groupBy("shard").applyInArrow(_build_shard, INDEX)


def lookup(new: DataFrame, index: DataFrame, shards: int) -> DataFrame:
    """All groups of history and ``new`` (rows of ``digests``) together."""
    return grouped(new, shards).groupBy("shard").cogroup(index.groupBy("shard")).applyInArrow(_resolve_shard, GROUPS)


def resolve(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of ``digests`` and the groups of all documents.

    The lower half of the id range is the history, the rest the new batch.
    """
    rows = checkpoint(digests(docs))
    low, high, n = rows.agg(F.min("doc_id"), F.max("doc_id"), F.count(F.lit(1))).first()
    middle = F.lit((low + high) // 2 if low is not None else 0)
    old = F.coalesce(F.col("doc_id") <= middle, F.lit(False))
    shards = shard_count(n)
    return rows, lookup(rows.filter(~old), build_index(rows.filter(old), shards), shards)


def assign(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, keep_id, group_size, kept, text_sha256."""
    rows, groups = resolve(docs)
    return rows.join(groups, "digest").select("doc_id", "keep_id", "group_size", (F.col("row_no") == F.col("keep_row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def keep_winners(docs: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns."""
    rows, groups = resolve(docs)
    key, gid = fresh(docs, "digest_"), fresh(docs, "winner_")
    won = checkpoint(groups.select(F.col("digest").alias(key), F.col("keep_id").alias(gid)))
    out = docs.withColumn(key, digest(F.col("text"))).join(won.withColumnRenamed(key, f"{key}r"), (F.col(key) == F.col(f"{key}r")) & docs["doc_id"].eqNullSafe(F.col(gid)), "left_semi")
    repeated = rows.groupBy("digest", "doc_id").count().filter("count > 1").join(won.select(F.col(key).alias("digest"), F.col(gid).alias("w")), "digest").filter(F.col("w").eqNullSafe(F.col("doc_id")))
    if not repeated.isEmpty():
        out = out.dropDuplicates(["doc_id", key])
    return out.drop(key)


ORACLE = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
