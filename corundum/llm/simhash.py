"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints: majority bits over the XXH64 of 4-word shingles, repeats counted.
Two fingerprints link at 4 or fewer differing bits.  The 64 bits are grouped by
correlation into m partitions with thresholds t_i (-1: not probed) that add up
to 4 - m + 1; any linked pair is within t_i in some partition i.  Partitions
and thresholds come from dynamic programming on candidate counts estimated
from a bounded sample of fingerprints: the sample steers cost only, never the
result.  Every fingerprint is filed under its own partition values and under
the larger values within t_i, and each bucket is verified on all 64 bits.

A bucket emits its verified links directly while it is small, and a spanning
forest of them when it is large, so that dense groups do not emit all pairs.
Buckets beyond ``HOT`` fingerprints are not gathered at all: their members meet
at midpoints (fingerprints within two bits of both), which is exact and linear
in the size of the bucket.

``keep_one`` adds a second way in: documents whose sets of five-word shingles
have a similarity of 0.8 or more.  Two such sets share a shingle of their
prefixes (a fifth of each, rare shingles first), so no such pair is missed,
whatever the edit; bitmaps drop most other pairs, and the rest is verified on
whole sets before anything stands for it.

Cases: null, empty or blank texts have fingerprint zero and link like any
other; equal fingerprints are one node; rows without ``doc_id`` take part, and
a component with no id at all has a null ``component_id``; an empty table gives
an empty result; extra columns are ignored, and passed through ``keep_one``,
for which a row is itself whatever its id: rows with one id and different texts
are different documents, and rows without id stay unless they resemble others.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, fresh, lean
from .components import components, settled, with_least

DISTANCE = 4
SHINGLE = 4
#: For ``keep_one``: words of a shingle and the similarity of the sets.
VERIFIED = 5
SIMILARITY = 0.8
#: 64-bit words of the bitmap of a set of shingles.
MARKS = 8
#: Rounds that thin the candidates of large buckets, before all that are left are verified.
ROUNDS = 2
#: Fingerprints that steer the plan.
SAMPLE = 2048
#: Rows up to which a list of documents is broadcast; a longer one is joined by a shuffle.
FEW = 200_000
#: Words whose shingles are worked out at a time.
TOGETHER = 100_000
#: Fingerprints filed in a bucket that one task may gather.
HOT = 32_768
#: Buckets up to this size emit each verified link, larger ones a spanning forest.
SMALL = 16
ROWS_PER_TASK = 60_000
#: Cost of comparing a pair, in filed rows.
COMPARE = 0.02


# ------------------------------------------------------------ fingerprints
def hashes(text: str | None, size: int = SHINGLE) -> list[int]:
    """XXH64 of each shingle; bytes.lower and bytes.split know ASCII only, as asked."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()
    if not words:
        return []
    if len(words) <= size:
        return [xxh64_intdigest(b" ".join(words), 42)]
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - size + 1].tolist()
    return [xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts, ends[size - 1 :].tolist(), strict=True)]


def majority(found: list[int]) -> int:
    """Bits set in more than half of the hashes."""
    if not found:
        return 0
    ones, values = np.zeros(64, np.int64), np.array(found, "<u8")
    for at in range(0, len(values), 65_536):
        part = values[at : at + 65_536]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(values), bitorder="little").view("<u8")[0])


def _fingerprint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = np.fromiter((majority(hashes(t.as_py())) for t in b.column(1)), np.uint64, b.num_rows)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and the fingerprint as a signed bigint."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_fingerprint, "doc_id bigint, fp bigint")


# ------------------------------------------------------------ the plan
def bit_groups(bits: np.ndarray, m: int) -> list[list[int]]:
    """The bits in m groups of like width, each grown by correlation with what it holds."""
    spread = bits.std(axis=0) if len(bits) else np.zeros(64)
    alike = np.zeros((64, 64))
    if live := np.flatnonzero(spread > 0).tolist():
        alike[np.ix_(live, live)] = np.abs(np.corrcoef(bits[:, live], rowvar=False)).reshape(len(live), len(live))
    left, out = set(range(64)), []
    for g in range(m):
        width = 64 // m + (g < 64 % m)
        rest = sorted(left)
        group = [max(rest, key=lambda b: (alike[b, rest].sum(), -b))]
        while len(group) < width:
            rest = sorted(left - set(group))
            group.append(max(rest, key=lambda b: (alike[b, group].sum(), -b)))
        left -= set(group)
        out.append(sorted(group))
    return out


def within(keys: np.ndarray, bits: np.ndarray, most: int) -> list[float]:
    """The estimated share of pairs at distance 0, at most 1, ... in a partition.

    Seen frequencies where the sample has enough of them, else the distribution
    that independent bits of the same frequencies would have.
    """
    p = bits.mean(axis=0) if len(bits) else np.full(bits.shape[1], 0.5)
    model = np.ones(1)
    for d in 2 * p * (1 - p):
        model = np.convolve(model, [1 - d, d])
    seen, pairs = np.zeros(65), len(keys) * (len(keys) - 1) / 2
    for at in range(0, len(keys), 256):
        apart = np.bitwise_count(keys[at : at + 256, None] ^ keys[None, :])
        apart[np.arange(len(apart))[:, None] + at >= np.arange(len(keys))[None, :]] = 255
        seen += np.bincount(apart.ravel(), minlength=256)[:65]
    seen, model = np.cumsum(seen), np.cumsum(np.pad(model, (0, 65 - len(model))))
    return [float(seen[t] / pairs if pairs and seen[t] >= 30 else model[t]) for t in range(most + 1)]


def allocate(cost: list[dict[int, float]], total: int) -> tuple[float, list[int]]:
    """Thresholds adding up to ``total`` at least cost, by dynamic programming."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for group in cost:
        step: dict[int, tuple[float, list[int]]] = {}
        for done, (c, ts) in best.items():
            for t, extra in group.items():
                if done + t not in step or c + extra < step[done + t][0]:
                    step[done + t] = (c + extra, [*ts, t])
        best = step
    return best.get(total, (math.inf, []))


def plan(sample: list[int], n: int, distance: int = DISTANCE) -> list[tuple[int, int]]:
    """(mask, threshold) of each partition that is probed, for n distinct fingerprints."""
    keys = np.array(sample, np.int64).view(np.uint64)
    bits = np.unpackbits(keys.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(float)
    chosen: tuple[float, list[tuple[int, int]]] | None = None
    for m in range(2, distance + 2):
        cost, groups = [], bit_groups(bits, m)
        for g in groups:
            mask = np.uint64(sum(1 << b for b in g))
            share = within(keys & mask, bits[:, g], 2)
            filed = [sum(math.comb(len(g), k) / (2 if k else 1) for k in range(t + 1)) for t in range(3)]
            cost.append({-1: 0.0} | {t: n * filed[t] + COMPARE * n * n / 2 * share[t] for t in range(3)})
        price, ts = allocate(cost, distance - m + 1)
        if ts and (chosen is None or price < chosen[0]):
            chosen = price, [(sum(1 << b for b in g), t) for g, t in zip(groups, ts, strict=True) if t >= 0]
    assert chosen
    return chosen[1]


# ------------------------------------------------------------ buckets
def flips(mask: int, most: int) -> np.ndarray:
    """XOR masks of up to ``most`` bits of ``mask``, the empty one first."""
    bits = [1 << b for b in range(64) if mask >> b & 1]
    return np.array([sum(c) for k in range(most + 1) for c in combinations(bits, k)], np.uint64)


def _filer(parts: list[tuple[int, int]]):
    """Files each fingerprint under its value and under larger values within the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ways = [(i, np.uint64(mask), flips(mask, t)) for i, (mask, t) in enumerate(parts)]
        for b in batches:
            fps = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for i, mask, xors in ways:
                step = max(1, 2_000_000 // len(xors))
                for at in range(0, len(fps), step):
                    own = fps[at : at + step] & mask
                    keys = own[:, None] ^ xors[None, :]
                    take = keys >= own[:, None]  # of two values, the smaller one is filed under the larger
                    who = np.broadcast_to(fps[at : at + step, None], keys.shape)[take]
                    turned = np.broadcast_to(np.bitwise_count(xors)[None, :], keys.shape)[take]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(who), i, np.int32)), pa.array(keys[take].view(np.int64)), pa.array(who.view(np.int64)), pa.array(turned.astype(np.int32))], names=["part", "key", "fp", "turned"])

    return run


def forest(fps: np.ndarray, distance: int) -> list[np.ndarray]:
    """Edges of a spanning forest of the links among ``fps``."""
    out, left = [], fps
    while len(left):
        front, left = [left[0]], left[1:]
        while front and len(left):
            at = front.pop()
            near = np.bitwise_count(left ^ at) <= distance
            if near.any():
                found = left[near]
                out.append(np.stack([np.full(len(found), at), found]))
                left = left[~near]
                front.extend(found)
    return out


def bucket_links(part: np.ndarray, key: np.ndarray, fp: np.ndarray, distance: int = DISTANCE, small: int = SMALL) -> np.ndarray:
    """Links (2, n) within the buckets (part, key): all of a small bucket, a forest of a large one."""
    order = np.lexsort((fp, key, part))
    part, key, fp = part[order], key[order], fp[order]
    new = np.concatenate(([True], (part[1:] != part[:-1]) | (key[1:] != key[:-1]))) if len(fp) else np.zeros(0, bool)
    starts = np.flatnonzero(new)
    sizes = np.diff(np.append(starts, len(fp)))
    out = [edge for s, n in zip(starts[sizes > small], sizes[sizes > small], strict=True) for edge in forest(fp[s : s + n], distance)]
    group = np.repeat(np.arange(len(starts)), sizes)
    keep = np.repeat(sizes <= small, sizes)
    group, fp = group[keep], fp[keep]
    for d in range(1, small):
        if d >= len(fp):
            break
        linked = np.flatnonzero((group[d:] == group[:-d]) & (np.bitwise_count(fp[d:] ^ fp[:-d]) <= distance))
        out.append(np.stack([fp[linked], fp[linked + d]]))
    return np.concatenate(out, axis=1) if out else np.zeros((2, 0), np.uint64)


def _links(t: pa.Table) -> pa.Table:
    as_ = lambda c, kind: t[c].to_numpy().astype(np.int64).view(kind)
    found = bucket_links(as_("part", np.int64), as_("key", np.uint64), as_("fp", np.uint64))
    found = np.unique(np.sort(found.view(np.int64), axis=0), axis=1)
    return pa.table({"a": pa.array(found[0]), "b": pa.array(found[1])})


def _midpoints(parts: list[tuple[int, int]]):
    """Fingerprints of a hot bucket at the points within two bits of them that have the bucket's value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = (1 << 64) - 1
        ways = {(i, left): flips(every & ~mask, left) for i, (mask, t) in enumerate(parts) for left in range(3)}
        for b in batches:
            part, key, fp, turned = (b.column(c).to_numpy(zero_copy_only=False) for c in range(4))
            for i, left in sorted({(int(p), 2 - int(k)) for p, k in zip(part, turned, strict=True)}):
                mine = (part == i) & (turned == 2 - left)
                mask = np.uint64(parts[i][0])
                at = (fp[mine].view(np.uint64) & ~mask) | key[mine].view(np.uint64)
                who, xors = fp[mine], ways[i, left]
                for s in range(0, len(who), max(1, 1_000_000 // len(xors))):
                    points = (at[s : s + max(1, 1_000_000 // len(xors)), None] ^ xors[None, :]).ravel()
                    yield pa.RecordBatch.from_arrays([pa.array(points.view(np.int64)), pa.array(np.repeat(who[s : s + max(1, 1_000_000 // len(xors))], len(xors)))], names=["point", "fp"])

    return run


def hot_links(filed: DataFrame, parts: list[tuple[int, int]]) -> DataFrame:
    """Links that connect what is linked in buckets too large for a task.

    x and y are within 4 bits exactly if some point is within 2 of both, so the
    fingerprints at a point are linked to its smallest one.
    """
    at = filed.select("part", "key", "fp", "turned").mapInArrow(_midpoints(parts), "point bigint, fp bigint").distinct()
    least = at.groupBy("point").agg(F.min("fp").alias("b"))
    return with_least(at, "point", least).filter("fp <> b").select(F.col("fp").alias("a"), "b").distinct()


def links(fps: DataFrame, n: int, hot: int = HOT) -> DataFrame:
    """Links (a, b) among n distinct fingerprints that connect all that is within ``DISTANCE``."""
    sample = [r[0] for r in fps.orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).collect()]
    parts = plan(sample, n)
    filed = fps.select("fp").mapInArrow(_filer(parts), "part int, key bigint, fp bigint, turned int")
    crowded = checkpoint(filed.groupBy("part", "key").count().filter(F.col("count") > hot)) if n > hot else None
    usual = filed
    if crowded is not None and not crowded.isEmpty():
        usual = filed.join(crowded, ["part", "key"], "left_anti")
    rows = n * sum(sum(math.comb(bin(mask).count("1"), k) / (2 if k else 1) for k in range(t + 1)) for mask, t in parts)
    tasks = max(1, math.ceil(rows / ROWS_PER_TASK))
    found = usual.select("part", "key", "fp").groupBy(F.pmod(F.xxhash64("part", "key"), F.lit(tasks)).alias("task")).applyInArrow(_links, "a bigint, b bigint")
    if usual is not filed:
        found = found.union(hot_links(filed.join(crowded, ["part", "key"], "left_semi"), parts))
    return found


# ------------------------------------------------------------ documents
def assign(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """Per document: doc_id, fingerprint, component_id, and fp (the fingerprint as a bigint)."""
    rows = checkpoint(fingerprints(docs))
    fps = checkpoint(rows.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(links(fps, fps.count(), hot))
    placed = fps.join(roots, fps["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    owner = with_least(placed, "root", placed.groupBy("root").agg(F.min("first").alias("component_id"))).select("fp", "component_id")
    return rows.join(owner, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "fp")


# ------------------------------------------------------------ one of each group
#: An odd number, its inverse modulo 2**64, and two more to mix with.
BASE, BASE_INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
MIX = (0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F)


class Powers:
    """Powers of ``BASE`` and of its inverse modulo 2**64, as many as asked for."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << n.bit_length()
            self.up, self.down = (np.multiply.accumulate(np.array([1, *[b] * (size - 1)], np.uint64)) for b in (BASE, BASE_INVERSE))
        return self.up[:n], self.down[:n]


def shingles(text: str | None, powers: Powers) -> np.ndarray:
    """The set of five-word shingles, as sorted hashes: polynomials in the bytes, all shingles at once."""
    words, out = (text or "").encode().lower().split(), []
    for at in range(0, max(1, len(words) - VERIFIED + 1), TOGETHER):
        some = words[at : at + TOGETHER + VERIFIED - 1]
        if not some:
            break
        codes = np.frombuffer(b" ".join(some), np.uint8)
        up, down = powers(len(codes))
        sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * up, out=sums[1:])
        blanks = np.flatnonzero(codes == 32)
        starts, ends = np.concatenate(([0], blanks + 1)), np.concatenate((blanks, [len(codes)]))
        n = max(1, len(some) - VERIFIED + 1)
        found = (sums[ends[-n:]] - sums[starts[:n]]) * down[starts[:n]]
        for m in MIX:
            found = (found ^ (found >> np.uint64(29))) * np.uint64(m)
        out.append(found ^ (found >> np.uint64(32)))
    return np.unique(np.concatenate(out)) if out else np.zeros(0, np.uint64)


def marks(found: np.ndarray) -> np.ndarray:
    """A bitmap with the parity of the hashes at each bit: two of them differ in no more bits than the sets in members."""
    ones = np.bincount((found % np.uint64(64 * MARKS)).astype(np.int64), minlength=64 * MARKS)
    return np.packbits((ones & 1).astype(bool), bitorder="little").view("<i8")


def wide_marks(found: np.ndarray) -> bytes:
    """The same over as many bits as the set has members, rounded up to a power of two."""
    bits = max(64 * MARKS, 1 << max(0, len(found) - 1).bit_length())
    return np.packbits((np.bincount((found % np.uint64(bits)).astype(np.int64), minlength=bits) & 1).astype(bool), bitorder="little").tobytes()


def differing(one: bytes, other: bytes) -> int:
    """Differing bits of two such bitmaps; the longer is folded to the shorter, which is what that set's bitmap of that length is."""
    x, y = sorted((np.frombuffer(one, np.uint8), np.frombuffer(other, np.uint8)), key=len)
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum(dtype=np.int64))


def apart(sizes):
    """The most members in which sets of these sizes together may differ at ``SIMILARITY``; works on columns too."""
    return sizes * ((1 - SIMILARITY) / (1 + SIMILARITY)) + 1e-6


def _sketcher(keys: np.ndarray, counts: np.ndarray, most: float):
    """Of each document its digest, fingerprint, size and bitmap of its set, and the prefix of that; those in more than ``most`` of the sample are marked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                texts = [t.as_py() or "" for t in part.column(2)]
                sets = [shingles(t, powers) for t in texts]
                found = [prefix(s, keys, counts) for s in sets]
                bits = np.array([marks(s) for s in sets], np.int64).reshape(-1, MARKS)
                columns = [
                    part.column(0),
                    part.column(1),
                    pa.array([hashlib.sha256(t.encode()).digest() for t in texts], pa.binary()),
                    pa.array(np.fromiter((majority(hashes(t)) for t in texts), np.uint64, len(texts)).view(np.int64)),
                    pa.array(np.fromiter(map(len, sets), np.int64, len(sets))),
                    *(pa.array(np.ascontiguousarray(c)) for c in bits.T),
                    pa.array([k[c <= most].view(np.int64) for k, c in found], pa.list_(pa.int64())),
                    pa.array([k[c > most].view(np.int64) for k, c in found], pa.list_(pa.int64())),
                    pa.array(list(map(wide_marks, sets)), pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in SKETCH.split(", ")])

    return run


SKETCH = f"no bigint, doc_id bigint, digest binary, fp bigint, size bigint, {', '.join(f'm{i} bigint' for i in range(MARKS))}, rare array<bigint>, frequent array<bigint>, wide binary"


def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    powers = Powers()
    for b in batches:
        found = [shingles(t.as_py(), powers).view(np.int64) for t in b.column(1)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.int64()))], names=["no", "shingles"])


def _among(rows: DataFrame, hot: int) -> DataFrame:
    """Pairs (a, b) of rows: every one with the first of its fingerprint, and the firsts of linked fingerprints."""
    fps = checkpoint(rows.groupBy("fp").agg(F.min("no").alias("first")))
    found = links(fps, fps.count(), hot)
    firsts = lambda c: fps.select(F.col("fp").alias(c), F.col("first").alias(f"{c}_"))
    across = found.distinct().join(firsts("a"), "a").join(firsts("b"), "b").select(F.col("a_").alias("a"), F.col("b_").alias("b"))
    within_ = rows.select("fp", "no").join(fps, "fp").filter("no <> first").select(F.col("no").alias("a"), F.col("first").alias("b"))
    return across.union(within_)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs (a, b) of texts whose five-word shingle sets have a Jaccard similarity of ``SIMILARITY`` or more."""
    powers, last, mine = Powers(), None, np.zeros(0, np.uint64)
    for batch in batches:
        keep = []
        for at, (b, one, other) in enumerate(zip(batch.column("b").to_pylist(), batch.column("a_text"), batch.column("b_text"), strict=True)):
            if b != last:  # rows come sorted by b
                last, mine = b, shingles(other.as_py(), powers)
            its = shingles(one.as_py(), powers)
            shared = len(np.intersect1d(mine, its, assume_unique=True))
            if shared and shared >= SIMILARITY * (len(mine) + len(its) - shared):
                keep.append(at)
        yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))


def _plausible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs that their wide bitmaps allow to be similar: few others are left."""
    for b in batches:
        most = apart(b.column("a_size").to_numpy() + b.column("b_size").to_numpy()).tolist()
        keep = [i for i, (x, y, n) in enumerate(zip(b.column("a_wide").to_pylist(), b.column("b_wide").to_pylist(), most, strict=True)) if differing(x, y) <= n]
        yield b.select(["a", "b"]).take(pa.array(keep, pa.int64()))


def similar(texts: DataFrame, sketches: DataFrame, pairs: DataFrame, repeated: bool) -> DataFrame:
    """The pairs of rows (no) whose sets are similar enough.

    Wide bitmaps leave little but what is similar.  Then texts are sent and not
    sets, which are several times as large.  The list of pairs goes to the texts
    if it is short, so each is sent once for each pair.
    """
    of = lambda c: sketches.select(F.col("no").alias(c), F.col("digest").alias(f"{c}_of"), F.col("size").alias(f"{c}_size"), F.col("wide").alias(f"{c}_wide"))
    both = pairs.join(of("a").drop("a_of"), "a").join(of("b").drop("b_of"), "b")
    pairs = checkpoint(both.select("a", "b", "a_size", "b_size", "a_wide", "b_wide").mapInArrow(lean(_plausible), "a bigint, b bigint"))
    few, named = pairs.count() <= FEW, lambda c: of(c).select(c, f"{c}_of")
    ends, sent = {"a": pairs.join(named("a"), "a"), "b": pairs.select("b").distinct().join(named("b"), "b")}, {}
    for c, listed in ends.items():
        found = texts.join(F.broadcast(listed) if few else listed, F.col("digest") == F.col(f"{c}_of"))
        keys = [x for x in listed.columns if x != f"{c}_of"]
        sent[c] = found.groupBy(*keys).agg(F.first("text").alias(f"{c}_text")) if repeated else found.select(*keys, F.col("text").alias(f"{c}_text"))
    both = sent["a"].join(sent["b"], "b").sortWithinPartitions("b")
    return both.select("a", "b", "a_text", "b_text").mapInArrow(lean(_verify), "a bigint, b bigint")


# ------------------------------------------------------------ similar sets
def common(docs: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Shingles that documents of a bounded sample share, in how many of them, and the sample's size."""
    some = docs.filter(F.pmod(F.xxhash64("no", F.lit(VERIFIED)), F.lit(max(1, n // SAMPLE))) == 0)
    some = checkpoint(some.select("no", "text").limit(2 * SAMPLE).mapInArrow(lean(_shingles), "no bigint, shingles array<bigint>"))
    seen = some.select(F.explode("shingles").alias("key")).groupBy("key").count().filter("count > 1").orderBy(F.desc("count"), "key").limit(200_000).collect()
    keys = np.array([r["key"] for r in seen], np.int64).view(np.uint64)
    order = np.argsort(keys)
    return keys[order], np.array([r["count"] for r in seen], np.int64)[order], some.count()


def prefix(found: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of a set in one order for all (rare shingles first), as many that two similar sets share one; and their counts."""
    at = np.minimum(np.searchsorted(keys, found), max(0, len(keys) - 1))
    seen = np.where(keys[at] == found, counts[at], 0) if len(keys) else np.zeros(len(found), np.int64)
    take = np.lexsort((found, seen))[: len(found) - math.ceil(SIMILARITY * len(found) - 1e-6) + 1]
    return found[take], seen[take]


def _meet(t: pa.Table) -> pa.Table:
    """Small buckets give all their pairs (null, a, b); members of the others are passed on as (key, id, null)."""
    key, ids, size, hot = (t[c].to_numpy() for c in ("key", "no", "size", "hot"))
    order = np.lexsort((ids, size, key))
    key, ids, size, hot = key[order], ids[order], size[order], hot[order]
    starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    n = np.repeat(np.diff(np.append(starts, len(key))), np.diff(np.append(starts, len(key))))
    large = hot | (n > SMALL)
    few = (n > 1) & ~large
    k, i, s = key[few], ids[few], size[few]
    pairs = [np.zeros((2, 0), np.int64)]
    for d in range(1, SMALL):
        if d < len(k):
            hit = (k[d:] == k[:-d]) & (s[:-d] >= SIMILARITY * s[d:] - 1e-6)
            pairs.append(np.stack([i[d:][hit], i[:-d][hit]]))
    pairs = np.unique(np.sort(np.concatenate(pairs, axis=1), axis=0), axis=1)
    pairs = pairs[:, pairs[0] != pairs[1]]
    big = int(large.sum())
    return pa.table({
        "key": pa.concat_arrays([pa.array(key[large], pa.int64()), pa.nulls(pairs.shape[1], pa.int64())]),
        "a": pa.array(np.concatenate([ids[large], pairs[1]]), pa.int64()),
        "b": pa.concat_arrays([pa.nulls(big, pa.int64()), pa.array(pairs[0], pa.int64())]),
    })


def crossing(ids: np.ndarray, size: np.ndarray, bits: np.ndarray, root: np.ndarray, every: bool) -> list[tuple[int, int, int]]:
    """(a, b, differing bits) of pairs of other roots whose bitmaps allow ``SIMILARITY``: all, or what spans them, the nearest first."""
    order = np.argsort(size, kind="stable")
    ids, size, bits = ids[order], size[order], bits[order]
    group = np.unique(root[order], return_inverse=True)[1].reshape(-1)
    main = np.bincount(group).argmax()  # pairs within the largest one need no look
    own, out = group.copy(), []
    done = np.zeros(len(ids), bool)
    for i in np.flatnonzero(own != main):
        done[i] = True
        low, high = np.searchsorted(size, [SIMILARITY * size[i] - 1e-6, size[i] / SIMILARITY + 1e-6])
        near = np.arange(low, high)
        near = near[(group[near] != group[i]) & ~done[near]]
        differ = np.bitwise_count(bits[near] ^ bits[i]).sum(axis=1, dtype=np.int64)
        fit = differ <= apart(size[near] + size[i])
        near, differ = near[fit], differ[fit]
        if not every and len(near):
            best = np.argsort(differ, kind="stable")
            first = best[np.unique(group[near[best]], return_index=True)[1]]
            near, differ = near[first], differ[first]
        out += [(int(ids[i]), int(ids[j]), int(d)) for j, d in zip(near, differ, strict=True)]
        if not every and len(near):
            group[np.isin(group, group[near])] = group[i]
    return out


def _crosser(every: bool):
    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("key", "ascending"), ("low", "ascending"), ("high", "ascending"), ("no", "ascending")])
        key, low, high, ids, size, root = (t[c].to_numpy() for c in ("key", "low", "high", "no", "size", "root"))
        bits = np.stack([t[f"m{i}"].to_numpy() for i in range(MARKS)], axis=1).view(np.uint64)
        new = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1]))))
        found = {p for s, e in zip(new, np.append(new[1:], len(key)), strict=True) for p in crossing(ids[s:e], size[s:e], bits[s:e], root[s:e], every)}
        a, b, d = zip(*sorted({(max(a, b), min(a, b), d) for a, b, d in found}), strict=True) if found else ((), (), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "differ": pa.array(d, pa.int64())})

    return run


def _candidates(members: DataFrame, rows: DataFrame, roots: DataFrame, hot: int, every: bool) -> DataFrame:
    """Pairs (a, b) of members of one bucket that have other roots: all that can be similar, or two at most a document."""
    placed = rows.join(roots, rows["no"] == roots["node"], "left").select(*rows.columns, F.coalesce("root", "no").alias("root"))
    filed = checkpoint(members.join(placed, "no"))
    open_ = filed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("least"), F.max("root").alias("most")).filter("least <> most")
    open_ = checkpoint(open_.select("key", F.when(F.col("n") > hot, F.ceil(F.col("n") * 2 / hot)).otherwise(1).cast("int").alias("blocks"), "n"))
    tasks = max(1, math.ceil((open_.agg(F.sum(F.col("n") * F.col("blocks"))).first()[0] or 0) / ROWS_PER_TASK))
    filed = filed.join(open_.drop("n"), "key").withColumn("mine", F.pmod(F.xxhash64("no"), F.col("blocks")).cast("int"))
    filed = filed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    filed = filed.select("key", F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"), *rows.columns, "root")
    found = filed.groupBy(F.pmod(F.xxhash64("key", "low", "high"), F.lit(tasks)).alias("task")).applyInArrow(_crosser(every), "a bigint, b bigint, differ bigint")
    if every:
        return found.select("a", "b").distinct()
    picked = found.groupBy("a").agg(F.min_by("b", F.struct("differ", "b")).alias("near"), F.max("b").alias("last"))
    return picked.select("a", F.explode(F.array_distinct(F.array("near", "last"))).alias("b"))


def _some(df: DataFrame, listed: DataFrame, same: Column, how: str) -> DataFrame:
    """A semi or anti join with a list, which is broadcast only if it is short."""
    return df.join(F.broadcast(listed) if listed.count() <= FEW else listed, same, how)


def alike(texts: DataFrame, sketches: DataFrame, linked: DataFrame, hot: int = HOT) -> DataFrame:
    """Links (a, b) that, with ``linked``, connect all documents of similarity ``SIMILARITY`` or more.

    ``sketches`` has a row a distinct text, ``texts`` (digest, text) may repeat.
    Pairs are verified before anything stands for them: large buckets thin
    their candidates for a few rounds, by what is connected so far, and then
    give all that are left.
    """
    rows = sketches.select("no", "size", *(f"m{i}" for i in range(MARKS)))
    keyed = lambda c, hot: sketches.select(F.explode(c).alias("key"), "no", F.col("size").cast("int").alias("size"), F.lit(hot).alias("hot"))
    posts = keyed("rare", False).union(keyed("frequent", True))
    posted = sketches.agg(F.sum(F.size("rare") + F.size("frequent"))).first()[0] or 0
    tasks = max(1, math.ceil(posted / (4 * ROWS_PER_TASK)))
    dealt = F.pmod(F.when(F.col("hot"), F.xxhash64("key", "no")).otherwise(F.xxhash64("key")), F.lit(tasks))
    met = checkpoint(posts.groupBy(dealt.alias("task")).applyInArrow(_meet, "key bigint, a bigint, b bigint"))
    of = lambda c: rows.select(F.col("no").alias(c), *(F.col(m).alias(f"{c}{m}") for m in rows.columns[1:]))
    differ = sum((F.bit_count(F.col(f"am{i}").bitwiseXOR(F.col(f"bm{i}"))) for i in range(MARKS)), F.lit(0))
    pairs = met.filter("key IS NULL").select("a", "b").distinct().join(of("a"), "a").join(of("b"), "b").filter(differ <= apart(F.col("asize") + F.col("bsize")))
    pairs = checkpoint(pairs.select("a", "b"))
    members = met.filter("key IS NOT NULL").select("key", F.col("a").alias("no"))
    repeated = sketches.count() < texts.count()
    n, edges, every = rows.count(), settled(linked.select("a", "b")), False
    for k in range(ROUNDS + 1):
        roots = components(edges)
        likely = checkpoint(_candidates(members, rows, roots, hot, every))
        more = likely.count()
        if k and not more:  # no two members that could be similar are apart
            break
        edges = settled(edges.union(similar(texts, sketches, likely if k else likely.union(_open(pairs, roots)).distinct(), repeated)))
        if every:
            break
        every = k + 1 == ROUNDS or 16 * more <= n  # few candidates need no more thinning
    return edges


def _open(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs that are not connected yet."""
    of = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))
    both = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
    return both.filter(F.coalesce("a_root", "a") != F.coalesce("b_root", "b")).select("a", "b")


def sketched(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """A row a document: ``no``, which names the row from here on, doc_id, digest of the text, fingerprint, set size, bitmap and prefix."""
    texts = docs.select(F.monotonically_increasing_id().alias("no"), F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    n = docs.count()
    keys, counts, sampled = common(texts, n)
    return checkpoint(texts.mapInArrow(lean(_sketcher(keys, counts, max(1.0, hot * sampled / max(1, n)))), SKETCH))


def grouped(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """(no, doc_id, digest, root) of the rows that are near copies of another row.

    Rows link as in ``assign``, if their sets of five-word shingles have a
    similarity of ``SIMILARITY`` or more, or if their texts are equal.
    """
    rows = sketched(docs, hot)
    same = checkpoint(rows.groupBy("digest").agg(F.min("no").alias("first"), F.count(F.lit(1)).alias("n")))
    once = rows if same.filter("n > 1").isEmpty() else checkpoint(rows.join(same.select(F.col("first").alias("no")), "no", "left_semi"))
    texts = docs.select(digest(F.col("text")).alias("digest"), F.col("text").cast("string").alias("text"))
    roots = components(alike(texts, once, _among(once, hot), hot))
    linked = roots.select("node", "root").union(roots.select("root", "root").distinct())
    tagged = same.join(linked, same["first"] == linked["node"], "left").filter("n > 1 OR root IS NOT NULL")
    tagged = checkpoint(tagged.select("digest", F.coalesce("root", "first").alias("root")))
    return rows.select("no", "doc_id", "digest").join(tagged, "digest")


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text.cast("string"), F.lit("")), 256))


def keep_one(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """The document with the smallest id of each group of near copies, with all its columns.

    A row without an id loses against one with an id; then the smaller digest of
    the text stays.  Of rows alike in id and text the first by a hash of all
    columns stays.
    """
    rows = checkpoint(grouped(docs, hot))
    best = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest", "no")).alias("best"))
    lost = checkpoint(with_least(rows, "root", best).filter("no <> best.no"))
    again = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("digest") == F.col("best.digest"))
    key, gone, gid = (fresh(docs, c) for c in ("digest_", "gone_", "gone_id_"))
    listed = lambda some: some.select(F.col("doc_id").alias(gid), F.col("digest").alias(gone)).distinct()
    match = F.col(gid).eqNullSafe(docs["doc_id"].cast("bigint")) & (F.col(gone) == F.col(key))
    out = _some(docs.withColumn(key, digest(docs["text"])), listed(lost.filter(~again)), match, "left_anti")
    twice = listed(lost.filter(again))
    if not twice.isEmpty():
        rest, repeated = _some(out, twice, match, "left_anti"), _some(out, twice, match, "left_semi")
        row = F.struct(*docs.columns)
        one = repeated.groupBy("doc_id", key).agg(F.min_by(row, F.xxhash64(*docs.columns)).alias(key + "row"))
        out = rest.select(*docs.columns).union(one.select(F.col(key + "row.*")))
    return out.select(*docs.columns)
