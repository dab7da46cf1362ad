"""Secret scans: fixed patterns, and character Markov models.

Base spans come from three patterns (``assign``, ``access``, ``hex``).  The
method adds spans of kind ``markov``: runs of ``SHORTEST`` or more key
characters, which a dot or a base span ends, are scored by the log-likelihood
ratio of two character bigram models, one of random strings and one of ordinary
identifiers.  Runs of digits alone are numbers and are not scored.

The models are trained from labelled samples of the corpus: in about
``SAMPLE_DOCS`` documents (chosen by a hash of id and text) what the base
patterns hold as a key is labelled random, and words and runs that touch no
base span are labelled ordinary, at most ``MOST_SAMPLES`` distinct ones of
either label (by a hash).  Seeded random strings and identifiers made of common
words join them, so that there are samples where the corpus has none.  A fifth
of the corpus' samples is held out; the threshold is the ratio that at most
``FALSE_SHARE`` of the ordinary ones there reach, and never below ``LEAST``.

Cases: a null text counts as empty; an added span never overlaps a base span;
offsets are code points; repeated rows and null ids get their own result; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import random
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, unit_hash

#: The base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ASSIGN_LEAST = 12
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
HINT = re.compile(r"[:=]")
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
KINDS = ("assign", "access", "hex", "markov")

RUN = re.compile(r"[A-Za-z0-9+/_=-]+")
WORD = re.compile(r"[A-Za-z]{4,}")
#: The shortest run that is scored.
SHORTEST = 12
#: Share of held-out ordinary samples that may reach the threshold, and its least value in nats (prior odds of a thousand).
FALSE_SHARE, LEAST = 0.001, 7.0
SAMPLE_DOCS = 4000
MOST_SAMPLES = 20_000
SEED = 7
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
COMMON = """account action active add address admin all api app array async auth base batch block body buffer build byte cache call
channel check class client close code column commit config connect content context control copy count create current data date
default delete depth device disk domain driver edge empty end engine entry error event export field file filter first flag flow
format frame from function get graph group handle hash header height host http id image import index info init input insert int
item job join key label last layer left length level limit line link list load local lock log main map mask match max memory merge
message method min mode model module name net new next node null number object offset old open option order output owner page
parent parse part path pool port prefix print process query queue range rate read record ref region remove render reply request
reset result right role root route row run sample scale schema score search select send server session set shape shard size slot
sort source spec stack start state status step store stream string sum sync system table tag target task temp test text thread
time timeout title total trace track tree type unit update url user util valid value vector version view wait width window word
worker write zone""".split()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) in order; a failing match is dropped and not retried."""
    found = []
    lower = text.lower()
    if HINT.search(text) and any(w in lower for w in WORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


# ---------------------------------------------------------------- the models
class Markov:
    """A character bigram model with add-one smoothing; 0 stands for the ends."""

    def __init__(self, samples: list[str]):
        self.at = {c: i + 1 for i, c in enumerate(ALPHABET)}
        n = len(ALPHABET) + 1
        counts = np.ones((n, n))
        for s in samples:
            codes = [0, *(self.at.get(c, 0) for c in s), 0]
            np.add.at(counts, (codes[:-1], codes[1:]), 1)
        self.log = np.log(counts / counts.sum(axis=1, keepdims=True))


@dataclass
class Judge:
    """The log of the ratio of both models for each bigram, and the sum that counts as random."""

    ratios: np.ndarray
    threshold: float

    def __post_init__(self):
        self.at = {c: i + 1 for i, c in enumerate(ALPHABET)}
        self.rows = self.ratios.tolist()

    def ratio(self, s: str) -> float:
        at, rows, total, last = self.at, self.rows, 0.0, 0
        for c in s:
            code = at[c]
            total += rows[last][code]
            last = code
        return total + rows[last][0]

    def random(self, s: str) -> bool:
        return self.ratio(s) >= self.threshold



def random_samples(n: int = 6000, seed: int = SEED) -> list[str]:
    rng = random.Random(seed)
    sets = (ALPHABET[:-5], ALPHABET[:-3], "0123456789abcdef", ALPHABET[26:62], ALPHABET[:26] + ALPHABET[52:62])
    return ["".join(rng.choices(sets[i % len(sets)], k=rng.randint(16, 44))) for i in range(n)]


def identifier_samples(words: list[str], n: int = 6000, seed: int = SEED) -> list[str]:
    rng, out = random.Random(seed + 1), []
    for i in range(n):
        parts = rng.choices(words if i % 2 and words else COMMON, k=rng.randint(2, 5))
        style = i % 7
        name = "".join(p.capitalize() for p in parts) if style == 0 else ("_", "-", "/", "", "_", "")[style - 1].join(parts)
        name = name.upper() if style > 4 else name
        out.append(name + (str(rng.randint(0, 9999)) if rng.random() < 0.4 else ""))
    return out


def judged(text: str, base: list[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
    """The runs that are scored: what base spans leave of the runs of key characters, where long enough and not all digits."""
    for m in RUN.finditer(text):
        if m.end() - m.start() < SHORTEST:
            continue
        at, parts = m.start(), []
        for s, _, e in base:
            if s < m.end() and e > at:
                parts.append((at, s))
                at = max(at, e)
        for s, e in [*parts, (at, m.end())]:
            if e - s >= SHORTEST and not text[s:e].isdigit():
                yield s, e


def labelled(text: str) -> tuple[set[str], set[str]]:
    """Strings of a text that are labelled random and ordinary."""
    base = base_spans(text)
    keys = {m[2] for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST} if any(k == 0 for _, k, _ in base) else set()
    keys |= {text[s:e] for s, k, e in base if k}
    random_ = {p for k in keys for p in RUN.findall(k) if len(p) >= SHORTEST and not p.isdigit()}
    ordinary = {text[s:e] for s, e in judged(text, base)}
    ordinary |= {m[0] for m in WORD.finditer(text) if not any(s < m.end() and m.start() < e for s, _, e in base)}
    return random_, ordinary - random_


def held(s: str) -> bool:
    return zlib.crc32(s.encode()) % 5 == 0


def train(random_: list[str], ordinary: list[str]) -> Judge:
    """The judge learnt from samples of both labels; every fifth sample only sets the threshold."""
    learn = lambda found: sorted(s for s in set(found) if not held(s))
    words = [w for w in learn(ordinary) if w.isalpha() and len(w) < SHORTEST]
    one = Markov(random_samples() + learn(random_))
    two = Markov(identifier_samples(words) + learn(ordinary))
    judge = Judge(one.log - two.log, LEAST)
    seen = sorted((judge.ratio(s) for s in set(ordinary) if held(s) and len(s) >= SHORTEST), reverse=True)
    if len(above := seen[: int(FALSE_SHARE * len(seen)) + 1]):
        judge.threshold = max(LEAST, above[-1] + 1e-9)
    return judge


def quality(judge: Judge, random_: list[str], ordinary: list[str]) -> dict[str, float]:
    """Recall and precision over held-out samples long enough to be scored, without the base patterns."""
    hit = [judge.random(s) for s in sorted(set(random_)) if held(s)]
    false = [judge.random(s) for s in sorted(set(ordinary)) if held(s) and len(s) >= SHORTEST]
    return {"random": len(hit), "ordinary": len(false), "recall": sum(hit) / max(1, len(hit)), "precision": sum(hit) / max(1, sum(hit) + sum(false))}


def added_spans(text: str, base: list[tuple[int, int, int]], judge: Judge) -> list[tuple[int, int, int]]:
    return [(s, 3, e) for s, e in judged(text, base) if judge.random(text[s:e])]


def _samples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found: tuple[set[str], set[str]] = set(), set()
        for t in b.column(0):
            for every, some in zip(found, labelled(t.as_py() or ""), strict=True):
                every |= some
        rows = [(s, label) for label, every in ((True, found[0]), (False, found[1])) for s in sorted(every)]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.bool_())], names=["sample", "random"])


def samples(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, most: int = MOST_SAMPLES) -> tuple[list[str], list[str]]:
    """Labelled strings of about ``sample_docs`` documents: random and ordinary, ``most`` of either at most."""
    text = F.col("text").cast("string")
    share = min(1.0, sample_docs / max(1, docs.count()))
    some = docs.filter(unit_hash(F.col("doc_id"), text, F.lit(SEED)) < share).select(text)
    found = checkpoint(some.mapInArrow(_samples, "sample string, random boolean").groupBy("sample").agg(F.max("random").alias("random")))
    of = lambda label: sorted(r[0] for r in found.filter(F.col("random") == label).select("sample").orderBy(F.xxhash64("sample"), "sample").limit(most).collect())
    return of(True), of(False)


def _scanner(judge: Judge):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for b in batches:
            rows = []
            for t in b.column(1):
                text = t.as_py() or ""
                base = base_spans(text)
                rows.append([{"kind": KINDS[k], "start": s, "end": e} for s, k, e in sorted(base + added_spans(text, base, judge))])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, kind)], names=["doc_id", "spans"])

    return run


def find(docs: DataFrame) -> DataFrame:
    """Per document: doc_id and all spans (kind, start, end) in order."""
    judge = train(*samples(docs))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_scanner(judge), "doc_id bigint, spans array<struct<kind:string,start:bigint,end:bigint>>")


def spelled(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, counts of base spans, their digest, and all spans."""
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")
    base = F.filter("spans", lambda s: s["kind"] != KINDS[3])
    return find(docs).select("doc_id", *(of(k).alias(f"n_{k}") for k in KINDS[:3]), F.sha2(spelled(base), 256).alias("base_sha256"), spelled(F.col("spans")).alias("spans"))
