"""Toxicity by multiple-instance learning over sentences.

Only documents are labelled.  A sentence scores ``p = sigmoid(b + sum of the
weights of its words)``, a document ``1 - prod(1 - p)`` (noisy-or), and the
weights are fitted to the document labels through that combination; afterwards
the sentence with the highest score is the offending one.

A word counts through its features: the word itself and its first 3, 4, 5 and
7 letters, so that unseen forms of a known stem count too.

Labels are learnt only from documents whose crc32(doc_id) mod 5 is not 0, on
about ``PER_CLASS`` documents of each class (chosen by a hash of the id), and
fewer if their known features are more than ``MOST_FEATURES`` together; the
vocabulary is the ``VOCABULARY`` features of that sample most associated with
label 1.  Clean documents weigh ``CLEAN`` times, as they are the rule outside
the sample.  Scoring reads whole texts; no label, language, source or id is used.

Cases: a null or empty text is one empty sentence and gets the score of that;
without labels of both classes every score is the share of class 1 (0 if there
are no labels); a sentence ends at ``.``, ``!``, ``?`` or a line break and nowhere
else; repeated labels of an id count as toxic if any says so; extra
columns pass through ``screen``.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpoint, fresh, held_out, lean, stratified, trainable, unit_hash

PER_CLASS = 3000
#: Features (of sentences, repeats counted) of the documents that the driver fits on, and of a single one of them.
MOST_FEATURES = 4_000_000
MOST_OF_ONE = 40_000
VOCABULARY = 1500
#: Tasks that work on the sample at most, about 2 * PER_CLASS documents.
SAMPLE_TASKS = 12
LEAST_DOCS = 3
STEPS = 500
CLEAN = 3.0
PREFIXES = (3, 4, 5, 7)
#: Runs of non-blanks that a scoring task remembers.
CACHE = 300_000
SENTENCE = re.compile(r"[^.!?\n]+")
TOKEN = re.compile(r"[^\W\d_]+")


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    bias: float = 0.0
    constant: float | None = None  # the score of every document, where nothing could be learnt


def sentences(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in SENTENCE.finditer(text)] or [(0, len(text))]


def features(word: str) -> list[str]:
    return [word, *(f"{word[:n]}-" for n in PREFIXES if len(word) > n)]


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _log_not(z: float) -> float:
    """log(1 - sigmoid(z)) of a number."""
    return -math.log1p(math.exp(min(z, 40.0)))


# ---------------------------------------------------------------- training
def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many documents of each class have a feature, counted within the batch first."""
    for b in batches:
        found: tuple[Counter, Counter] = (Counter(), Counter())
        for text, toxic in zip(b.column("text"), b.column("toxic").to_pylist(), strict=True):
            found[toxic].update({f for w in set(TOKEN.findall((text.as_py() or "").lower())) for f in features(w)})
        names = sorted(found[0].keys() | found[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([c[f] for f in names], pa.int64()) for c in found)], names=["feature", "clean", "toxic"])


def _bags(vocabulary: list[str]):
    """Each document as the known features of its sentences and the number of sentences without any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = {w: i for i, w in enumerate(vocabulary)}
        for b in batches:
            bags, empty = [], []
            for text in b.column("text"):
                t = text.as_py() or ""
                each = [[at[f] for w in set(TOKEN.findall(t[s:e].lower())) for f in features(w) if f in at] for s, e in sentences(t)]
                bags.append([sorted(x) for x in each if x])
                empty.append(sum(not x for x in each))
            yield pa.RecordBatch.from_arrays([b.column("toxic"), pa.array(bags, pa.list_(pa.list_(pa.int32()))), pa.array(empty, pa.int64())], names=["toxic", "bags", "empty"])

    return run


def fit(toxic: list[int], bags: list[list[list[int]]], empty: list[int], size: int, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Weights and bias at the largest penalised likelihood of the noisy-or, by Adam."""
    y, blank = np.array(toxic, float), np.array(empty, float)
    doc = np.array([d for d, bag in enumerate(bags) for _ in bag], np.int64)
    flat = [s for bag in bags for s in bag]
    where = np.repeat(np.arange(len(flat)), [len(s) for s in flat]) if flat else np.zeros(0, np.int64)
    word = np.array([w for s in flat for w in s], np.int64)
    theta = np.zeros(size + 1)
    theta[-1] = -5.0
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        z = theta[-1] + np.bincount(where, weights=theta[word], minlength=len(flat))
        p, p0 = _sigmoid(z), _sigmoid(theta[-1])
        none = np.exp(np.bincount(doc, weights=np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=len(y)) + blank * np.log1p(-p0))
        pull = np.where(y > 0, none / np.maximum(1 - none, 1e-9), -CLEAN)  # of the log-likelihood, for a unit of p
        gz = pull[doc] * p
        grad = np.append(np.bincount(word, weights=gz[where], minlength=size), gz.sum() + (pull * blank).sum() * p0) / len(y)
        grad[:-1] -= 2e-5 * theta[:-1]
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad**2
        theta = theta + 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return theta[:-1], float(theta[-1])


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    ids = labels.filter(F.col("toxic").isin(0, 1) & trainable(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = stratified(ids, "toxic", per_class, seed=10)
    # about twice PER_CLASS ids, so small by construction; of the rows that share an id one is learnt from
    sample = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    # few tasks, however many shuffle partitions there are: without Hadoop's native library each file written to a file
    # system of this machine has the executor fork for chmod, and until it execs that child counts the whole JVM again
    sample = checkpoint(sample.select("text", "toxic").coalesce(SAMPLE_TASKS))
    count = {r[0]: r[1] for r in sample.groupBy("toxic").count().collect()}
    bad, good = count.get(1, 0), count.get(0, 0)
    if not bad or not good:
        return Model(constant=1.0 if bad else 0.0)
    a, b = F.col("toxic").cast("double"), F.col("clean").cast("double")
    c, d = F.lit(bad) - a, F.lit(good) - b
    chi = F.pow(a * d - b * c, 2) / ((a + b) * (c + d) + 1)
    found = sample.mapInArrow(lean(_counts), "feature string, clean bigint, toxic bigint").groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    found = found.filter((a >= LEAST_DOCS) & (a * good > b * bad)).select("feature", chi.alias("chi"))
    vocabulary = [r["feature"] for r in found.orderBy(F.desc("chi"), "feature").limit(VOCABULARY).collect()]
    found = checkpoint(sample.mapInArrow(lean(_bags(vocabulary)), "toxic int, bags array<array<int>>, empty bigint").withColumn("size", F.size(F.flatten("bags"))))
    found = found.filter(F.col("size") <= MOST_OF_ONE)
    share = min(1.0, MOST_FEATURES / max(1, found.agg(F.sum("size")).first()[0] or 0))
    rows = found.filter(unit_hash(F.col("bags"), F.col("empty")) < share).drop("size").collect()
    rows.sort(key=lambda r: (r["toxic"], r["empty"], r["bags"]))
    theta, bias = fit([r["toxic"] for r in rows], [r["bags"] for r in rows], [r["empty"] for r in rows], len(vocabulary))
    return Model(dict(zip(vocabulary, theta.tolist(), strict=True)), bias)


# ---------------------------------------------------------------- scoring
class Scorer:
    """Scores texts, remembering which words of a run of non-blanks have a weight."""

    def __init__(self, model: Model):
        self.model = model
        self.known: dict[str, tuple[str, ...]] = {}
        self.base = _log_not(model.bias)

    def weight(self, word: str) -> float:
        get = self.model.weights.get
        return get(word, 0.0) + sum([get(f"{word[:n]}-", 0.0) for n in PREFIXES if len(word) > n])

    def heavy(self, run: str) -> tuple[str, ...]:
        found = self.known.get(run)
        if found is None:
            if len(self.known) >= CACHE:
                self.known.clear()
            found = self.known[run] = tuple(w for w in TOKEN.findall(run) if self.weight(w))
        return found

    def __call__(self, text: str) -> tuple[float, int, int, float]:
        """Document score, and span and score of the worst sentence."""
        spans, model, heavy = sentences(text), self.model, self.heavy
        if model.constant is not None:
            return model.constant, *spans[0], model.constant
        total, worst, at = self.base * len(spans), 0.0, spans[0]
        low = text.lower()
        if any(map(heavy, set(low.split()))):
            aligned = len(low) == len(text)
            for s, e in spans:
                words = {w for run in set((low[s:e] if aligned else text[s:e].lower()).split()) for w in heavy(run)}
                if words:
                    z = sum(sorted(map(self.weight, words)))
                    total += _log_not(model.bias + z) - self.base
                    if z > worst:
                        worst, at = z, (s, e)
        return -math.expm1(total), *at, float(_sigmoid(model.bias + worst))


def score(text: str, model: Model) -> tuple[float, int, int, float]:
    return Scorer(model)(text)


SCORES = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("worst_start", T.LongType()), T.StructField("worst_end", T.LongType()), T.StructField("worst_score", T.DoubleType())])


def _scorer(model: Model, column: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for b in batches:
            found = [scorer(t.as_py() or "") for t in b.column(column)]
            own = [pa.array([f[i] for f in found], kind) for i, kind in enumerate((pa.float64(), pa.int64(), pa.int64(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([*b.columns, *own], names=names)

    return lean(run)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """The rows with score and worst sentence appended, under names that are free."""
    names = [fresh(docs, f.name) for f in SCORES]
    schema = T.StructType([*docs.schema.fields, *(T.StructField(n, f.dataType) for n, f in zip(names, SCORES, strict=True))])
    return docs.mapInArrow(_scorer(model, docs.columns.index("text"), [f.name for f in schema]), schema)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted, worst sentence."""
    model = train(docs, labels)
    out = scored(docs.select("doc_id", F.col("text").cast("string").alias("text")), model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "worst_start", "worst_end", "worst_score")


def screen(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not predicted toxic, with all their columns."""
    out = scored(docs, train(docs, labels))
    return out.filter(F.col(out.columns[len(docs.columns)]) < 0.5).select(*docs.columns)
