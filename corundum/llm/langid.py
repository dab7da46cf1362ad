"""Language identification by hierarchical discrimination.

The language family is predicted first; within the winning family, one linear
support vector machine for each pair of languages (one-versus-one) votes.  The
families duel in the same way.  Features are the square roots of the relative
frequencies of hashed letter 1-, 2- and 3-grams of the whole text.

Models are learnt from text and lang of documents whose crc32(doc_id) mod 5 is
not 0, on about ``PER_LANGUAGE`` documents of each of the ``LANGUAGES`` most
frequent values of lang (ties by name); machines are as many as pairs of them.

Cases: a null text or one without letters is ``und`` with score 0; with a
single learnt language that is always the answer, and with none everything is
``und``; ties of votes go to the larger sum of margins, then to the first name;
extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, stratified, trainable

PER_LANGUAGE = 800
LANGUAGES = 100
WIDTH = 2048
STEPS = 120
PENALTY = 1e-4
UND = "und"
#: Families of ISO 639-1 codes; any other language is a family of its own.
FAMILIES = {
    "germanic": "af da de en fo fy is lb nl nn no sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "indic": "bn gu hi mr ne pa ur",
    "semitic": "ar he mt am",
    "turkic": "az kk tr uz",
    "uralic": "et fi hu",
    "sinitic": "zh yue",
}


def family(lang: str) -> str:
    return next((name for name, members in FAMILIES.items() if lang.split("-")[0].lower() in members.split()), f"only-{lang}")


class Letters:
    """Texts as code points, runs of anything but letters as one space."""

    def __init__(self):
        self.low = np.array([chr(c).isalpha() for c in range(0x10000)])

    def codes(self, text: str) -> np.ndarray | None:
        """With a space on either end; None without a letter."""
        found = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
        alpha = self.low[np.minimum(found, 0xFFFF)]
        if len(high := np.flatnonzero(found > 0xFFFF)):
            alpha[high] = [chr(c).isalpha() for c in found[high].tolist()]
        if not alpha.any():
            return None
        found = np.where(alpha, found, 32)
        return found[alpha | np.concatenate(([True], alpha[:-1]))].astype(np.uint32)


def features(codes: np.ndarray, width: int = WIDTH) -> np.ndarray:
    c = codes * np.uint32(0x9E3779B1)
    two = c[:-1] * np.uint32(31) + codes[1:] * np.uint32(0x85EBCA6B)
    three = two[:-1] * np.uint32(37) + codes[2:] * np.uint32(0xC2B2AE35)
    top = np.uint32(32 - int(width).bit_length() + 1)
    count = sum(np.bincount((g * np.uint32(0x27D4EB2F)) >> top, minlength=width) for g in (c[1:-1] + np.uint32(1), two, three))
    return np.sqrt(count / count.sum())


# ---------------------------------------------------------------- training
def svm(x: np.ndarray, y: np.ndarray, steps: int = STEPS, penalty: float = PENALTY) -> np.ndarray:
    """A linear SVM with squared hinge loss, classes weighted alike; the bias is the last weight."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    share = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1)).astype(x.dtype)
    w = v = np.zeros(x.shape[1], x.dtype)
    step = 1 / (4.0 + penalty)
    for k in range(steps):
        short = np.maximum(0, 1 - y * (x @ v))
        new = v - step * (penalty * v - 2 * ((share * y * short) @ x))
        w, v = new, new + k / (k + 3) * (new - w)
    return w


@dataclass
class Duels:
    """One-versus-one machines among some names."""

    names: list[str]
    pairs: list[tuple[int, int]] = field(default_factory=list)
    weights: np.ndarray | None = None

    @classmethod
    def train(cls, x: np.ndarray, labels: np.ndarray) -> Duels:
        names = sorted(set(labels.tolist()))
        pairs = list(combinations(range(len(names)), 2))
        found = []
        for a, b in pairs:
            of = (labels == names[a]) | (labels == names[b])
            found.append(svm(x[of], np.where(labels[of] == names[a], 1.0, -1.0).astype(x.dtype)))
        return cls(names, pairs, np.array(found).T if found else None)

    def decide(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The winner of each row and its confidence: that of its closest duel."""
        if self.weights is None:
            return np.zeros(len(x), np.int64), np.ones(len(x))
        margins = x @ self.weights[:-1] + self.weights[-1]
        votes, sums, least = np.zeros((len(x), len(self.names))), np.zeros((len(x), len(self.names))), np.full((len(x), len(self.names)), np.inf)
        for i, (a, b) in enumerate(self.pairs):
            m = margins[:, i]
            votes[:, a] += m >= 0
            votes[:, b] += m < 0
            for k, s in ((a, m), (b, -m)):
                sums[:, k] += s
                least[:, k] = np.minimum(least[:, k], s)
        won = np.argmax(votes + 0.5 * np.tanh(sums / (1 + np.abs(sums).max())), axis=1)
        return won, 1 / (1 + np.exp(-3 * least[np.arange(len(x)), won]))


@dataclass
class Model:
    families: Duels
    languages: dict[str, Duels]

    @classmethod
    def train(cls, x: np.ndarray, langs: list[str]) -> Model:
        labels = np.array(langs, dtype=object)
        groups = np.array([family(s) for s in langs], dtype=object)
        return cls(Duels.train(x, groups), {g: Duels.train(x[groups == g], labels[groups == g]) for g in sorted(set(groups.tolist()))})

    def predict(self, x: np.ndarray) -> list[tuple[str, float]]:
        out: list[tuple[str, float]] = [(UND, 0.0)] * len(x)
        if not self.families.names or not len(x):
            return out
        won, sure = self.families.decide(x)
        for i, name in enumerate(self.families.names):
            at = np.flatnonzero(won == i)
            if len(at):
                duels = self.languages[name]
                lang, within = duels.decide(x[at])
                for j, k, s in zip(at.tolist(), lang.tolist(), (sure[at] * within).tolist(), strict=True):
                    out[j] = duels.names[k], float(s)
        return out


def _samples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    letters = Letters()
    for b in batches:
        rows = []
        for lang, text in zip(b.column("lang").to_pylist(), b.column("text"), strict=True):
            codes = letters.codes(text.as_py() or "")
            if codes is not None:
                x = features(codes)
                at = np.flatnonzero(x)
                rows.append((lang, at.astype(np.int32), x[at].astype(np.float32)))
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.list_(pa.int32())), pa.array([r[2] for r in rows], pa.list_(pa.float32()))], names=["lang", "at", "x"])


def train(docs: DataFrame, per_language: int = PER_LANGUAGE, languages: int = LANGUAGES) -> Model:
    known = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    known = known.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & trainable(F.col("doc_id")))
    common = [r["lang"] for r in known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(languages).collect()]
    rows = stratified(known.filter(F.col("lang").isin(common)), "lang", per_language, seed=4, by=("doc_id", "text")).select("lang", "text").mapInArrow(_samples, "lang string, at array<int>, x array<float>").collect()
    rows.sort(key=lambda r: (r["lang"], r["at"], r["x"]))
    x = np.zeros((len(rows), WIDTH), np.float32)
    for i, r in enumerate(rows):
        x[i, r["at"]] = r["x"]
    return Model.train(x, [r["lang"] for r in rows])


# ---------------------------------------------------------------- prediction
def _predictor(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = Letters()
        for b in batches:
            langs, scores = [], []
            for s in range(0, b.num_rows, 256):
                codes = [letters.codes(t.as_py() or "") for t in b.column(1).slice(s, 256)]
                found = iter(model.predict(np.array([features(c) for c in codes if c is not None]).reshape(-1, WIDTH)))
                got = [(UND, 0.0) if c is None else next(found) for c in codes]
                langs += [g[0] for g in got]
                scores += [g[1] for g in got]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return run


def identify(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score."""
    model = train(docs)
    out = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_predictor(model), "doc_id bigint, lang_pred string, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
