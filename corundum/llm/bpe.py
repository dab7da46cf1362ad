"""BPE encoding and decoding by forced-boundary splitting.

A pair of bytes that occurs inside no token of the vocabulary marks a certain
cut: no merge can cross it.  Texts are cut at such pairs, the fragments are
encoded independently, and the results are concatenated.  A fragment is
normalised, split into words and each word's bytes are merged by rank here; the
tokenizer's file gives merges, vocabulary, normaliser and word pattern.  Words
repeat, so a cache bounded in bytes holds the fragments seen in a task.  Texts
that are equal and encoded together, as copies from a mix are, are encoded once.
Where only ids are wanted they are kept, joined and handed to Spark as packed
numbers (``Ids``), never as text.

The vocabulary marks the end of a word with a suffix and splits words by a
pattern first, so of the certain cuts those are used that are also boundaries
of that pattern whatever stands around them: before ASCII white space, and
after an ASCII letter before any other ASCII character.  Bytes of added tokens
count as inside a token, so those are never cut.

White space and letters beyond ASCII make no cut: what the pattern takes for a
word there depends on what the normaliser composes around it.  A text without
certain cuts is one fragment, however long, and takes time in proportion to
n log n.

Cases: a null or empty text has no tokens; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import json
import os
import re
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, lean

#: Bytes of fragments and results kept in memory by a task, and the longest fragment that is kept.
CACHE = 150_000_000
LONGEST = 64
#: What an entry of the cache takes besides its texts.
ENTRY = 300
#: Documents encoded together, and bytes of text beyond which no further one is added to them.
TOGETHER = 500
TOGETHER_BYTES = 400_000


def byte_letters() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


def certain_cuts(tokenizer_json: str) -> np.ndarray:
    """cut[a, b]: a text may be cut between bytes a and b."""
    spec = json.loads(tokenizer_json)
    letters, suffix = byte_letters(), spec["model"].get("end_of_word_suffix") or ""
    inside = np.zeros((256, 256), bool)
    for token in [*spec["model"]["vocab"], *(t["content"] for t in spec["added_tokens"])]:
        raw = [letters[c] for c in (token.removesuffix(suffix) if suffix else token) if c in letters]
        inside[raw[:-1], raw[1:]] = True
    lower = np.arange(256)
    lower[65:91] += 32  # the normaliser lowers case
    absent = ~inside[np.ix_(lower, lower)]
    code = np.arange(256)
    space = (code == 32) | (code >= 9) & (code <= 13)
    letter = (lower >= 97) & (lower <= 122)
    plain = (code < 128) & ~letter & ~space
    return absent & (~space[:, None] & space[None, :] | letter[:, None] & plain[None, :])


def fragments(raw: bytes, cuts: np.ndarray) -> list[bytes]:
    codes = np.frombuffer(raw, np.uint8)
    if not len(codes):
        return []
    at = (np.flatnonzero(cuts[codes[:-1], codes[1:]]) + 1).tolist()
    return [raw[a:b] for a, b in zip([0, *at], [*at, len(raw)], strict=True)]


class Encoder:
    """Fragments to what is kept of their tokens: (ids joined by a space, tokens joined by a space); None for a fragment without tokens."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        if library.decoder is not None:
            raise ValueError("only tokenizers that decode by joining tokens are supported")
        with open(path, encoding="utf-8") as f:
            text = f.read()
        spec = json.loads(text)
        model, added = spec["model"], spec["added_tokens"]
        if any(t[k] for t in added for k in ("single_word", "lstrip", "rstrip", "normalized")) or model.get("unk_token") or model.get("continuing_subword_prefix"):
            raise ValueError("only plain added tokens and vocabularies over all bytes are supported")
        self.cuts = certain_cuts(text)
        self.normal, self.words_of = library.normalizer, library.pre_tokenizer
        self.suffix = model.get("end_of_word_suffix") or ""
        vocabulary = model["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        pairs = np.array([vocabulary[x] << 32 | vocabulary[y] for x, y in merges], np.int64)
        made = np.array([vocabulary[x + y] for x, y in merges], np.int64)
        pairs, first = np.unique(pairs, return_index=True)  # of a pair that is listed twice the first counts
        self.pairs, self.rank, self.made = pairs, first, made[first]
        self.by_pair = {p: (r, m) for p, r, m in zip(pairs.tolist(), first.tolist(), self.made.tolist(), strict=True)}
        self.alone = {c: vocabulary[c] for c in byte_letters()}
        self.last = {c: vocabulary[c + self.suffix] for c in byte_letters()}
        self.added = re.compile("|".join(re.escape(t["content"]) for t in sorted(added, key=lambda t: -len(t["content"]))) or r"(?!)")
        self.letters = {b: c for c, b in byte_letters().items()}
        self.known: dict = {}
        self.words: dict = {}
        self.bytes = 0
        self.name(vocabulary | {t["content"]: t["id"] for t in added})
        self.special = {t["content"]: self.kept([t["id"]]) for t in added}

    def name(self, vocabulary: dict[str, int]) -> None:
        """What ``kept`` needs of the tokens."""
        self.tokens = {i: t for t, i in vocabulary.items()}
        self.names = {i: str(i) for i in self.tokens}

    def kept(self, ids: list[int]) -> tuple[str, str]:
        """What is kept of the ids of a word; one or more."""
        names, tokens = self.names, self.tokens
        return " ".join([names[i] for i in ids]), " ".join([tokens[i] for i in ids])

    def joined(self, parts: list[tuple[str, str]]) -> tuple[str, str]:
        return " ".join([p[0] for p in parts]), " ".join([p[1] for p in parts])

    def size(self, found: tuple[str, str]) -> int:
        return len(found[0]) + len(found[1])

    def result(self, parts: list[tuple[str, str]]) -> tuple[int, str, str]:
        ids, tokens = self.joined(parts)
        return ids.count(" ") + 1 if ids else 0, ids, tokens

    @staticmethod
    def columns(found: list[tuple[int, str, str]]) -> list[pa.Array]:
        return [pa.array([f[i] for f in found], kind) for i, kind in enumerate((pa.int64(), pa.string(), pa.string()))]

    def symbols(self, letters: str) -> list[int]:
        return [*map(self.alone.__getitem__, letters[:-1]), self.last[letters[-1]]]

    def merged(self, words: list[list[int]]) -> list[list[int]]:
        """Words of symbols as their tokens: in each the adjacent pair of the lowest rank is joined, the leftmost first, until none has a rank.

        All words take a step at a time, so that a step is a few operations on arrays.
        """
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        symbol, word, done = np.array([x for w in words for x in w], np.int64), np.repeat(np.arange(len(words)), sizes), []
        never = np.int64(1) << 62
        while len(symbol):
            linked = word[1:] == word[:-1]
            key = symbol[:-1] << 32 | symbol[1:]
            at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
            place = np.arange(len(key))
            value = np.append(np.where(linked & (self.pairs[at] == key), self.rank[at] << 32 | place, never), never)
            starts = np.flatnonzero(np.concatenate(([True], ~linked)))
            best = np.minimum.reduceat(value, starts)
            over = best == never
            if over.any():
                gone = np.repeat(over, np.diff(np.append(starts, len(symbol))))
                done.append((word[gone], symbol[gone]))
            join = best[~over] & ((1 << 32) - 1)
            symbol[join] = self.made[at[join]]
            keep = np.ones(len(symbol), bool)
            keep[join + 1] = False
            if over.any():
                keep &= ~gone
            symbol, word = symbol[keep], word[keep]
        word, symbol = (np.concatenate([d[i] for d in done]) for i in (0, 1))
        order = np.argsort(word, kind="stable")
        ends = np.cumsum(np.bincount(word, minlength=len(words)))
        every = symbol[order].tolist()
        return [every[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    def merged_long(self, parts: list) -> list[int]:
        """The same for one long word, by a heap of pairs over a linked list."""
        known, n = self.by_pair, len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pair = lambda i: parts[i] << 32 | parts[after[i]]
        heap = [(known[p][0], i, p) for i in range(n - 1) if (p := pair(i)) in known]
        heapq.heapify(heap)
        while heap:
            _, i, p = heapq.heappop(heap)
            if parts[i] is None or after[i] >= n or pair(i) != p:
                continue  # joined meanwhile
            j = after[i]
            parts[i], parts[j], after[i] = known[p][1], None, after[j]
            if after[i] < n:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] < n and (p := pair(k)) in known:
                    heapq.heappush(heap, (known[p][0], k, p))
        return [p for p in parts if p is not None]

    def split(self, raw: bytes) -> list:
        """The words of a fragment, as letters that stand for bytes; an added token is there as what is kept of it."""
        text = raw.decode()
        plain = text.strip(" ")
        if plain.isalpha() and max(plain) < "\u0100":  # the pattern takes it for one word, and nothing in it composes
            low = plain.lower()
            return [low if low.isascii() else low.encode().decode("latin-1").translate(self.letters)]
        parts, at = [], 0
        for m in [*self.added.finditer(text), None]:
            if piece := text[at : m.start() if m else len(text)]:
                parts += [w for w, _ in self.words_of.pre_tokenize_str(self.normal.normalize_str(piece))]
            if m:
                parts.append(self.special[m[0]])
                at = m.end()
        return parts

    def learn(self, new: list[bytes]) -> None:
        """Adds fragments to those known; long words are not kept by themselves."""
        cut, known = [self.split(f) for f in new], self.words
        fresh = list({w for parts in cut for w in parts if isinstance(w, str) and w not in known})
        short, own = [w for w in fresh if len(w) <= LONGEST], {}
        made = list(zip(short, self.merged([self.symbols(w) for w in short]), strict=True)) if short else []
        made += [(w, self.merged_long(self.symbols(w))) for w in fresh if len(w) > LONGEST]
        for w, ids in made:
            found = self.kept(ids)
            if len(w) <= LONGEST:
                known[w] = found
                self.bytes += len(w) + self.size(found) + ENTRY
            else:
                own[w] = found
        for f, parts in zip(new, cut, strict=True):
            have = [(known.get(w) or own[w]) if isinstance(w, str) else w for w in parts]
            found = self.known[f] = have[0] if len(have) == 1 else self.joined(have) if have else None
            self.bytes += len(f) + (self.size(found) if found else 0) + ENTRY

    def forget(self) -> None:
        self.known.clear()
        self.words.clear()
        self.bytes = 0

    def encode(self, texts: list[str]) -> list:
        """The result of each text: (number of ids, ids and tokens joined by a space).  Equal texts share one."""
        if self.bytes > CACHE:
            self.forget()
        known, found = self.known, dict.fromkeys(texts)
        cut = [fragments(t.encode(), self.cuts) for t in found]
        new = list(set().union(*cut).difference(known))
        self.learn(new)
        for t, c in zip(found, cut, strict=True):
            found[t] = self.result([p for f in c if (p := known[f])])
        for f in new:
            if len(f) > LONGEST:  # rarely seen again, and large
                gone = known.pop(f)
                self.bytes -= len(f) + (self.size(gone) if gone else 0) + ENTRY
        return [found[t] for t in texts]


class Ids(Encoder):
    """The same, but what is kept and the result of a text are the ids alone, as packed 32-bit numbers."""

    def name(self, vocabulary: dict[str, int]) -> None:
        pass

    def kept(self, ids: list[int]) -> bytes:
        return array("i", ids).tobytes()

    def joined(self, parts: list[bytes]) -> bytes:
        return b"".join(parts)

    size = staticmethod(len)
    result = joined

    @staticmethod
    def columns(found: list[bytes]) -> list[pa.Array]:
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        ends = np.concatenate(([0], np.cumsum(sizes)))
        ids = pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(found))])
        return [pa.array(sizes), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), ids)]


def together(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Runs (start, end) of texts that are encoded at once: their fragments are all in memory."""
    start = size = 0
    for i, n in enumerate(pc.binary_length(texts).to_pylist()):
        size += n or 0
        if size >= TOGETHER_BYTES or i + 1 - start >= TOGETHER or i + 1 == len(texts):
            yield start, i + 1
            start, size = i + 1, 0


def _encoder(path: str, kind: type[Encoder] = Encoder):
    names = ["doc_id", "n_tokens", "ids", "decoded"][: 3 if kind is Ids else 4]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = kind(path)
        give_back()  # the tokenizer's file took several times what is kept of it
        for b in batches:
            for start, end in together(b.column(1)):
                part = b.slice(start, end - start)
                found = encoder.encode([t.as_py() or "" for t in part.column(1)])
                yield pa.RecordBatch.from_arrays([part.column(0), *kind.columns(found)], names=names)

    return lean(run)


def _run(docs: DataFrame, work: Callable, schema: str) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(work, schema)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """Per document: doc_id, n_tokens, the ids joined by a space, and the text decoded from them.

    ``path`` is the tokenizer's file on the executors.
    """
    return _run(docs, _encoder(path), "doc_id bigint, n_tokens bigint, ids string, decoded string")


def digest(docs: DataFrame, path: str) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return encode(docs, path).select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def tokens(docs: DataFrame, path: str) -> DataFrame:
    """Per document: doc_id, n_tokens and the ids as an array."""
    return _run(docs, _encoder(path, Ids), "doc_id bigint, n_tokens bigint, ids array<int>")
