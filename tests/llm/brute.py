"""Plain versions of the operators, one document or one pair at a time, that share no code with them."""

import hashlib
import math
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def fill(sizes, weights, share=1.5, most=2.0):
    """Targets by weight, none above ``most`` times its size; the excess is shared out again until none is above."""
    targets, rest, left = [0.0] * len(sizes), share * sum(sizes), list(range(len(sizes)))
    while left:
        total = sum(weights[i] for i in left)
        full = [i for i in left if rest * weights[i] / total > most * sizes[i]]
        if not full:
            for i in left:
                targets[i] = rest * weights[i] / total
            break
        for i in full:
            targets[i] = most * sizes[i]
            rest -= targets[i]
        left = [i for i in left if i not in full]
    return targets


def mixed(docs, seed=20_240_607):
    """(document, copies): every document of a source at the same rate, by size class and digest."""
    size = lambda d: len(WORD.findall(d["text"] or ""))
    names = sorted({d["source"] for d in docs}, key=lambda s: (s is None, s or ""))
    totals = [sum(size(d) for d in docs if d["source"] == s) for s in names]
    digest = lambda d: hashlib.md5(f"{'' if d['doc_id'] is None else d['doc_id']}|{d['text'] or ''}".encode()).hexdigest()
    out = []
    for s, total, target in zip(names, totals, fill(totals, [(3, 1, 2)[i % 3] for i in range(len(names))]), strict=True):
        rate = target / total if total else 0.0
        start = int(hashlib.md5((f"{seed}:" + ("" if s is None else f"={s}")).encode()).hexdigest()[:13], 16) / 2**52
        mine = sorted((d for d in docs if d["source"] == s), key=lambda d: ((size(d) + 1).bit_length(), f"{size(d) + 1:b}"[:5], digest(d)))
        out += [(d, math.floor(start + rate * (k + 1)) - math.floor(start + rate * k)) for k, d in enumerate(mine)]
    return out


def fingerprint(text):
    import xxhash

    words = WORD.findall(lower(text))
    found = [xxhash.xxh64(" ".join(words[i : i + 4]).encode(), seed=42).intdigest() for i in range(max(1, len(words) - 3))] if words else []
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in found) * 2 > len(found)) if found else 0


def shingles(text, size=5):
    words = WORD.findall(lower(text))
    return {" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def alike(a, b, least=0.8):
    return bool(a) and len(a & b) >= least * len(a | b)


def similar_pairs(sets, least=0.8):
    """All pairs (i < j) of sets with a Jaccard similarity of ``least``: two such sets share a member."""
    at, out = {}, {}
    for i, s in enumerate(sets):
        for x in s:
            at.setdefault(x, []).append(i)
    for i, s in enumerate(sets):
        shared = {}
        for x in s:
            for j in at[x]:
                if j < i:
                    shared[j] = shared.get(j, 0) + 1
        for j, n in shared.items():
            if n >= least * (len(s) + len(sets[j]) - n):
                out[j, i] = n / (len(s) + len(sets[j]) - n)
    return out


def groups(texts):
    """For each text the least index of its group: 4 bits on 4-word shingles, or five-word similarity 0.8."""
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    fps = [fingerprint(t) for t in texts]
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4 or texts[i] == texts[j]]
    for i, j in [*pairs, *similar_pairs([shingles(t) for t in texts])]:
        a, b = find(i), find(j)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


def toxicity(text, weights, bias):
    """1 - the product over sentences of 1 - sigmoid(bias + weights of the sentence's features)."""
    none = 1.0
    for sentence in [s for s in re.split(r"[.!?\n]+", text) if s] or [""]:
        words = {w.lower() for w in re.findall(r"[^\W\d_]+", sentence.lower())}
        z = bias
        for w in words:
            z += weights.get(w, 0.0) + sum(weights.get(w[:n] + "-", 0.0) for n in (3, 4, 5, 7) if len(w) > n)
        none *= 1 - 1 / (1 + math.exp(-z))
    return 1 - none


def grams(text, width=2048):
    """Square roots of the shares of hashed letter 1-, 2- and 3-grams; None without a letter."""
    cut = re.sub(r"[^a]", lambda m: m[0] if m[0].isalpha() else " ", text.lower())
    codes = [ord(c) for c in re.sub(" +", " ", f" {cut} ")]
    if codes == [32]:
        return None
    m32, top = 0xFFFFFFFF, 32 - width.bit_length() + 1
    one = [c * 0x9E3779B1 & m32 for c in codes]
    two = [a * 31 + c * 0x85EBCA6B & m32 for a, c in zip(one, codes[1:], strict=False)]
    three = [a * 37 + c * 0xC2B2AE35 & m32 for a, c in zip(two, codes[2:], strict=False)]
    count = [0] * width
    for g in [(o + 1) & m32 for o in one[1:-1]] + two + three:
        count[(g * 0x27D4EB2F & m32) >> top] += 1
    return [math.sqrt(c / sum(count)) for c in count]


def duel(names, weights, x):
    """The winner of one-versus-one machines: most votes, then the larger sum of margins, then the first name."""
    votes, sums = dict.fromkeys(names, 0), dict.fromkeys(names, 0.0)
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    for (a, b), w in zip(pairs, weights, strict=True):
        margin = sum(v * u for v, u in zip(w, [*x, 1.0], strict=True))
        votes[a if margin >= 0 else b] += 1
        sums[a] += margin
        sums[b] -= margin
    return max(names, key=lambda n: (votes[n], sums[n], -names.index(n)))
