"""The pipeline against a brute-force version of its stages."""

import random
from collections import Counter

import corpus_pipeline
import duckdb
import numpy as np
import public_tokenizers
import pytest
from corundum.llm import simhash, toxicity
from tests.llm import brute
from tests.llm.test_llm import ODD

DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def near(docs):
    """Of each group the row with the smallest id (null last), then the smallest digest."""
    import hashlib

    best = {}
    for d, g in zip(docs, brute.groups([d["text"] for d in docs]), strict=True):
        rank = (d["doc_id"] is None, d["doc_id"] or 0, hashlib.sha256((d["text"] or "").encode()).digest())
        if g not in best or rank < best[g][0]:
            best[g] = rank, d
    return [d for _, d in best.values()]


def stages(spark, docs, sf_dir):
    """The rows after each of the first four stages; only the learnt weights come from the operator."""
    model = toxicity.train(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = [[d for d in docs if brute.toxicity(d["text"] or "", model.weights, model.bias) < 0.5]]
    best = {}
    for d in out[-1]:
        best[d["text"] or ""] = max(best.get(d["text"] or "", d), d, key=lambda x: x["doc_id"])
    out.append(list(best.values()))
    out.append(near(out[-1]))
    out.append([d for d, n in brute.mixed(out[-1]) for _ in range(n)])
    return out


def test_run(spark, sf):
    from tokenizers import Tokenizer

    docs = [r.asDict() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = stages(spark, docs, sf)
    now = spark.read.parquet(f"{sf}/documents.parquet")
    for (name, stage), expected in zip(corpus_pipeline.STAGES, want, strict=False):
        out = stage(spark, now, sf)
        assert out.columns == now.columns
        assert Counter(map(tuple, out.collect())) == Counter(tuple(d.values()) for d in expected), name
        now = spark.createDataFrame(out.collect(), out.schema)
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = Counter((r["doc_id"], r["n_tokens"], tuple(r["ids"])) for r in corpus_pipeline.run(spark, sf).collect())
    encoded = [(d["doc_id"], library.encode(d["text"] or "", add_special_tokens=False).ids) for d in want[-1]]
    assert got == Counter((i, len(ids), tuple(ids)) for i, ids in encoded)
    assert 0 < len(want[1]) < len(want[0]) < len(docs)


def test_stages_on_odd_and_empty_tables(spark, sf):
    for rows in (ODD, []):
        now = spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], f"{DOC}, score int, digest_ int, no int, root int")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, now, sf)
            assert out.columns == now.columns
            now = spark.createDataFrame(out.collect(), out.schema)
        assert corpus_pipeline.STAGES[-1][1](spark, now, sf).count() == now.count()
        if rows:
            assert {r["doc_id"] for r in now.collect()} & {8, 11}


# ---------------------------------------------------------------- near duplicates
def check_near(spark, docs, hot=simhash.HOT):
    """keep_one keeps exactly the rows that brute force keeps."""
    table = spark.createDataFrame([(d["doc_id"], d["text"], "x") for d in docs], "doc_id bigint, text string, no string")
    got = Counter((r["doc_id"], r["text"]) for r in simhash.keep_one(table, hot).collect())
    assert got == Counter((d["doc_id"], d["text"]) for d in near(docs))


def dense_copies(n=300, seed=5):
    """Copies of one text of 150 words, each with a few words changed, so that many pairs lie just below similarity 0.8."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(5000)}" for _ in range(150)]
    texts = []
    for _ in range(n):
        words = list(base)
        for at in rng.sample(range(150), rng.randint(1, 6)):
            words[at] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(words))
    return texts


@pytest.mark.parametrize("hot", [simhash.HOT, 40])
def test_near_copies_in_large_buckets(spark, hot):
    check_near(spark, [{"doc_id": i, "text": t} for i, t in enumerate(dense_copies())], hot)


def test_blocks_appended_or_removed(spark):
    """Texts that differ by one block, so that their fingerprints lie far apart."""
    rng = random.Random(11)
    docs = []
    for k in range(60):
        words = [f"w{rng.randrange(20_000)}" for _ in range(rng.choice((60, 300, 2000)))]
        block = [f"y{rng.randrange(20_000)}" for _ in range(int(len(words) * rng.choice((0.1, 0.18, 0.23))))]
        at = rng.choice((0, len(words) // 2, len(words)))
        docs += [{"doc_id": 2 * k, "text": " ".join(words)}, {"doc_id": 2 * k + 1, "text": " ".join(words[:at] + block + words[at:])}]
    check_near(spark, docs)


def test_a_row_is_itself_whatever_its_id(spark):
    one, two, three = (" ".join(f"{c}{i}" for i in range(40)) for c in "xyz")
    docs = [(5, one), (5, two), (6, three), (None, three + " more"), (None, "quite other words " * 3), (7, one), (7, one), (4, one.upper()), (None, None), (None, ""), (8, "short"), (9, "Short"), (None, two), (None, two)]
    check_near(spark, [{"doc_id": i, "text": t} for i, t in docs])
    check_near(spark, [{"doc_id": 3, "text": one}] * 5 + [{"doc_id": None, "text": two}] * 4)


def test_pair_recall(spark):
    """All pairs of different texts of a similarity of 0.8 or more, by enumeration, are linked."""
    rows = duckdb.sql("SELECT text, min(doc_id) FROM '/root/testdata/sf0.1/documents.parquet' GROUP BY text").fetchall()
    pairs = brute.similar_pairs([brute.shingles(t) for t, _ in rows])
    table = spark.createDataFrame([(i, t) for t, i in rows], "doc_id bigint, text string").repartition(8)
    root = {r["doc_id"]: r["root"] for r in simhash.grouped(table).collect()}
    found = sum(root.get(rows[i][1], -1) == root.get(rows[j][1], -2) for i, j in pairs)
    assert len(pairs) >= 40 and found == len(pairs)


def test_shingle_sets_are_those_of_the_words():
    powers, rng = simhash.Powers(), random.Random(3)
    texts = [" ".join(rng.choices(["a", "B", "cé", "dd", "\U0001f600"], k=rng.randint(0, 60))) for _ in range(300)] + ["x  \t y\n\x0bz", " ", "word " * 5000, "é" * 3000]
    by = {}
    for t in texts:
        want = brute.shingles(t)
        got = simhash.shingles(t, powers)
        assert len(got) == len(want)
        by.setdefault(frozenset(want), set()).add(tuple(got.tolist()))
    assert all(len(v) == 1 for v in by.values())
    whole, simhash.TOGETHER = simhash.TOGETHER, 7
    try:
        assert all((simhash.shingles(t, powers) == next(iter(by[frozenset(brute.shingles(t))]))).all() for t in texts)
    finally:
        simhash.TOGETHER = whole


def test_wide_bitmaps_never_exceed_what_sets_differ_in():
    rng = np.random.default_rng(4)
    pool = rng.integers(0, 2**63, 20_000).astype(np.uint64)
    for n, m in ((0, 0), (1, 3), (500, 520), (900, 1100), (5000, 4000), (10_000, 20_000)):
        a, b = np.unique(pool[:n]), np.unique(pool[n // 10 : n // 10 + m])
        far = simhash.differing(simhash.wide_marks(a), simhash.wide_marks(b))
        assert far <= len(np.setxor1d(a, b)) and simhash.differing(simhash.wide_marks(a), simhash.wide_marks(a)) == 0


def test_stages_hand_few_rows_at_once_to_python(spark, sf, monkeypatch):
    def large(batches):
        return (b for b in batches if b.num_rows > 50)

    stages = [(name, stage.__wrapped__) for name, stage in corpus_pipeline.STAGES]
    assert len(stages) == 5
    monkeypatch.setattr(corpus_pipeline, "ARROW_ROWS", 50)
    monkeypatch.setattr(corpus_pipeline, "STAGES", [("any", corpus_pipeline.small_batches(lambda s, d, _: d.select("doc_id").mapInArrow(large, "doc_id bigint")))])
    held = spark.conf.get(corpus_pipeline.ARROW)
    assert spark.read.parquet(f"{sf}/documents.parquet").count() > 50 and corpus_pipeline.run(spark, sf).count() == 0
    assert spark.conf.get(corpus_pipeline.ARROW) == held
