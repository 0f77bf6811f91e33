"""Near copies by word shingles against all pairs."""

import random

import corpus_pipeline as P
import numpy as np
import pyarrow as pa

from blockcodec.llm import shingles as H
from blockcodec.llm.simhash import fingerprint, one_of_each
from blockcodec.llm.substring_dedup import Hashes


def plain_shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 0


def kept(rows, close):
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, a in enumerate(rows):
        for b in rows[:k]:
            if close(a[1], b[1]):
                x, y = sorted((find(a[0]), find(b[0])))
                root[y] = x
    return sorted(i for i in root if find(i) == i)


def edited(rng, words, n):
    out = list(words)
    for at in rng.sample(range(len(out)), n):
        out[at] = f"new{rng.randrange(10**9)}"
    return " ".join(out)


def corpus(rng):
    vocabulary = [f"w{k}" for k in range(3000)]
    rows = [None, "", "one two", "One two", "one three"]
    for _ in range(8):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([60, 150, 400]))]
        rows += [" ".join(base)] + [edited(rng, base, max(1, round(len(base) * f))) for f in (0.005, 0.01, 0.015, 0.02, 0.03, 0.06, 0.1) for _ in range(2)]
    shared = [rng.choice(vocabulary) for _ in range(200)]
    rows += [" ".join(shared + [rng.choice(vocabulary) for _ in range(n)]) for n in (20, 30, 200, 210, 600)]
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_sets_and_similarity():
    rng, cache = random.Random(1), Hashes()
    for _ in range(100):
        a, b = (" ".join(rng.choice(["a", "B", "é", "d"]) for _ in range(rng.randint(0, 12))) for _ in "ab")
        x, y = H.shingles(a, cache), H.shingles(b, cache)
        assert len(x) == len(plain_shingles(a)) and len(np.intersect1d(x, y)) == len(plain_shingles(a) & plain_shingles(b))
        assert H.similar(x, y, 0.8) == (jaccard(plain_shingles(a), plain_shingles(b)) >= 0.8)


def test_near_stage_drops_word_edits_beyond_three_bits(spark):
    rows = corpus(random.Random(7))
    sets, marks = {t: plain_shingles(t) for _, t in rows}, {t: fingerprint(t) for _, t in rows}
    want = kept(rows, lambda a, b: (marks[a] ^ marks[b]).bit_count() <= 3 or jaccard(sets[a], sets[b]) >= 0.8)
    thin = kept(rows, lambda a, b: (marks[a] ^ marks[b]).bit_count() <= 3)
    assert len(thin) > len(want) + 5
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(r["doc_id"] for r in P.near_stage(spark, df, "").collect()) == want
    assert sorted(r["doc_id"] for r in one_of_each(df).collect()) == thin


def test_a_passage_that_many_texts_share(spark, monkeypatch):
    """Texts whose better half is one passage: their buckets are large, finer
    bands tell them apart, and links are still all found."""
    rng = random.Random(11)
    vocabulary = [f"v{k}" for k in range(5000)]
    passage = [rng.choice(vocabulary) for _ in range(120)]
    rows = [" ".join(passage + [rng.choice(vocabulary) for _ in range(rng.randint(60, 90))]) for _ in range(150)]
    rows += [edited(rng, rng.choice(rows).split(), 2) for _ in range(30)]
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    monkeypatch.setattr(H, "SMALL", 8)
    sets = {t: plain_shingles(t) for _, t in rows}
    marks = {t: fingerprint(t) for _, t in rows}
    want = kept(rows, lambda a, b: (marks[a] ^ marks[b]).bit_count() <= 3 or jaccard(sets[a], sets[b]) >= 0.8)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(r["doc_id"] for r in P.near_stage(spark, df, "").collect()) == want and len(want) < len(rows)


def test_sketches_of_similar_texts_are_near():
    rng = random.Random(3)
    near, apart = [], []
    for _ in range(60):
        base = [f"v{rng.randrange(5000)}" for _ in range(300)]
        for n, out in ((5, near), (30, apart)):
            a, b = (next(H._finer([pa.RecordBatch.from_pydict({"_rid": [1], "text": [t]})]))["sketch"][0].as_py() for t in (" ".join(base), edited(rng, base, n)))
            out.append(sum(((x ^ y) & ((1 << 64) - 1)).bit_count() for x, y in zip(a, b)))
            assert len(a) * 64 == H.FINE_BANDS * H.FINE_ROWS
    assert max(near) <= H.far(0.8) < min(apart)
