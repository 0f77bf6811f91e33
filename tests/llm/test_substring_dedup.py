import hashlib
import random
import re

import pytest

from blockcodec.llm import common
from blockcodec.llm import substring_dedup as D
from blockcodec.llm.substring_dedup import substring_dedup

NO_ID = 1 << 63  # after every doc_id


def brute(rows, window=13):
    words = [(NO_ID if i is None else i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    first = {}
    for i, w in words:
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            first[key] = min(i, first.get(key, i))
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < i:
                gone[k : k + window] = [True] * window
        out.append((str(None if i == NO_ID else i), len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest()))
    return sorted(out)


def run(spark, rows, parts=3, **options):
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, block int").repartition(parts)
    return sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup(df, **options).collect())


def corpus(seed, n, vocabulary):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary)]
    passages = [[rng.choice(words) for _ in range(rng.randint(8, 60))] for _ in range(8)]
    rows = []
    for i in range(n):
        text = []
        for _ in range(rng.randint(0, 5)):
            text += rng.choice(passages)[rng.randint(0, 5) :] if rng.random() < 0.6 else [rng.choice(words) for _ in range(rng.randint(1, 40))]
        rows.append((i, rng.choice((" ", "\n", "  ", "\t")).join(text)))
    return rows


@pytest.mark.parametrize("vocabulary,block", [(2, 4000), (3, 8000), (30, 6 << 20), (3000, 5000)])
def test_against_brute_force(spark, vocabulary, block):
    rows = corpus(vocabulary, 80, vocabulary)
    assert run(spark, rows, block_bytes=block) == brute(rows)


def test_edges(spark):
    line = " ".join(f"x{i}" for i in range(13))
    rows = [(5, line), (3, line + " more"), (9, "A " + line), (None, line), (None, line), (4, None), (6, ""), (7, " \n"), (8, line.replace(" ", " ")), (2, line[:-1]), (2**63 - 1, "B " + line), (3, line), (11, line + " " + line), (12, "é " * 40)]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []


def test_hot_passage(spark):
    line = " ".join(f"x{i}" for i in range(30))
    rows = [(i, f"a{i} b{i} {line} c{i}") for i in range(400)]
    assert run(spark, rows, parts=6, block_bytes=4000) == brute(rows)


def test_carry(spark):
    line = " ".join(f"x{i}" for i in range(20))
    df = spark.createDataFrame([(1, f"a\n{line}", "k"), (2, f"b  c\n{line}", "k"), (3, line, None)], "doc_id long, text string, kept_text string")
    got = {r["doc_id"]: (r["kept_text"], r["row"]["text"], r["row"]["kept_text"]) for r in substring_dedup(df, carry=True).collect()}
    assert got == {1: (None, f"a\n{line}", "k"), 2: ("b c", f"b  c\n{line}", "k"), 3: ("", line, None)}


def test_the_largest_doc_id_is_before_none(spark):
    line = " ".join(f"x{i}" for i in range(13))
    rows = [(2**63 - 1, line), (None, line), (None, line)]
    assert run(spark, rows) == brute(rows)
    only = [(None, line), (None, line + " " + line)]
    assert run(spark, only) == brute(only) and all(r[2] == 0 for r in brute(only))


def test_more_blocks_than_buckets(spark, monkeypatch):
    """Spark takes 100,000 buckets at most; then a bucket has several blocks."""
    monkeypatch.setattr(common, "MAX_BUCKETS", 3)
    rows = corpus(5, 80, 30)
    assert run(spark, rows, block_bytes=1000) == brute(rows)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("blocks_")]


def test_windows_of_equal_first_hash_are_told_apart(spark, monkeypatch):
    """Keys whose first 64 bits collide: the second hash decides."""
    import numpy as np

    keys, docs = np.array([7, 7, 7, 9], np.uint64), np.array([3, 1, 2, 5])
    kinds, seconds = np.full(4, D.SOME, np.uint8), np.array([4, 8, 4, 4], np.uint64)
    found = D.least_by(keys, docs, kinds, seconds, True)
    assert list(zip(*(x.tolist() for x in found[:2]), found[3].tolist())) == [(7, 2, 4), (7, 1, 8), (9, 5, 4)]
    blob = D.pack(found[0], found[3], found[1], found[2], found[4])
    known, low, _, _ = D.lookup([blob], keys, np.array([4, 8, 5, 4], np.uint64))
    assert known.tolist() == [True, True, False, True] and low[:2].tolist() == [2, 1]


def test_very_long_text(spark):
    rng = random.Random(8)
    long_ = " ".join(f"w{rng.randrange(50_000)}" for _ in range(200_000))
    rows = [(1, long_), (2, long_[300_000:900_000]), (3, "a " + long_)]
    assert len(long_) > 1 << 20 and run(spark, rows) == brute(rows)
