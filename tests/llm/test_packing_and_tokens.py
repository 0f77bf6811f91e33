import random
import zlib

import numpy as np
import pytest

from blockcodec.llm import token_files as T
from blockcodec.llm.packing import best_fit, pack, pack_documents
from blockcodec.llm.queries import tokenizer_file
from blockcodec.llm.tokens import WordEncoder

WORDS = tokenizer_file("word_bpe_49k.json")


def brute_fit(items, capacity):
    bins, out = [], []
    for n, s, c in items:
        room = [capacity - sum(x[0] for x in b) for b in bins]
        ok = [(r, i) for i, (r, b) in enumerate(zip(room, bins)) if r >= n and not any((s is not None and x[1] == s) or (c is not None and x[2] == c) for x in b)]
        i = min(ok)[1] if ok else len(bins)
        if not ok:
            bins.append([])
        out.append((i, sum(x[0] for x in bins[i])))
        bins[i].append((n, s, c))
    return out, len(bins)


def test_best_fit_against_brute_force():
    rng = random.Random(1)
    for _ in range(200):
        items = sorted([(rng.randint(1, 30), rng.choice([None, 0, 0, 0, 1, 2]), rng.choice([None, None, 0, 1])) for _ in range(rng.randint(0, 50))], key=lambda x: -x[0])
        assert best_fit(items, 30) == brute_fit(items, 30)


def test_pack(spark):
    rng = random.Random(2)
    rows = [(k, None if k % 50 == 0 else k, rng.choice([0, 1, 99, 100, 101, 250, rng.randint(1, 120)]), None if k % 9 == 0 else f"s{rng.choice([0, 0, 1, 2])}", rng.choice([None, k % 7])) for k in range(400)]
    df = spark.createDataFrame(rows, "_rid long, doc_id long, n_tokens long, source string, cluster long")
    got = pack(df, capacity=100, shard_rows=60).collect()
    assert sum(r["n_tokens"] for r in got) == sum(r[2] for r in rows)
    assert len(got) == sum(-(-r[2] // 100) for r in rows)
    bins = {}
    for r in got:
        bins.setdefault(r["bin_id"], []).append(r)
    for members in bins.values():
        assert sum(r["n_tokens"] for r in members) <= 100
        at = 0
        for r in sorted(members, key=lambda r: r["bin_start"]):
            assert r["bin_start"] == at
            at += r["n_tokens"]
        for c in ("source", "cluster"):
            seen = [r[c] for r in members if r[c] is not None]
            assert len(seen) == len(set(seen))
    assert pack(df.limit(0)).collect() == []


def test_pack_documents(spark):
    rows = [(1, "a b c", "s", 0), (2, "A b c", "t", 0), (3, None, None, 0), (4, "", "s", 0), (5, "word " * 5000, "u", 0), (None, "x", "s", 0), (1, "a b c", "s", 0)]
    got = pack_documents(spark.createDataFrame(rows, "doc_id long, text string, source string, n_tokens int"), WORDS).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(["1", "1", "2", "3", "4", "5", "5", "5", "None"])
    one, two = (next(r for r in got if r["doc_id"] == i) for i in (1, 2))
    assert one["cluster"] == two["cluster"] and one["bin_id"] != two["bin_id"] and one["n_tokens"] == 4


@pytest.mark.parametrize("n,alphabet,block", [(0, 1, 64), (1, 1, 64), (1000, 7, 64), (5000, 300, 1 << 17), (3000, 5, 512)])
def test_wavelet_matrix(n, alphabet, block):
    rng = np.random.default_rng(n)
    ids = rng.integers(0, alphabet, n).astype(np.uint32) * 3
    f = T.TokenFile(T.encode_file(ids, [9] if n else [], [n] if n else [], block))
    assert (f.tokens() == ids).all() and f.count(1) == 0
    for i in rng.integers(0, n, 25).tolist() if n else []:
        token, places = int(ids[i]), np.nonzero(ids == ids[i])[0]
        k = int(rng.integers(len(places)))
        assert f.access(i) == token and f.locate(token, k) == places[k]
        assert f.count(token) == len(places) and f.count(token, i // 2, i) == ((places >= i // 2) & (places < i)).sum()
    with pytest.raises(IndexError):
        f.locate(1, 0)
    with pytest.raises(ValueError):
        T.TokenFile(b"nothing")


def test_word_encoder_equals_the_library():
    encoder, rng = WordEncoder(WORDS), random.Random(1)
    pool = [chr(c) for c in range(0x250)] + list("ΣσςİıſKÅé́̇日本😀ǅⅫ٣ 　<|>'") + ["<|endoftext|>", "'s", "'RE"]
    texts = ["".join(rng.choice(pool if rng.random() < 0.5 else "abcDEF 's<|\xa0\x85é1²") for _ in range(rng.randint(0, 40))) for _ in range(5000)] + ["", "x" * 3000, "it's I'M"]
    want = encoder.ids.tokenizer.encode_batch(texts, add_special_tokens=False)
    assert [x.tolist() for x in encoder.encode(texts)] == [e.ids for e in want]


def test_files_against_the_library(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["Hello", "wörld", "l'été", "12", "<|endoftext|>", "\n"]) for _ in range(rng.randint(0, 60)))) for i in range(120)] + [(500, None), (501, ""), (2**63 - 1, "the largest id"), (None, "last"), (None, None), (7, "again")]
    rng.shuffle(rows)
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, start int").repartition(3)
    got = T.token_files(df, WORDS, file_tokens=200).collect()
    encoder = WordEncoder(WORDS)
    ids = {k: np.append(encoder.encode([t])[0], 2).astype("<u4") for k, (_, t) in enumerate(rows)}
    want = sorted((str(i), len(ids[k]), zlib.crc32(ids[k])) for k, (i, _) in enumerate(rows))
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["ids_crc32"]) for r in got) == want
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    order = [2**64 if r["doc_id"] is None else r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
    assert order == sorted(order)
    assert T.token_files(df.limit(0), WORDS).collect() == []


def test_prefix_sums_over_many_partitions(spark, monkeypatch):
    monkeypatch.setattr(T, "PARTS_TOGETHER", 2)
    rows = [(i if i % 3 else None, "same text here" if i % 2 else f"text number {i}") for i in range(90)]
    got = T.token_files(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), WORDS, file_tokens=20, partition_bytes=150).collect()
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(i) for i, _ in rows)


def test_very_long_text(spark):
    long_ = " ".join(f"word{k % 4999} été" for k in range(100_000))
    got = T.token_files(spark.createDataFrame([(1, "before"), (2, long_), (3, "after")], "doc_id long, text string"), WORDS).collect()
    encoder = WordEncoder(WORDS)
    want = {i: np.append(encoder.encode([t])[0], 2).astype("<u4") for i, t in ((1, "before"), (2, long_), (3, "after"))}
    assert len(long_) > 1 << 20 and {r["doc_id"]: (r["n_tokens"], r["ids_crc32"]) for r in got} == {i: (len(x), zlib.crc32(x)) for i, x in want.items()}
