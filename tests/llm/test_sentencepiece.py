import hashlib
import itertools
import random
import zlib

import numpy as np
import pytest
import sentencepiece as sp
from pyspark.sql import functions as F

from blockcodec.llm import sentencepiece_lattice as L
from blockcodec.llm.queries import tokenizer_file

PATH = tokenizer_file("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sp.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def model():
    return L.load(PATH)


def samples():
    rng = random.Random(1)
    pool = ["the", "tion", " ", "  ", "\n", "é", "ñ", "日本", "😀", "▁", "a", "b", "http://", "\t", "123", "<s>", "ing", ".", "é"]
    return ["", " ", "a", "   ", "x" * 59, "x" * 60, "y" * 61, "ab" * 400, " " * 130 + "q", "\x00\x01"] + ["".join(rng.choice(pool) for _ in range(rng.randint(1, 40))) for _ in range(150)]


def test_heap_merges_equal_the_library(library, model):
    for t in samples():
        assert [i for w in model.words(t) for i in L.merged(w, model)] == library.encode(t), t
        assert L.decode_ids(library.encode(t), model) == library.decode(library.encode(t))


def test_operator_equals_the_library(spark, library, model):
    rows = [*enumerate(samples()), (None, "no id"), (2**63 - 1, "the largest id"), (3, None), (3, "again")]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, word int").repartition(3)
    got = L.sentencepiece(df, model, block_bytes=2000).collect()
    want = [(str(i), library.encode(t or ""), (t or "").replace("▁", " ")) for i, t in rows]
    assert sorted((str(r["doc_id"]), list(r["ids"]), r["decoded"]) for r in got) == sorted(want)
    got = L.sentencepiece(df, model, digest=True).collect()
    assert sorted((str(r["doc_id"]), r["n_pieces"], r["ids_crc32"], r["decoded_sha256"]) for r in got) == sorted((i, len(x), zlib.crc32(np.array(x, "<u4")), hashlib.sha256(t.encode()).hexdigest()) for i, x, t in want)
    assert L.sentencepiece(df.limit(0), model).collect() == []


def brute(word, scores):
    best = None
    for cuts in itertools.product((0, 1), repeat=len(word) - 1):
        at = [0, *(i + 1 for i, c in enumerate(cuts) if c), len(word)]
        parts = [word[a:b] for a, b in zip(at, at[1:])]
        if all(p in scores or len(p) == 1 for p in parts):
            total = sum(scores[p] if p in scores and len(p) > 1 else -100.0 if p not in scores else scores[p] for p in parts)
            best = max(best or (-1e9, ()), (total, tuple(parts)))
    return best[0]


def test_viterbi_against_all_paths(spark):
    """A unigram model of a few pieces; single characters cost the same."""
    rng = random.Random(2)
    scores = {p: -rng.uniform(1, 9) for p in ("ab", "bc", "abc", "ca", "cab", "bb", "aab", "bca")}
    model = L.pieces(dict(zip(scores, range(9))), scores, [p.encode() for p in scores], [0] * 256)
    words = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 9))) for _ in range(60)]
    df = spark.createDataFrame([(w, 1) for w in sorted(set(words))], "word string, place long")
    for r in L.segment(df, model, L.piece_table(spark, model), viterbi=True).collect():
        cuts = [i for i in range(len(r["word"]) + 1) if r["bits"] >> i & 1]
        parts = [r["word"][a:b] for a, b in zip(cuts, cuts[1:])]
        assert abs(sum(scores.get(p, -100.0) for p in parts) - brute(r["word"], scores)) < 1e-9


def test_lattice_stays_in_one_stage(spark, model):
    words = spark.range(5).select(F.col("id").cast("string").alias("word"), F.col("id").alias("place")).repartition(4, "word")
    plan = L.segment(words, model, L.piece_table(spark, model))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "BroadcastHashJoin" in plan and "Python" not in plan


def test_other_models_are_refused(library):
    """By what the model file says: its kind, its byte fallback and how it
    treats characters."""
    raw = library.serialized_model_proto()
    L.check_kind(raw)

    def message(fields):
        return b"".join(bytes([k << 3 | (0 if isinstance(v, int) else 2)]) + (bytes([v]) if isinstance(v, int) else bytes([len(v)]) + v) for k, v in fields)

    def model(trainer=((3, 2),), normalizer=((4, 0),)):
        # Field 35 takes a key of two bytes.
        return message([(2, message(trainer) + b"\x98\x02\x01"), (3, message(normalizer))])

    L.check_kind(model())
    for bad in (model(trainer=((3, 1),)), model(normalizer=()), model(normalizer=((4, 0), (3, 0))), model(normalizer=((4, 0), (2, b"rules"))), message([(2, message([(3, 2)])), (3, message([(4, 0)]))])):
        with pytest.raises(ValueError):
            L.check_kind(bad)


def test_very_long_text_and_words_in_many_blocks(spark, library, model, monkeypatch):
    monkeypatch.setattr(L, "LISTED", 2)
    long_ = " ".join(f"word{k % 3001} été" for k in range(110_000))
    rows = [(1, long_), *((i, "the common words of all blocks") for i in range(2, 60))]
    got = {r["doc_id"]: r for r in L.sentencepiece(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), model, digest=True, block_bytes=200).collect()}
    assert len(long_) > 1 << 20 and len(got) == len(rows)
    for i, t in rows[:3]:
        assert got[i]["ids_crc32"] == zlib.crc32(np.array(library.encode(t), "<u4"))
