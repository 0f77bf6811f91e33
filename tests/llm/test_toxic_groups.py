"""The chain on toxic rows of every language, and on words of no table."""

import random
import zlib

import numpy as np

from blockcodec.llm import toxicity as X

SF = "/root/testdata/sf0.1"


def test_recall_by_language_on_held_out_rows(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = {r["doc_id"]: r for r in X.toxicity(docs, labels).collect()}
    lang = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    held = [(i, y) for i, y in labels.select("doc_id", "toxic").collect() if i in got and y is not None and zlib.crc32(str(i).encode()) % 5 == 0]
    recall = {v: np.mean([got[i]["toxic"] for i, y in held if y and lang[i] == v]) for v in sorted({lang[i] for i, y in held if y})}
    some = {v: np.mean([max(got[i][f"p_{c}"] for c in X.CHAIN[:-1]) > 0.2 for i, y in held if y and lang[i] == v]) for v in recall}
    print("recall", recall, "in a category", some, "false", np.mean([got[i]["toxic"] for i, y in held if not y]))
    assert set(recall) == {"de", "en", "es", "fr"}
    # All held-out toxic rows, whatever words they hold.
    assert np.mean([got[i]["toxic"] for i, y in held if y]) >= 0.9
    assert all(r >= 0.8 for r in recall.values()) and all(r >= 0.5 for r in some.values())
    assert np.mean([got[i]["toxic"] for i, y in held if not y]) < 0.02


def test_categories_come_from_the_labelled_rows(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choices([f"w{k}" for k in range(300)], k=20) + ([rng.choice(["zarg", "blick", "quot", "vemp"])] if i % 5 == 0 else []))) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    chain = X.train(docs, spark.createDataFrame([(i, int(i % 5 == 0)) for i, _ in rows], "doc_id long, toxic int"))
    assert all(np.abs(w[:-1]).max() > 0 for w in chain.weights)
    assert {b"zarg", b"blick", b"quot", b"vemp"} <= set(chain.vocabulary)


def test_ties_repeated_rows_and_long_texts(spark):
    """Words that tell alike, by name; copies teach once; a long text is read
    to its end."""
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choices("abcdefgh", k=12)) + (f" bad{i % 3}" if i % 4 == 0 else "")) for i in range(200)]
    labels = [(i, int(i % 4 == 0)) for i, _ in rows] + [(i, int(i % 4 == 0)) for i in range(20)]
    long_ = "a b c d e f g h " * 70_000
    more = rows + rows[:50] + [(9001, long_), (9002, long_ + "bad1"), (9003, None), (None, "a b c d e f g h bad2")]
    docs = spark.createDataFrame([(i, t, 1.0) for i, t in more], "doc_id long, text string, p_toxic double").repartition(3)
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = X.toxicity(docs, known).collect()
    assert len(long_) > 1 << 20 and len(got) == len(more)
    by = {r["doc_id"]: r["toxic"] for r in got}
    assert not by[9001] and by[9002] and not by[9003] and by[None]
    assert sum(by[i] == (i % 4 == 0) for i, _ in rows) >= 0.97 * len(rows)
    again = {(r["doc_id"], r["p_toxic"]) for r in X.toxicity(docs.repartition(5), known).collect()}
    assert again == {(r["doc_id"], r["p_toxic"]) for r in got}


def test_word_beginnings():
    assert X.word_set("Ab, abcdefgh ab") == {b"ab", b"abcdefgh", b" abcde", b" abcdef", b" abcdefg"}
    assert X.word_set(None) == set() and X.word_set("\u00e9" * 9) >= {(" " + "\u00e9" * 5).encode()}
