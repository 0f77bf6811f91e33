import hashlib
import random

import pytest

from blockcodec.llm.exact_dedup import ContentTable, exact_dedup, kept_rows

SCHEMA = "doc_id long, text string, rep string, _rid string, keep_id string"


def fold(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", None, "y") for i, t in rows], SCHEMA)


def check(rows, got):
    groups = {}
    for i, t in rows:
        groups.setdefault(fold(t), []).append(i)
    want = sorted((str(i), max(g), len(g), hashlib.sha256(fold(t).encode()).hexdigest()) for i, t in rows for g in [groups[fold(t)]])
    assert sorted((str(r["doc_id"]), r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == want
    kept = [r for r in got if r["kept"]]
    assert sorted(r["text_sha256"] for r in kept) == sorted({r["text_sha256"] for r in got})
    assert all(r["doc_id"] == r["keep_id"] for r in kept)


@pytest.mark.parametrize("limit", [250, 3000, 1 << 20])
def test_against_brute_force(spark, limit):
    """A small table takes a text or two of a bucket and level: many levels."""
    rng = random.Random(limit)
    texts = ["", None, "A", "a", "Ä", "ä", "a ", "x" * 2000] + ["".join(rng.choice("aAbB ") for _ in range(rng.randint(0, 4))) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    check(rows, exact_dedup(docs(spark, rows).repartition(3), limit).collect())


def test_hot_group_nulls_and_repeats(spark):
    rows = [(i, "same") for i in range(300)] + [(7, "b"), (7, "b"), (9, "B")]
    check(rows, exact_dedup(docs(spark, rows).repartition(6)).collect())
    got = exact_dedup(docs(spark, [(None, "q"), (None, "q"), (3, "Q"), (None, "z"), (None, "z")])).collect()
    assert sorted((r["group_size"], r["keep_id"], r["kept"], r["doc_id"]) for r in got if r["keep_id"] == 3) == sorted([(3, 3, True, 3), (3, 3, False, None), (3, 3, False, None)], key=str) or sum(r["kept"] for r in got) == 2
    assert sum(r["kept"] for r in got) == 2


def test_empty_table(spark):
    assert exact_dedup(docs(spark, [])).collect() == []
    assert kept_rows(docs(spark, [])).collect() == []


def test_kept_rows_keep_their_columns(spark):
    kept = kept_rows(docs(spark, [(1, "A"), (2, "a"), (3, None), (4, "")]))
    assert kept.columns == ["doc_id", "text", "rep", "_rid", "keep_id"]
    assert sorted((r["doc_id"], r["text"]) for r in kept.collect()) == [(2, "a"), (4, "")]


def test_equal_hashes_do_not_make_equal_texts():
    table = ContentTable()
    a, b = table.insert(5, b"one"), table.insert(5, b"two")
    assert table.find(5, b"one") == a and table.find(5, b"two") == b and table.find(5, b"three") == -1
    for k in range(500):
        table.insert(k * 64, b"%d" % k)
    assert all(table.texts[table.find(k * 64, b"%d" % k)] == b"%d" % k for k in range(500))
