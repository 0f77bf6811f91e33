"""The stages, and run(), against plain versions on a small table."""

import re

import corpus_pipeline as P
from test_packing_and_tokens import WORDS, brute_fit
from test_shingles import jaccard, plain_shingles
from tokenizers import Tokenizer

from blockcodec.llm import common
from blockcodec.llm import quality as Q
from blockcodec.llm.common import write_table
from blockcodec.llm.simhash import fingerprint

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def rows(df):
    return {r["doc_id"]: r.asDict() for r in df.collect()}


def plain_exact(before):
    best = {}
    for i, r in before.items():
        t = re.sub("[A-Z]", lambda m: m[0].lower(), r["text"] or "")
        best[t] = max(i, best.get(t, i))
    return {i: before[i] for i in best.values()}


def plain_near(before):
    """Links within three bits, or of a similarity of 0.8 on five-word
    shingles; the least of each component stays."""
    root = {i: i for i in before}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    marks = {i: fingerprint(r["text"]) for i, r in before.items()}
    sets = {i: plain_shingles(r["text"]) for i, r in before.items()}
    for a in before:
        for b in before:
            if a < b and ((marks[a] ^ marks[b]).bit_count() <= 3 or jaccard(sets[a], sets[b]) >= 0.8):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: r for i, r in before.items() if find(i) == i}


def plain_substring(before):
    first, out = {}, {}
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "") for i, r in before.items()}
    for i in sorted(words):
        for k in range(len(words[i]) - 12):
            first.setdefault(tuple(words[i][k : k + 13]), i)
    for i, w in words.items():
        gone = [False] * len(w)
        for k in range(len(w) - 12):
            if first[tuple(w[k : k + 13])] < i:
                gone[k : k + 13] = [True] * 13
        if not any(gone):
            out[i] = before[i]
        elif not all(gone):
            text = " ".join(x for x, g in zip(w, gone) if not g)
            out[i] = before[i] | {"text": text, "n_chars": len(text)}
    return out


def plain_pack(before, capacity=2048):
    """Pieces with their bins. As one shard has all rows of this table, so has
    one search; equal lengths go by doc_id."""
    tokenizer = Tokenizer.from_file(WORDS)
    n = {i: len(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for i, r in before.items()}
    order = sorted((i for i in n if n[i] % capacity), key=lambda i: (-(n[i] % capacity), i))
    placed, _ = brute_fit([(n[i] % capacity, before[i]["source"], re.sub("[A-Z]", lambda m: m[0].lower(), before[i]["text"] or "")) for i in order], capacity)
    bins = {}
    for i, (b, at) in zip(order, placed):
        bins.setdefault(b, []).append((i, n[i] // capacity, n[i] % capacity, at))
    full = [[(i, k, capacity, 0)] for i in n for k in range(n[i] // capacity)]
    return sorted([sorted(b) for b in bins.values()] + full)


def found_bins(df):
    bins = {}
    for r in df.collect():
        bins.setdefault(r["bin_id"], []).append((r["doc_id"], r["piece"], r["n_tokens"], r["bin_start"]))
    return sorted(sorted(b) for b in bins.values())


def passing(spark, docs):
    """By the operator's own scores, which test_models.py checks against a
    plain fit: the stage fits on statistics made in another way."""
    return {r["doc_id"] for r in Q.quality(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect() if r["predicted"]}


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in P.STAGES] == ["quality", "exact", "near", "substring", "pack"]
    good, before = passing(spark, docs), rows(docs)
    want = {i: r for i, r in before.items() if i in good}
    for (name, stage), plain in zip(P.STAGES, (None, plain_exact, plain_near, plain_substring, plain_pack)):
        if plain is not None:
            want = plain(before)
        if name == "pack":
            assert found_bins(stage(spark, docs, SF)) == want
        else:
            docs = write_table(stage(spark, docs, SF), name)
            before = rows(docs)
            assert docs.columns == COLUMNS and before == want, name


def stage_folders(spark):
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{common.shared_dir(spark)}/blockcodec")
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    return {s.getPath().getName() for s in fs.listStatus(place) if s.getPath().getName().startswith("stage-")} if fs.exists(place) else set()


def test_run(spark):
    """run() as a whole. Nothing of an earlier stage's scratch is left then."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    good = passing(spark, docs)
    kept = {i: r for i, r in rows(docs).items() if i in good}
    want = plain_pack(plain_substring(plain_near(plain_exact(kept))))
    before = stage_folders(spark)
    out = P.run(spark, SF)
    assert found_bins(out) == want and {"doc_id", "piece", "n_tokens", "bin_id", "bin_start", "source"} <= set(out.columns)
    assert stage_folders(spark) - before == {common._LAST[spark.sparkContext.applicationId].rsplit("/", 1)[1]}


def test_edges(spark):
    long_ = " ".join(f"word{k % 9973}" for k in range(120_000))
    docs = spark.createDataFrame([(None, None, None, None, None), (None, "", "en", "a", 0), (1, "", "en", "a", 0), (1, "x", None, "b", 1), (1, "x", None, "b", 1), (2, long_, "en", None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    assert len(long_) > 1 << 20
    want = {"exact": 3, "near": 3, "substring": 6}
    for name, stage in P.STAGES[1:]:
        got = stage(spark, docs, SF).collect()
        assert got, name
        assert len(got) == want.get(name, len(got)), (name, got)
        assert stage(spark, docs.limit(0), SF).collect() == [], name
    assert P.STAGES[0][1](spark, docs.limit(0), SF).collect() == []
    assert len(P.STAGES[0][1](spark, docs, SF).collect()) <= 6


def test_other_columns_stay_with_their_rows(spark):
    docs = spark.createDataFrame([(1, "a b c", "en", "s", 5, "u", 1), (2, "A b c", "en", "s", 5, "v", 2), (3, "other words", "en", "s", 11, "w", 3)], "doc_id long, text string, lang string, source string, n_chars long, row string, h int")
    for name, kept in (("exact", [2, 3]), ("near", [1, 3]), ("substring", [1, 2, 3])):
        got = dict(P.STAGES)[name](spark, docs, SF)
        assert got.columns == docs.columns
        assert sorted((r["doc_id"], r["row"], r["h"]) for r in got.collect()) == [(i, "uvw"[i - 1], i) for i in kept], name


def test_query_names():
    import __spark_entry__ as e

    names = list(e.queries())
    assert "pipeline" in names and all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11))
