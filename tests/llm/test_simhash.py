import random

import numpy as np
import xxhash

from blockcodec.llm import simhash as S
from blockcodec.llm.components import components


def plain_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    root = {f: f for f in fps}
    for _ in fps:
        for a in fps:
            for b in fps:
                if (a ^ b).bit_count() <= 3:
                    root[a] = root[b] = min(root[a], root[b])
    return root


def test_fingerprint():
    rng = random.Random(1)
    for text in [None, "", " \n", "one", "One two", "a b c", "A b c d", "x " * 700] + [" ".join(rng.choice("abcDEé") for _ in range(rng.randint(1, 40))) for _ in range(60)]:
        assert S.fingerprint(text) == plain_fingerprint(text)


def clustered(rng, n):
    seeds = [rng.getrandbits(64) for _ in range(6)]
    out = set()
    while len(out) < n:
        x = rng.choice(seeds) if rng.random() < 0.6 else rng.getrandbits(64)
        for _ in range(rng.randint(0, 4)):
            x ^= 1 << rng.randrange(64)
        out.add(x)
        seeds.append(x) if rng.random() < 0.1 else None
    return np.array(sorted(out), np.uint64)


def test_tree_finds_what_brute_force_finds():
    rng = random.Random(2)
    for n in (0, 1, 2, 70, 400, 1500):
        fps = clustered(rng, n)
        pairs = [(int(a), int(b)) for k, a in enumerate(fps) for b in fps[k + 1 :][np.bitwise_count(fps[k + 1 :] ^ a) <= 3]]
        want = dict(S.forest([a for a, _ in pairs], [b for _, b in pairs]))
        a, b = S.close_links(fps, fps, 3)
        assert (np.bitwise_count(a ^ b) <= 6).all()
        assert dict(S.forest(a.tolist(), b.tolist())) == want
        tree = S.top_tree(fps[::3], 5, 3)
        idx, leaf, home = S.route(tree, fps)
        assert sorted(idx[home].tolist()) == list(range(n))
        found = [S.close_links(fps[idx[(leaf == k) & home]], fps[idx[leaf == k]], 3) for k in np.unique(leaf)]
        a, b = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.uint64) for i in (0, 1))
        assert dict(S.forest(a.tolist(), b.tolist())) == want
        found = []
        for mask, part in S.halves(3):
            idx, leaf, home = S.route(S.top_tree(fps[::3], 9, part, mask), fps)
            assert sorted(idx[home].tolist()) == list(range(n))
            found += [S.close_links(fps[idx[(leaf == k) & home]], fps[idx[leaf == k]], 3, mask, part) for k in np.unique(leaf)]
        a, b = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.uint64) for i in (0, 1))
        assert dict(S.forest(a.tolist(), b.tolist())) == want


def test_components_of_a_long_chain(spark):
    links = [(i, i + 1) for i in range(200)] + [(1000, 1001), (1001, 1000), (5, 5)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 201)}, 1001: 1000}


def texts(rng, n):
    base = [" ".join(rng.choice(["aa", "bb", "cc", "dd", "ee", "ff"]) for _ in range(200)) for _ in range(12)]
    out = [None, "", " ", "A b", "a B"]
    while len(out) < n:
        t = rng.choice(base).split()
        t[rng.randrange(len(t))] = "zz"
        out.append(" ".join(t))
    return out


def test_operator_against_brute_force(spark):
    rng = random.Random(3)
    rows = list(enumerate(texts(rng, 150)))
    rng.shuffle(rows)
    rows += [rows[3], rows[4]]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, fp int").repartition(3)
    marks = {i: plain_fingerprint(t) for i, t in rows}
    roots = brute_components(sorted(set(marks.values())))
    least = {}
    for i, f in marks.items():
        least[roots[f]] = min(i, least.get(roots[f], i))
    for shard in (10_000, 20):
        got = sorted((r["doc_id"], r["fingerprint"], r["component_id"]) for r in S.simhash_dedup(df, shard=shard).collect())
        assert got == sorted((i, f"{marks[i]:016x}", least[roots[marks[i]]]) for i, _ in rows)
    kept = sorted(r["doc_id"] for r in S.one_of_each(df).collect())
    assert kept == sorted(set(least.values()))


def test_nulls_and_empty(spark):
    df = spark.createDataFrame([(None, ""), (None, None), (4, ""), (None, "lone text here")], "doc_id long, text string")
    got = S.simhash_dedup(df).collect()
    assert sorted(str(r["component_id"]) for r in got) == ["4", "4", "4", "None"]
    assert sorted(str(r["doc_id"]) for r in S.one_of_each(df).collect()) == ["4", "None"]
    assert S.simhash_dedup(df.limit(0)).collect() == [] and S.one_of_each(df.limit(0)).collect() == []


def test_as_many_shards_as_asked():
    """The sample grows with the shards, so no shard grows with the data."""
    rng = np.random.default_rng(1)
    for leaves in (10, 300, 3000):
        sample = rng.integers(0, 1 << 64, 2 * S.SAMPLE * leaves, np.uint64)
        fps = rng.integers(0, 1 << 64, 100 * leaves, np.uint64)
        for mask, part in S.halves(3):
            _, leaf, home = S.route(S.top_tree(sample, leaves, part, mask), fps)
            sizes = np.bincount(leaf[home], minlength=leaves)
            assert len(sizes) == leaves and sizes.min() > 0 and sizes.max() < 400


def test_equal_halves_are_split_by_all_bits():
    """Many fingerprints with one lower half: the mask tells nothing apart."""
    rng = np.random.default_rng(2)
    high = rng.integers(0, 1 << 32, 4000, np.uint64) << np.uint64(32)
    fps = np.unique(np.concatenate([high, high[:500] ^ np.uint64(1 << 40)]) | np.uint64(7))
    mask, part = S.halves(3)[0]
    tree = S.top_tree(fps, 20, part, mask)
    idx, leaf, home = S.route(tree, fps)
    assert len(np.unique(leaf)) >= 15
    a, b = S.close_links(fps, fps, 3, mask, part)
    pairs = [(int(x), int(y)) for k, x in enumerate(fps) for y in fps[k + 1 :][np.bitwise_count(fps[k + 1 :] ^ x) <= 3]]
    assert dict(S.forest(a.tolist(), b.tolist())) == dict(S.forest([x for x, _ in pairs], [y for _, y in pairs]))


def test_long_text_and_ties(spark):
    long_ = " ".join(f"w{k % 7919}x{k % 13}" for k in range(150_000))
    rows = [(3, long_), (1, long_), (1, long_), (2, long_ + " one more"), (5, "other text of its own")]
    df = spark.createDataFrame([(i, t, "z") for i, t in rows], "doc_id long, text string, component_id string")
    assert len(long_) > 1 << 20
    assert sorted(r["component_id"] for r in S.simhash_dedup(df).collect()) == [1, 1, 1, 1, 5]
    assert sorted(r["doc_id"] for r in S.one_of_each(df, similarity=0.8).collect()) == [1, 5]
