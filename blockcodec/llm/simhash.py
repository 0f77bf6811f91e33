"""SimHash near-dedup by vantage-point trees.

Documents become 64-bit fingerprints; equal fingerprints collapse to one row
before any search. Of two that differ in at most 3 bits, the halves of 32 bits
differ in at most 1 on one side or the other; so the search is made once for
each half, with a radius of 1, in which vantage points prune far more than with
a radius of 3 over all bits.

For a half, fingerprints are partitioned by its Hamming distance to vantage
points (a top tree made from a sample), and each also visits the shards whose
boundary is within the radius, so that every close pair meets in at least one
shard. A shard builds its own tree and prunes branches by the triangle
inequality; where a half tells nothing apart, by all bits. What is left is
compared in full. A shard reports a spanning forest of the pairs it finds,
never all pairs of a group.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from .common import MAX_BUCKETS, shuffle_partitions, to_bytes, with_row_id, write_buckets, write_table
from .components import components
from .shingles import bands, minhash, shingles, similar_links
from .substring_dedup import Hashes

SHINGLE = 3
RADIUS = 3
LEAF = 64
#: Fingerprints of a shard, and how many sampled ones stand for a shard in the
#: making of the top tree: one in 2,500 goes to the driver. Only the balance of
#: shards depends on the sample, no link does.
SHARD, SAMPLE = 40_000, 16
#: Bytes of text in a bucket of the rows that one_of_each() writes.
BUCKET_BYTES = 64 << 20
ALL = (1 << 64) - 1
HALVES = ((1 << 32) - 1, ALL ^ ((1 << 32) - 1))


#: A byte spread over eight byte lanes of a word, lowest bit first.
LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def majority(hashes: np.ndarray) -> int:
    """Bit b is set if over half of the hashes have it set. Byte lanes are
    added up 255 hashes at a time, which none of them can overflow."""
    n, counts = len(hashes), np.zeros(64, np.int64)
    for at in range(0, n, 255 * 256):
        lanes = LANES[hashes[at : at + 255 * 256].view(np.uint8).reshape(-1, 8)]
        sums = np.add.reduceat(lanes, np.arange(0, len(lanes), 255), axis=0)
        counts += sums.view(np.uint8).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def fingerprint(text, width: int = SHINGLE) -> int:
    """The majority of the shingles' XXH64 (seed 42), repeats included."""
    words = to_bytes(text).lower().split()  # A-Z only; exactly 09-0D and 20
    if not words:
        return 0
    shingles = [b" ".join(s) for s in zip(*(words[i:] for i in range(width)))] or [b" ".join(words)]
    return majority(np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(42)), np.uint64, len(shingles)))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _fingerprints(batches):
    for batch in batches:
        fps = [_signed(fingerprint(t)) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("_rid"), batch.column("doc_id"), pa.array(fps, pa.int64())], ["_rid", "doc_id", "fp"])


def _distance(x: np.ndarray, v, mask=ALL) -> np.ndarray:
    """Differing bits among those of the mask."""
    return np.bitwise_count((x ^ np.uint64(v)) & np.uint64(mask)).astype(np.int16)


def top_tree(sample: np.ndarray, leaves: int, radius: int, mask: int = ALL, seed: int = 7, wide: int = RADIUS):
    """A nested tuple (vantage, mask, radius, mu, inside, outside), or a leaf
    number. The vantage point is the candidate whose distances spread most;
    where the mask's bits are all alike, all bits count, with the wide radius."""
    rng, count = np.random.default_rng(seed), [0]

    def grow(x, k):
        if k > 1 and len(x) >= SAMPLE:
            picks = rng.choice(x, min(16, len(x)), replace=False)
            for m, r in ((mask, radius), (ALL, wide)):
                v = max(picks, key=lambda p: float(_distance(x, p, m).std()))
                d = _distance(x, v, m)
                mu = int(np.median(d))
                for cut in (mu, mu - 1):
                    inside = d <= cut
                    if 0 < inside.sum() < len(x):
                        share = min(k - 1, max(1, round(k * float(inside.mean()))))
                        return (int(v), m, r, cut, grow(x[inside], share), grow(x[~inside], k - share))
        count[0] += 1
        return count[0] - 1

    return grow(sample, leaves)


def route(tree, fps: np.ndarray):
    """(index, leaf, is home): all shards that a ball around each fingerprint
    can reach; exactly one is its home."""
    out = []

    def go(node, idx, home):
        if not len(idx):
            return
        if not isinstance(node, tuple):
            out.append((idx, np.full(len(idx), node), home))
            return
        v, mask, radius, mu, inside, outside = node
        d = _distance(fps[idx], v, mask)
        near, far = d - radius <= mu, d + radius > mu
        go(inside, idx[near], home[near] & (d[near] <= mu))
        go(outside, idx[far], home[far] & (d[far] > mu))

    go(tree, np.arange(len(fps)), np.ones(len(fps), bool))
    if not out:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(c) for c in zip(*out))


def close_links(home: np.ndarray, queries: np.ndarray, radius: int, mask: int = ALL, part: int | None = None):
    """Links (query, home) that connect whatever lies within the radius over
    all bits and within part (default: the radius) over those of the mask.

    A vantage-point tree over home, walked by all queries at once: a branch is
    left out for the queries that the triangle inequality excludes. In a leaf
    the neighbours of a query are a bit pattern; a query is linked to the first
    of its pattern, and each distinct pattern is chained once.
    """
    rng, a, b = np.random.default_rng(11), [], []
    views = [(mask, radius if part is None else part)] + ([(ALL, radius)] if mask != ALL else [])

    def leaf(idx, q):
        members = home[idx]
        for at in range(0, len(members), LEAF):
            m = members[at : at + LEAF]
            for some in range(0, len(q), 1 << 16):
                mine = queries[q[some : some + (1 << 16)]]
                hit = np.bitwise_count(mine[:, None] ^ m[None, :]) <= radius
                hit &= mine[:, None] != m[None, :]
                rows = hit.any(axis=1)
                if rows.any():
                    hit, who = hit[rows], mine[rows]
                    a.append(who)
                    b.append(m[hit.argmax(axis=1)])
                    packed = np.unique(np.packbits(hit, axis=1), axis=0)
                    for bits in np.unpackbits(packed, axis=1)[:, : len(m)]:
                        own = m[bits.astype(bool)]
                        a.append(own[1:])
                        b.append(own[:-1])

    def split(x):
        """(vantage, mask, radius, mu, inside) of a split that divides x."""
        v = x[rng.integers(len(x))]
        for m, r in views:
            d = _distance(x, v, m)
            mu = int(np.median(d))
            for cut in (mu, mu - 1):
                inside = d <= cut
                if inside.any() and not inside.all():
                    return v, m, r, cut, inside
        return None

    def walk(idx, q):
        while len(idx) > LEAF and len(q) and (found := split(home[idx])):
            v, m, r, mu, inside = found
            dq = _distance(queries[q], v, m)
            walk(idx[inside], q[dq - r <= mu])
            idx, q = idx[~inside], q[dq + r > mu]
        if len(q):
            leaf(idx, q)

    if len(home) and len(queries):
        walk(np.arange(len(home)), np.arange(len(queries)))
    return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, np.uint64),) * 2


def forest(a, b):
    """(node, root) for all nodes but the roots, by union-find."""
    root: dict[int, int] = {}

    def find(x):
        r = x
        while (p := root.setdefault(r, r)) != r:
            r = p
        while root[x] != r:
            root[x], x = r, root[x]
        return r

    for x, y in zip(a, b):
        if (p := find(x)) != (q := find(y)):
            root[max(p, q)] = min(p, q)
    return [(x, r) for x in root if (r := find(x)) != x]


def halves(radius: int):
    """(mask, radius) of the searches: fingerprints within the radius are within
    half of it, rounded down, in one half of the bits at least."""
    return [(m, radius // 2) for m in HALVES]


def _routes(trees):
    def run(batches):
        for batch in batches:
            fps = batch.column("fp").to_numpy().view(np.uint64)
            for k, tree in enumerate(trees):
                idx, leaf, home = route(tree, fps)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(idx), k, np.int32)), pa.array(leaf.astype(np.int32)), pa.array(fps[idx].view(np.int64)), pa.array(home.astype(bool))], ["half", "leaf", "fp", "home"])

    return run


def _shard_links(radius):
    def run(key, group):
        fps, home = group["fp"].to_numpy().view(np.uint64), group["home"].to_numpy()
        mask, part = halves(radius)[key[0].as_py()]
        a, b = close_links(fps[home], fps, radius, mask, part)
        found = forest(a.view(np.int64).tolist(), b.view(np.int64).tolist())
        cols = list(zip(*found)) or [(), ()]
        return pa.table({"a": pa.array(cols[0], pa.int64()), "b": pa.array(cols[1], pa.int64())})

    return run


def simhash_links(fps: DataFrame, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """Links (a, b) among distinct fingerprints fp that connect exactly those
    within the radius of each other, directly or through others. fps must be
    written; nulls may not be among them."""
    n = fps.count()
    leaves = max(1, -(-n // shard))
    # The sample grows with the number of shards, one value in shard / SAMPLE
    # (twice as many are asked for, so that every leaf has enough).
    share = min(1.0, 2 * SAMPLE / shard)
    some = fps.where(F.pmod(F.xxhash64("fp"), F.lit(1 << 20)) < int(share * (1 << 20))) if leaves > 1 else fps.limit(0)
    sample = np.sort(some.toPandas()["fp"].to_numpy(np.int64)).view(np.uint64)
    trees = [top_tree(sample, leaves, r, m, wide=radius) for m, r in halves(radius)]
    routed = fps.mapInArrow(_routes(trees), "half int, leaf int, fp long, home boolean")
    return routed.groupBy("half", "leaf").applyInArrow(_shard_links(radius), "a long, b long")


def _marked(id_at: int, text_at: int, banded: bool):
    """(_rid, row) -> (_rid, doc_id, fp, size, bands, row)."""

    def run(batches):
        cache = Hashes()
        for batch in batches:
            row = batch.column("row")
            texts = row.field(text_at).to_pylist()
            fps = [_signed(fingerprint(t)) for t in texts]
            found = [shingles(t, cache) for t in texts] if banded else [()] * len(texts)
            keys = [bands(minhash(x)).view(np.int64) if len(x) else None for x in found]
            cols = [batch.column("_rid"), row.field(id_at).cast(pa.int64()), pa.array(fps, pa.int64()), pa.array([len(x) for x in found], pa.int32()), pa.array(keys, pa.list_(pa.int64())), row]
            yield pa.RecordBatch.from_arrays(cols, ["_rid", "doc_id", "fp", "size", "bands", "row"])

    return run


def _classes(marks: DataFrame, radius: int, shard: int, texts: DataFrame | None = None, similarity: float | None = None) -> DataFrame:
    """marks (_rid, doc_id, fp), written -> (fp, component_id, stays): stays is
    the _rid of the row of the component that stays. With a similarity, marks
    have bands too, and texts is (_rid, text)."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_rid"))
    fps = write_table(marks.groupBy("fp").agg(first.alias("first")), "distinct")
    links = simhash_links(fps.select("fp"), radius, shard)
    if similarity is not None:
        links = similar_links(marks, texts, write_table(links, "links"), radius, similarity)
    roots = components(links)
    rooted = fps.join(roots, fps.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("first"))
    return rooted.select("fp", "root").join(least, "root").select("fp", F.col("first.doc_id").alias("component_id"), F.col("first._rid").alias("stays"))


def simhash_dedup(docs: DataFrame, radius: int = RADIUS, shard: int = SHARD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, fingerprint, component_id.

    Words are the runs between bytes 09-0D and 20 after lower-casing A-Z; null
    and empty texts have fingerprint zero and are linked like any other.
    component_id is the smallest doc_id reachable over links of at most radius
    differing bits; null doc_ids are passed over, and null is what a component
    of nothing else gets. Repeated rows come out as often as they came in.
    """
    rows = with_row_id(docs, doc_id=F.col(id_col).cast("long"), text=F.col(text_col))
    marks = write_table(rows.select("doc_id", "text", "_rid").mapInArrow(_fingerprints, "_rid long, doc_id long, fp long"), "fingerprints")
    classes = _classes(marks, radius, shard)
    return marks.join(classes, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, radius: int = RADIUS, shard: int = SHARD, id_col: str = "doc_id", text_col: str = "text", similarity: float | None = None) -> DataFrame:
    """The rows of docs, with all their columns, without those of a component
    that are not its first: the smallest doc_id stays, nulls being last, and of
    repeated rows one. Null and empty texts are one component. With a
    similarity, texts whose five-word shingles have at least that Jaccard
    similarity are linked too, however far apart their fingerprints are.

    One pass over the texts writes rows, fingerprints and bands together,
    bucketed by _rid. That is the one exchange of all texts: what later looks
    texts up or drops rows moves the other side to them."""
    total = docs.agg(F.sum(F.octet_length(text_col).cast("long"))).first()[0] or 0
    buckets = int(min(MAX_BUCKETS, max(shuffle_partitions(docs.sparkSession), -(-total // BUCKET_BYTES))))
    at = (docs.columns.index(id_col), docs.columns.index(text_col))
    fields = [StructField(n, t) for n, t in (("_rid", LongType()), ("doc_id", LongType()), ("fp", LongType()), ("size", IntegerType()), ("bands", ArrayType(LongType())))]
    rows = docs.select(F.monotonically_increasing_id().alias("_rid"), F.struct("*").alias("row"))
    made = rows.mapInArrow(_marked(*at, similarity is not None), StructType([*fields, StructField("row", docs.schema, False)]))
    marked = write_buckets(made.repartition(buckets, "_rid"), "marked", "_rid", buckets)
    classes = _classes(marked.drop("row"), radius, shard, marked.select("_rid", F.col("row")[text_col].alias("text")), similarity)
    # Both sides may be of any size: a merge join, whatever is measured of them.
    gone = marked.select("_rid", "fp").join(classes, "fp").where("_rid <> stays").select("_rid")
    return marked.select("_rid", "row").join(gone.hint("merge"), "_rid", "left_anti").select("row.*")
