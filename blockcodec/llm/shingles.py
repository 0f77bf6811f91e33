"""Near copies by the Jaccard similarity of word shingles.

Candidates are documents that agree on a band of MinHash values; a candidate
counts only if the exact similarity of the two shingle sets is high enough. A
bucket of a band is not taken apart into all its pairs: its members are first
compared with one of them. Of those that are then still in different
components, the members of a small bucket are compared with each other. Those
of larger buckets, which a passage common to many texts makes, get finer bands,
which unrelated texts hardly ever share, and a sketch of one bit for each
MinHash value, which rules out most of what is not similar enough before any
text is moved. Blocks of such documents send their finer bands as packed keys,
one for all documents of a component, and hear which keys several components
have: only the members of those become rows.

A pair at similarity s shares a band with probability 1 - (1 - s**rows)**bands:
0.999997 at 0.8 for the first bands, 0.999998 for the finer ones, and more above
it. At 0.33, as of texts whose half is common, it is 0.25 and 0.0003. Sketches
of a pair at 0.8 differ in more than far() bits with probability 3e-7; at 0.7 in
fewer with probability 0.006.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, shuffle_partitions, to_bytes, write_buckets, write_table
from .components import components
from .substring_dedup import PIECE, Hashes, answer, ask, lookup, rolled

WIDTH = 5
SIMILARITY = 0.8
BANDS, ROWS = 24, 4
FINE_BANDS, FINE_ROWS = 192, 12
#: Members of a bucket that are compared with each other without finer bands.
SMALL = 32
#: Documents of a block (its finer bands are some 3 MB), and keys of a bucket.
BLOCK_DOCS, BUCKET_KEYS = 2048, 1 << 20
#: Hashes taken at a time, and words whose hashes are kept.
STEP, KNOWN_WORDS = 1 << 20, 1 << 17

# The factor and the addend of each MinHash function.
_COARSE = np.random.default_rng(5).integers(0, 1 << 64, (2, BANDS * ROWS), np.uint64) | np.uint64(1)
_FINE = np.random.default_rng(6).integers(0, 1 << 64, (2, FINE_BANDS * FINE_ROWS), np.uint64) | np.uint64(1)


def shingles(text, cache: Hashes, width: int = WIDTH) -> np.ndarray:
    """The distinct shingles of a text as sorted hashes; a text of fewer words
    is one shingle, one without words has none. A-Z are lower-cased."""
    words = to_bytes(text).lower().split()
    if len(cache) > KNOWN_WORDS:
        cache.clear()
    h = np.fromiter((cache[w] for w in words), np.uint64, len(words))
    return np.unique(rolled(h, min(width, len(h)))) if len(h) else h


def minhash(found: np.ndarray, functions: np.ndarray = _COARSE) -> np.ndarray:
    """The least value of each function over the shingles."""
    factors, addends = functions
    least = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    step = max(1, STEP // len(factors))
    with np.errstate(over="ignore"):
        for at in range(0, len(found), step):
            least = np.minimum(least, (found[at : at + step, None] * factors + addends).min(axis=0))
    return least


def bands(least: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """A hash of each band of MinHash values."""
    out = np.zeros(len(least) // rows, np.uint64)
    with np.errstate(over="ignore"):
        for row in least.reshape(-1, rows).T:
            out = mix64(out * np.uint64(3) + row)
    return out


def far(similarity: float) -> int:
    """How many bits the sketches of a pair of that similarity differ in, and
    five standard deviations more."""
    n, p = FINE_BANDS * FINE_ROWS, (1 - similarity) / 2
    return int(n * p + 5 * (n * p * (1 - p)) ** 0.5)


def similar(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both > 0 and both >= similarity * (len(a) + len(b) - both) - 1e-9


def _finer(batches):
    cache = Hashes()
    for batch in batches:
        keys, sketches = [], []
        for t in batch.column("text").to_pylist():
            least = minhash(shingles(t, cache), _FINE)
            keys.append(bands(least, FINE_ROWS).view(np.int64))
            sketches.append(np.packbits((mix64(least) & np.uint64(1)).astype(np.uint8)).view(np.int64))
        longs = pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("_rid"), pa.array(keys, longs), pa.array(sketches, longs)], ["_rid", "bands", "sketch"])


def _flat(group):
    """The finer bands of a block's documents in one array, and the root of each."""
    keys = group["bands"].combine_chunks().flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    return keys, np.repeat(group["root"].to_numpy(), FINE_BANDS)


def _asked(buckets):
    def run(key, group):
        keys, roots = _flat(group)
        return ask(key[0].as_py(), buckets, keys, roots, np.zeros(len(keys), bool), np.zeros(len(keys), np.uint64), False)

    return run


def _shared(_, group, told):
    """A row for each document and key of its that several roots have."""
    keys, _ = _flat(group)
    known = lookup(told["payload"].to_pylist(), keys)[0] if told.num_rows else np.zeros(len(keys), bool)
    at = np.nonzero(known)[0]
    rows = group.select(["_rid", "fp", "size", "root", "sketch"]).take(pa.array(at // FINE_BANDS))
    return rows.append_column("key", pa.array(keys[at].view(np.int64)))


def _verified(similarity):
    def run(batches):
        cache, last, held = Hashes(), None, None
        for batch in batches:
            keep = []
            for a, x, y in zip(*(batch.column(c).to_pylist() for c in ("a", "text_a", "text_b"))):
                if a != last:
                    last, held = a, shingles(x, cache)
                keep.append(similar(held, shingles(y, cache), similarity))
            yield batch.select(["fp_a", "fp_b"]).filter(pa.array(keep, pa.bool_()))

    return run


def similar_links(marks: DataFrame, texts: DataFrame, links: DataFrame, radius: int, similarity: float = SIMILARITY) -> DataFrame:
    """links (a, b) among fingerprints, those within the radius, and those that
    connect the fingerprints of texts whose shingles have at least the
    similarity. marks, written: _rid, fp, size (shingles) and bands, null for a
    text without words; texts: _rid, text, written in buckets by _rid."""

    def verify(pairs):
        """The links of pairs (a, b: members) that are similar. Sizes alone
        rule out what could not be; what is within the radius is linked."""
        could = F.least("a.size", "b.size") >= similarity * F.greatest("a.size", "b.size") - 1e-6
        new = F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) > radius
        ids = pairs.where(could & new).select(F.col("a._rid").alias("a"), F.col("b._rid").alias("b"), F.col("a.fp").alias("fp_a"), F.col("b.fp").alias("fp_b")).distinct()
        ids = write_table(ids, "pairs")
        # Only the texts of candidates are moved; a text that very many others
        # are compared with is a hot key of the last join alone, where skewed
        # partitions are split.
        text_a = write_table(ids.select("a").distinct().join(texts.toDF("a", "text_a"), "a"), "texts")
        text_b = ids.join(texts.toDF("b", "text_b"), "b")
        both = text_b.join(text_a, "a").select("a", "text_a", "text_b", "fp_a", "fp_b")
        return write_table(both.mapInArrow(_verified(similarity), "fp_a long, fp_b long").toDF("a", "b").distinct(), "similar")

    member, bucket = F.struct("_rid", "size", "fp"), ["band", "key"]
    banded = marks.where("bands is not null").select("_rid", "fp", "size", F.posexplode("bands").alias("band", "key"))
    first = banded.groupBy(*bucket).agg(F.min(member).alias("a"), F.min("fp").alias("low"), F.max("fp").alias("high")).where("low < high")
    links = links.unionAll(verify(banded.select(*bucket, member.alias("b")).join(first, bucket)))

    # The members of buckets that are in several components, with their root.
    roots = components(links).withColumnRenamed("node", "fp")
    rooted = banded.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    mixed = rooted.groupBy(*bucket).agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n")).where("low < high")
    left = write_table(rooted.join(mixed.select(*bucket, "n"), bucket), "members")

    def each(rows, on, *more):
        member = F.struct("_rid", "size", "fp", "root", *more)
        pairs = rows.select(*on, member.alias("a")).join(rows.select(*on, member.alias("b")), on)
        return pairs.where("a.root < b.root")

    links = links.unionAll(verify(each(left.where(F.col("n") <= SMALL), bucket)))
    large = left.where(F.col("n") > SMALL).select("_rid", "fp", "size", "root").distinct()
    fine = large.select("_rid").join(texts, "_rid").mapInArrow(_finer, "_rid long, bands array<long>, sketch array<long>")
    finer = write_table(large.join(fine, "_rid"), "finer")
    n = finer.count()
    dealt = finer.withColumn("block", F.pmod(F.xxhash64("_rid"), F.lit(-(-n // BLOCK_DOCS) or 1)))
    dealt = write_buckets(dealt, "dealt", "block", -(-n // BLOCK_DOCS))
    buckets = max(shuffle_partitions(marks.sparkSession), -(-n * FINE_BANDS // BUCKET_KEYS))
    asked = dealt.select("block", "root", "bands").groupBy("block").applyInArrow(_asked(buckets), PIECE)
    told = write_table(asked.groupBy("bucket").applyInArrow(answer(False), "block long, payload binary"), "told")
    shared = "_rid long, fp long, size int, root long, sketch array<long>, key long"
    again = write_table(dealt.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(_shared, shared), "shared")
    differ = F.expr("aggregate(zip_with(a.sketch, b.sketch, (x, y) -> bit_count(x ^ y)), 0, (s, n) -> s + n)")
    close = differ <= far(similarity)
    # As above: one member of a key with all others, then those still apart.
    whole = F.struct("_rid", "size", "fp", "root", "sketch")
    one = again.groupBy("key").agg(F.min(whole).alias("a"))
    links = links.unionAll(verify(again.select("key", whole.alias("b")).join(one, "key").where("a.root <> b.root").where(close)))
    roots = components(links).withColumnRenamed("node", "fp")
    apart = again.drop("root").join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    return links.unionAll(verify(each(apart, ["key"], "sketch").where(close)))
