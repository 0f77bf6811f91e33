"""Best-fit packing with conflicts.

Texts become pieces of at most `capacity` tokens. In a shard, pieces go in
order of decreasing length into bins kept in order of residual room. A bin
carries a bitmap of its sources and one of its duplicate clusters; from the
tightest bin with room the search goes on to its successors until one has
neither the source nor the cluster of the piece. No bin ever holds two pieces
of one source, or of one cluster.

Shards are dealt by a hash of the row, so a source or a cluster that holds a
third of all rows holds a third of each shard, and no shard grows with the data.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import to_bytes, with_row_id, write_table
from .tokens import WordEncoder, batched

CAPACITY = 2048
SHARD_ROWS = 4096


def best_fit(items, capacity: int):
    """items: (length, source bit or None, cluster bit or None), lengths from 1
    to capacity, longest first -> (bin, offset) for each, and the bin count."""
    rooms: list[tuple[int, int]] = []  # (residual, bin), ascending
    sources: list[int] = []
    clusters: list[int] = []
    having: dict[int | None, int] = {}
    placed = []
    for length, source, cluster in items:
        s = 0 if source is None else 1 << source
        c = 0 if cluster is None else 1 << cluster
        found = -1
        if not s or having.get(source, 0) < len(rooms):
            for at in range(bisect_left(rooms, (length, -1)), len(rooms)):
                b = rooms[at][1]
                if not (sources[b] & s or clusters[b] & c):
                    found = at
                    break
        if found >= 0:
            room, b = rooms.pop(found)
        else:
            room, b = capacity, len(sources)
            sources.append(0)
            clusters.append(0)
        placed.append((b, capacity - room))
        sources[b] |= s
        clusters[b] |= c
        if s:
            having[source] = having.get(source, 0) + 1
        insort(rooms, (room - length, b))
    return placed, len(sources)


def _bits(values, at_least: int = 1):
    """A bit for each value that occurs at_least times; None for the rest and
    for null."""
    count: dict = {}
    for v in values:
        count[v] = count.get(v, 0) + 1
    bits: dict = {}
    return [None if v is None or count[v] < at_least else bits.setdefault(v, len(bits)) for v in values]


OUT = "doc_id long, piece int, n_tokens int, bin_id long, bin_start int, source string, cluster long"


def _pack(capacity: int):
    def run(key, group):
        shard = key[0].as_py()
        rows = sorted(zip(*(group[c].to_pylist() for c in ("n_tokens", "doc_id", "_rid", "source", "cluster"))), key=lambda r: (-(r[0] % capacity), r[1] is None, r[1], r[2]))
        tails = [r for r in rows if r[0] % capacity]
        items = zip([r[0] % capacity for r in tails], _bits([r[3] for r in tails]), _bits([r[4] for r in tails], 2))
        placed, bins = best_fit(items, capacity)
        out = [(r[1], r[0] // capacity, r[0] % capacity, b, at, r[3], r[4]) for r, (b, at) in zip(tails, placed)]
        for r in rows:  # a full piece is a bin of its own
            for piece in range(r[0] // capacity):
                out.append((r[1], piece, capacity, bins, 0, r[3], r[4]))
                bins += 1
        doc, piece, n, b, at, source, cluster = zip(*out)
        return pa.table({"doc_id": pa.array(doc, pa.int64()), "piece": pa.array(piece, pa.int32()), "n_tokens": pa.array(n, pa.int32()), "bin_id": pa.array((np.array(b, np.int64) + (shard << 32)), pa.int64()), "bin_start": pa.array(at, pa.int32()), "source": pa.array(source, pa.string()), "cluster": pa.array(cluster, pa.int64())})

    return run


def pack(rows: DataFrame, capacity: int = CAPACITY, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """rows: doc_id long, n_tokens, source string, cluster long, and _rid, a
    unique stable long. One row for each piece: doc_id, piece, n_tokens,
    bin_id, bin_start, source, cluster.

    A text of n tokens has ceil(n / capacity) pieces; all but the last fill a
    bin each. A text without tokens has none. A null source or cluster
    conflicts with nothing. Ties in length go by doc_id, nulls last.
    """
    shards = max(1, -(-rows.count() // shard_rows))
    dealt = rows.where("n_tokens > 0").withColumn("shard", F.pmod(F.xxhash64("_rid"), F.lit(shards)))
    return dealt.groupBy("shard").applyInArrow(_pack(capacity), OUT)


def _lengths(path: str):
    def run(batches):
        encoder = WordEncoder(path)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            n, cluster = [], []
            for a, b in batched(texts):
                n += [len(ids) + 1 for ids in encoder.encode(texts[a:b])]
                cluster += [xxhash.xxh64_intdigest(to_bytes(t).lower()) - (1 << 63) for t in texts[a:b]]
            yield pa.RecordBatch.from_arrays([batch.column("_rid"), batch.column("doc_id"), batch.column("source"), pa.array(n, pa.int64()), pa.array(cluster, pa.int64())], ["_rid", "doc_id", "source", "n_tokens", "cluster"])

    return run


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Pack whole texts by their tokens, with one end token each (so a null or
    empty text has one token). The cluster is the hash of the text with A-Z
    lower-cased, so copies never share a bin. Columns as from pack()."""
    rows = with_row_id(docs, doc_id=F.col("doc_id").cast("long"), source=F.col("source").cast("string"), text=F.col("text"))
    lengths = rows.mapInArrow(_lengths(tokenizer), "_rid long, doc_id long, source string, n_tokens long, cluster long")
    return pack(write_table(lengths, "lengths"), capacity, shard_rows)
