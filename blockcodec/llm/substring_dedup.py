"""Substring dedup by seed and extend.

Seeds are winnowed anchors: of the 6-word grams in any 13 consecutive words the
one of least hash is selected, so that two texts that share 13 words select
the same anchor there. The windows that one anchor occurrence stands for form
its run. Documents meet on equal anchors, and a match is extended both ways:

1. where all runs of an anchor are equal, the whole run matches at once;
2. where they differ, the run is taken apart into its windows, which are
   matched by their own content, as far as the match extends.

A word is removed if a matched window covers it, which leaves the maximal
repeats of at least 13 words of the earliest document that has them.

Documents are dealt with in blocks of bounded bytes. A block sends each anchor
once, with the least doc_id and the run, however many of its documents hold it:
a passage that a third of all documents share is one entry per block. Neither
pairs of documents nor pairs of occurrences are ever made.

Hashes stand for words, 128 bits of them wherever something is removed. A run
counts as matched only if all runs of its anchor agree, in 64 bits of their own
besides the anchor's 64; a window is known by two 64-bit hashes. Anchors alone
that collide only send their windows to the second step.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import mix64, shuffle_partitions, to_bytes, write_buckets, write_table

WINDOW = 13
GRAM = 6
BLOCK_BYTES = 4 << 20
LAST = np.iinfo(np.int64).max
#: What the documents of a key are, besides their least doc_id: several with a
#: doc_id, some with one, some with none. A null doc_id is after all others.
SEVERAL, SOME, NONE = 1, 2, 4
PIECE = "bucket int, block long, payload binary"
PIECE_SCHEMA = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("payload", pa.binary())])


class Hashes(dict):
    """Word -> XXH64. Emptied when it has grown large; only speed depends on it."""

    def __missing__(self, word):
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def rolled(h: np.ndarray, width: int, factor: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """A 64-bit hash of each width consecutive values; another for each factor."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(width):
            out = out * np.uint64(factor) + h[j : j + n]
    return mix64(out)


class Block:
    """The words of some documents, their windows and the runs of windows."""

    def __init__(self, ids, texts, window=WINDOW, gram=GRAM):
        cache = Hashes()
        self.words = [to_bytes(t).split() for t in texts]
        self.lengths = np.array([len(w) for w in self.words], np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.lengths)[:-1]]).astype(np.int64) if len(ids) else np.zeros(0, np.int64)
        self.none = np.array([i is None for i in ids], bool)
        self.ids = np.array([LAST if i is None else i for i in ids], np.int64)
        self.window = window
        h = np.fromiter((cache[w] for doc in self.words for w in doc), np.uint64, int(self.lengths.sum()))
        doc = np.repeat(np.arange(len(ids)), self.lengths)
        n = max(0, len(h) - window + 1)
        starts = np.nonzero(doc[:n] == doc[window - 1 : window - 1 + n])[0] if n else np.zeros(0, np.int64)
        grams, self.starts = rolled(h, gram), starts
        self.content, self.second = rolled(h, window)[starts], rolled(h, window, 0xD6E8FEB86659FD93)[starts]
        best, at = grams[starts], np.zeros(len(starts), np.int64)
        for j in range(1, window - gram + 1):
            g = grams[starts + j]
            less = g < best
            best, at = np.where(less, g, best), np.where(less, j, at)
        # A run: consecutive windows with the anchor at one place.
        place = starts + at
        new = np.ones(len(starts), bool)
        new[1:] = place[1:] != place[:-1]
        self.run_of = np.cumsum(new) - 1  # by window
        head = np.nonzero(new)[0]
        tail = np.append(head[1:], len(starts))[: len(head)] - 1
        self.anchor = best[head]
        self.window_doc, self.window_none = self.ids[doc[starts]], self.none[doc[starts]]
        self.run_doc, self.run_none = self.window_doc[head], self.window_none[head]
        with np.errstate(over="ignore"):
            shape = (tail - head).astype(np.uint64) * np.uint64(64) + at[head].astype(np.uint64)
            # A run is shorter than two windows, so its first and last have all of it.
            self.run = mix64(self.content[head] * np.uint64(3) + mix64(self.content[tail] + shape))

    def covered(self, matched: np.ndarray) -> np.ndarray:
        """By word: whether a matched window covers it."""
        n = int(self.lengths.sum())
        edge = np.zeros(n + 1, np.int64)
        at = self.starts[matched]
        np.add.at(edge, at, 1)
        np.add.at(edge, at + self.window, -1)
        return np.cumsum(edge[:n]) > 0


def heads(*sorted_keys) -> np.ndarray:
    """Where a new key begins."""
    new = np.ones(len(sorted_keys[0]), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in sorted_keys])
    return np.nonzero(new)[0]


def ordered(keys: np.ndarray, seconds: np.ndarray, exact: bool):
    """An order in which equal keys are neighbours, and where each begins. With
    exact, a key is the pair of both hashes."""
    if exact:
        order = np.lexsort((seconds, keys))
        return order, heads(keys[order], seconds[order])
    order = np.argsort(keys, kind="stable")
    return order, heads(keys[order])


def least_by(keys: np.ndarray, docs: np.ndarray, kinds: np.ndarray, seconds: np.ndarray, exact: bool):
    """For each distinct key: (key, least doc_id, kind of its documents, a
    second hash, whether there are several second hashes)."""
    order, head = ordered(keys, seconds, exact)
    keys, docs, kinds, seconds = keys[order], docs[order], kinds[order], seconds[order]
    if not len(head):
        return keys, docs, kinds, seconds, np.zeros(0, bool)
    # Documents without a doc_id have no part in which is least or whether they are several.
    low, high = np.minimum.reduceat(docs, head), np.maximum.reduceat(np.where(kinds & SOME, docs, np.iinfo(np.int64).min), head)
    kind = np.bitwise_or.reduceat(kinds, head)
    kind |= (((kind & SOME) > 0) & (low != high)).astype(np.uint8) * np.uint8(SEVERAL)
    first, last = np.minimum.reduceat(seconds, head), np.maximum.reduceat(seconds, head)
    return keys[head], low, kind, first, first != last


def is_shared(kind: np.ndarray) -> np.ndarray:
    """Whether a key has documents of which one comes before another."""
    return ((kind & SEVERAL) > 0) | ((kind & (SOME | NONE)) == (SOME | NONE))


def comes_later(docs, none, low, kind) -> np.ndarray:
    """Whether a document with a smaller doc_id has the key."""
    return np.where(none, (kind & SOME) > 0, low < docs)


def pack(*arrays) -> bytes:
    return zstandard.compress(np.int64(len(arrays[0])).tobytes() + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays), 1)


def unpack(blob: bytes, *kinds):
    raw = zstandard.decompress(blob)
    n, at, out = int(np.frombuffer(raw, np.int64, 1)[0]), 8, []
    for k in kinds:
        out.append(np.frombuffer(raw, k, n, at))
        at += n * np.dtype(k).itemsize
    return out


ASK = (np.uint64, np.int64, np.uint8, np.uint64, np.bool_)
TELL = (np.uint64, np.uint64, np.int64, np.uint8, np.bool_)


def ask(block: int, buckets: int, keys, docs, none, seconds, exact: bool):
    """One piece for each bucket of the keys that a block asks about."""
    kinds = np.where(none, np.uint8(NONE), np.uint8(SOME))
    keys, low, kind, second, several = least_by(keys, docs, kinds, seconds, exact)
    bucket = (mix64(keys + np.uint64(1)) % np.uint64(buckets)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    starts = heads(bucket[order]) if len(order) else np.zeros(0, np.int64)
    rows = []
    # As many turns as there are buckets with a key, not as buckets there are.
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(order)]):
        i = order[a:b]
        rows.append((int(bucket[i[0]]), block, pack(keys[i], low[i], kind[i], second[i], several[i])))
    cols = list(zip(*rows)) or [(), (), ()]
    return pa.table([pa.array(c, f.type) for c, f in zip(cols, PIECE_SCHEMA)], schema=PIECE_SCHEMA)


def answer(exact: bool):
    """All pieces of a bucket -> for each block its keys that several documents
    have: the least doc_id, what documents they are, and whether runs differ."""

    def run(group: pa.Table) -> pa.Table:
        parts = [unpack(p.as_py(), *ASK) for p in group["payload"]]
        sizes = [len(p[0]) for p in parts]
        keys, docs, kinds, seconds, several = (np.concatenate([p[i] for p in parts]) for i in range(5))
        order, head = ordered(keys, seconds, exact)
        _, low, kind, _, differ = least_by(keys, docs, kinds, seconds, exact)
        differ = differ | np.logical_or.reduceat(several[order], head)
        owner = np.empty(len(keys), np.int64)
        owner[order] = np.repeat(np.arange(len(head)), np.diff(np.append(head, len(keys))))
        shared, rows, at = is_shared(kind), [], 0
        for block, n in zip(group["block"].to_pylist(), sizes):
            own = owner[at : at + n]
            tell = shared[own]
            if tell.any():
                own = own[tell]
                rows.append((block, pack(keys[at : at + n][tell], seconds[at : at + n][tell], low[own], kind[own], differ[own])))
            at += n
        cols = list(zip(*rows)) or [(), ()]
        return pa.table({"block": pa.array(cols[0], pa.int64()), "payload": pa.array(cols[1], pa.binary())})

    return run


def lookup(payloads, keys: np.ndarray, seconds: np.ndarray | None = None):
    """(known, least doc_id, kind, runs differ) for each key, or pair of hashes."""
    parts = [unpack(p, *TELL) for p in payloads]
    if not parts:
        return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64), np.zeros(len(keys), np.uint8), np.zeros(len(keys), bool)
    told = [np.concatenate([p[i] for p in parts]) for i in range(5)]
    known, asked = told[0], keys
    if seconds is not None:  # equal pairs get one number
        k, s = np.concatenate([told[0], keys]), np.concatenate([told[1], seconds])
        by, first = ordered(k, s, True)
        number = np.empty(len(k), np.int64)
        number[by] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(k))))
        known, asked = number[: len(known)], number[len(known) :]
    order = np.argsort(known)
    at = np.minimum(np.searchsorted(known[order], asked), len(known) - 1)
    hit = known[order][at] == asked
    return (hit, *(told[i][order][at] for i in (2, 3, 4)))


def _blocks(limit):
    """Number the rows by blocks of at most limit bytes of text."""

    def run(batches):
        task, block, held = TaskContext.get().partitionId() << 32, 0, 0
        for batch in batches:
            out = []
            for size in batch.column("_size").to_pylist():
                if held and held + size > limit:
                    block, held = block + 1, 0
                held += size
                out.append(task + block)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64()), *batch.columns[1:]], ["block", *batch.schema.names[1:]])

    return run


def _groups(group: pa.Table, window, gram) -> Block:
    return Block(group["doc_id"].to_pylist(), group["text"].to_pylist(), window, gram)


def _anchors(buckets, window, gram):
    def run(key, group):
        b = _groups(group, window, gram)
        return ask(key[0].as_py(), buckets, b.anchor, b.run_doc, b.run_none, b.run, False)

    return run


def _windows(buckets, window, gram):
    def run(key, group, told):
        b = _groups(group, window, gram)
        known, _, _, differ = lookup(told["payload"].to_pylist(), b.anchor)
        open_ = (known & differ)[b.run_of] if len(b.run_of) else np.zeros(0, bool)
        return ask(key[0].as_py(), buckets, b.content[open_], b.window_doc[open_], b.window_none[open_], b.second[open_], True)

    return run


def _result(window, gram, carry, text_at):
    def run(key, group, told):
        texts = group["row"].combine_chunks().field(text_at) if carry else group["text"]
        b = Block(group["doc_id"].to_pylist(), texts.to_pylist(), window, gram)
        level = told["level"].to_pylist() if told.num_rows else []
        payloads = told["payload"].to_pylist() if told.num_rows else []
        known, low, kind, differ = lookup([p for p, x in zip(payloads, level) if x == 1], b.anchor)
        if len(b.run_of):
            whole = (known & ~differ & comes_later(b.run_doc, b.run_none, low, kind))[b.run_of]
            open_ = (known & differ)[b.run_of]
            known, low, kind, _ = lookup([p for p, x in zip(payloads, level) if x == 2], b.content, b.second)
            matched = whole | (open_ & known & comes_later(b.window_doc, b.window_none, low, kind))
        else:
            matched = np.zeros(0, bool)
        gone = b.covered(matched)
        removed, sha, kept = [], [], []
        for words, at in zip(b.words, b.first.tolist()):
            g = gone[at : at + len(words)]
            n = int(g.sum())
            text = b" ".join([w for w, x in zip(words, g.tolist()) if not x] if n else words)
            removed.append(n)
            sha.append(hashlib.sha256(text).hexdigest())
            kept.append(text.decode("utf-8", "replace") if n else None)
        cols = {"doc_id": group["doc_id"], "n_words": pa.array(b.lengths), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(sha, pa.string())}
        if carry:
            cols |= {"kept_text": pa.array(kept, pa.string()), "row": group["row"]}
        return pa.table(cols)

    return run


def substring_dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, block_bytes: int = BLOCK_BYTES, carry: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, n_words, n_removed, kept_sha256.

    Words are the runs between bytes 09-0D and 20, unchanged; a null text has
    none. A word goes if a window of `window` consecutive words covers it whose
    words also start somewhere in a document with a smaller doc_id. A null
    doc_id is larger than all others; documents of equal doc_id do not count
    against each other, nor does one against itself. With carry, also
    kept_text (the kept words joined by one space; null where none was removed)
    and row, a struct of all columns of docs.
    """
    spark = docs.sparkSession
    # With carry a text is stored once, within its row.
    content = F.struct("*").alias("row") if carry else F.col(text_col).alias("text")
    rows = docs.select(F.coalesce(F.octet_length(F.col(text_col)) + 64, F.lit(64)).cast("long").alias("_size"), F.col(id_col).cast("long").alias("doc_id"), content)
    total = rows.agg(F.sum("_size")).first()[0] or 0
    buckets = int(max(shuffle_partitions(spark), -(-total // (16 << 20))))
    # Blocks as a bucketed table: the passes over it need no exchange of texts.
    schema = StructType([StructField("block", LongType()), *rows.schema.fields[1:]])
    n = max(buckets, -(-2 * total // block_bytes))
    blocks = write_buckets(rows.mapInArrow(_blocks(block_bytes), schema), "blocks", "block", n)
    text = F.col("row")[text_col].alias("text") if carry else F.col("text")
    by_block = blocks.select("block", "doc_id", text).groupBy("block")

    def answered(asked, exact, name):
        return write_table(asked.groupBy("bucket").applyInArrow(answer(exact), "block long, payload binary"), name)

    told = answered(by_block.applyInArrow(_anchors(buckets, window, gram), PIECE), False, "told1")
    more = answered(by_block.cogroup(told.groupBy("block")).applyInArrow(_windows(buckets, window, gram), PIECE), True, "told2")
    both = told.select(F.lit(1).alias("level"), "*").unionAll(more.select(F.lit(2).alias("level"), "*"))
    out = [StructField("doc_id", LongType()), StructField("n_words", LongType()), StructField("n_removed", LongType()), StructField("kept_sha256", StringType())]
    if carry:
        out += [StructField("kept_text", StringType()), StructField("row", blocks.schema["row"].dataType)]
    at = docs.columns.index(text_col)
    return blocks.groupBy("block").cogroup(both.groupBy("block")).applyInArrow(_result(window, gram, carry, at), StructType(out))
