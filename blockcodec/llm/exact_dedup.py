"""Exact dedup by Grace hashing.

Rows are hash-partitioned to spill files; each bucket is then deduplicated in
an open-addressing table that compares complete content. A bucket whose
distinct texts outgrow the table leaves the rest over, which is partitioned
again under another seed, until nothing is left.

Each task first collapses the copies it has in a table of the same kind, so a
text that a third of all rows share reaches its bucket once for each task, and
no row count follows the size of a group of copies.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from .common import shuffle_partitions, to_bytes, with_row_id, write_table


class ContentTable:
    """Open addressing with linear probing. Equal hashes are not enough for a
    hit: the complete contents must be equal. limit bounds the bytes held."""

    ROW = 100  # bytes counted for an entry besides its content

    def __init__(self, limit: int | None = None):
        self.slots, self.mask = [-1] * 64, 63
        self.hashes: list[int] = []
        self.texts: list[bytes] = []
        self.limit, self.bytes = limit, 0

    def find(self, h: int, text: bytes) -> int:
        """The entry of text, or -1."""
        i = h & self.mask
        while (e := self.slots[i]) >= 0:
            if self.hashes[e] == h and self.texts[e] == text:
                return e
            i = (i + 1) & self.mask
        return -1

    def full(self, text: bytes) -> bool:
        """A lone text always fits: a bucket of one cannot be split."""
        return bool(self.texts) and self.limit is not None and self.bytes + len(text) + self.ROW > self.limit

    def insert(self, h: int, text: bytes) -> int:
        if 2 * len(self.texts) >= len(self.slots):
            self.mask = 4 * len(self.slots) - 1
            self.slots = [-1] * (self.mask + 1)
            for e, x in enumerate(self.hashes):
                self._place(x, e)
        e = len(self.texts)
        self.hashes.append(h)
        self.texts.append(text)
        self.bytes += len(text) + self.ROW
        self._place(h, e)
        return e

    def _place(self, h: int, e: int) -> None:
        i = h & self.mask
        while self.slots[i] >= 0:
            i = (i + 1) & self.mask
        self.slots[i] = e


#: Bytes that the table of one task holds at most.
TABLE_BYTES = 48 << 20

SPILL = pa.schema([("_rid", pa.int64()), ("doc_id", pa.int64()), ("rep", pa.int64()), ("sha", pa.string()), ("best", pa.int64()), ("n", pa.int64()), ("h", pa.int64()), ("text", pa.binary())])
SPILL_DDL = "_rid long, doc_id long, rep long, sha string, best long, n long, h long, text binary"
RESOLVED = pa.schema([("rep", pa.int64()), ("doc_id", pa.int64()), ("best", pa.int64()), ("n", pa.int64()), ("h", pa.int64()), ("text", pa.binary()), ("keep_rid", pa.int64()), ("keep_id", pa.int64()), ("group_size", pa.int64())])
RESOLVED_DDL = "rep long, doc_id long, best long, n long, h long, text binary, keep_rid long, keep_id long, group_size long"


def _order(doc_id, tie):
    """What stays: the largest doc_id; a null is below all; then the tie."""
    return (doc_id is not None, doc_id or 0, tie)


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def collapse(limit: int):
    """A row for each input row, with rep, the first row that the task's table
    had its text from; and, with content, a row for each text of the table:
    rep, how many rows it stands for and which of them stays. A table that has
    grown to limit bytes is closed and a new one begun."""

    def run(batches):
        table, best, count, rep, sha = ContentTable(), [], [], [], []

        def contents():
            for at in range(0, len(rep), 2000):
                part = range(at, min(at + 2000, len(rep)))
                cols = [[None] * len(part), [best[e][0] for e in part], [rep[e] for e in part], [sha[e] for e in part], [best[e][1] for e in part], [count[e] for e in part], [_signed(table.hashes[e]) for e in part], [table.texts[e] for e in part]]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, SPILL)], schema=SPILL)

        for batch in batches:
            rids, ids, entry = batch.column("_rid").to_pylist(), batch.column("doc_id").to_pylist(), []
            for rid, doc_id, t in zip(rids, ids, batch.column("text").to_pylist()):
                text = to_bytes(t).lower()  # bytes.lower is A-Z only
                h = xxhash.xxh64_intdigest(text)
                if (e := table.find(h, text)) < 0:
                    e = table.insert(h, text)
                    best.append((doc_id, rid))
                    count.append(0)
                    rep.append(rid)
                    sha.append(hashlib.sha256(text).hexdigest())
                elif _order(doc_id, rid) > _order(*best[e]):
                    best[e] = (doc_id, rid)
                count[e] += 1
                entry.append(e)
            none = [None] * len(entry)
            cols = [rids, ids, [rep[e] for e in entry], [sha[e] for e in entry], none, none, none, none]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, SPILL)], schema=SPILL)
            if table.bytes >= limit:
                yield from contents()
                table, best, count, rep, sha = ContentTable(), [], [], [], []
        yield from contents()

    return run


def bucket_pass(limit: int):
    """A bucket through a table of at most limit bytes. Rows whose text is not
    in the full table come out with their text, for the next level; as no entry
    is ever evicted, all copies of such a text come out alike. A text comes
    once for each task before, which bounds the reps of an entry."""

    def run(batches):
        table, best, size, reps = ContentTable(limit), [], [], []
        for batch in batches:
            left = []
            cols = [batch.column(c).to_pylist() for c in ("rep", "doc_id", "best", "n", "h", "text")]
            for rep, doc_id, rid, n, h, text in zip(*cols):
                u = h & 0xFFFFFFFFFFFFFFFF
                if (e := table.find(u, text)) < 0:
                    if table.full(text):
                        left.append((rep, doc_id, rid, n, h, text, None, None, None))
                        continue
                    e = table.insert(u, text)
                    best.append((doc_id, rid))
                    size.append(0)
                    reps.append([])
                elif _order(doc_id, rid) > _order(*best[e]):
                    best[e] = (doc_id, rid)
                size[e] += n
                reps[e].append(rep)
                table.bytes += 16
            if left:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*left), RESOLVED)], schema=RESOLVED)
        out = [(r, None, None, None, None, None, best[e][1], best[e][0], size[e]) for e in range(len(best)) for r in reps[e]]
        for at in range(0, len(out), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out[at : at + 10_000]), RESOLVED)], schema=RESOLVED)

    return run


def _dealt(todo: DataFrame, level: int, bytes_: int, table_bytes: int) -> DataFrame:
    """The partitioning of a level, under a seed of its own."""
    parts = max(shuffle_partitions(todo.sparkSession), -(-2 * bytes_ // table_bytes))
    return todo.repartition(int(parts), F.xxhash64("h", F.lit(level)))


def exact_dedup(docs: DataFrame, table_bytes: int = TABLE_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, keep_id, group_size, kept,
    text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as
    empty. The row with the largest doc_id stays; a null doc_id is below all
    others, and of rows with equal doc_id and text exactly one stays. Any other
    columns of docs are ignored. table_bytes bounds the table of one task.
    """
    rows = with_row_id(docs, doc_id=F.col(id_col).cast("long"), text=F.col(text_col))
    spill = write_table(rows.mapInArrow(collapse(table_bytes), SPILL_DDL), "spill")
    todo = spill.where("text is not null").select("rep", "doc_id", "best", "n", "h", "text")
    resolved = None
    for level in range(1 << 30):
        size = todo.agg(F.sum(F.octet_length("text") + ContentTable.ROW)).first()[0] or 0
        done = write_table(_dealt(todo, level, size, table_bytes).mapInArrow(bucket_pass(table_bytes), RESOLVED_DDL), f"level{level}")
        some = done.where("text is null").select("rep", "keep_rid", "keep_id", "group_size")
        resolved = some if resolved is None else resolved.unionAll(some)
        todo = done.where("text is not null").select("rep", "doc_id", "best", "n", "h", "text")
        if todo.isEmpty():
            break
    # A rep has at most the rows of one task.
    found = spill.where("_rid is not null").select("_rid", "doc_id", "rep", "sha").join(resolved, "rep")
    return found.select("doc_id", "keep_id", "group_size", (F.col("_rid") == F.col("keep_rid")).alias("kept"), F.col("sha").alias("text_sha256"))


# Whole rows: the same passes, in which the row that stays travels.


class Stayers:
    """For each text seen, the row that stays, whole, in bounded memory."""

    def __init__(self, limit: int):
        self.table, self.best = ContentTable(limit), []
        self.chunks: list[pa.RecordBatch] = []
        self.place: list[int] = []  # of each entry's row among the chunks
        self.made, self.stale = 0, 0

    def add(self, batch: pa.RecordBatch, hashes, texts, ids, ties, evict: bool) -> list[int]:
        """Take a batch in. The rows that a full table has no room for; with
        evict there are none, and the table may outgrow its limit."""
        left, won = [], {}
        for i, (h, text, doc_id, tie) in enumerate(zip(hashes, texts, ids, ties)):
            e = self.table.find(h, text)
            if e < 0:
                if not evict and self.table.full(text):
                    left.append(i)
                    continue
                e = self.table.insert(h, text)
                self.best.append((doc_id, tie))
                self.place.append(-1)
                won[e] = i
            elif _order(doc_id, tie) > _order(*self.best[e]):
                self.best[e] = (doc_id, tie)
                won[e] = i
                self.stale += len(text)
        if won:
            self.chunks.append(batch.take(pa.array(list(won.values()), pa.int64())))
            for k, e in enumerate(won):
                self.place[e] = self.made + k
            self.made += len(won)
        if self.stale > (self.table.limit or 0) // 2:
            self.chunks, self.stale = self.rows(), 0
            self.place, self.made = list(range(len(self.place))), len(self.place)
        return left

    def rows(self) -> list[pa.RecordBatch]:
        if not self.place:
            return []
        return pa.Table.from_batches(self.chunks).take(pa.array(self.place, pa.int64())).combine_chunks().to_batches(max_chunksize=2000)




def _keep(limit: int, id_at: int, text_at: int, first: bool):
    """(h, row) -> (h, row, left). The first pass makes h and closes a table
    that is full; the second leaves over what a full table has no room for."""

    def run(batches):
        held = Stayers(limit)

        def out(rows, left):
            for b in rows:
                yield pa.RecordBatch.from_arrays([b.column("h"), b.column("row"), pa.array([left] * b.num_rows, pa.bool_())], ["h", "row", "left"])

        for batch in batches:
            row = batch.column("row")
            spelt = [to_bytes(t) for t in row.field(text_at).to_pylist()]
            ids, texts = row.field(id_at).cast(pa.int64()).to_pylist(), [t.lower() for t in spelt]
            if first:
                hashes = [xxhash.xxh64_intdigest(t) for t in texts]
                batch = pa.RecordBatch.from_arrays([pa.array([_signed(h) for h in hashes], pa.int64()), row], ["h", "row"])
            else:
                hashes = [h & 0xFFFFFFFFFFFFFFFF for h in batch.column("h").to_pylist()]
                batch = batch.select(["h", "row"])
            left = held.add(batch, hashes, texts, ids, spelt, first)
            if left:
                yield from out([batch.take(pa.array(left, pa.int64()))], True)
            if first and held.table.bytes >= limit:
                yield from out(held.rows(), False)
                held = Stayers(limit)
        yield from out(held.rows(), False)

    return run


def kept_rows(docs: DataFrame, table_bytes: int = TABLE_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that exact_dedup() keeps, with all their columns; of
    rows with equal doc_id and equal text exactly one, that of the greatest
    spelling. Whole rows go through the buckets, so nothing is joined back and
    each text moves once."""
    at = (docs.columns.index(id_col), docs.columns.index(text_col))
    schema = StructType([StructField("h", LongType()), StructField("row", docs.schema, False), StructField("left", BooleanType())])
    size = docs.agg(F.sum(F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)) + ContentTable.ROW)).first()[0] or 0
    todo = docs.select(F.struct("*").alias("row")).mapInArrow(_keep(table_bytes, *at, True), schema)
    kept = None
    for level in range(1 << 30):
        done = write_table(_dealt(todo.select("h", "row"), level, size, table_bytes).mapInArrow(_keep(table_bytes, *at, False), schema), f"kept{level}")
        some = done.where("not left").select("row.*")
        kept = some if kept is None else kept.unionAll(some)
        todo = done.where("left")
        if todo.isEmpty():
            return kept
        size = todo.agg(F.sum(F.octet_length(F.col("row")[text_col]) + ContentTable.ROW)).first()[0] or 0
