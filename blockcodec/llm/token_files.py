"""Token ids in wavelet-matrix files.

A file holds the ids of a run of documents in ascending doc_id order, as one
bit-plane for each bit of the shard's own alphabet (Claude, Navarro, Ordonez,
"The Wavelet Matrix", 2015): the sequence is dealt stably by the plane's bit,
zeros first, on the way to the next plane. Planes are cut into blocks that are
compressed one by one and have their rank beside them, so access, rank and
select read only the blocks they need.

Layout, little-endian: magic b"WMT2"; 9 int64: tokens n, documents d, how many
of them have no doc_id (the last ones, with a doc id of 0 in the file), alphabet
size a, planes p, bits to a block, then three lengths of the compressed
alphabet, doc ids and document ends; those three; for each plane its number of
zeros, its ones before each block and the end of each block (int64 each); then
the blocks.
"""

from __future__ import annotations

import posixpath
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import new_path, shuffle_partitions, write_table
from .tokens import WordEncoder, batched

MAGIC = b"WMT2"
BLOCK_BITS = 1 << 17
#: A file is closed at so many tokens; a document is never split over two.
FILE_TOKENS = 1 << 21


def _code_type(planes: int):
    return np.uint16 if planes <= 16 else np.uint32


def encode_file(ids: np.ndarray, doc_ids, ends, block_bits: int = BLOCK_BITS) -> bytes:
    """ids: uint32; doc_ids: integers, None only at the end; ends: the end of
    each document in ids."""
    alphabet = np.nonzero(np.bincount(ids, minlength=1))[0] if len(ids) else np.zeros(0, np.int64)
    planes, head, body = max(1, int(len(alphabet) - 1).bit_length()), [], []
    code = np.zeros(int(alphabet[-1]) + 1 if len(alphabet) else 1, _code_type(planes))
    code[alphabet] = np.arange(len(alphabet))
    seq = code[ids]
    for p in range(planes - 1, -1, -1):
        one = (seq & seq.dtype.type(1 << p)).astype(bool)
        starts = range(0, len(one), block_bits)
        ones = [int(np.count_nonzero(one[at : at + block_bits])) for at in starts]
        blocks = [zstandard.compress(np.packbits(one[at : at + block_bits]).tobytes(), 1) for at in starts]
        before = np.cumsum([0, *ones])[:-1]
        head.append(np.array([len(one) - sum(ones), *before, *np.cumsum([len(b) for b in blocks])] if blocks else [0], np.int64))
        body.append(b"".join(blocks))
        seq = np.concatenate([seq[~one], seq[one]])
    parts = [zstandard.compress(np.ascontiguousarray(x).tobytes(), 1) for x in (alphabet.astype(np.uint32), np.array([i or 0 for i in doc_ids], np.int64), np.asarray(ends, np.int64))]
    sizes = struct.pack("<9q", len(ids), len(doc_ids), sum(i is None for i in doc_ids), len(alphabet), planes, block_bits, *map(len, parts))
    return b"".join([MAGIC, sizes, *parts, *(h.tobytes() for h in head), *body])


class TokenFile:
    """One compressed file: access, rank, select and counting."""

    def __init__(self, raw: bytes):
        if raw[:4] != MAGIC:
            raise ValueError("not a token file")
        self.raw = memoryview(raw)
        self.n, d, nameless, self.a, self.planes, self.block_bits, *sizes = struct.unpack_from("<9q", raw, 4)
        at, parts = 4 + 72, []
        for size, kind in zip(sizes, (np.uint32, np.int64, np.int64)):
            parts.append(np.frombuffer(zstandard.decompress(raw[at : at + size]), kind))
            at += size
        self.alphabet, ids, self.ends = parts
        self.doc_ids: list[int | None] = ids[: d - nameless].tolist() + [None] * nameless
        self.blocks = -(-self.n // self.block_bits)
        self.zeros, self.before, self.spans = [], [], []
        heads = []
        for _ in range(self.planes):
            k = 1 + 2 * self.blocks if self.blocks else 1
            heads.append(np.frombuffer(raw, np.int64, k, at))
            at += 8 * k
        for h in heads:
            self.zeros.append(int(h[0]))
            self.before.append(h[1 : 1 + self.blocks])
            ends = h[1 + self.blocks :]
            self.spans.append((at + np.concatenate([[0], ends[:-1]]), at + ends) if self.blocks else ((), ()))
            at += int(ends[-1]) if self.blocks else 0
        self._cache: dict[tuple[int, int], np.ndarray] = {}

    def _bits(self, plane: int, block: int) -> np.ndarray:
        if (plane, block) not in self._cache:
            start, end = int(self.spans[plane][0][block]), int(self.spans[plane][1][block])
            n = min(self.block_bits, self.n - block * self.block_bits)
            self._cache[plane, block] = np.unpackbits(np.frombuffer(zstandard.decompress(bytes(self.raw[start:end])), np.uint8))[:n]
        return self._cache[plane, block]

    def _rank1(self, plane: int, i: int) -> int:
        """Ones among the first i bits of a plane."""
        if i >= self.n:
            return self.n - self.zeros[plane]
        block, rest = divmod(i, self.block_bits)
        return int(self.before[plane][block]) + (int(self._bits(plane, block)[:rest].sum()) if rest else 0)

    def _select(self, plane: int, bit: int, k: int) -> int:
        """The place of the k-th (from 0) bit of that value in a plane."""
        before = self.before[plane] if bit else np.arange(self.blocks) * self.block_bits - self.before[plane]
        block = int(np.searchsorted(before, k, side="right")) - 1
        return block * self.block_bits + int(np.nonzero(self._bits(plane, block) == bit)[0][k - int(before[block])])

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        code = 0
        for p in range(self.planes):
            block, rest = divmod(i, self.block_bits)
            bit = int(self._bits(p, block)[rest])
            ones = self._rank1(p, i)
            code = 2 * code + bit
            i = self.zeros[p] + ones if bit else i - ones
        return int(self.alphabet[code])

    def _range(self, token: int, i: int, j: int):
        """Where the occurrences of token in [i, j) end up below the last plane."""
        code = int(np.searchsorted(self.alphabet, token))
        if code >= self.a or self.alphabet[code] != token:
            return None
        for p in range(self.planes):
            a, b = self._rank1(p, i), self._rank1(p, j)
            if (code >> (self.planes - 1 - p)) & 1:
                i, j = self.zeros[p] + a, self.zeros[p] + b
            else:
                i, j = i - a, j - b
        return code, i, j

    def count(self, token: int, start: int = 0, end: int | None = None) -> int:
        """Occurrences of token in [start, end)."""
        found = self._range(token, start, self.n if end is None else end)
        return 0 if found is None else found[2] - found[1]

    def locate(self, token: int, k: int) -> int:
        """The place of the k-th (from 0) occurrence of token."""
        found = self._range(token, 0, self.n)
        if found is None or not 0 <= k < found[2] - found[1]:
            raise IndexError(k)
        code, i = found[0], found[1] + k
        for p in range(self.planes - 1, -1, -1):
            bit = (code >> (self.planes - 1 - p)) & 1
            i = self._select(p, bit, i - self.zeros[p] if bit else i)
        return i

    def tokens(self) -> np.ndarray:
        """All ids in order, from the last plane up: the zeros of a plane were
        dealt to the front of the next one and the ones behind them, each in
        order, so they are taken back in order."""
        code = np.zeros(self.n, _code_type(self.planes))
        for p in range(self.planes - 1, -1, -1):
            one = np.concatenate([self._bits(p, b) for b in range(self.blocks)]).astype(bool) if self.blocks else np.zeros(0, bool)
            self._cache.clear()
            above = np.empty_like(code)
            above[~one] = code[: self.zeros[p]]
            above[one] = code[self.zeros[p] :] | code.dtype.type(1 << (self.planes - 1 - p))
            code = above
        return self.alphabet[code]


def _filesystem(uri: str):
    """pyarrow's file system for a URI of the shared folder, and its path."""
    return pyarrow.fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri)


def write_bytes(uri: str, data: bytes) -> None:
    """All or nothing: a task that is run again, or twice, replaces the file."""
    fs, path = _filesystem(uri)
    fs.create_dir(posixpath.dirname(path), recursive=True)
    part = f"{path}.{uuid.uuid4().hex}"
    with fs.open_output_stream(part) as f:
        f.write(data)
    fs.move(part, path)


def read_bytes(uri: str) -> bytes:
    fs, path = _filesystem(uri)
    with fs.open_input_stream(path) as f:
        return f.read()


FILES = "part int, file int, path string, n_tokens long, n_docs long"


def _writer(folder: str, tokenizer: str, end_id: int, file_tokens: int):
    def run(batches):
        part, made, encoder = TaskContext.get().partitionId(), 0, WordEncoder(tokenizer)
        docs: list = []
        ids: list[np.ndarray] = []
        held = 0

        def close():
            nonlocal made, held
            path = f"{folder}/part-{part:06d}-{made:06d}.wmt"
            write_bytes(path, encode_file(np.concatenate(ids), docs, np.cumsum([len(x) for x in ids])))
            row = pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([made], pa.int32()), pa.array([path]), pa.array([held], pa.int64()), pa.array([len(docs)], pa.int64())], ["part", "file", "path", "n_tokens", "n_docs"])
            made, held = made + 1, 0
            docs.clear()
            ids.clear()
            return row

        for batch in batches:
            keys, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            for a, b in batched(texts):
                for key, x in zip(keys[a:b], encoder.encode(texts[a:b])):
                    docs.append(key)
                    ids.append(np.append(x, np.uint32(end_id)).astype(np.uint32))
                    held += len(x) + 1
                    if held >= file_tokens:
                        yield close()
        if docs:
            yield close()

    return run


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 2, file_tokens: int = FILE_TOKENS, partition_bytes: int = 24 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the ids of docs, in ascending doc_id order over the files; returns
    a table of the files: part, file, path, n_tokens, n_docs."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(shuffle_partitions(docs.sparkSession), -(-size // partition_bytes))
    # A doc_id, or its lack, that many rows have is dealt out by their texts,
    # and a text that many of those have by the row.
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text"), F.col("_row")]
    dealt = rows.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(int(parts), *order).sortWithinPartitions(*order).drop("_row")
    return write_table(dealt.mapInArrow(_writer(folder, tokenizer, end_id, file_tokens), FILES), "files")


def _reader(batches):
    for batch in batches:
        for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
            f = TokenFile(read_bytes(path))
            ids, begin = f.tokens().astype("<u4"), np.concatenate([[0], f.ends[:-1]]).astype(np.int64)
            crc = [zlib.crc32(ids[a:b]) for a, b in zip(begin.tolist(), f.ends.tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(f.doc_ids, pa.int64()), pa.array(start + begin), pa.array(f.ends - begin), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


#: Writer's partitions that one task sums up.
PARTS_TOGETHER = 1024


def read_token_files(files: DataFrame) -> DataFrame:
    """From the files alone: doc_id, start (ids of all documents before it),
    n_tokens, ids_crc32. The ids before a file are prefix sums in two levels:
    within runs of partitions, and over the runs, of which there are few."""
    spark = files.sparkSession

    def before(rows, by, order):
        w = (Window.partitionBy(by) if by else Window).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return rows.withColumn("before", F.coalesce(F.sum("n_tokens").over(w), F.lit(0)))

    run = F.expr(f"part div {PARTS_TOGETHER}").alias("run")
    inner = before(files.select(run, "part", "file", "path", "n_tokens"), "run", ["part", "file"])
    runs = before(files.groupBy(run).agg(F.sum("n_tokens").alias("n_tokens")), None, ["run"])
    placed = inner.join(runs.select("run", F.col("before").alias("base")).hint("merge"), "run").select("path", (F.col("base") + F.col("before")).alias("start"))
    n = max(shuffle_partitions(spark), files.count() // 4)
    return placed.repartition(n, "path").mapInArrow(_reader, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, tokenizer: str, folder: str | None = None, **options) -> DataFrame:
    """Encode, write, read back: one row for each row of docs.

    Null and empty texts have the end id only. A null doc_id comes after all
    others; rows of one doc_id follow each other in the order of their texts'
    hashes. Other columns are ignored; an empty table makes no files.
    """
    return read_token_files(write_token_files(docs, folder or new_path(docs.sparkSession, "tokens"), tokenizer, **options))
