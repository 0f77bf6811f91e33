"""Data source "snappy_frames": framed files as rows, read, streamed, written.

Reading gives a row for each chunk: path, chunk_no, at, chunk_type, value (the
decoded bytes of a data chunk). Files are read through pyarrow file systems, so
hdfs:// and object stores work as local paths do. A file above split_bytes is
cut at chunk boundaries, which the chunk headers alone tell; a chunk type
filter is applied before anything is decoded.

Writing takes the rows' `value` column in order: each task writes one stream.
"""

from __future__ import annotations

import posixpath
import uuid
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, EqualTo, In, InputPartition, WriterCommitMessage

from ..functions.constants import CHUNK_HEADER, IDENTIFIER
from ..functions.kernels import CodecError, data_chunks, decode_chunks, pieces_of, split_chunks

SCHEMA = "path string, chunk_no int, at bigint, chunk_type int, value binary"
ARROW = pa.schema([("path", pa.string()), ("chunk_no", pa.int32()), ("at", pa.int64()), ("chunk_type", pa.int32()), ("value", pa.binary())])


def _open(uri: str):
    return pyarrow.fs.FileSystem.from_uri(uri if "://" in uri else "file://" + posixpath.abspath(uri))


def _files(uri: str) -> list[tuple[str, int]]:
    fs, path = _open(uri)
    info = fs.get_file_info(path)
    if info.type == pyarrow.fs.FileType.File:
        return [(path, info.size)]
    found = fs.get_file_info(pyarrow.fs.FileSelector(path, recursive=True))
    return sorted((f.path, f.size) for f in found if f.is_file and not f.base_name.startswith(("_", ".")))


@dataclass
class Span(InputPartition):
    """Bytes [start, end) of a file, from a chunk boundary to another."""

    path: str
    start: int
    end: int
    first_chunk: int


@dataclass
class Spans(InputPartition):
    """Spans that one task reads one after the other."""

    spans: list[Span]


#: Tasks that a read has at most: beyond, a task reads several spans.
READ_TASKS = 1024


def _spans(fs, path: str, size: int, split: int):
    """Cut a file at chunk boundaries; a malformed header ends the cutting, and
    the last span then finds the error."""
    if size <= split:
        return [Span(path, 0, size, 0)]
    out, at, start, no, first = [], 0, 0, 0, 0
    with fs.open_input_file(path) as f:
        while at + CHUNK_HEADER <= size:
            head = int.from_bytes(f.read_at(CHUNK_HEADER, at), "little")
            nxt = at + CHUNK_HEADER + (head >> 8)
            if nxt > size:
                break
            at, no = nxt, no + 1
            if at - start >= split:
                out.append(Span(path, start, at, first))
                start, first = at, no
    if start < size or not out:
        out.append(Span(path, start, size, first))
    return out


def _rows(fs, span: Span, wanted):
    with fs.open_input_file(span.path) as f:
        data = f.read_at(span.end - span.start, span.start)
    chunks, _, _, error = split_chunks(data)
    rows = []
    for i, c in enumerate(chunks):
        if wanted is not None and c[1] not in wanted:
            continue
        values, bad, _ = decode_chunks([c])
        if bad:
            raise CodecError(bad, span.first_chunk + i)
        rows.append((span.path, span.first_chunk + i, span.start + c[0], c[1], values[0] if values else None))
    if error:
        raise CodecError(error, span.first_chunk + len(chunks))
    for at in range(0, len(rows), 256):  # up to 16 MB decoded
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[at : at + 256]), ARROW)], schema=ARROW)


class FramesReader(DataSourceReader):
    def __init__(self, options):
        self.uri, self.split, self.wanted = options["path"], int(options.get("split_bytes", 32 << 20)), None

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("chunk_type",):
                self.wanted = {f.value} if self.wanted is None else self.wanted & {f.value}
            elif isinstance(f, In) and f.attribute == ("chunk_type",):
                self.wanted = set(f.value) if self.wanted is None else self.wanted & set(f.value)
            else:
                yield f

    def partitions(self):
        fs, _ = _open(self.uri)
        spans = [s for path, size in _files(self.uri) for s in _spans(fs, path, size, self.split)]
        per = -(-len(spans) // READ_TASKS)
        return [Spans(spans[at : at + per]) for at in range(0, len(spans), per)] if spans else [Spans([])]

    def read(self, partition):
        fs = _open(self.uri)[0]
        for span in partition.spans:
            yield from _rows(fs, span, self.wanted)


class FramesStreamReader(DataSourceStreamReader):
    """New files of a folder, in the order of their names: an offset is the
    last name that was read, so names must grow."""

    def __init__(self, options):
        self.uri, self.at = options["path"], ""

    def initialOffset(self):
        return {"after": ""}

    def latestOffset(self):
        # All there is: a run that is asked only once leaves nothing unread.
        self.at = max([self.at, *(p for p, _ in _files(self.uri))])
        return {"after": self.at}

    def partitions(self, start, end):
        return [Span(p, 0, n, 0) for p, n in _files(self.uri) if start["after"] < p <= end["after"]]

    def read(self, span):
        yield from _rows(_open(self.uri)[0], span, None)

    def commit(self, end):
        pass


@dataclass
class Written(WriterCommitMessage):
    part: str | None
    name: str | None


class FramesWriter(DataSourceWriter):
    def __init__(self, options, overwrite: bool):
        self.uri, self.overwrite, self.job = options["path"], overwrite, uuid.uuid4().hex

    def write(self, rows):
        fs, folder = _open(self.uri)
        fs.create_dir(folder, recursive=True)
        ctx = TaskContext.get()
        part = f"{folder}/_{self.job}-{ctx.partitionId():05d}-{ctx.taskAttemptId()}"
        out, held, pending = None, 0, []
        try:
            for row in rows:
                if row["value"] is None:
                    continue
                if out is None:
                    out = fs.open_output_stream(part)
                    out.write(IDENTIFIER)
                pending.append(bytes(row["value"]))
                held += len(pending[-1])
                if held >= 1 << 22:
                    held, pending = self._flush(out, pending, False)
            if out is not None:
                self._flush(out, pending, True)
        finally:
            if out is not None:
                out.close()
        # Without a row there is no write, and without a write no identifier.
        return Written(part if out is not None else None, f"{folder}/part-{ctx.partitionId():05d}-{self.job}.sz")

    @staticmethod
    def _flush(out, pending, final):
        data = b"".join(pending)
        whole = len(data) if final else len(data) >> 16 << 16
        out.write(b"".join(data_chunks(pieces_of(data[:whole]))))
        return len(data) - whole, [data[whole:]]

    def commit(self, messages):
        fs, folder = _open(self.uri)
        before = [path for path, _ in _files(self.uri)] if self.overwrite else []
        for m in messages:
            if m is not None and m.part:
                fs.move(m.part, m.name)
        # Only once the new files are in place: a failure never loses both.
        for path in before:
            fs.delete_file(path)
        with fs.open_output_stream(f"{folder}/_SUCCESS"):
            pass

    def abort(self, messages):
        fs, _ = _open(self.uri)
        for m in messages:
            if m is not None and m.part and fs.get_file_info(m.part).type == pyarrow.fs.FileType.File:
                fs.delete_file(m.part)


class SnappyFrames(DataSource):
    @classmethod
    def name(cls):
        return "snappy_frames"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return FramesReader(self._checked())

    def streamReader(self, schema):
        return FramesStreamReader(self._checked())

    def writer(self, schema, overwrite):
        if "value" not in schema.fieldNames():
            raise ValueError("rows need a binary column named value")
        return FramesWriter(self._checked(), overwrite)

    def _checked(self):
        if "path" not in self.options:
            raise ValueError("snappy_frames needs a path")
        if int(self.options.get("split_bytes", 1)) < 1:
            raise ValueError("split_bytes must be at least 1")
        return dict(self.options)

