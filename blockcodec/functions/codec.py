"""The codec as Arrow UDFs: null in, null out, a batch at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

from . import exprs
from .crc import combine, crc32c_many
from .kernels import KINDS, CodecError, compress, compress_fragment, decompress, frame_many, frame_writes, is_valid, split_chunks, try_unframe_many, unframe_many, walk

RESULT = pa.struct([("ok", pa.bool_()), ("error", pa.string()), ("value", pa.binary())])
UNFRAMED = pa.struct([("ok", pa.bool_()), ("error", pa.string()), ("error_chunk", pa.int32()), ("value", pa.binary())])
TAGS = pa.list_(pa.struct([("tag_no", pa.int32()), ("at", pa.int32()), ("kind", pa.string()), ("length", pa.int64()), ("offset", pa.int64()), ("literal", pa.binary())]))
SHAPES = pa.list_(pa.struct([f for f in TAGS.value_type if f.name != "literal"]))
CHUNKS = pa.list_(pa.struct([("chunk_no", pa.int32()), ("at", pa.int64()), ("chunk_type", pa.int32()), ("body_len", pa.int32()), ("crc", pa.int64()), ("body", pa.binary()), ("error", pa.string())]))


def _mapped(fn, kind):
    """fn over the values of a column; binary values are not copied in."""

    def run(col: pa.Array) -> pa.Array:
        return pa.array([None if not v.is_valid else fn(v.as_buffer()) for v in col], kind)

    return run


def _mapped_many(fn, kind):
    """The same for a function of many values at once."""

    def run(col: pa.Array) -> pa.Array:
        some = iter(fn([v.as_buffer() for v in col if v.is_valid]))
        return pa.array([next(some) if v.is_valid else None for v in col], kind)

    return run


def _elements(literals: bool):
    """The elements of blocks as Arrow columns, with the literals' bytes or
    without."""

    def run(col: pa.Array) -> pa.Array:
        found, ends, parts, bytes_ = [np.zeros((4, 0), np.int64)], [0], [np.zeros(0, np.int32)], []
        for v in col:
            n = 0
            if v.is_valid:
                block = v.as_buffer()
                for at, kind, length, offset, literal in walk(block):
                    found.append(np.stack([at, kind, length, offset]))
                    parts.append(np.arange(n, n + len(at), dtype=np.int32))
                    n += len(at)
                    if literals:
                        bytes_ += [block[a : a + m].to_pybytes() if k == 0 else None for k, a, m in zip(kind.tolist(), literal.tolist(), length.tolist())]
            ends.append(ends[-1] + n)
        at, kind, length, offset = np.concatenate(found, axis=1)
        copies = (kind > 0) & (kind < 4)
        names = pa.array(KINDS).take(pa.array(kind))
        cols = [pa.array(np.concatenate(parts)), pa.array(at.astype(np.int32)), names, pa.array(length), pa.array(offset, mask=~copies)]
        shape = TAGS if literals else SHAPES
        rows = pa.StructArray.from_arrays(cols + ([pa.array(bytes_, pa.binary())] if literals else []), fields=list(shape.value_type))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows, mask=col.is_null()).cast(shape)

    return run


def _try(block) -> dict:
    try:
        return dict(ok=True, error=None, value=decompress(block))
    except CodecError as e:
        return dict(ok=False, error=e.code, value=None)


def chunk_rows(data) -> list[dict]:
    """The chunks of a stream; a last row without a body tells an error."""
    chunks, at, _, error = split_chunks(data)
    rows = [dict(chunk_no=i, at=a, chunk_type=k, body_len=n, crc=int.from_bytes(b[:4], "little") if k < 2 else None, body=b, error=None) for i, (a, k, n, b) in enumerate(chunks)]
    if error:
        rows.append(dict(chunk_no=len(rows), at=at, chunk_type=None, body_len=None, crc=None, body=None, error=error))
    return rows


def _bytes(col) -> list:
    return [v.as_buffer() if v.is_valid else None for v in col]


def _crc(col: pa.Array) -> pa.Array:
    return pa.array(crc32c_many(_bytes(col)).astype("int64"), mask=col.is_null().to_numpy(zero_copy_only=False))


def _crc_append(crc: pa.Array, col: pa.Array) -> pa.Array:
    none = [a is None or not b.is_valid for a, b in zip(crc.to_pylist(), col)]
    found = crc32c_many(_bytes(col), [0 if x is None else x for x in crc.to_pylist()])
    return pa.array(found.astype("int64"), mask=pa.array(none).to_numpy(zero_copy_only=False))


def _crc_combine(a: pa.Array, b: pa.Array, n: pa.Array) -> pa.Array:
    rows = list(zip(a.to_pylist(), b.to_pylist(), n.to_pylist()))
    none = [None in r for r in rows]
    found = combine(*[[0 if x is None else x for x in c] for c in zip(*rows)]) if rows else []
    return pa.array([None if x else int(v) for x, v in zip(none, found)], pa.int64())


def _crc_fold(crcs: pa.Array, lengths: pa.Array) -> pa.Array:
    """Lists of CRCs and lengths of consecutive parts -> the CRC of the whole."""
    out = []
    for cs, ns in zip(crcs.to_pylist(), lengths.to_pylist()):
        total = 0
        for c, n in zip(cs or [], ns or []):
            total = int(combine(total, c, n)[0])
        out.append(None if cs is None else total)
    return pa.array(out, pa.int64())


def _frame_writes(col: pa.Array) -> pa.Array:
    return pa.array([None if w is None else frame_writes([(x["bytes"], x["flush"]) for x in w]) for w in col.to_pylist()], pa.binary())


def _udf(run, kind):
    return F.arrow_udf(run, from_arrow_type(kind))


snappy_compress = _udf(_mapped(compress, pa.binary()), pa.binary())
snappy_compress_fragment = _udf(_mapped(compress_fragment, pa.binary()), pa.binary())
snappy_decompress = _udf(_mapped(decompress, pa.binary()), pa.binary())
try_snappy_decompress = _udf(_mapped(_try, RESULT), RESULT)
snappy_is_valid = _udf(_mapped(is_valid, pa.bool_()), pa.bool_())
snappy_frame = _udf(_mapped_many(frame_many, pa.binary()), pa.binary())
snappy_unframe = _udf(_mapped_many(unframe_many, pa.binary()), pa.binary())
try_snappy_unframe = _udf(_mapped_many(try_unframe_many, UNFRAMED), UNFRAMED)
snappy_tag_array = _udf(_elements(True), TAGS)
#: The same without the bytes of literals.
snappy_tag_shapes = _udf(_elements(False), SHAPES)
snappy_chunk_array = _udf(_mapped(chunk_rows, CHUNKS), CHUNKS)
crc32c = _udf(_crc, pa.int64())
crc32c_append = _udf(_crc_append, pa.int64())
crc32c_combine = _udf(_crc_combine, pa.int64())
crc32c_fold = _udf(_crc_fold, pa.int64())
snappy_frame_writes = _udf(_frame_writes, pa.binary())


def try_snappy_compress(data, capacity):
    """The block if it takes at most capacity bytes, else null."""
    block = snappy_compress(data)
    return F.when(F.octet_length(block) <= capacity, block)


def snappy_decompress_prefix(block, n):
    """The first n bytes of a valid block; the whole block is validated."""
    return F.substring(snappy_decompress(block), 1, n) if isinstance(n, int) else F.call_function("substring", snappy_decompress(block), F.lit(1), n)


def masked_crc32c(data):
    return exprs.mask_crc(crc32c(data))


SQL_FUNCTIONS = {
    "snappy_compress": snappy_compress,
    "snappy_compress_fragment": snappy_compress_fragment,
    "snappy_decompress": snappy_decompress,
    "try_snappy_decompress": try_snappy_decompress,
    "snappy_is_valid": snappy_is_valid,
    "snappy_frame": snappy_frame,
    "snappy_unframe": snappy_unframe,
    "try_snappy_unframe": try_snappy_unframe,
    "snappy_tag_array": snappy_tag_array,
    "snappy_tag_shapes": snappy_tag_shapes,
    "snappy_chunk_array": snappy_chunk_array,
    "crc32c": crc32c,
    "crc32c_append": crc32c_append,
    "crc32c_combine": crc32c_combine,
}
