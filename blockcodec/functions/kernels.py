"""The codec on plain bytes: blocks, tags, frames. No Spark here."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .constants import (
    BLOCK_SIZE,
    CHECKSUM,
    CHUNK_HEADER,
    COMPRESSED_DATA,
    CORRUPT_BLOCK,
    CRC_MISMATCH,
    EXPANSION_LIMIT,
    FIRST_SKIPPABLE,
    IDENTIFIER,
    IDENTIFIER_BODY,
    INVALID_CHUNK_LENGTH,
    INVALID_LENGTH,
    INVALID_STREAM_IDENTIFIER,
    MAX_CHUNK_BODY,
    MAX_LENGTH,
    STREAM_IDENTIFIER,
    UNCOMPRESSED_DATA,
    UNEXPECTED_END,
    UNKNOWN_CHUNK_TYPE,
    VARINT_MAX,
)
from .crc import crc32c_many, mask

CODEC = "snappy"


class CodecError(ValueError):
    """Malformed input, with one of the codes of constants."""

    def __init__(self, code: str, at: int | None = None):
        super().__init__(code if at is None else f"{code} at {at}")
        self.code, self.at = code, at

    def __reduce__(self):
        return CodecError, (self.code, self.at)


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def parse_varint(data) -> tuple[str, int, int]:
    """(DONE, value, size), or NEED_MORE_DATA or INVALID_DATA with zeros."""
    value = 0
    for i, b in enumerate(bytes(data[:VARINT_MAX])):
        if i == VARINT_MAX - 1 and b > 15:
            return "INVALID_DATA", 0, 0
        value |= (b & 127) << (7 * i)
        if b < 128:
            return "DONE", value, i + 1
    return "NEED_MORE_DATA", 0, 0


def uncompressed_length(block) -> tuple[int, int]:
    """(length, bytes of the header). Looks at the header only."""
    status, value, size = parse_varint(block)
    if status != "DONE" or value > MAX_LENGTH:
        raise CodecError(INVALID_LENGTH)
    return value, size


def compress(data) -> bytes:
    # The library's encoder leaves an empty value without tags already.
    return pa.compress(data, codec=CODEC, asbytes=True)


def compress_fragment(data) -> bytes:
    """The tags of at most 64 KB, without the length."""
    if len(data) > BLOCK_SIZE:
        raise ValueError("a fragment has at most 65536 bytes")
    return compress(data)[len(varint(len(data))) :]


def decompress(block) -> bytes:
    length, header = uncompressed_length(block)
    body = len(block) - header
    # Before anything is allocated: a few bytes must not claim gigabytes.
    if length > EXPANSION_LIMIT * body or (length == 0 and body):
        raise CodecError(CORRUPT_BLOCK)
    if length == 0:
        return b""
    try:
        return pa.decompress(block, decompressed_size=length, codec=CODEC, asbytes=True)
    except (OSError, ValueError, pa.ArrowException):
        raise CodecError(CORRUPT_BLOCK) from None


# Elements of a block. Where each possible element would end is looked up for
# all bytes of a window at once; the elements there are follow from each other.

WINDOW = 1 << 18
KINDS = ("literal", "copy1", "copy2", "copy4", "invalid")
_TAG = np.arange(256)
#: Bytes of an element with the tag; 0 for literals whose length follows the tag.
_SPAN = np.where(_TAG & 3, np.array([0, 2, 3, 5])[_TAG & 3], np.where(_TAG >> 2 < 60, (_TAG >> 2) + 2, 0))


def _number(data: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Little-endian numbers of so many bytes; data has room behind them."""
    out = np.zeros(len(at), np.int64)
    for i in range(size):
        out |= data[at + i].astype(np.int64) << (8 * i)
    return out


def walk(block):
    """The elements of a block in bounded memory: for each window (at, kind,
    length, offset, start of the literal). A truncated element is the last, of
    kind 4 and length 0."""
    whole = np.frombuffer(block, np.uint8)
    at, n = uncompressed_length(block)[1], len(whole)
    while at < n:
        first, end = at, min(at + WINDOW, n)
        data = np.concatenate([whole[first : end + 8], np.zeros(8, np.uint8)])
        tag = data[: end - first]
        step = _SPAN[tag]
        long_ = np.nonzero(step == 0)[0]
        extra = (tag[long_] >> 2).astype(np.int64) - 59
        size = np.zeros(len(long_), np.int64)
        for k in (1, 2, 3, 4):
            of = extra == k
            size[of] = _number(data, long_[of] + 1, k) + 1
        step[long_] = 1 + extra + size
        steps, places, i = step.tolist(), [], 0
        while i < len(steps):
            places.append(i)
            i += steps[i]
        at = first + i
        places = np.array(places, np.int64)
        tag = tag[places].astype(np.int64)
        kind, length, offset, literal = tag & 3, (tag >> 2) + 1, np.zeros(len(tag), np.int64), np.zeros(len(tag), np.int64)
        of = np.nonzero(kind == 0)[0]
        more = np.maximum(length[of] - 60, 0)
        length[of] = np.where(more > 0, step[places[of]] - 1 - more, length[of])
        literal[of] = first + places[of] + 1 + more
        of = kind == 1
        length[of] = (tag[of] >> 2 & 7) + 4
        for k, width in ((1, 1), (2, 2), (3, 4)):
            of = kind == k
            offset[of] = _number(data, places[of] + 1, width)
        of = kind == 1
        offset[of] |= tag[of] >> 5 << 8
        if at > n:
            kind[-1], length[-1], offset[-1] = 4, 0, 0
        yield first + places, kind, length, offset, literal


def is_valid(block) -> bool:
    """Whether a block can be decoded; nothing is decoded."""
    try:
        declared, header = uncompressed_length(block)
    except CodecError:
        return False
    if declared > EXPANSION_LIMIT * (len(block) - header) or (declared == 0 and len(block) > header):
        return False
    produced = 0
    for _, kind, length, offset, _ in walk(block):
        before = produced + np.cumsum(length) - length
        produced += int(length.sum())
        if (kind == 4).any() or ((kind > 0) & ((offset == 0) | (offset > before))).any() or produced > declared:
            return False
    return produced == declared


def tags(block) -> list[dict]:
    """The elements of a block as far as they can be read: tag_no, at, kind,
    length, offset, literal. A truncated or impossible element is the last, of
    kind 'invalid'."""
    data, out = memoryview(block), []
    for window in walk(block):
        for at, kind, length, offset, literal in zip(*(c.tolist() for c in window)):
            out.append(dict(tag_no=len(out), at=at, kind=KINDS[kind], length=length, offset=offset if 0 < kind < 4 else None, literal=bytes(data[literal : literal + length]) if kind == 0 else None))
    return out


# Framing.


def chunk(kind: int, body: bytes) -> bytes:
    return (len(body) << 8 | kind).to_bytes(4, "little") + body


def data_chunks(pieces) -> list[bytes]:
    """A data chunk for each piece of at most 64 KB: compressed only if smaller."""
    crcs, out = crc32c_many(pieces), []
    for piece, crc in zip(pieces, crcs.tolist()):
        packed = compress(piece)
        kind, body = (COMPRESSED_DATA, packed) if len(packed) < len(piece) else (UNCOMPRESSED_DATA, bytes(piece))
        out.append(chunk(kind, mask(crc).to_bytes(4, "little") + body))
    return out


def pieces_of(data) -> list[bytes]:
    return [data[at : at + BLOCK_SIZE] for at in range(0, len(data), BLOCK_SIZE)]


#: Bytes that are dealt with together, so that small steps are taken once for all.
TOGETHER = 16 << 20


def _together(values):
    """Runs of values of about TOGETHER bytes, one value at least."""
    run, held = [], 0
    for v in values:
        run.append(v)
        held += len(v)
        if held >= TOGETHER:
            yield run
            run, held = [], 0
    if run:
        yield run


def frame_many(values) -> list[bytes]:
    """A stream of one write for each value: the identifier, then chunks of
    64 KB. Checksums are taken over the pieces of many values at once."""
    out = []
    for run in _together(values):
        pieces = [pieces_of(v) for v in run]
        made, at = data_chunks([p for ps in pieces for p in ps]), 0
        for ps in pieces:
            out.append(b"".join([IDENTIFIER, *made[at : at + len(ps)]]))
            at += len(ps)
    return out


def frame(data) -> bytes:
    return frame_many([data])[0]


def frame_writes(writes) -> bytes:
    """writes: (bytes, flush after it). Chunks end every 64 KB since the last
    flush; no write at all gives an empty stream."""
    out, pending, any_write = [], b"", False
    for data, flush in writes:
        any_write = any_write or data is not None
        pending += data or b""
        whole = len(pending) if flush else len(pending) // BLOCK_SIZE * BLOCK_SIZE
        out += data_chunks(pieces_of(pending[:whole]))
        pending = pending[whole:]
    out += data_chunks(pieces_of(pending))
    return b"".join([IDENTIFIER, *out]) if any_write else b""


def split_chunks(data, final: bool = True):
    """(chunks, bytes used, skip, error): chunks are (at, type, body length,
    body or None). Reading stops at the first error; without final, at the
    first chunk that is not complete, and skip is how much of a skippable
    chunk is still to come."""
    data, at, out = memoryview(data), 0, []
    while at < len(data):
        if len(data) - at < CHUNK_HEADER:
            return out, at, 0, UNEXPECTED_END if final else None
        head = int.from_bytes(data[at : at + CHUNK_HEADER], "little")
        kind, size = head & 255, head >> 8
        here = len(data) - at - CHUNK_HEADER >= size
        if kind in (COMPRESSED_DATA, UNCOMPRESSED_DATA):
            if not CHECKSUM <= size <= MAX_CHUNK_BODY:
                return out, at, 0, INVALID_CHUNK_LENGTH
        elif kind == STREAM_IDENTIFIER:
            if size != len(IDENTIFIER_BODY):
                return out, at, 0, INVALID_STREAM_IDENTIFIER
        elif kind < FIRST_SKIPPABLE:
            return out, at, 0, UNKNOWN_CHUNK_TYPE
        elif not here and not final:
            out.append((at, kind, size, None))
            return out, len(data), size - (len(data) - at - CHUNK_HEADER), None
        if not here:
            return out, at, 0, UNEXPECTED_END if final else None
        body = bytes(data[at + CHUNK_HEADER : at + CHUNK_HEADER + size])
        if kind == STREAM_IDENTIFIER and body != IDENTIFIER_BODY:
            return out, at, 0, INVALID_STREAM_IDENTIFIER
        out.append((at, kind, size, body))
        at += CHUNK_HEADER + size
    return out, at, 0, None


def decode_chunk(kind: int, body: bytes) -> bytes:
    """The bytes of a data chunk, before its checksum is tested."""
    payload = body[CHECKSUM:]
    if kind == UNCOMPRESSED_DATA:
        if len(payload) > BLOCK_SIZE:
            raise CodecError(INVALID_CHUNK_LENGTH)
        return payload
    length, header = uncompressed_length(payload)
    if length > EXPANSION_LIMIT * (len(payload) - header):
        raise CodecError(CORRUPT_BLOCK)
    if length > BLOCK_SIZE:
        raise CodecError(INVALID_CHUNK_LENGTH)
    return decompress(payload)


def decode_many(streams):
    """For the chunks of each stream (values, error, number of the failing
    chunk among them), with one pass of checksums over all."""
    decoded = []
    for chunks in streams:
        values, error, failed = [], None, None
        for no, (_, kind, _, body) in enumerate(chunks):
            if kind in (COMPRESSED_DATA, UNCOMPRESSED_DATA):
                try:
                    values.append((no, decode_chunk(kind, body), int.from_bytes(body[:CHECKSUM], "little")))
                except CodecError as e:
                    error, failed = e.code, no
                    break
        decoded.append((values, error, failed))
    crcs, at, out = crc32c_many([v for values, _, _ in decoded for _, v, _ in values]).tolist(), 0, []
    for values, error, failed in decoded:
        good = values
        for k, (no, _, want) in enumerate(values):
            if mask(crcs[at + k]) != want:
                good, error, failed = values[:k], CRC_MISMATCH, no
                break
        at += len(values)
        out.append(([v for _, v, _ in good], error, failed))
    return out


def decode_chunks(chunks):
    """(values, error, number of the failing chunk among chunks)."""
    return decode_many([chunks])[0]


def try_unframe_many(streams) -> list[dict]:
    """For each stream ok, error, error_chunk and value: all that comes before
    the first bad chunk, and nothing after it."""
    out = []
    for run in _together(streams):
        split = [split_chunks(s) for s in run]
        for (chunks, _, _, error), (values, bad, at) in zip(split, decode_many([c[0] for c in split])):
            if bad is None and error is not None:
                bad, at = error, len(chunks)
            out.append(dict(ok=bad is None, error=bad, error_chunk=at, value=b"".join(values)))
    return out


def try_unframe(data) -> dict:
    return try_unframe_many([data])[0]


def _value(out: dict) -> bytes:
    if not out["ok"]:
        raise CodecError(out["error"], out["error_chunk"])
    return out["value"]


def unframe_many(streams) -> list[bytes]:
    return [_value(out) for out in try_unframe_many(streams)]


def unframe(data) -> bytes:
    return _value(try_unframe(data))
