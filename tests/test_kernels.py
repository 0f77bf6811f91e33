import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import referee
from blockcodec.functions import constants as C
from blockcodec.functions import kernels as K
from blockcodec.functions.crc import combine, crc32c, crc32c_many, mask
from blockcodec.plans.parallel import ParallelOptions


@given(st.binary(max_size=3000))
@settings(max_examples=150, deadline=None)
def test_round_trip(data):
    block = K.compress(data)
    assert K.decompress(block) == data == referee.decode(block)
    assert K.uncompressed_length(block)[0] == len(data)
    assert K.unframe(K.frame(data)) == data


def test_round_trip_at_the_limits():
    for data in referee.payloads(random.Random(5), 120):
        assert K.decompress(K.compress(data)) == data
        assert K.unframe(K.frame(data)) == data


def test_mutations_get_the_referees_verdict():
    rng, bad = random.Random(7), 0
    for data in referee.payloads(rng, 600):
        block = referee.mutated(rng, K.compress(data[:600]))
        want = referee.decode(block)
        try:
            got = K.decompress(block)
        except K.CodecError as e:
            assert e.code in (C.CORRUPT_BLOCK, C.INVALID_LENGTH)
            got, bad = None, bad + 1
        assert got == want, block.hex()
        assert K.is_valid(block) == (want is not None)
    assert bad > 100


def test_mutated_streams_give_a_prefix_or_an_error():
    rng = random.Random(9)
    for data in referee.payloads(rng, 300):
        stream = referee.mutated(rng, K.frame(data))
        out = K.try_unframe(stream)
        value, ok = referee.unframe(stream)
        assert (out["ok"], out["value"]) == (ok, value), stream[:40].hex()
        assert out["ok"] == (out["error"] is None) == (out["error_chunk"] is None)


@pytest.mark.parametrize("n", [*range(1, 16)])
def test_short_values_are_one_literal(n):
    for data in (b"a" * n, bytes(range(n)), b"ab" * n):
        data = data[:n]
        assert K.compress(data) == bytes([n, (n - 1) * 4]) + data


def test_fragments_are_compressed_apart():
    data = b"abcdefgh" * 30_000
    whole = K.varint(len(data)) + b"".join(K.compress_fragment(p) for p in K.pieces_of(data))
    assert whole == K.compress(data)
    assert K.compress_fragment(b"") == b""
    with pytest.raises(ValueError):
        K.compress_fragment(b"x" * 65537)


@pytest.mark.parametrize("data,status", [(b"", "NEED_MORE_DATA"), (b"\x80" * 4, "NEED_MORE_DATA"), (b"\x80" * 5, "INVALID_DATA"), (b"\xff" * 4 + b"\x10", "INVALID_DATA"), (b"\xff" * 4 + b"\x0f", "DONE"), (b"\x80\x00", "DONE")])
def test_varint_status(data, status):
    assert K.parse_varint(data)[0] == status


@pytest.mark.parametrize("n", [0, 127, 128, 16383, 16384, 2097151, 2097152, 268435455, 268435456, 4294967295])
def test_varint(n):
    assert K.varint(n) == referee.varint(n)
    assert K.parse_varint(K.varint(n)) == ("DONE", n, len(K.varint(n)))


def test_every_tag_byte():
    for tag in range(256):
        kind = tag & 3
        body = bytes([tag]) + b"\x05\x00\x00\x00"[: {0: 0, 1: 1, 2: 2, 3: 4}[kind]]
        if kind == 0 and tag >> 2 >= 60:
            body += b"\x00" * (tag >> 2) and (4).to_bytes((tag >> 2) - 59, "little")
        length = (tag >> 2) + 1
        if kind == 0:
            length = 5 if length > 60 else length
            body += b"x" * length
        elif kind == 1:
            length = (tag >> 2 & 7) + 4
        (t,) = K.tags(b"\x7f" + body)
        assert (t["kind"], t["length"]) == (("literal", "copy1", "copy2", "copy4")[kind], length)
        if kind:
            assert t["offset"] == 5 + ((tag >> 5) << 8 if kind == 1 else 0)


def test_overlap_grid():
    for offset in range(1, 71):
        pattern = bytes((i * 7 + 1) % 251 for i in range(offset))
        for length in (1, 2, 3, 4, 8, 11, 12, 31, 60, 63, 64):
            literal = bytes([60 << 2, offset - 1]) if offset > 60 else bytes([(offset - 1) << 2])
            block = K.varint(offset + length) + literal + pattern + bytes([(length - 1) << 2 | 2]) + offset.to_bytes(2, "little")
            assert K.decompress(block) == referee.decode(block) == (pattern * 66)[: offset + length]


def test_copy_from_another_fragment():
    literal = bytes(range(256)) * 300
    block = K.varint(len(literal) + 40) + bytes([62 << 2]) + (len(literal) - 1).to_bytes(3, "little") + literal + bytes([39 << 2 | 3]) + (70_000).to_bytes(4, "little")
    assert K.decompress(block) == literal + literal[-70_000 : -70_000 + 40]


def test_crc_known_answers():
    assert crc32c(b"123456789") == 0xE3069283
    assert crc32c(b"a") == 0xC1D04330
    assert mask(crc32c(b"a")) == ((0xC1D04330 >> 15 | 0xC1D04330 << 17) + 0xA282EAD8) & 0xFFFFFFFF


def test_crc_against_the_plain_loop():
    rng = random.Random(3)
    values = [rng.randbytes(n) for n in (0, 1, 2, 3, 7, 8, 9, 63, 64, 65, 127, 1000, 1024, 1025, 4097, 70_000)]
    assert crc32c_many([*values, None]).tolist() == [*(referee.crc32c(v) for v in values), 0]
    a, b = values[11], values[9]
    assert int(combine(crc32c(a), crc32c(b), len(b))[0]) == crc32c(a + b)
    assert int(crc32c_many([b], [crc32c(a)])[0]) == crc32c(a + b)


def test_writes_and_flushes():
    assert K.frame_writes([]) == b""
    assert K.frame_writes([(b"", False)]) == C.IDENTIFIER
    data = bytes(range(256)) * 600
    once = K.frame_writes([(data, False)])
    assert once == K.frame(data) == K.frame_writes([(data[:100], False), (data[100:], False)])
    flushed = K.frame_writes([(data[:100], True), (data[100:], True)])
    assert flushed != once and K.unframe(flushed) == data
    assert len([c for c in K.split_chunks(flushed)[0] if c[1] < 2]) == 1 + -(-(len(data) - 100) // 65536)


def test_stored_where_compression_does_not_pay():
    data = random.Random(1).randbytes(256)
    framed = K.frame(data)
    assert len(framed) == 10 + 8 + 256 and framed[10] == C.UNCOMPRESSED_DATA


def test_earliest_error_wins():
    good, bad = K.frame(b"good"), K.chunk(1, b"\0\0\0\0oops")
    out = K.try_unframe(good + bad + b"\x02\0\0\0")
    assert (out["error"], out["error_chunk"], out["value"]) == (C.CRC_MISMATCH, 2, b"good")
    out = K.try_unframe(good + b"\x02\0\0\0" + bad)
    assert (out["error"], out["error_chunk"]) == (C.UNKNOWN_CHUNK_TYPE, 2)


@pytest.mark.parametrize("size", [1, 2, 3, 7, 10, 1000])
def test_incremental_split(size):
    stream = K.chunk(200, b"skipped" * 50) + K.frame(b"abc" * 50_000) + K.chunk(254, b"\0" * 9)
    tail, skip, got = b"", 0, []
    for at in range(0, len(stream), size if size > 50 else size * 50):
        data = stream[at : at + (size if size > 50 else size * 50)]
        gone = min(skip, len(data))
        data, skip = tail + data[gone:], skip - gone
        chunks, used, more, error = K.split_chunks(data, final=False)
        assert error is None
        skip, tail = skip + more, data[used:]
        got += K.decode_chunks(chunks)[0]
    assert b"".join(got) == b"abc" * 50_000 and not tail and not skip


def test_options():
    with pytest.raises(ValueError):
        ParallelOptions(partitions=0)
    with pytest.raises(ValueError):
        ParallelOptions(min_length=-1)
    assert ParallelOptions().min_length == 262_144
    assert C.MAX_CHUNK_BODY == 76_499


def test_many_at_once_equals_one_by_one():
    rng = random.Random(6)
    values = [*referee.payloads(rng, 60), b"", rng.randbytes(300_000)]
    assert K.frame_many(values) == [K.frame(v) for v in values]
    streams = [referee.mutated(rng, s) if k % 3 == 0 else s for k, s in enumerate(K.frame_many(values))]
    assert K.try_unframe_many(streams) == [K.try_unframe(s) for s in streams]
    assert [referee.unframe(s) for s in streams] == [(o["value"], o["ok"]) for o in K.try_unframe_many(streams)]


def test_elements_over_windows(monkeypatch):
    """Elements that reach over the windows they are looked up in."""
    data = b"".join(random.Random(5).randbytes(700) + b"abc" * 90 for _ in range(60))
    block = K.compress(data)
    want = K.tags(block)
    for size in (1, 7, 64, 1000):
        monkeypatch.setattr(K, "WINDOW", size)
        assert K.tags(block) == want and K.is_valid(block) and not K.is_valid(block[:-1])
    assert sum(t["length"] for t in want) == len(data)
