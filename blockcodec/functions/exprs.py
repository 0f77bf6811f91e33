"""What the codec needs no Python for: Column expressions, all code-generated."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .constants import BLOCK_SIZE, CRC_MASK_DELTA, EXPANSION_LIMIT, MAX_LENGTH


def _long(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("long")


def _hex(n: Column, digits: int) -> Column:
    return F.lpad(F.hex(n), digits, "0")


def le_bytes(n: Column, size: int) -> Column:
    """An integer as `size` little-endian bytes."""
    return F.unhex(F.concat(*[_hex(F.shiftrightunsigned(n, 8 * i).bitwiseAND(F.lit(255)), 2) for i in range(size)]))


def le_integer(data: Column, start: int, size: int) -> Column:
    """Little-endian bytes from a 1-based start, as a long."""
    parts = [F.conv(F.hex(F.substring(data, start + i, 1)), 16, 10).cast("long") * F.lit(256**i) for i in range(size)]
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return total


def max_compressed_length(n) -> Column:
    """The bound for n bytes; an error below 0 or where it passes 2^31 - 1."""
    n = _long(n)
    rest = n % BLOCK_SIZE
    whole = (F.lit(32 + BLOCK_SIZE) + F.lit(BLOCK_SIZE // 6)) * F.floor(n / BLOCK_SIZE).cast("long")
    bound = F.lit(5) + whole + F.when(rest > 0, F.lit(32) + rest + F.floor(rest / 6).cast("long")).otherwise(0)
    bad = F.raise_error(F.lit("INVALID_LENGTH: out of range")).cast("long")
    return F.when((n < 0) | (bound > MAX_LENGTH), bad).otherwise(bound)


def try_max_compressed_length(n) -> Column:
    n = _long(n)
    fits = (n >= 0) & (n <= MAX_LENGTH)
    return F.when(fits, F.when(_bound(n) <= MAX_LENGTH, _bound(n)))


def _bound(n: Column) -> Column:
    rest = n % BLOCK_SIZE
    return F.lit(5) + F.floor(n / BLOCK_SIZE).cast("long") * (32 + BLOCK_SIZE + BLOCK_SIZE // 6) + F.when(rest > 0, 32 + rest + F.floor(rest / 6).cast("long")).otherwise(0)


def varint_size(n) -> Column:
    n = _long(n)
    return F.when(n < 1 << 7, 1).when(n < 1 << 14, 2).when(n < 1 << 21, 3).when(n < 1 << 28, 4).otherwise(5)


def varint(n) -> Column:
    """n below 2^32 as base-128 bytes, least first."""
    n = _long(n)
    more = [_hex(F.shiftrightunsigned(n, 7 * i).bitwiseAND(F.lit(127)).bitwiseOR(F.lit(128)), 2) for i in range(4)]
    last = [_hex(F.shiftrightunsigned(n, 7 * i).bitwiseAND(F.lit(127)), 2) for i in range(5)]
    out = F.unhex(F.concat(*more, last[4]))
    for i in range(3, -1, -1):
        out = F.when(n < 1 << 7 * (i + 1), F.unhex(F.concat(*more[:i], last[i]))).otherwise(out)
    return out


def _byte(data: Column, i: int) -> Column:
    """Byte i (from 0) as a long; null beyond the end."""
    return F.when(F.octet_length(data) > i, F.conv(F.hex(F.substring(data, i + 1, 1)), 16, 10).cast("long"))


def varint_status(data: Column) -> Column:
    """DONE, NEED_MORE_DATA or INVALID_DATA."""
    out = F.when(_byte(data, 4).isNull(), F.lit("NEED_MORE_DATA")).when(_byte(data, 4) > 15, F.lit("INVALID_DATA")).otherwise(F.lit("DONE"))
    for i in range(3, -1, -1):
        out = F.when(_byte(data, i).isNull(), F.lit("NEED_MORE_DATA")).when(_byte(data, i) < 128, F.lit("DONE")).otherwise(out)
    return F.when(data.isNotNull(), out)


def varint_length(data: Column) -> Column:
    """The bytes that a complete varint takes; null where there is none."""
    out = F.when(_byte(data, 4) <= 15, F.lit(5))
    for i in range(3, -1, -1):
        out = F.when(_byte(data, i) < 128, F.lit(i + 1)).when(_byte(data, i).isNotNull(), out)
    return out


def varint_value(data: Column) -> Column:
    """The value of a complete varint; null where there is none."""
    size = varint_length(data)
    total = F.lit(0).cast("long")
    for i in range(5):
        total = total + F.when(size > i, (_byte(data, i) % 128) * F.lit(1 << 7 * i)).otherwise(0)
    return F.when(size.isNotNull(), total)


def uncompressed_length(block: Column) -> Column:
    """What a block's header declares; the tags are not looked at."""
    n = varint_value(block)
    bad = F.raise_error(F.lit("INVALID_LENGTH")).cast("int")
    return F.when(block.isNull(), F.lit(None).cast("int")).when(n.isNull() | (n > MAX_LENGTH), bad).otherwise(n.cast("int"))


def try_uncompressed_length(block: Column) -> Column:
    n = varint_value(block)
    return F.when(n <= MAX_LENGTH, n.cast("int"))


def is_plausible(block: Column) -> Column:
    """Whether the declared length can come from so many bytes of tags."""
    n, body = varint_value(block), F.octet_length(block) - varint_length(block)
    return F.coalesce((n <= MAX_LENGTH) & (n <= body.cast("long") * EXPANSION_LIMIT) & ((n > 0) | (body == 0)), F.when(block.isNotNull(), F.lit(False)))


def mask_crc(crc) -> Column:
    crc = _long(crc)
    turned = F.shiftrightunsigned(crc, 15).bitwiseOR(F.shiftleft(crc.bitwiseAND(F.lit(32767)), 17))
    return (turned + CRC_MASK_DELTA).bitwiseAND(F.lit(0xFFFFFFFF))


def unmask_crc(masked) -> Column:
    turned = (_long(masked) - CRC_MASK_DELTA).bitwiseAND(F.lit(0xFFFFFFFF))
    return F.shiftrightunsigned(turned, 17).bitwiseOR(F.shiftleft(turned.bitwiseAND(F.lit(131071)), 15))


def literal_tag(data: Column) -> Column:
    """data (1 byte or more) as one literal element."""
    n = F.octet_length(data).cast("long") - 1
    short = F.unhex(_hex(n * 4, 2))
    long_ = [F.concat(F.unhex(F.lit(f"{(59 + k) << 2:02X}")), le_bytes(n, k)) for k in (1, 2, 3, 4)]
    return F.concat(F.when(n < 60, short).when(n < 1 << 8, long_[0]).when(n < 1 << 16, long_[1]).when(n < 1 << 24, long_[2]).otherwise(long_[3]), data)


def literal_block(data: Column) -> Column:
    """A valid block without any copies; what encoders make of 1 to 15 bytes."""
    n = F.octet_length(data)
    return F.when(n == 0, F.unhex(F.lit("00"))).otherwise(F.concat(varint(n), literal_tag(data)))


def copy_tag(offset: Column, length: Column) -> Column:
    """A copy element of up to 64 bytes: two bytes where length is 4 to 11 and
    offset below 2,048, three where offset is below 65,536, else five."""
    offset, length = _long(offset), _long(length)
    near = F.unhex(F.concat(_hex(F.shiftrightunsigned(offset, 8) * 32 + (length - 4) * 4 + 1, 2), _hex(offset.bitwiseAND(F.lit(255)), 2)))
    far = F.concat(F.unhex(_hex((length - 1) * 4 + 2, 2)), le_bytes(offset, 2))
    farther = F.concat(F.unhex(_hex((length - 1) * 4 + 3, 2)), le_bytes(offset, 4))
    return F.when(length.between(4, 11) & (offset < 2048), near).when(offset < 1 << 16, far).otherwise(farther)


def chunk(kind: Column, body: Column) -> Column:
    """A framed chunk: type, three bytes of length, body."""
    return F.concat(F.unhex(_hex(kind, 2)), le_bytes(F.octet_length(body).cast("long"), 3), body)


def fragment_count(data: Column) -> Column:
    return F.floor((F.octet_length(data) + F.lit(BLOCK_SIZE - 1)) / BLOCK_SIZE).cast("int")
