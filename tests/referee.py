"""A plain decoder, written from the format alone, to judge the codec by."""


def varint(n):
    out = []
    while True:
        n, low = n >> 7, n & 127
        out.append(low | (128 if n else 0))
        if not n:
            return bytes(out)


def decode(block):
    """The decoded bytes, or None for anything malformed."""
    n = at = 0
    for i in range(5):
        if i >= len(block):
            return None
        n |= (block[i] & 127) << 7 * i
        at = i + 1
        if block[i] < 128:
            break
    else:
        return None
    if n >= 2**31 or (i == 4 and block[4] > 15):
        return None
    out = bytearray()
    while at < len(block):
        tag, at = block[at], at + 1
        if tag & 3 == 0:
            length = tag >> 2
            if length >= 60:
                k = length - 59
                if at + k > len(block):
                    return None
                length, at = int.from_bytes(block[at : at + k], "little"), at + k
            length += 1
            if at + length > len(block):
                return None
            out += block[at : at + length]
            at += length
        else:
            k = (0, 1, 2, 4)[tag & 3]
            if at + k > len(block):
                return None
            offset, at = int.from_bytes(block[at : at + k], "little"), at + k
            length = (tag >> 2) + 1
            if k == 1:
                offset, length = offset | (tag >> 5) << 8, (tag >> 2 & 7) + 4
            if not 0 < offset <= len(out):
                return None
            for _ in range(length):
                out.append(out[-offset])
        if len(out) > n:
            return None
    return bytes(out) if len(out) == n else None


def crc32c(data, crc=0):
    crc ^= 0xFFFFFFFF
    for byte in data:
        crc ^= byte
        for _ in range(8):
            crc = crc >> 1 ^ (0x82F63B78 if crc & 1 else 0)
    return crc ^ 0xFFFFFFFF


def _crcs():
    table = []
    for i in range(256):
        for _ in range(8):
            i = i >> 1 ^ (0x82F63B78 if i & 1 else 0)
        table.append(i)
    return table


TABLE = _crcs()


def masked(data):
    crc = 0xFFFFFFFF
    for byte in data:
        crc = TABLE[(crc ^ byte) & 255] ^ crc >> 8
    crc ^= 0xFFFFFFFF
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def unframe(stream):
    """(what comes before the first bad chunk, whether there is none), from the
    framing format alone."""
    out, at = bytearray(), 0
    while at < len(stream):
        kind, size = stream[at], int.from_bytes(stream[at + 1 : at + 4], "little")
        body = stream[at + 4 : at + 4 + size]
        if len(stream) - at < 4 or len(body) < size or 2 <= kind < 128:
            return bytes(out), False
        if kind == 255 and body != b"sNaPpY":
            return bytes(out), False
        if kind < 2:
            value = (decode(body[4:]) if kind == 0 else body[4:]) if size >= 4 else None
            if value is None or len(value) > 65536 or masked(value) != int.from_bytes(body[:4], "little"):
                return bytes(out), False
            out += value
        at += 4 + size
    return bytes(out), True


def payloads(rng, count):
    """Text-like, random, repetitive and mixed values, sizes near the limits."""
    sizes = (0, 1, 2, 14, 15, 16, 17, 59, 60, 61, 255, 256, 257, 4095, 65535, 65536, 65537, 140_000)
    for i in range(count):
        n = rng.choice(sizes) if rng.random() < 0.5 else rng.randint(0, 3000)
        kind = i % 4
        if kind == 0:
            yield rng.randbytes(n)
        elif kind == 1:
            yield (b"the quick brown fox %d " % rng.randint(0, 99) * (n // 20 + 1))[:n]
        elif kind == 2:
            yield (rng.randbytes(rng.randint(1, 9)) * (n + 1))[:n]
        else:
            yield (rng.randbytes(n // 2) + b"a" * n)[:n]


def mutated(rng, data):
    """data with a bit flipped, a byte set, cut, a slice doubled or dropped, or
    its header changed."""
    b = bytearray(data)
    if not b:
        return bytes([rng.randrange(256)])
    at = rng.randrange(len(b))
    match rng.randrange(6):
        case 0:
            b[at] ^= 1 << rng.randrange(8)
        case 1:
            b[at] = rng.randrange(256)
        case 2:
            del b[at:]
        case 3:
            b[at:at] = b[at : at + rng.randint(1, 9)]
        case 4:
            b[0] = rng.randrange(256)
        case 5:
            del b[at : at + rng.randint(1, 9)]
    return bytes(b)
