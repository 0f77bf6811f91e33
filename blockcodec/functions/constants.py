"""Fixed values of the block and framing formats."""

BLOCK_SIZE = 65536
VARINT_MAX = 5
MAX_LENGTH = 2**31 - 1
#: A valid block cannot declare more than this many bytes per byte of tags.
EXPANSION_LIMIT = 22
CHUNK_HEADER = 4
CHECKSUM = 4
IDENTIFIER_BODY = b"sNaPpY"
IDENTIFIER = b"\xff\x06\x00\x00" + IDENTIFIER_BODY
COMPRESSED_DATA, UNCOMPRESSED_DATA, PADDING, STREAM_IDENTIFIER = 0x00, 0x01, 0xFE, 0xFF
FIRST_SKIPPABLE = 0x80
MAX_CHUNK_BODY = CHECKSUM + VARINT_MAX + 32 + BLOCK_SIZE + BLOCK_SIZE // 6
CRC_POLYNOMIAL = 0x82F63B78
CRC_MASK_DELTA = 0xA282EAD8

# Error codes of the try_ functions.
INVALID_LENGTH = "INVALID_LENGTH"
CORRUPT_BLOCK = "CORRUPT_BLOCK"
INVALID_CHUNK_LENGTH = "INVALID_CHUNK_LENGTH"
INVALID_STREAM_IDENTIFIER = "INVALID_STREAM_IDENTIFIER"
UNKNOWN_CHUNK_TYPE = "UNKNOWN_CHUNK_TYPE"
CRC_MISMATCH = "CRC_MISMATCH"
UNEXPECTED_END = "UNEXPECTED_END"
