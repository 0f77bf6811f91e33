"""The codec's query catalogue and its DuckDB SQL.

Encoders may differ in the bytes they choose, so the SQL states what any valid
encoder must give: decoded values, geometry, and exact bytes only for values of
1 to 15 bytes, which can only come out as one literal.
"""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import functions as F

from .functions import codec, exprs
from .functions.constants import BLOCK_SIZE, IDENTIFIER
from .operators import tables
from .plans import parallel
from .register import register_all
from .streaming.frames import frame_stream, unframe_stream

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def add(fn):
        QUERIES[fn.__name__] = fn
        ORACLE_SQL[fn.__name__] = sql
        return fn

    return add


def read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(c):
    return F.encode(F.col(c) if isinstance(c, str) else c, "UTF-8")


def n_bytes(c):
    return F.octet_length(c).cast("long")


# SQL shapes that several queries share.
def sql_varint(n: str) -> str:
    part = [f"printf('%02X', (({n} >> {7 * i}) & 127) | 128)" for i in range(4)]
    last = [f"printf('%02X', ({n} >> {7 * i}) & 127)" for i in range(5)]
    whens = " ".join(f"WHEN {n} < {1 << 7 * (i + 1)} THEN {' || '.join([*part[:i], last[i]])}" for i in range(4))
    return f"(CASE {whens} ELSE {' || '.join([*part, last[4]])} END)"


def sql_block(s: str) -> str:
    """The only block of 1 to 15 bytes without copies."""
    return f"(printf('%02X%02X', octet_length(encode({s})), (octet_length(encode({s})) - 1) * 4) || hex(encode({s})))"


CRC_TABLE = """RECURSIVE steps(i, k, c) AS (
    SELECT range::BIGINT, 0, range::BIGINT FROM range(256)
    UNION ALL SELECT i, k + 1, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 2197175160) ELSE c >> 1 END FROM steps WHERE k < 8
), crctab AS (SELECT list(c ORDER BY i) AS tab FROM steps WHERE k = 8)"""


def sql_crc(s: str) -> str:
    data = f"list_transform(range(1, octet_length(encode({s})) + 1), lambda j: ('0x' || substr(hex(encode({s})), 2 * j - 1, 2))::BIGINT)"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {data}), lambda acc, v: xor(tab[(xor(acc, v) & 255) + 1], acc >> 8)), 4294967295)"


def sql_mask(c: str) -> str:
    return f"(((({c}) >> 15) | ((({c}) & 32767) << 17)) + 2726488792) & 4294967295"


def sql_le(n: str, size: int) -> str:
    return "(" + " || ".join(f"printf('%02X', (({n}) >> {8 * i}) & 255)" for i in range(size)) + ")"


#: Documents of 200 ids in a row as one value: 5 to 15 fragments each.
SQL_BLOBS = "(SELECT doc_id // 200 AS blob, string_agg(text, '' ORDER BY doc_id) AS t FROM documents GROUP BY 1)"


def blobs(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select(F.expr("doc_id div 200").alias("blob"), "doc_id", utf8("text").alias("part"))
    return tables.gathered(docs, ["blob"], "doc_id", "part", "data")


# Blocks.


def _roundtrip(df, key):
    back = codec.snappy_decompress(codec.snappy_compress(F.col("data")))
    return df.select(key, "data", back.alias("back")).groupBy(key).agg(F.count("*").alias("n"), F.sum(n_bytes("data")).alias("raw_bytes"), F.sum((F.md5("data") == F.md5("back")).cast("long")).alias("n_equal"))


def _sql_roundtrip(key, text, name):
    return f"SELECT {key}, count(*) AS n, sum(octet_length(encode({text})))::BIGINT AS raw_bytes, count(*) AS n_equal FROM {name} GROUP BY {key}"


@query(_sql_roundtrip("lang", "text", "documents"))
def q_roundtrip_documents(spark, sf_dir):
    return _roundtrip(read(spark, sf_dir, "documents").select("lang", utf8("text").alias("data")), "lang")


@query(_sql_roundtrip("k", "html", "(SELECT octet_length(encode(url)) % 7 AS k, html FROM pages)"))
def q_roundtrip_pages(spark, sf_dir):
    return _roundtrip(read(spark, sf_dir, "pages").select((F.octet_length("url") % 7).cast("long").alias("k"), utf8("html").alias("data")), "k")


@query(_sql_roundtrip("role", "text", "conversations"))
def q_roundtrip_conversations(spark, sf_dir):
    return _roundtrip(read(spark, sf_dir, "conversations").select("role", utf8("text").alias("data")), "role")


LINE = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus")


@query(_sql_roundtrip("l_returnflag", "concat_ws(',', " + ", ".join(f"{c}::VARCHAR" for c in LINE) + ")", "lineitem"))
def q_roundtrip_lineitem(spark, sf_dir):
    line = F.concat_ws(",", *[F.col(c).cast("string") for c in LINE])
    return _roundtrip(read(spark, sf_dir, "lineitem").select("l_returnflag", utf8(line).alias("data")), "l_returnflag")


@query(f"SELECT n_name, {sql_block('n_name')} AS block_hex FROM nation")
def q_canonical_block_nation(spark, sf_dir):
    return read(spark, sf_dir, "nation").select("n_name", F.hex(codec.snappy_compress(utf8("n_name"))).alias("block_hex"))


@query(f"SELECT event_type, {sql_block('event_type')} AS block_hex, count(*) AS n FROM events GROUP BY event_type")
def q_canonical_block_event_type(spark, sf_dir):
    counted = read(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    return counted.select("event_type", F.hex(codec.snappy_compress(utf8("event_type"))).alias("block_hex"), "n")


@query(f"SELECT o_orderpriority, {sql_block('o_orderpriority')} AS block_hex, {sql_block('o_orderpriority')} AS built_hex FROM (SELECT DISTINCT o_orderpriority FROM orders)")
def q_canonical_block_priority(spark, sf_dir):
    some = read(spark, sf_dir, "orders").select("o_orderpriority").distinct()
    return some.select("o_orderpriority", F.hex(codec.snappy_compress(utf8("o_orderpriority"))).alias("block_hex"), F.hex(exprs.literal_block(utf8("o_orderpriority"))).alias("built_hex"))


@query("SELECT o_orderkey, " + sql_varint("v") + " AS varint_hex, (octet_length(unhex(" + sql_varint("v") + ")))::INTEGER AS size, 'DONE' AS status, v AS value, octet_length(unhex(" + sql_varint("v") + "))::INTEGER AS parsed_size FROM (SELECT o_orderkey, (o_orderkey * 104729) % 4294967296 AS v FROM orders)")
def q_varint_orders(spark, sf_dir):
    v = (F.col("o_orderkey").cast("long") * 104729) % F.lit(1 << 32)
    made = read(spark, sf_dir, "orders").select("o_orderkey", v.alias("v")).withColumn("b", exprs.varint("v"))
    b = F.col("b")
    return made.select("o_orderkey", F.hex(b).alias("varint_hex"), exprs.varint_size("v").alias("size"), exprs.varint_status(b).alias("status"), exprs.varint_value(b).alias("value"), exprs.varint_length(b).alias("parsed_size"))


VARINTS = [("", "NEED_MORE_DATA", None), ("80", "NEED_MORE_DATA", None), ("80808080", "NEED_MORE_DATA", None), ("8080808010", "INVALID_DATA", None), ("FFFFFFFF80", "INVALID_DATA", None), ("FFFFFFFF0F", "DONE", 4294967295), ("8000", "DONE", 0), ("7F", "DONE", 127), ("8001FF", "DONE", 128), ("FFFFFFFF07", "DONE", 2147483647)]


def sql_rows(rows, *names):
    def lit(x):
        return "NULL" if x is None else str(x).lower() if isinstance(x, bool) else f"'{x}'" if isinstance(x, str) else str(x)

    return f"(VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) v({', '.join(names)})"


@query(f"SELECT data, status, coalesce(value, -1)::BIGINT AS value, (CASE WHEN value <= 2147483647 THEN value ELSE -1 END)::INTEGER AS length FROM {sql_rows(VARINTS, 'data', 'status', 'value')}")
def q_varint_malformed(spark, sf_dir):
    b = F.unhex("data")
    return spark.createDataFrame([(x,) for x, _, _ in VARINTS], "data string").select("data", exprs.varint_status(b).alias("status"), F.coalesce(exprs.varint_value(b), F.lit(-1)).cast("long").alias("value"), F.coalesce(exprs.try_uncompressed_length(b), F.lit(-1)).alias("length"))


@query("SELECT o_orderkey, 5 + (n // 65536) * 76490 + CASE WHEN n % 65536 > 0 THEN 32 + n % 65536 + (n % 65536) // 6 ELSE 0 END AS bound FROM (SELECT o_orderkey, o_orderkey * 37 AS n FROM orders)")
def q_max_compressed_length(spark, sf_dir):
    return read(spark, sf_dir, "orders").select("o_orderkey", exprs.max_compressed_length(F.col("o_orderkey").cast("long") * 37).alias("bound"))


@query(f"SELECT n_name, NULL::VARCHAR AS one_short, {sql_block('n_name')} AS exact FROM nation")
def q_try_compress_capacity(spark, sf_dir):
    n, data = F.octet_length(utf8("n_name")), utf8("n_name")
    return read(spark, sf_dir, "nation").select("n_name", F.hex(codec.try_snappy_compress(data, n + 1)).alias("one_short"), F.hex(codec.try_snappy_compress(data, n + 2)).alias("exact"))


@query("SELECT doc_id, octet_length(encode(text))::INTEGER AS length, true AS plausible FROM documents")
def q_uncompressed_length(spark, sf_dir):
    made = read(spark, sf_dir, "documents").select("doc_id", codec.snappy_compress(utf8("text")).alias("block"))
    return made.select("doc_id", exprs.uncompressed_length(F.col("block")).alias("length"), exprs.is_plausible(F.col("block")).alias("plausible"))


@query(f"SELECT blob, f::INTEGER AS fragment_no, f * 65536 AS start, octet_length(p)::INTEGER AS len, md5(p) AS md5 FROM (SELECT blob, f, unhex(substr(hex(encode(t)), f * 131072 + 1, 131072)) AS p FROM (SELECT blob, t, unnest(range(0, (octet_length(encode(t)) + 65535) // 65536)) AS f FROM {SQL_BLOBS}))")
def q_fragments(spark, sf_dir):
    return tables.fragments(blobs(spark, sf_dir), "data", ["blob"]).select("blob", "fragment_no", "start", "len", F.md5("bytes").alias("md5"))


@query("SELECT conv_id, octet_length(encode(t))::INTEGER AS n, md5(t) AS md5 FROM (SELECT conv_id, string_agg(text, '' ORDER BY turn) AS t FROM conversations GROUP BY conv_id)")
def q_segmented_compress(spark, sf_dir):
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", utf8("text").alias("part"))
    whole = tables.gathered(turns, ["conv_id"], "turn", "part", "data")
    made = whole.select("conv_id", codec.snappy_compress(F.col("data")).alias("block"))
    return made.select("conv_id", exprs.uncompressed_length(F.col("block")).alias("n"), F.md5(codec.snappy_decompress(F.col("block"))).alias("md5"))


@query("SELECT conv_id, md5(t) AS md5 FROM (SELECT conv_id, string_agg(text, '' ORDER BY turn) AS t FROM conversations GROUP BY conv_id)")
def q_segmented_decompress(spark, sf_dir):
    """A block that arrives in pieces: cut in 100 bytes, gathered, decoded."""
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", utf8("text").alias("part"))
    block = tables.gathered(turns, ["conv_id"], "turn", "part", "data").select("conv_id", codec.snappy_compress(F.col("data")).alias("b"))
    cut = block.withColumn("i", F.explode(F.sequence(F.lit(0), F.expr("(octet_length(b) - 1) div 100")))).select("conv_id", "i", F.expr("substring(b, i * 100 + 1, 100)").alias("part"))
    return tables.gathered(cut, ["conv_id"], "i", "part", "block").select("conv_id", F.md5(codec.snappy_decompress(F.col("block"))).alias("md5"))


@query(f"SELECT blob, octet_length(encode(t))::BIGINT AS n, true AS same_block, true AS same_frames FROM {SQL_BLOBS}")
def q_parallel_equals_single(spark, sf_dir):
    data = blobs(spark, sf_dir)
    options = parallel.ParallelOptions(partitions=7, min_length=100_000)
    cell = data.select("blob", n_bytes("data").alias("n"), codec.snappy_compress(F.col("data")).alias("b1"), codec.snappy_frame(F.col("data")).alias("f1"))
    block = parallel.compress_parallel(data, "data", ["blob"], options).withColumnRenamed("block", "b2")
    frames = parallel.frame_parallel(data, "data", ["blob"], options).withColumnRenamed("frames", "f2")
    return cell.join(block, "blob").join(frames, "blob").select("blob", "n", (F.col("b1") == F.col("b2")).alias("same_block"), (F.col("f1") == F.col("f2")).alias("same_frames"))


@query(f"SELECT blob, true AS ok, NULL::VARCHAR AS error, md5(t) AS md5 FROM {SQL_BLOBS}")
def q_parallel_unframe(spark, sf_dir):
    frames = parallel.frame_parallel(blobs(spark, sf_dir), "data", ["blob"])
    return parallel.unframe_parallel(frames, "frames", ["blob"]).select("blob", "ok", "error", F.md5("value").alias("md5"))


@query(f"SELECT blob, true AS same FROM {SQL_BLOBS}")
def q_crc32c_parallel(spark, sf_dir):
    data = blobs(spark, sf_dir)
    whole = data.select("blob", codec.crc32c(F.col("data")).alias("c1"))
    return whole.join(parallel.crc32c_parallel(data, "data", ["blob"]), "blob").select("blob", (F.col("c1") == F.col("crc")).alias("same"))


# Checksums.


@query(f"WITH {CRC_TABLE} SELECT n_name, {sql_crc('n_name')}::BIGINT AS crc, ({sql_mask(sql_crc('n_name'))})::BIGINT AS masked FROM nation, crctab")
def q_crc32c_short(spark, sf_dir):
    return read(spark, sf_dir, "nation").select("n_name", codec.crc32c(utf8("n_name")).alias("crc")).select("n_name", "crc", exprs.mask_crc("crc").alias("masked"))


@query(f"WITH {CRC_TABLE}, d AS (SELECT DISTINCT event_type FROM events) SELECT event_type, ({sql_mask(sql_crc('event_type'))})::BIGINT AS masked, {sql_crc('event_type')}::BIGINT AS unmasked FROM d, crctab")
def q_crc32c_masked(spark, sf_dir):
    some = read(spark, sf_dir, "events").select("event_type").distinct()
    return some.select("event_type", codec.masked_crc32c(utf8("event_type")).alias("masked")).select("event_type", "masked", exprs.unmask_crc("masked").alias("unmasked"))


NAMED = "(SELECT n_name, r_name, n_name || r_name AS both_names FROM nation JOIN region ON n_regionkey = r_regionkey)"


def _named(spark, sf_dir):
    n, r = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    return n.join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "r_name", utf8("n_name").alias("a"), utf8("r_name").alias("b"))


@query(f"WITH {CRC_TABLE} SELECT n_name, r_name, {sql_crc('both_names')}::BIGINT AS crc FROM {NAMED}, crctab")
def q_crc32c_append(spark, sf_dir):
    return _named(spark, sf_dir).select("n_name", "r_name", codec.crc32c_append(codec.crc32c(F.col("a")), F.col("b")).alias("crc"))


@query(f"WITH {CRC_TABLE} SELECT n_name, r_name, {sql_crc('both_names')}::BIGINT AS crc FROM {NAMED}, crctab")
def q_crc32c_combine(spark, sf_dir):
    return _named(spark, sf_dir).select("n_name", "r_name", codec.crc32c_combine(codec.crc32c(F.col("a")), codec.crc32c(F.col("b")), n_bytes("b")).alias("crc"))


# Frames.

ID_HEX = IDENTIFIER.hex().upper()


def sql_stored(s: str) -> str:
    n = f"octet_length(encode({s}))"
    return f"('01' || {sql_le(n + ' + 4', 3)} || {sql_le(sql_mask(sql_crc(s)), 4)} || hex(encode({s})))"


@query(f"WITH {CRC_TABLE} SELECT n_name, '{ID_HEX}' || {sql_stored('n_name')} AS frames_hex FROM nation, crctab")
def q_frame_small_exact(spark, sf_dir):
    return read(spark, sf_dir, "nation").select("n_name", F.hex(codec.snappy_frame(utf8("n_name"))).alias("frames_hex"))


@query(f"SELECT blob, (f + 1)::INTEGER AS chunk_no, octet_length(p)::INTEGER AS len, md5(p) AS md5 FROM (SELECT blob, f, unhex(substr(hex(encode(t)), f * 131072 + 1, 131072)) AS p FROM (SELECT blob, t, unnest(range(0, (octet_length(encode(t)) + 65535) // 65536)) AS f FROM {SQL_BLOBS}))")
def q_chunks_geometry(spark, sf_dir):
    frames = blobs(spark, sf_dir).select("blob", codec.snappy_frame(F.col("data")).alias("frames"))
    rows = tables.chunks(frames, "frames", ["blob"]).where("chunk_type < 2")
    payload = F.expr("substring(body, 5, octet_length(body) - 4)")
    value = F.when(F.col("chunk_type") == 0, codec.snappy_decompress(F.when(F.col("chunk_type") == 0, payload))).otherwise(payload)
    return rows.select("blob", "chunk_no", value.alias("v")).select("blob", "chunk_no", F.octet_length("v").alias("len"), F.md5("v").alias("md5"))


@query("SELECT * FROM (VALUES (255, 25::BIGINT, 150::BIGINT), (1, 25::BIGINT, (SELECT sum(octet_length(encode(n_name)) + 4) FROM nation)::BIGINT), (254, 25::BIGINT, 25 * 3::BIGINT), (128, 25::BIGINT, 0::BIGINT)) v(chunk_type, n, body_bytes)")
def q_chunks_types(spark, sf_dir):
    padding, skip = exprs.chunk(F.lit(254), F.lit(b"\0\0\0")), exprs.chunk(F.lit(128), F.lit(b""))
    frames = read(spark, sf_dir, "nation").select("n_name", F.concat(codec.snappy_frame(utf8("n_name")), padding, skip).alias("frames"))
    return tables.chunks(frames, "frames", ["n_name"]).groupBy("chunk_type").agg(F.count("*").alias("n"), F.sum("body_len").alias("body_bytes"))


@query("SELECT source, (sum(CASE WHEN b > 0 THEN (b + 65535) // 65536 ELSE 0 END))::BIGINT AS chunks_flushed, ((sum(b) + 65535) // 65536)::BIGINT AS chunks_unflushed, sum(b)::BIGINT AS raw_bytes, true AS same FROM (SELECT source, octet_length(encode(text)) AS b FROM documents) GROUP BY source")
def q_frame_flush_boundaries(spark, sf_dir):
    """A flush after each document ends its chunk, so documents are framed one
    by one; without any, chunks end every 64 KB of a source, so its pieces are.
    What both give back is compared piece by piece."""
    docs = read(spark, sf_dir, "documents").select("source", "doc_id", utf8("text").alias("bytes"))

    def stream(writes, flush):
        return codec.snappy_frame_writes(F.transform(writes, lambda x: F.struct(x["bytes"].alias("bytes"), F.lit(flush).alias("flush"))))

    def data_chunks(c):
        return F.size(F.filter(codec.snappy_chunk_array(F.col(c)), lambda x: x["chunk_type"] < 2)).cast("long")

    # A write with a flush after it has the chunks of a stream of its own.
    a = docs.withColumn("a", codec.snappy_frame(F.col("bytes"))).withColumn("back", codec.snappy_unframe(F.col("a")))
    whole = F.octet_length("back").eqNullSafe(F.octet_length("bytes"))
    flushed = a.groupBy("source").agg(F.sum(data_chunks("a")).alias("chunks_flushed"), F.sum(n_bytes("bytes")).alias("raw_bytes"), F.min(whole).alias("whole"))
    back = tables.placed(a.select("source", "doc_id", "bytes", "back"), ["source"], "doc_id", "bytes")
    slices = tables.slices(back, ["source"], ["bytes", "back"], BLOCK_SIZE)
    pieces = slices.groupBy("source", "piece_no").agg(F.array_sort(F.collect_list(F.struct("start", "bytes"))).alias("w"), F.expr("listagg(back) WITHIN GROUP (ORDER BY start)").alias("back"))
    b = pieces.select("source", "back", stream("w", False).alias("b"))
    unflushed = b.select("source", data_chunks("b").alias("n"), F.md5("back").eqNullSafe(F.md5(codec.snappy_unframe(F.col("b")))).alias("same")).groupBy("source").agg(F.sum("n").alias("chunks_unflushed"), F.min("same").alias("same"))
    own = unflushed.withColumnRenamed("source", "_source")
    out = flushed.join(own, flushed["source"].eqNullSafe(own["_source"]), "left")
    # A source without any data has no pieces, one of nulls only no bytes.
    n = F.coalesce("chunks_unflushed", F.when(F.col("raw_bytes") == 0, F.lit(0).cast("long")))
    return out.select("source", "chunks_flushed", n.alias("chunks_unflushed"), "raw_bytes", (F.col("whole") & F.coalesce("same", F.lit(True))).alias("same"))


@query("SELECT doc_id, md5(text) AS md5 FROM documents")
def q_unframe_roundtrip(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(codec.snappy_unframe(codec.snappy_frame(utf8("text")))).alias("md5"))


@query("SELECT n_name, md5(n_name || r_name) AS md5 FROM nation JOIN region ON n_regionkey = r_regionkey")
def q_unframe_concat(spark, sf_dir):
    two = F.concat(codec.snappy_frame(F.col("a")), codec.snappy_frame(F.col("b")))
    return _named(spark, sf_dir).select("n_name", F.md5(codec.snappy_unframe(two)).alias("md5"))


@query("SELECT n_name, md5(n_name) AS md5 FROM nation")
def q_unframe_skippable(spark, sf_dir):
    skips = [exprs.chunk(F.lit(k), F.lit(b"\1\2\3\4" * n)) for k, n in ((128, 1), (254, 0), (200, 30_000))]
    return read(spark, sf_dir, "nation").select("n_name", F.md5(codec.snappy_unframe(F.concat(skips[0], codec.snappy_frame(utf8("n_name")), *skips[1:]))).alias("md5"))


@query("SELECT n_name, md5(n_name) AS md5 FROM nation")
def q_unframe_empty_chunks(spark, sf_dir):
    """Data chunks without data, stored and compressed: their checksum is that
    of nothing."""
    crc = exprs.le_bytes(exprs.mask_crc(F.lit(0)), 4)
    empty = F.concat(exprs.chunk(F.lit(1), crc), exprs.chunk(F.lit(0), F.concat(crc, F.lit(b"\0"))))
    return read(spark, sf_dir, "nation").select("n_name", F.md5(codec.snappy_unframe(F.concat(empty, codec.snappy_frame(utf8("n_name")), empty))).alias("md5"))


#: name, what follows a good stream of "good", ok, error, error_chunk, value.
UNFRAME_CASES = [
    ("complete", "", True, None, None, "good"),
    ("short header", "0100", False, "UNEXPECTED_END", 2, "good"),
    ("short body", "01080000AABBCC", False, "UNEXPECTED_END", 2, "good"),
    ("short skip", "80080000AABBCC", False, "UNEXPECTED_END", 2, "good"),
    ("crc", "01050000000000005A", False, "CRC_MISMATCH", 2, "good"),
    ("reserved", "02000000", False, "UNKNOWN_CHUNK_TYPE", 2, "good"),
    ("reserved, no body", "7FFFFF00", False, "UNKNOWN_CHUNK_TYPE", 2, "good"),
    ("no checksum", "01030000AABBCC", False, "INVALID_CHUNK_LENGTH", 2, "good"),
    ("too long", "00D42A01", False, "INVALID_CHUNK_LENGTH", 2, "good"),
    ("identifier length", "FF05000073", False, "INVALID_STREAM_IDENTIFIER", 2, "good"),
    ("identifier body", "FF060000734E61507058", False, "INVALID_STREAM_IDENTIFIER", 2, "good"),
    ("bad length", "0009000000000000FFFFFFFFFF", False, "INVALID_LENGTH", 2, "good"),
    ("bad block", "000700000000000002F041", False, "CORRUPT_BLOCK", 2, "good"),
    ("after an error", "02000000FF060000734E61507059", False, "UNKNOWN_CHUNK_TYPE", 2, "good"),
    ("second identifier", "FF060000734E61507059", True, None, None, "good"),
]


@query(f"SELECT name, ok, error, coalesce(error_chunk, -1)::INTEGER AS error_chunk, value, true AS same FROM {sql_rows([(n, o, e, c, v) for n, _, o, e, c, v in UNFRAME_CASES], 'name', 'ok', 'error', 'error_chunk', 'value')}")
def q_unframe_errors(spark, sf_dir):
    cases = spark.createDataFrame([(n, t) for n, t, *_ in UNFRAME_CASES], "name string, tail string")
    streams = cases.select("name", F.concat(codec.snappy_frame(F.lit(b"good")), F.unhex("tail")).alias("s"))
    cell = streams.select("name", codec.try_snappy_unframe(F.col("s")).alias("r")).select("name", "r.*")
    many = parallel.unframe_parallel(streams, "s", ["name"]).select("name", F.struct("ok", "error", "error_chunk", "value").alias("p"))
    same = F.struct("ok", "error", "error_chunk", "value").eqNullSafe(F.col("p"))
    return cell.join(many, "name").select("name", "ok", "error", F.coalesce("error_chunk", F.lit(-1)).alias("error_chunk"), F.decode("value", "UTF-8").alias("value"), same.alias("same"))


#: name, block, ok, error, decoded value.
BLOCK_CASES = [
    ("empty", "00", True, None, ""),
    ("one literal", "0308414243", True, None, "ABC"),
    ("run", "0A0041220100", True, None, "A" * 10),
    ("no header", "", False, "INVALID_LENGTH", None),
    ("open header", "FFFF", False, "INVALID_LENGTH", None),
    ("header over 2^31 - 1", "FFFFFFFF0F00", False, "INVALID_LENGTH", None),
    ("empty with tags", "000041", False, "CORRUPT_BLOCK", None),
    ("claims gigabytes", "FFFFFFFF0700414141", False, "CORRUPT_BLOCK", None),
    ("literal cut", "03084142", False, "CORRUPT_BLOCK", None),
    ("short output", "0408414243", False, "CORRUPT_BLOCK", None),
    ("long output", "0208414243", False, "CORRUPT_BLOCK", None),
    ("offset zero", "0500410100", False, "CORRUPT_BLOCK", None),
    ("offset before the start", "0500410102", False, "CORRUPT_BLOCK", None),
    ("length of a literal cut", "05F4", False, "CORRUPT_BLOCK", None),
    ("copy-4", "06084142430B03000000", True, None, "ABCABC"),
    ("overlapping copy", "08044142160200", True, None, "ABABABAB"),
]


@query(f"SELECT name, ok, error, value, ok AS is_valid FROM {sql_rows([(n, o, e, v) for n, _, o, e, v in BLOCK_CASES], 'name', 'ok', 'error', 'value')}")
def q_try_decompress_errors(spark, sf_dir):
    cases = spark.createDataFrame([(n, b) for n, b, *_ in BLOCK_CASES], "name string, block string").select("name", F.unhex("block").alias("b"))
    return cases.select("name", codec.try_snappy_decompress(F.col("b")).alias("r"), codec.snappy_is_valid(F.col("b")).alias("is_valid")).select("name", "r.ok", "r.error", F.decode("r.value", "UTF-8").alias("value"), "is_valid")


@query("SELECT doc_id, hex(unhex(substr(hex(encode(text)), 1, 40))) AS prefix_hex, least(20, octet_length(encode(text)))::INTEGER AS n FROM documents")
def q_decompress_prefix(spark, sf_dir):
    made = read(spark, sf_dir, "documents").select("doc_id", codec.snappy_compress(utf8("text")).alias("b"))
    return made.select("doc_id", codec.snappy_decompress_prefix(F.col("b"), 20).alias("p")).select("doc_id", F.hex("p").alias("prefix_hex"), F.octet_length("p").alias("n"))


@query("SELECT n_nationkey::INTEGER AS n_nationkey, n_nationkey * 4 <= 22 * (n_nationkey % 5) AND (n_nationkey > 0 OR n_nationkey % 5 = 0) AS plausible FROM nation")
def q_22x_guard(spark, sf_dir):
    """A header that declares 4k bytes before k mod 5 bytes of tags."""
    k = F.col("n_nationkey").cast("int")
    block = F.concat(exprs.varint(k * 4), F.expr("substring(unhex('0000000000'), 1, cast(n_nationkey % 5 as int))"))
    return read(spark, sf_dir, "nation").select(k.alias("n_nationkey"), exprs.is_plausible(block).alias("plausible"))


# Tags.


@query("SELECT doc_id, 0 AS tag_no, 'literal' AS kind, octet_length(encode(text))::BIGINT AS length, md5(text) AS md5 FROM documents WHERE octet_length(encode(text)) > 0")
def q_tags_literal_only(spark, sf_dir):
    made = read(spark, sf_dir, "documents").select("doc_id", exprs.literal_block(utf8("text")).alias("block"))
    return tables.tags(made, "block", ["doc_id"]).select("doc_id", "tag_no", "kind", "length", F.md5("literal").alias("md5"))


@query("SELECT doc_id, lang, CASE WHEN doc_id % 3 = 0 THEN true ELSE false END AS valid FROM documents")
def q_validate_relational(spark, sf_dir):
    """Sound blocks, blocks without their last byte, and blocks with a copy
    from before the start, told apart by a fold over their tags."""
    block = codec.snappy_compress(utf8("text"))
    made = read(spark, sf_dir, "documents").select("doc_id", "lang", block.alias("b"))
    cut = F.expr("substring(b, 1, octet_length(b) - 1)")
    bad = F.concat(F.col("b"), exprs.copy_tag(F.lit(65535), F.lit(1)))
    changed = F.when(F.col("doc_id") % 3 == 0, F.col("b")).when(F.col("doc_id") % 3 == 1, cut).otherwise(bad)
    return tables.valid_by_tags(made.select("doc_id", "lang", changed.alias("block")), "block", ["doc_id", "lang"])


@query("SELECT lang, sum(octet_length(encode(text)))::BIGINT AS length, 0::BIGINT AS n_copy4, 0::BIGINT AS n_invalid FROM documents GROUP BY lang")
def q_no_copy4_emitted(spark, sf_dir):
    made = read(spark, sf_dir, "documents").select("lang", codec.snappy_compress(utf8("text")).alias("block"))
    kind = F.col("kind")
    return tables.tags(made, "block", ["lang"], literals=False).groupBy("lang").agg(F.sum("length").alias("length"), F.sum((kind == "copy4").cast("long")).alias("n_copy4"), F.sum((kind == "invalid").cast("long")).alias("n_invalid"))


@query("SELECT lang, count(*) AS n, count(*) AS n_within FROM documents GROUP BY lang")
def q_block_within_max_length(spark, sf_dir):
    made = read(spark, sf_dir, "documents").select("lang", n_bytes(utf8("text")).alias("n"), codec.snappy_compress(utf8("text")).alias("b"))
    return made.groupBy("lang").agg(F.count("*").alias("n"), F.sum((F.octet_length("b") <= exprs.max_compressed_length("n")).cast("long")).alias("n_within"))


PATTERN = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"


@query(f"SELECT o::INTEGER AS o, l::INTEGER AS l, substr(repeat(substr('{PATTERN}', 1, o::INTEGER), 65), 1, (o + l)::INTEGER) AS value FROM range(1, 65) a(o), range(1, 65) b(l)")
def q_overlap_copies(spark, sf_dir):
    """Copies of 1 to 64 bytes from 1 to 64 bytes back."""
    grid = spark.range(64 * 64).select(F.expr("cast(id div 64 + 1 as int)").alias("o"), F.expr("cast(id % 64 + 1 as int)").alias("l"))
    literal = F.expr(f"encode(substring('{PATTERN}', 1, o), 'UTF-8')")
    block = F.concat(exprs.varint(F.col("o") + F.col("l")), exprs.literal_tag(literal), exprs.copy_tag(F.col("o"), F.col("l")))
    return grid.select("o", "l", F.decode(codec.snappy_decompress(block), "UTF-8").alias("value"))


# With Spark's own operators.


@query("SELECT source, count(*) AS n, count(DISTINCT md5(text)) AS n_distinct FROM documents GROUP BY source")
def q_dedupe_by_crc(spark, sf_dir):
    """Equal texts by checksum and compressed bytes."""
    made = read(spark, sf_dir, "documents").select("source", codec.crc32c(utf8("text")).alias("crc"), F.md5(codec.snappy_compress(utf8("text"))).alias("m"))
    per = made.groupBy("source", "crc", "m").agg(F.count("*").alias("n"))
    return per.groupBy("source").agg(F.sum("n").alias("n"), F.count("*").alias("n_distinct"))


@query("SELECT lang, count(*) AS n FROM documents GROUP BY lang HAVING count(*) > 0")
def q_ratio_never_above_max(spark, sf_dir):
    made = read(spark, sf_dir, "documents").select("lang", n_bytes(utf8("text")).alias("raw"), n_bytes(codec.snappy_frame(utf8("text"))).alias("framed"))
    # A framed value grows by its headers at most.
    return made.where("framed <= raw + 10 + 8 * ((raw + 65535) div 65536)").groupBy("lang").agg(F.count("*").alias("n"))


@query("SELECT n_name, 0 AS tag_no, 'literal' AS kind, octet_length(encode(n_name))::BIGINT AS length, 2 AS n_chunks FROM nation")
def q_sql_functions(spark, sf_dir):
    """The same functions by their SQL names, and the table functions."""
    register_all(spark)
    read(spark, sf_dir, "nation").createOrReplaceTempView("codec_nation")
    return spark.sql("""
        SELECT n_name, t.tag_no, t.kind, t.length, cast(count(*) AS int) AS n_chunks
        FROM (SELECT n_name, snappy_compress(encode(n_name, 'UTF-8')) AS b, snappy_frame(encode(n_name, 'UTF-8')) AS f FROM codec_nation) s,
             LATERAL snappy_tags(s.b) t, LATERAL snappy_chunks(s.f) c
        GROUP BY ALL""")


# Streaming and files.


def shared(spark, name):
    given = spark.sparkContext._jsc.sc().getCheckpointDir()
    root = spark.conf.get("spark.checkpoint.dir", None) or (given.get() if given.isDefined() else None)
    if not root:  # a local session: a folder of our own, for this process
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="blockcodec-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
        root = "file://" + root
    return f"{root}/codec-{uuid.uuid4().hex}/{name}"


def _streamed(spark, rows, operator):
    """Rows through a streaming query to its end, and its output as a table."""
    source, out = shared(spark, "source"), shared(spark, "out")
    rows.write.parquet(source)
    stream = operator(spark.readStream.schema(rows.schema).parquet(source))
    run = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", shared(spark, "checkpoint")).outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def _stream_rows(pieces, key):
    """stream_id, seq, bytes, eof of cut pieces, out of order by their shuffle."""
    return pieces.select(F.col(key).cast("string").alias("stream_id"), F.col("piece_no").alias("seq"), "bytes", F.col("last").alias("eof"))


def _framed_pieces(spark, docs, key):
    """key, piece_no, bytes: a stream of one write of each key's documents, in
    a row for each chunk; the first has the identifier before it."""
    made = tables.cut(docs, [key], "doc_id", "part", BLOCK_SIZE).select(key, "piece_no", codec.snappy_frame(F.col("bytes")).alias("f"))
    body = F.expr(f"substring(f, {len(IDENTIFIER) + 1}, octet_length(f) - {len(IDENTIFIER)})")
    path = shared(spark, "chunks")
    made.select(key, "piece_no", F.when(F.col("piece_no") == 0, F.col("f")).otherwise(body).alias("bytes")).write.parquet(path)
    return spark.read.parquet(path)


def _by_stream(docs, key, *found):
    """stream_id of every key and, where they have it, the columns of tables
    by stream_id."""
    out = docs.groupBy(F.col(key).cast("string").alias("stream_id")).agg(F.max(F.octet_length("part")).alias("longest"))
    for i, df in enumerate(found):
        own = df.withColumnRenamed("stream_id", f"_id{i}")
        out = out.join(own, out["stream_id"].eqNullSafe(own[f"_id{i}"]), "left").drop(f"_id{i}")
    return out


@query("SELECT lang AS stream_id, md5(string_agg(text, '' ORDER BY doc_id)) AS md5, 0::BIGINT AS n_errors FROM documents GROUP BY lang")
def q_stream_unframe(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("lang", "doc_id", utf8("text").alias("part"))
    frames = tables.cut(_framed_pieces(spark, docs, "lang"), ["lang"], "piece_no", "bytes", 50_000, run=64)
    out = _streamed(spark, _stream_rows(frames, "lang"), unframe_stream)
    got = tables.digests(out, ["stream_id"], ["seq"], "value")
    bad = out.groupBy("stream_id").agg(F.count("error").alias("n_errors"))
    # A stream without data has no rows.
    md5 = F.coalesce("md5", F.when(F.col("longest") == 0, F.md5(F.lit(b""))))
    return _by_stream(docs, "lang", got, bad).select("stream_id", md5.alias("md5"), F.coalesce("n_errors", F.lit(0).cast("long")).alias("n_errors"))


@query("SELECT lang AS stream_id, md5(string_agg(text, '' ORDER BY doc_id)) AS md5, true AS same FROM documents GROUP BY lang")
def q_stream_frame(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("lang", "doc_id", utf8("text").alias("part"))
    out = _streamed(spark, _stream_rows(tables.cut(docs, ["lang"], "doc_id", "part", 40_000), "lang"), frame_stream)
    made = tables.digests(out, ["stream_id"], ["seq"], "frames").select("stream_id", F.struct("n_bytes", "md5").alias("made"))
    batch = tables.digests(_framed_pieces(spark, docs, "lang"), ["lang"], ["piece_no"], "bytes").select(F.col("lang").cast("string").alias("stream_id"), F.struct("n_bytes", "md5").alias("batch"))
    # A row has whole chunks, which are decoded apart.
    back = tables.digests(out.select("stream_id", "seq", codec.snappy_unframe(F.col("frames")).alias("value")), ["stream_id"], ["seq"], "value")
    return _by_stream(docs, "lang", made, batch, back).select("stream_id", "md5", F.col("made").eqNullSafe(F.col("batch")).alias("same"))


@query("SELECT count(*) AS n_docs, sum(octet_length(encode(text)))::BIGINT AS raw_bytes, 5::BIGINT AS n_files, md5(string_agg(text, '' ORDER BY doc_id)) AS md5 FROM documents")
def q_source_roundtrip(spark, sf_dir):
    """Documents into five framed files in order of doc_id, and back."""
    register_all(spark)
    docs = read(spark, sf_dir, "documents").select("doc_id", utf8("text").alias("value"))
    path = shared(spark, "frames")
    docs.repartitionByRange(5, "doc_id").sortWithinPartitions("doc_id").select("value").write.format("snappy_frames").mode("append").save(path)
    back = spark.read.format("snappy_frames").option("path", path).option("split_bytes", 100_000).load().where("value is not null")
    whole = tables.digests(back, [], ["path", "chunk_no"], "value")
    return whole.select(F.lit(docs.count()).alias("n_docs"), F.col("n_bytes").alias("raw_bytes"), F.col("n_firsts").alias("n_files"), "md5")


@query("SELECT 255 AS chunk_type, 1::BIGINT AS n")
def q_source_pushdown(spark, sf_dir):
    """A chunk type filter reaches the source, which then decodes no data."""
    register_all(spark)
    path = shared(spark, "frames")
    read(spark, sf_dir, "nation").select(utf8("n_name").alias("value")).coalesce(1).write.format("snappy_frames").mode("append").save(path)
    return spark.read.format("snappy_frames").option("path", path).load().where("chunk_type = 255").groupBy("chunk_type").agg(F.count("*").alias("n"))
