import random

import pytest
from pyspark.sql import functions as F

import referee
from blockcodec.functions import codec, exprs
from blockcodec.functions import kernels as K
from blockcodec.operators import tables
from blockcodec.plans import parallel
from blockcodec.register import register_all


@pytest.fixture(scope="module")
def values(spark):
    rows = [(i, v) for i, v in enumerate(referee.payloads(random.Random(2), 60))] + [(1000, None), (1001, b"")]
    return rows, spark.createDataFrame(rows, "id long, data binary").repartition(3)


def collected(df):
    return {r["id"]: r for r in df.collect()}


def test_null_and_values(values):
    rows, df = values
    got = collected(df.select("id", codec.snappy_compress(F.col("data")).alias("b"), codec.snappy_frame(F.col("data")).alias("f"), codec.crc32c(F.col("data")).alias("c")).select("*", codec.snappy_decompress(F.col("b")).alias("d"), codec.try_snappy_decompress(F.col("b")).alias("t"), codec.snappy_unframe(F.col("f")).alias("u"), codec.snappy_is_valid(F.col("b")).alias("v")))
    for i, v in rows:
        r = got[i]
        if v is None:
            assert r["b"] is r["f"] is r["c"] is r["d"] is r["t"] is r["u"] is r["v"] is None
            continue
        assert bytes(r["d"]) == v == bytes(r["t"]["value"]) == bytes(r["u"]) and r["v"] and r["t"]["ok"]
        assert bytes(r["b"]) == K.compress(v) and bytes(r["f"]) == K.frame(v)
        if len(v) < 5000:
            assert r["c"] == referee.crc32c(v)


def test_parallel_plans_do_not_depend_on_partitioning(values):
    rows, df = values
    for options in (parallel.ParallelOptions(min_length=0), parallel.ParallelOptions(partitions=5, min_length=70_000)):
        blocks = collected(parallel.compress_parallel(df, "data", ["id"], options))
        frames = parallel.frame_parallel(df, "data", ["id"], options)
        found = collected(frames)
        back = collected(parallel.unframe_parallel(frames, "frames", ["id"], options))
        crcs = collected(parallel.crc32c_parallel(df, "data", ["id"], options))
        for i, v in rows:
            if v is None:
                assert blocks[i]["block"] is None and found[i]["frames"] is None and crcs[i]["crc"] is None
                assert back[i]["ok"] is back[i]["error"] is back[i]["error_chunk"] is back[i]["value"] is None
                continue
            assert bytes(blocks[i]["block"]) == K.compress(v)
            assert bytes(found[i]["frames"]) == K.frame(v)
            assert back[i]["ok"] and bytes(back[i]["value"]) == v
            assert crcs[i]["crc"] == K.crc32c_many([v])[0]


def test_fragments_and_gathering(values):
    rows, df = values
    pieces = tables.fragments(df, "data", ["id"])
    assert pieces.where("len > 65536 or start <> fragment_no * 65536").count() == 0
    back = collected(tables.gathered(pieces.repartition(7), ["id"], "fragment_no", "bytes"))
    for i, v in rows:
        assert (i in back) == bool(v)
        if v:
            assert bytes(back[i]["bytes"]) == v


def test_tag_table_agrees_with_the_decoder(spark):
    rng = random.Random(4)
    blocks = [(i, referee.mutated(rng, K.compress(v[:400]))) for i, v in enumerate(referee.payloads(rng, 200))]
    blocks = [(i, b) for i, b in blocks if K.parse_varint(b)[0] == "DONE" and K.parse_varint(b)[1] < 2**31]
    df = spark.createDataFrame(blocks, "id long, block binary")
    got = collected(tables.valid_by_tags(df, "block", ["id"]))
    for i, b in blocks:
        assert got[i]["valid"] == (referee.decode(b) is not None), b.hex()


def test_expressions(spark):
    ns = [0, 1, 127, 128, 16383, 16384, 2097151, 2097152, 268435455, 268435456, 2147483647]
    df = spark.createDataFrame([(n,) for n in ns], "id long").withColumn("b", exprs.varint("id"))
    got = collected(df.select("id", "b", exprs.varint_size("id").alias("s"), exprs.varint_value(F.col("b")).alias("v"), exprs.uncompressed_length(F.col("b")).alias("u"), exprs.unmask_crc(exprs.mask_crc("id")).alias("m"), exprs.le_integer(exprs.le_bytes(F.col("id"), 4), 1, 4).alias("le")))
    for n in ns:
        r = got[n]
        assert bytes(r["b"]) == K.varint(n) and r["s"] == len(K.varint(n)) and r["v"] == r["u"] == r["m"] == r["le"] == n


def test_max_compressed_length(spark):
    cases = {0: 5, 1: 38, 6: 44, 65536: 76495, 65537: 76495 + 33, 100_000: 5 + 76490 + 32 + 34464 + 5744}
    df = spark.createDataFrame([(n,) for n in cases], "id long").select("id", exprs.max_compressed_length("id").alias("m"))
    assert {r["id"]: r["m"] for r in df.collect()} == cases
    odd = spark.createDataFrame([(-1,), (2**31 - 1,)], "id long")
    assert [r[0] for r in odd.select(exprs.try_max_compressed_length("id")).collect()] == [None, None]
    with pytest.raises(Exception, match="INVALID_LENGTH"):
        odd.select(exprs.max_compressed_length("id")).collect()


def test_strict_functions_fail_the_query(spark):
    bad = spark.createDataFrame([(b"\x05\x00\x41\x01\x00",)], "b binary")
    with pytest.raises(Exception, match="CORRUPT_BLOCK"):
        bad.select(codec.snappy_decompress(F.col("b"))).collect()
    with pytest.raises(Exception, match="UNKNOWN_CHUNK_TYPE"):
        spark.createDataFrame([(b"\x02\0\0\0",)], "b binary").select(codec.snappy_unframe(F.col("b"))).collect()


def test_plan_prunes_and_pushes(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(10).selectExpr("id", "encode(cast(id as string), 'UTF-8') data", "id % 2 k").write.parquet(path)
    df = spark.read.parquet(path).select("id", "k", codec.snappy_compress(F.col("data")).alias("b"))
    plan = df.where("k = 1").select("id")._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan and "EqualTo(k,1)" in plan and "data" not in plan.split("ReadSchema")[1]


def test_source(spark, tmp_path):
    register_all(spark)
    path = str(tmp_path / "frames")
    rows = [(i, (b"row %d " % i) * 3000) for i in range(40)]
    spark.createDataFrame(rows, "id long, value binary").coalesce(1).sortWithinPartitions("id").write.format("snappy_frames").mode("append").save(path)
    back = spark.read.format("snappy_frames").option("path", path).option("split_bytes", 500).load()
    assert back.rdd.getNumPartitions() > 3
    parts = back.where("value is not null").orderBy("chunk_no").collect()
    assert b"".join(bytes(r["value"]) for r in parts) == b"".join(v for _, v in rows)
    assert back.where("chunk_type = 255").count() == 1
    spark.createDataFrame([], "value binary").write.format("snappy_frames").mode("append").save(str(tmp_path / "none"))
    assert spark.read.format("snappy_frames").option("path", str(tmp_path / "none")).load().count() == 0
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x.sz").write_bytes(K.frame(b"abc")[:-1])
    with pytest.raises(Exception, match="UNEXPECTED_END"):
        spark.read.format("snappy_frames").option("path", str(tmp_path / "bad")).load().collect()
    with pytest.raises(Exception, match="path"):
        spark.read.format("snappy_frames").load().collect()


def test_source_stream(spark, tmp_path):
    register_all(spark)
    folder = tmp_path / "in"
    folder.mkdir()
    for i in range(3):
        (folder / f"{i}.sz").write_bytes(K.frame(b"file %d" % i))
    run = spark.readStream.format("snappy_frames").option("path", str(folder)).load().writeStream.format("memory").queryName("frames_in").option("checkpointLocation", str(tmp_path / "c")).start()
    run.processAllAvailable()
    run.stop()
    assert sorted(bytes(r["value"]) for r in spark.table("frames_in").where("value is not null").collect()) == [b"file 0", b"file 1", b"file 2"]


def test_null_and_repeated_keys(spark):
    good, bad = K.compress(b"abc" * 50), K.compress(b"abc" * 50)[:-1]
    rows = [(1, good), (1, good), (None, good), (None, bad), (2, bad), (2, None), (3, b""), (3, b"\xff\xff")]
    got = tables.valid_by_tags(spark.createDataFrame(rows, "id long, block binary"), "block", ["id"]).collect()
    assert sorted((str(r["id"]), str(r["valid"])) for r in got) == sorted((str(i), str(None if b is None else K.is_valid(b))) for i, b in rows)
    streams = [(None, 1, K.frame(b"x" * 200_000)), (1, None, K.frame(b"y") + b"\x02\0\0\0"), (None, None, K.frame(b"")), (2, 2, None)]
    got = parallel.unframe_parallel(spark.createDataFrame(streams, "a long, b long, s binary"), "s", ["a", "b"]).collect()
    want = {(a, b): K.try_unframe(s) if s is not None else dict.fromkeys(("ok", "error", "error_chunk", "value")) for a, b, s in streams}
    assert {(r["a"], r["b"]): {k: bytes(r[k]) if isinstance(r[k], bytearray) else r[k] for k in ("ok", "error", "error_chunk", "value")} for r in got} == want


def test_long_literals_and_far_copies(spark):
    n = (1 << 24) + 5
    data = spark.range(1).select(F.expr(f"encode(repeat('ab', {n // 2 + 1}), 'UTF-8')").alias("d"))
    block = data.select(exprs.literal_block(F.expr(f"substring(d, 1, {n})")).alias("b")).first()["b"]
    assert K.decompress(bytes(block)) == (b"ab" * n)[:n]
    copy = bytes(spark.range(1).select(exprs.copy_tag(F.lit(70_000), F.lit(40)).alias("c")).first()["c"])
    literal = bytes(range(256)) * 300
    made = K.varint(len(literal) + 40) + bytes([62 << 2]) + (len(literal) - 1).to_bytes(3, "little") + literal + copy
    assert K.decompress(made) == literal + literal[-70_000 : -70_000 + 40] and copy[0] & 3 == 3
