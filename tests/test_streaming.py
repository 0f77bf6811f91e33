import random

from blockcodec.functions import kernels as K
from blockcodec.streaming.frames import frame_stream, unframe_stream

SCHEMA = "stream_id string, seq long, bytes binary, eof boolean"


def pieces(name, data, size):
    cut = [data[at : at + size] for at in range(0, len(data), size)] or [b""]
    return [(name, i, p, i == len(cut) - 1) for i, p in enumerate(cut)]


def run(spark, tmp_path, name, batches, operator):
    folder = tmp_path / name
    folder.mkdir()
    stream = operator(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder)))
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))
    q = stream.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"{name}-c")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    out = {}
    for r in spark.table(name).orderBy("seq").collect():
        out.setdefault(r["stream_id"], []).append(r)
    return out


def test_unframe_out_of_order_over_batches(spark, tmp_path):
    rng = random.Random(1)
    a, b = rng.randbytes(90_000) + b"x" * 90_000, b"short"
    good = K.chunk(200, b"s" * 5000) + K.frame(a)
    rows = pieces("a", good, 7000) + pieces("b", K.frame(b), 3) + pieces("cut", K.frame(b)[:-1], 4) + pieces("bad", K.frame(b) + b"\x02\0\0\0" + K.frame(b), 5) + pieces("empty", b"", 1)
    rng.shuffle(rows)
    got = run(spark, tmp_path, "unframed", [rows[:20], rows[20:30], rows[30:]], unframe_stream)
    joined = {k: b"".join(bytes(r["value"] or b"") for r in v) for k, v in got.items()}
    errors = {k: [r["error"] for r in v if r["error"]] for k, v in got.items()}
    assert joined["a"] == a and joined["b"] == b and joined["bad"] == b and joined["cut"] == b""
    assert errors["a"] == errors["b"] == [] and errors["cut"] == ["UNEXPECTED_END"] and errors["bad"] == ["UNKNOWN_CHUNK_TYPE"]
    assert "empty" not in got


def test_frame_equals_one_write(spark, tmp_path):
    data = {"a": b"abc" * 60_000, "b": b"", "c": b"tiny"}
    rows = [r for k, v in data.items() for r in pieces(k, v, 50_000)]
    random.Random(2).shuffle(rows)
    got = run(spark, tmp_path, "framed", [rows[:2], rows[2:]], frame_stream)
    assert {k: b"".join(bytes(r["frames"]) for r in v) for k, v in got.items()} == {k: K.frame(v) for k, v in data.items()}


def test_flush_rows(spark, tmp_path):
    """Chunks end after each row with a flush, as after a write with one."""
    data, rng = bytes(range(256)) * 700, random.Random(4)
    cut = [data[:100], data[100:70_000], b"", data[70_000:]]
    flush = [True, False, True, False]
    rows = [("s", i, p, i == 3, f) for i, (p, f) in enumerate(zip(cut, flush))]
    rng.shuffle(rows)
    folder = tmp_path / "flushed"
    folder.mkdir()
    schema = SCHEMA + ", flush boolean"
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
    q = frame_stream(spark.readStream.schema(schema).parquet(str(folder))).writeStream.format("memory").queryName("flushed").option("checkpointLocation", str(tmp_path / "flushed-c")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = b"".join(bytes(r["frames"]) for r in spark.table("flushed").orderBy("seq").collect())
    assert got == K.frame_writes(list(zip(cut, flush))) and K.unframe(got) == data
