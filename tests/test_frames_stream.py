from blockcodec.functions import kernels as K
from blockcodec.register import register_all


def test_all_files_are_read_over_restarts(spark, tmp_path):
    register_all(spark)
    folder, seen = tmp_path / "in", []
    folder.mkdir()

    def run():
        stream = spark.readStream.format("snappy_frames").option("path", str(folder)).option("max_files", 3).load()
        sink = stream.where("chunk_type < 2").writeStream.foreachBatch(lambda rows, _: seen.extend(bytes(r["value"]) for r in rows.select("value").collect()))
        sink.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()

    def add(names):
        for i in names:
            (folder / f"{i:05d}.sz").write_bytes(K.frame(b"%d" % i))

    add(range(10))
    run()
    assert sorted(seen) == sorted(b"%d" % i for i in range(10))
    add(range(10, 15))
    run()
    run()
    assert sorted(seen) == sorted(b"%d" % i for i in range(15))
