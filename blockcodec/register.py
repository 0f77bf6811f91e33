"""SQL names, table functions and the data source of a session."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from .functions.codec import SQL_FUNCTIONS, chunk_rows
from .functions.kernels import tags
from .sources.frames import SnappyFrames


@udtf(returnType="tag_no int, at int, kind string, length bigint, offset bigint, literal binary")
class SnappyTags:
    def eval(self, block: bytes):
        for t in tags(block) if block is not None else ():
            yield t["tag_no"], t["at"], t["kind"], t["length"], t["offset"], t["literal"]


@udtf(returnType="chunk_no int, at bigint, chunk_type int, body_len int, crc bigint, body binary, error string")
class SnappyChunks:
    def eval(self, frames: bytes):
        for c in chunk_rows(frames) if frames is not None else ():
            yield c["chunk_no"], c["at"], c["chunk_type"], c["body_len"], c["crc"], c["body"], c["error"]


def register_all(spark: SparkSession) -> None:
    # The source takes chunk type filters, which Spark offers it only if told.
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for name, fn in SQL_FUNCTIONS.items():
        spark.udf.register(name, fn)
    spark.udtf.register("snappy_tags", SnappyTags)
    spark.udtf.register("snappy_chunks", SnappyChunks)
    spark.dataSource.register(SnappyFrames)
