"""Encoding and decoding of large values over many tasks.

Fragments of a block are compressed apart and never refer to each other, and
so are chunks of a stream; a value above a threshold becomes rows, which Spark
deals out, and is put together in order. The bytes are those of the one-task
plan, whatever the partitioning.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import codec, exprs
from ..functions.constants import COMPRESSED_DATA, FIRST_SKIPPABLE, IDENTIFIER, UNCOMPRESSED_DATA
from ..operators import tables


@dataclass(frozen=True)
class ParallelOptions:
    """partitions: how many tasks fragments are dealt to (None: Spark's
    setting). min_length: values shorter than that stay in one task."""

    partitions: int | None = None
    min_length: int = 256 * 1024

    def __post_init__(self):
        if self.partitions is not None and self.partitions < 1:
            raise ValueError("partitions must be at least 1")
        if self.min_length < 0:
            raise ValueError("min_length must not be negative")


def _dealt(pieces: DataFrame, keys, number, options):
    # By key and number: the pieces of one large value go to many tasks.
    by = [*keys, number]
    return pieces.repartition(options.partitions, *by) if options.partitions else pieces.repartition(*by)


def compress_parallel(df: DataFrame, data: str, keys: list[str], options: ParallelOptions = ParallelOptions()) -> DataFrame:
    """keys, block. keys must identify a row; a null value has a null block.

    Short values go through the cell plan, without a shuffle."""
    long_ = F.octet_length(data) >= F.lit(max(options.min_length, 1))
    cell = df.where(~long_ | F.col(data).isNull()).select(*keys, codec.snappy_compress(F.col(data)).alias("block"))
    pieces = _dealt(tables.fragments(df.where(long_), data, keys), keys, "fragment_no", options)
    packed = pieces.select(*keys, "fragment_no", "len", codec.snappy_compress_fragment(F.col("bytes")).alias("packed"))
    total = packed.groupBy(*keys).agg(F.sum("len").alias("n"), F.expr("listagg(packed) WITHIN GROUP (ORDER BY fragment_no)").alias("body"))
    return cell.unionByName(total.select(*keys, F.concat(exprs.varint(F.col("n")), F.col("body")).alias("block")))


def frame_parallel(df: DataFrame, data: str, keys: list[str], options: ParallelOptions = ParallelOptions()) -> DataFrame:
    """keys, frames: each value as a stream of one write."""
    some = F.octet_length(data) > 0
    empty = df.where(~some | F.col(data).isNull()).select(*keys, F.when(F.col(data).isNotNull(), F.lit(IDENTIFIER)).alias("frames"))
    pieces = _dealt(tables.fragments(df.where(some), data, keys), keys, "fragment_no", options)
    made = pieces.select(*keys, "fragment_no", "bytes", "len", codec.snappy_compress(F.col("bytes")).alias("packed"), codec.crc32c(F.col("bytes")).alias("crc"))
    smaller = F.octet_length("packed") < F.col("len")
    body = F.concat(exprs.le_bytes(exprs.mask_crc("crc"), 4), F.when(smaller, F.col("packed")).otherwise(F.col("bytes")))
    kind = F.when(smaller, F.lit(COMPRESSED_DATA)).otherwise(F.lit(UNCOMPRESSED_DATA))
    rows = made.select(*keys, "fragment_no", exprs.chunk(kind, body).alias("chunk"))
    joined = tables.gathered(rows, keys, "fragment_no", "chunk", "body")
    return empty.unionByName(joined.select(*keys, F.concat(F.lit(IDENTIFIER), F.col("body")).alias("frames")))


def _same(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """A left join on equal keys, null being equal to null."""
    other = b.select(*[F.col(k).alias(f"_{k}") for k in keys], *[c for c in b.columns if c not in keys])
    on = F.lit(True)
    for k in keys:
        on = on & a[k].eqNullSafe(other[f"_{k}"])
    return a.join(other, on, "left").drop(*[f"_{k}" for k in keys])


def unframe_parallel(df: DataFrame, stream: str, keys: list[str], options: ParallelOptions = ParallelOptions()) -> DataFrame:
    """keys, ok, error, error_chunk, value: as try_snappy_unframe, with chunks
    decoded in many tasks. Of several errors the first in the stream counts.
    keys must identify a row; nulls among them are a value like any other. A
    null stream has nulls in all columns."""
    rows = tables.chunks(df, stream, keys).where(F.col("error").isNotNull() | (F.col("chunk_type") < FIRST_SKIPPABLE))
    # Each data chunk is decoded as a stream of its own.
    alone = exprs.chunk(F.col("chunk_type"), F.col("body"))
    decoded = _dealt(rows, keys, "chunk_no", options).select(*keys, "chunk_no", "error", codec.try_snappy_unframe(F.when(F.col("error").isNull(), alone)).alias("r"))
    told = decoded.select(*keys, "chunk_no", F.coalesce("error", "r.error").alias("error"), F.col("r.value").alias("value"))
    first = told.where("error is not null").groupBy(*keys).agg(F.min_by("error", "chunk_no").alias("error"), F.min("chunk_no").alias("error_chunk"))
    good = _same(told.drop("error"), first.select(*keys, "error_chunk"), keys).where(F.col("error_chunk").isNull() | (F.col("chunk_no") < F.col("error_chunk")))
    values = tables.gathered(good, keys, "chunk_no", "value", "value")
    base = df.select(*keys, F.col(stream).isNotNull().alias("_some"))
    out = _same(_same(base, first, keys), values, keys)
    return out.select(*keys, F.when(F.col("_some"), F.col("error").isNull()).alias("ok"), "error", "error_chunk", F.when(F.col("_some"), F.coalesce("value", F.lit(b""))).alias("value"))


def crc32c_parallel(df: DataFrame, data: str, keys: list[str], options: ParallelOptions = ParallelOptions()) -> DataFrame:
    """keys, crc: a CRC for each fragment, combined in order. Combining is
    associative, so the checksum of a value never needs the value in one task.
    A null value has a null checksum."""
    pieces = _dealt(tables.fragments(df, data, keys), keys, "fragment_no", options).select(*keys, "fragment_no", "len", codec.crc32c(F.col("bytes")).alias("crc"))
    listed = pieces.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("fragment_no", "len", "crc"))).alias("parts"))
    some = listed.select(*keys, codec.crc32c_fold(F.col("parts.crc"), F.col("parts.len")).alias("crc"))
    none = df.where(F.col(data).isNull() | (F.octet_length(data) == 0)).select(*keys, F.when(F.col(data).isNotNull(), F.lit(0)).cast("long").alias("crc"))
    return some.unionByName(none)
