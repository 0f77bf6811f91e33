"""Fragments, tags and chunks as rows, and values made of rows again."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

from ..functions import codec, exprs
from ..functions.constants import BLOCK_SIZE


def fragments(df: DataFrame, data: str, keys: list[str]) -> DataFrame:
    """keys, fragment_no, start, len, bytes: the 64 KB slices of each value.

    An empty or null value has none. Only column arithmetic: no Python, and a
    row of the result never holds more than 64 KB.
    """
    numbered = df.where(F.octet_length(data) > 0).select(*keys, data, F.explode(F.sequence(F.lit(0), exprs.fragment_count(F.col(data)) - 1)).alias("fragment_no"))
    start = F.col("fragment_no").cast("long") * BLOCK_SIZE
    return numbered.select(*keys, "fragment_no", start.alias("start"), F.expr(f"substring(`{data}`, fragment_no * {BLOCK_SIZE} + 1, {BLOCK_SIZE})").alias("bytes")).select(*keys, "fragment_no", "start", F.octet_length("bytes").alias("len"), "bytes")


#: Bytes of blocks or streams whose elements are made into rows together.
TOGETHER = 1 << 19


def _listed(df: DataFrame, column: str, made, kind, together: int) -> DataFrame:
    """df with the column's values replaced by lists that `made` finds in them.
    Elements take many times the bytes they are found in, so a batch is worked
    off in runs of rows: what is held doesn't grow with it."""
    at, width = df.columns.index(column), together

    def run(batches):
        for batch in batches:
            sizes = [v.as_buffer().size if v.is_valid else 0 for v in batch.column(at)]
            first = 0
            while first < batch.num_rows:
                end, held = first + 1, sizes[first]
                while end < batch.num_rows and held + sizes[end] <= width:
                    held += sizes[end]
                    end += 1
                some = batch.slice(first, end - first)
                yield pa.RecordBatch.from_arrays([made(c) if i == at else c for i, c in enumerate(some.columns)], names=some.schema.names)
                first = end

    return df.mapInArrow(run, df.withColumn(column, F.lit(None).cast(from_arrow_type(kind))).schema)


def tags(df: DataFrame, block: str, keys: list[str], literals: bool = True) -> DataFrame:
    """keys, tag_no, at, kind, length, offset and, with literals, literal: the
    elements of blocks. A block whose header cannot be read fails the query."""
    rows = df.select(*keys, F.col(block).alias("_list"))
    return _listed(rows, "_list", codec._elements(literals), codec.TAGS if literals else codec.SHAPES, TOGETHER).select(*keys, F.inline("_list"))


def chunks(df: DataFrame, stream: str, keys: list[str]) -> DataFrame:
    """keys, chunk_no, at, chunk_type, body_len, crc, body, error. A last row
    with an error stands for what could not be read."""
    rows = df.select(*keys, F.col(stream).alias("_list"))
    return _listed(rows, "_list", codec._mapped(codec.chunk_rows, codec.CHUNKS), codec.CHUNKS, 8 * TOGETHER).select(*keys, F.inline("_list"))


def gathered(df: DataFrame, keys: list[str], order: str, data: str, name: str = "bytes") -> DataFrame:
    """One value for each key: its pieces in the order of a column, so how rows
    were partitioned never shows. A value may have 2 GB; longer ones stay rows."""
    return df.groupBy(*keys).agg(F.expr(f"listagg(`{data}`) WITHIN GROUP (ORDER BY `{order}`)").alias(name))


def placed(df: DataFrame, keys: list[str], order: str, data: str, run: int = 1024) -> DataFrame:
    """df with start and total: how many bytes a key's values have before a
    row's, in the order of an integer column, and in all. Rows meet in runs of
    that column; only the runs' sums, one row for each, meet by key."""
    own = df.withColumn("_run", F.struct(*keys, F.expr(f"`{order}` div {run}").alias("_no")))
    n = F.coalesce(F.octet_length(data).cast("long"), F.lit(0).cast("long"))
    sums = own.groupBy("_run").agg(F.sum(n).alias("_n"))
    by = Window.partitionBy(*[F.col(f"_run.{k}") for k in keys])
    before = F.sum("_n").over(by.orderBy(F.col("_run._no").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1))
    base = sums.select("_run", F.coalesce(before, F.lit(0).cast("long")).alias("_base"), F.sum("_n").over(by).alias("total"))
    within = F.sum(n).over(Window.partitionBy("_run").orderBy(F.col(order).asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1))
    return own.withColumn("_within", F.coalesce(within, F.lit(0).cast("long"))).join(base, "_run").withColumn("start", F.col("_base") + F.col("_within")).drop("_run", "_base", "_within")


def slices(rows: DataFrame, keys: list[str], columns: list[str], size: int) -> DataFrame:
    """keys, piece_no, start, last and the columns: placed rows, cut where
    pieces of `size` bytes of their key's concatenation end. The columns of a
    row have equal lengths; empty and null ones have no slice."""
    end = F.col("start") + F.octet_length(columns[0])
    cut = rows.where(F.octet_length(columns[0]) > 0).withColumn("_end", end)
    cut = cut.withColumn("piece_no", F.explode(F.expr(f"sequence(start div {size}, (_end - 1) div {size})")))
    parts = [F.expr(f"substring(`{c}`, cast(greatest(piece_no * {size} - start, 0) + 1 as int), cast(least(_end, (piece_no + 1) * {size}) - greatest(start, piece_no * {size}) as int))").alias(c) for c in columns]
    return cut.select(*keys, "piece_no", F.greatest("start", F.col("piece_no") * size).alias("start"), F.expr(f"piece_no = (total - 1) div {size}").alias("last"), *parts)


def cut(df: DataFrame, keys: list[str], order: str, data: str, size: int, run: int = 1024) -> DataFrame:
    """keys, piece_no, bytes, last: the concatenation of each key's values, as
    gathered() would make it, in pieces of `size` bytes that never are one
    cell. An empty concatenation is one empty piece; one of nulls only is none."""
    pieces = slices(placed(df, keys, order, data, run), keys, [data], size).groupBy(*keys, "piece_no", "last").agg(F.expr(f"listagg(`{data}`) WITHIN GROUP (ORDER BY start)").alias("bytes"))
    empty = df.groupBy(*keys).agg(F.max(F.octet_length(data)).alias("_n")).where("_n = 0")
    return pieces.select(*keys, "piece_no", "bytes", "last").unionByName(empty.select(*keys, F.lit(0).cast("long").alias("piece_no"), F.lit(b"").alias("bytes"), F.lit(True).alias("last")))


def digests(df: DataFrame, keys: list[str], order: list[str], data: str) -> DataFrame:
    """keys, n_bytes, n_firsts, md5: length and MD5 of the concatenation of
    each key's values, and how many values the first column of `order` has.

    MD5 goes on from byte to byte, so a key's rows pass through one task, but
    only a batch of them is held. Without keys there is always one row."""
    rows = df.select(*keys, *order, data)
    rows = (rows.repartition(*keys) if keys else rows.repartition(1)).sortWithinPartitions(*keys, *order)
    k = len(keys)

    def fold(batches):
        key = held = None

        def told():
            columns = [pa.array([v], t) for v, t in zip(key, kinds)]
            some, md5, n, firsts, _ = held
            return pa.RecordBatch.from_arrays([*columns, pa.array([n if some else None], pa.int64()), pa.array([firsts], pa.int64()), pa.array([md5.hexdigest() if some else None], pa.string())], names=names)

        for batch in batches:
            kinds = [c.type for c in batch.columns[:k]]
            of = zip(*[c.to_pylist() for c in batch.columns[:k]]) if k else [()] * batch.num_rows
            for now, first, value in zip(of, batch.column(k).to_pylist(), batch.column(batch.num_columns - 1)):
                if held is None or now != key:
                    if held is not None:
                        yield told()
                    key, held = now, [False, hashlib.md5(), 0, 0, None]
                if not value.is_valid:
                    continue
                if not held[3] or first != held[4]:
                    held[3], held[4] = held[3] + 1, first
                piece = value.as_buffer()
                held[0] = True
                held[1].update(piece)
                held[2] += piece.size
        if held is not None:
            yield told()

    names = [*keys, "n_bytes", "n_firsts", "md5"]
    schema = rows.select(*keys).withColumns({"n_bytes": F.lit(0).cast("long"), "n_firsts": F.lit(0).cast("long"), "md5": F.lit("")}).schema
    for f in schema:
        f.nullable = True
    made = rows.mapInArrow(fold, schema)
    return made if keys else made.agg(F.max("n_bytes").alias("n_bytes"), F.coalesce(F.max("n_firsts"), F.lit(0).cast("long")).alias("n_firsts"), F.max("md5").alias("md5"))


def valid_by_tags(df: DataFrame, block: str, keys: list[str]) -> DataFrame:
    """keys, valid: whether tags stay within what they have produced and end at
    the declared length - a fold over the tags of each row. Rows are judged one
    by one, whatever their keys; a null block is null."""
    declared = exprs.try_uncompressed_length(F.col(block))
    readable = F.when(declared.isNotNull(), F.col(block))
    rows = _listed(df.select(*keys, F.col(block).isNull().alias("_none"), declared.alias("_declared"), readable.alias("_tags")), "_tags", codec._elements(False), codec.SHAPES, TOGETHER)

    def step(state, tag):
        back = tag["kind"].startswith("copy") & ~((tag["offset"] > 0) & (tag["offset"] <= state["made"]))
        return F.struct((state["made"] + tag["length"]).alias("made"), (state["bad"] | (tag["kind"] == "invalid") | F.coalesce(back, F.lit(False))).alias("bad"))

    start = F.struct(F.lit(0).cast("long").alias("made"), F.lit(False).alias("bad"))
    end = F.aggregate(F.coalesce("_tags", F.array().cast(rows.schema["_tags"].dataType)), start, step)
    walked = rows.select(*keys, "_none", "_declared", end.alias("_end"))
    sound = F.col("_declared").isNotNull() & ~F.col("_end.bad") & (F.col("_end.made") == F.col("_declared"))
    return walked.select(*keys, F.when(~F.col("_none"), F.coalesce(sound, F.lit(False))).alias("valid"))
