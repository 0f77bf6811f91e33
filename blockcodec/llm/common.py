"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}
#: The folder of the pipeline stage that is running, and that of the last one.
_STAGE: ContextVar[str | None] = ContextVar("stage", default=None)
_LAST: dict[str, str] = {}
#: Buckets of a written table: Spark refuses more than 100,000.
MAX_BUCKETS = 65_536


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees: spark.checkpoint.dir of the session, or
    what the context was given with setCheckpointDir.

    A session on this machine alone may have neither: then a folder of our own
    takes its place and goes when the process ends. On a cluster that is an
    error, as executors would not see the folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    given = spark.sparkContext._jsc.sc().getCheckpointDir()
    if given.isDefined():
        return given.get()
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="blockcodec-")
        atexit.register(shutil.rmtree, _OWN[app], ignore_errors=True)
    return "file://" + _OWN[app]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{_STAGE.get() or shared_dir(spark) + '/blockcodec'}/{uuid.uuid4().hex}/{name}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder, wherever it is."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def stage_scratch(spark: SparkSession):
    """What is written in here goes when the session enters the next such
    block: the result of a stage is written before the next stage begins, and
    needs nothing of the stage then. One pipeline at a time in a session."""
    app = spark.sparkContext.applicationId
    if app in _LAST:
        remove(spark, _LAST.pop(app))
    _LAST[app] = f"{shared_dir(spark)}/blockcodec/stage-{uuid.uuid4().hex}"
    token = _STAGE.set(_LAST[app])
    try:
        yield
    finally:
        _STAGE.reset(token)


def write_table(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, and what
    an executor computed survives its loss."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def write_buckets(df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """write_table(), bucketed by a key: passes over it by that key need no
    exchange. Above the number of buckets that Spark takes, a bucket has more
    keys. The catalogue entry is dropped at once; the files are what counts."""
    spark = df.sparkSession
    entry = f"{name}_{uuid.uuid4().hex}"
    n = max(1, min(int(buckets), MAX_BUCKETS))
    df.write.bucketBy(n, key).option("compression", "zstd").option("path", new_path(spark, name)).saveAsTable(entry)
    found = spark.table(entry)
    spark.sql(f"DROP TABLE {entry}")
    return found


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_row_id(docs: DataFrame, **cols) -> DataFrame:
    """cols by their new names, and _rid, an id of the row itself: doc_id may
    be null or repeat. Only stable once written."""
    return docs.select(*[c.alias(n) for n, c in cols.items()], F.monotonically_increasing_id().alias("_rid"))


def to_bytes(text) -> bytes:
    return b"" if text is None else text.encode("utf-8", "replace") if isinstance(text, str) else text


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: spreads hash values over all 64 bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))
