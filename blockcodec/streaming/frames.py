"""Stateful decoding and encoding of framed streams.

Rows (stream_id, seq, bytes, eof and, for encoding, flush) come in any order
within and across batches; they are used in the order of seq, from 0. State is one stream's unread tail,
how much of a skippable chunk is still to come, the next seq, rows that came
too early, and the error once there is one: nothing after it is ever decoded.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.constants import BLOCK_SIZE, IDENTIFIER, UNEXPECTED_END
from ..functions.kernels import data_chunks, decode_chunks, pieces_of, split_chunks

UNFRAMED = "stream_id string, seq bigint, value binary, error string"
FRAMED = "stream_id string, seq bigint, frames binary"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _InOrder(StatefulProcessor):
    """Hands rows to take() in the order of seq."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.next = handle.getValueState("next", "seq bigint")
        self.early = handle.getMapState("early", "seq bigint", "bytes binary, eof boolean, flush boolean")
        self.state = handle.getValueState("state", self.STATE)

    def handleInputRows(self, key, rows, timerValues):
        at = self.next.get()[0] if self.next.exists() else 0
        state = tuple(self.state.get()) if self.state.exists() else self.START
        # Rows that came too early wait in the state store, and what rows
        # complete goes on at once: neither ever is in memory as a whole.
        for batch in rows:
            for row in batch.itertuples(index=False):
                if pd.isna(row.seq):
                    raise ValueError("seq must not be null")
                seq, now = int(row.seq), (bytes(row.bytes or b""), bool(row.eof), bool(row.flush))
                if seq > at:
                    self.early.updateValue((seq,), now)
                    continue
                while now is not None and seq == at:
                    state, out = self.take(state, *now)
                    if out is not None:
                        yield pd.DataFrame({"stream_id": [key[0]], "seq": [at], **{k: pd.Series([v], dtype=object) for k, v in out.items()}})
                    at, now = at + 1, None
                    if self.early.containsKey((at,)):
                        data, eof, flush = self.early.getValue((at,))
                        seq, now = at, (bytes(data), eof, flush)
                        self.early.removeKey((at,))
        self.state.update(state)
        self.next.update((at,))

    def close(self) -> None:
        pass


class Unframe(_InOrder):
    STATE = "tail binary, skip bigint, failed string"
    START = (b"", 0, None)

    def take(self, state, data, eof, flush):
        tail, skip, failed = state
        if failed is not None:
            return state, None
        gone = min(skip, len(data))
        data, skip = bytes(tail) + data[gone:], skip - gone
        chunks, used, more, error = split_chunks(data, final=False)
        values, bad, _ = decode_chunks(chunks)
        error = bad or error
        skip += more
        if eof and error is None and (skip or used < len(data)):
            error = UNEXPECTED_END
        value = b"".join(values)
        out = dict(value=value, error=error) if value or error else None
        return (b"" if error else data[used:], skip, error), out


class Frame(_InOrder):
    STATE = "pending binary, started boolean"
    START = (b"", False)

    def take(self, state, data, eof, flush):
        pending, started = state
        data = bytes(pending) + data
        whole = len(data) if eof or flush else len(data) // BLOCK_SIZE * BLOCK_SIZE
        frames = (b"" if started else IDENTIFIER) + b"".join(data_chunks(pieces_of(data[:whole])))
        return (data[whole:], True), dict(frames=frames) if frames else None


def _stateful(rows: DataFrame, processor, schema: str, mode: str) -> DataFrame:
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    flush = F.col("flush") if "flush" in rows.columns else F.lit(False)
    return rows.select("stream_id", "seq", "bytes", "eof", flush.alias("flush")).groupBy("stream_id").transformWithStateInPandas(statefulProcessor=processor, outputStructType=schema, outputMode=mode, timeMode="None")


def unframe_stream(rows: DataFrame, mode: str = "Append") -> DataFrame:
    """stream_id, seq, value, error: what each row of a stream completes."""
    return _stateful(rows, Unframe(), UNFRAMED, mode)


def frame_stream(rows: DataFrame, mode: str = "Append") -> DataFrame:
    """stream_id, seq, frames: concatenated by seq, a framed stream. eof on a
    row flushes what is pending after it, and so does flush, where rows have
    that column."""
    return _stateful(rows, Frame(), FRAMED, mode)
