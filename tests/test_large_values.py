"""Concatenations of many rows never become one cell."""

import hashlib
import random

import pandas as pd
import pytest

from blockcodec.functions import kernels as K
from blockcodec.operators import tables
from blockcodec.queries import QUERIES
from blockcodec.sources import frames
from blockcodec.streaming.frames import Frame, Unframe

SF = "/root/testdata/sf0.001"


def rows(seed, n=400):
    rng = random.Random(seed)
    return [(rng.choice(["a", "b", None]), i * 7, rng.randbytes(rng.choice([0, 1, 50, 3000])) if rng.random() < 0.9 else None) for i in range(n)] + [("empty", 5, b""), ("empty", 9, None), ("none", 1, None)]


def joined(some):
    out = {}
    for k, _, v in sorted(some, key=lambda r: r[1]):
        out[k] = out.get(k) if v is None else (out.get(k) or b"") + v
    return out


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString().lower()


def test_digests_are_those_of_the_whole(spark):
    some = rows(1)
    df = spark.createDataFrame(some, "k string, no long, data binary").repartition(7)
    got = {r["k"]: (r["n_bytes"], r["md5"]) for r in tables.digests(df, ["k"], ["no"], "data").collect()}
    assert got == {k: (None, None) if v is None else (len(v), hashlib.md5(v).hexdigest()) for k, v in joined(some).items()}
    whole = b"".join(v or b"" for _, _, v in sorted(some, key=lambda r: r[1]))
    assert tables.digests(df, [], ["no"], "data").first().asDict() == {"n_bytes": len(whole), "n_firsts": sum(v is not None for _, _, v in some), "md5": hashlib.md5(whole).hexdigest()}
    assert tables.digests(df.where("no < 0"), [], ["no"], "data").first().asDict() == {"n_bytes": None, "n_firsts": 0, "md5": None}


def test_source_roundtrip_makes_no_cell_of_all(spark):
    assert "listagg" not in plan(QUERIES["q_source_roundtrip"](spark, SF))


def test_a_read_has_a_bounded_number_of_tasks(tmp_path, monkeypatch):
    data = random.Random(3).randbytes(40 * K.BLOCK_SIZE)
    (tmp_path / "x.sz").write_bytes(K.frame(data))
    reader = frames.FramesReader({"path": str(tmp_path), "split_bytes": "1000"})
    assert len(reader.partitions()) > 30
    monkeypatch.setattr(frames, "READ_TASKS", 3)
    parts = reader.partitions()
    assert len(parts) == 3
    read = [r for p in parts for b in reader.read(p) for r in b.to_pylist() if r["value"] is not None]
    assert b"".join(r["value"] for r in read) == data and [r["chunk_no"] for r in read] == list(range(1, 41))


def test_cut_pieces_are_those_of_the_whole(spark):
    some = rows(2)
    df = spark.createDataFrame(some, "k string, no long, data binary").repartition(7)
    for size, run in ((1000, 50), (4096, 1024)):
        got = {}
        for r in tables.cut(df, ["k"], "no", "data", size, run).collect():
            got.setdefault(r["k"], {})[r["piece_no"]] = (bytes(r["bytes"]), r["last"])
        for k, whole in joined(some).items():
            if whole is None:
                assert k not in got
                continue
            want = [whole[at : at + size] for at in range(0, len(whole), size)] or [b""]
            assert got[k] == {i: (p, i == len(want) - 1) for i, p in enumerate(want)}


class Handle:
    """State that is kept in dictionaries."""

    def __init__(self):
        self.values = {}

    def getValueState(self, name, schema):
        return State(self.values, name)

    def getMapState(self, name, key, value):
        return State(self.values.setdefault(name, {}), None)


class State:
    def __init__(self, where, name):
        self.where, self.name = where, name

    def exists(self):
        return self.name in self.where

    def get(self):
        return self.where[self.name]

    def update(self, value):
        self.where[self.name] = value

    def containsKey(self, k):
        return k in self.where

    def getValue(self, k):
        return self.where[k]

    def updateValue(self, k, v):
        self.where[k] = v

    def removeKey(self, k):
        del self.where[k]


def stream_batches(pieces, order, read):
    for no in order:
        read.append(no)
        yield pd.DataFrame({"stream_id": ["s"], "seq": [no], "bytes": [pieces[no]], "eof": [no == len(pieces) - 1], "flush": [False]})


@pytest.mark.parametrize("kind", [Frame, Unframe])
def test_streams_hand_on_rows_before_the_next_are_read(kind):
    data = random.Random(5).randbytes(300_000)
    given = data if kind is Frame else K.frame(data)
    pieces = [given[at : at + 70_000] for at in range(0, len(given), 70_000)]
    for order in ([0, 1, 2, 3, 4], [4, 2, 0, 1, 1, 0, 3]):
        processor, read, out, early = kind(), [], [], []
        processor.init(Handle())
        for df in processor.handleInputRows(("s",), stream_batches(pieces, order, read), None):
            early.append(len(read) < len(order))
            out += df.to_dict("records")
        assert early[0] and [r["seq"] for r in out] == [0, 1, 2, 3, 4]
        assert b"".join(r["frames" if kind is Frame else "value"] for r in out) == (K.frame(data) if kind is Frame else data)


def test_elements_are_found_in_runs_of_rows(spark, monkeypatch):
    rng = random.Random(6)
    data = [(i, None if i % 9 == 8 else bytes(rng.choices(b"abc", k=rng.choice([0, 30, 900])))) for i in range(60)]
    blocks = spark.createDataFrame([(i, v if v is None else K.compress(v)) for i, v in data], "id long, b binary").coalesce(1)
    streams = spark.createDataFrame([(i, v if v is None else K.frame(v)) for i, v in data], "id long, b binary").coalesce(1)
    for together in (1, 500, tables.TOGETHER):
        monkeypatch.setattr(tables, "TOGETHER", together)
        tags, chunks = tables.tags(blocks, "b", ["id"], literals=False), tables.chunks(streams, "b", ["id"])
        for df in (tags, chunks, tables.valid_by_tags(blocks, "b", ["id"])):
            assert "mapinarrow" in plan(df) and "arrowevalpython" not in plan(df)
        assert sorted((r["id"], r["tag_no"], r["length"]) for r in tags.collect()) == [(i, t["tag_no"], t["length"]) for i, v in data if v is not None for t in K.tags(K.compress(v))]
        assert sorted((r["id"], r["chunk_no"]) for r in chunks.collect()) == [(i, n) for i, v in data if v is not None for n in range(1 + bool(v))]
        assert {r["id"]: r["valid"] for r in tables.valid_by_tags(blocks, "b", ["id"]).collect()} == {i: None if v is None else True for i, v in data}


def test_flush_boundaries_gather_no_source(spark):
    text = plan(QUERIES["q_frame_flush_boundaries"](spark, SF))
    gathering = [line for line in text.splitlines() if "collect_list" in line or "listagg" in line]
    assert gathering and all("piece_no" in line.split("[", 2)[1] for line in gathering if "aggregate [" in line)
