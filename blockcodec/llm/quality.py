"""Quality classifier: random Fourier features, ridge and isotonic calibration.

Document statistics (never labels, lang, source or doc_id) are mapped by random
Fourier features, which approximate a Gaussian kernel; partitions sum their
share of the normal equations; the driver solves them for ridge weights. Two
folds of the training rows score each other, and isotonic regression over those
scores calibrates the final model, which is fitted on both.
"""

from __future__ import annotations

from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import to_bytes, write_table

SYMBOLS = b"#*$%&|<>"
UPPER, DIGITS, STOPS = bytes(range(65, 91)), bytes(range(48, 58)), b".,;:?"
HIGH = bytes(range(128, 256))
CONTINUED = bytes(range(128, 192))
N_STATS = 20
FEATURES = 256
#: The fit uses at most about this many labelled rows, chosen by a hash.
TRAIN_ROWS = 200_000
THRESHOLD = 0.3


def statistics(text) -> list[float]:
    """N_STATS numbers of a whole text; null counts as empty."""
    raw = to_bytes(text)
    words = raw.split()
    n, size = len(words), max(1, len(raw))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    chars = max(1, len(raw) - _count(raw, CONTINUED))
    per_word, distinct = max(1, n), len(set(words))
    sizes = list(map(len, words))
    return [
        np.log1p(n),
        sum(sizes) / per_word,
        max(sizes, default=0) ** 0.5,
        _count(raw, SYMBOLS) / per_word,
        raw.count(b"|") / per_word,
        raw.count(b"!") / per_word,
        _count(raw, DIGITS) / chars,
        _count(raw, UPPER) / chars,
        _count(raw, STOPS) / per_word,
        _count(raw, HIGH) / size,
        distinct / per_word,
        distinct / per_word**0.5,
        sum(map(eq, words, words[1:])) / per_word,
        len(set(zip(words, words[1:]))) / per_word,
        sum(s <= 3 for s in sizes) / per_word,
        np.log1p(len(lines)),
        1 - len(set(lines)) / max(1, len(lines)),
        np.log1p(n / max(1, len(lines))),
        _count(raw, b"(){}[]=;_/\\@") / per_word,
        sum(len(x) > 1 and x.isupper() for x in words) / per_word,
    ]


def _count(raw: bytes, which: bytes) -> int:
    return len(raw) - len(raw.translate(None, which))


def _stats(batches):
    for batch in batches:
        flat = np.array([statistics(t) for t in batch.column("text").to_pylist()], np.float64).reshape(-1)
        lists = pa.FixedSizeListArray.from_arrays(pa.array(flat), N_STATS).cast(pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists], ["doc_id", "stats"])


def _labelled_stats(batches):
    for batch in batches:
        found = next(_stats([batch.select(["doc_id", "text"])]))
        yield pa.RecordBatch.from_arrays([found.column("doc_id"), found.column("stats"), batch.column("label").cast(pa.float64())], ["key", "stats", "label"])


def document_statistics(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_stats, "doc_id long, stats array<double>")


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    omega: np.ndarray
    phase: np.ndarray
    weights: np.ndarray
    knots: np.ndarray  # raw scores, increasing
    levels: np.ndarray  # calibrated scores, not decreasing

    def features(self, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats - self.mean) / self.scale, -6, 6)
        z = np.cos(x @ self.omega + self.phase) * np.sqrt(2 / len(self.phase))
        return np.hstack([z, np.ones((len(x), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(stats), self.knots, self.levels)


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray):
    """Pool adjacent violators over points in order of x: (knots, levels),
    interpolated between the ends of the blocks."""
    blocks: list[list[float]] = []
    for a, b, c in zip(x, y, w):
        blocks.append([a, a, b, c])
        while len(blocks) > 1 and blocks[-2][2] >= blocks[-1][2]:
            _, hi, v, n = blocks.pop()
            p = blocks[-1]
            blocks[-1] = [p[0], hi, (p[2] * p[3] + v * n) / (p[3] + n), p[3] + n]
    knots = [k for lo, hi, _, _ in blocks for k in ((lo, hi) if hi > lo else (lo,))]
    levels = [v for lo, hi, v, _ in blocks for _ in ((lo, hi) if hi > lo else (lo,))]
    return np.array(knots), np.array(levels)


def _equations(model: Model):
    """Each partition's share of X'X and X'y, by fold, as one blob a fold."""

    def run(batches):
        d = len(model.phase) + 1
        sums = {}
        for batch in batches:
            x = model.features(np.array(batch.column("stats").to_pylist(), np.float64).reshape(-1, N_STATS))
            y, fold = batch.column("label").to_numpy(), batch.column("fold").to_numpy()
            for f in np.unique(fold):
                s = sums.setdefault(int(f), np.zeros((d, d + 1)))
                own = x[fold == f]
                s += own.T @ np.column_stack([own, y[fold == f]])
        for f, s in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([f], pa.int32()), pa.array([s.tobytes()], pa.binary())], ["fold", "sums"])

    return run


def _added(group: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(s.as_py()) for s in group["sums"])
    return pa.table({"fold": group["fold"][:1], "sums": pa.array([total.tobytes()], pa.binary())})


def _solve(sums: np.ndarray, ridge: float) -> np.ndarray:
    a = sums[:, :-1] + ridge * np.eye(len(sums))
    a[-1, -1] -= ridge  # the intercept isn't shrunk
    return np.linalg.lstsq(a, sums[:, -1], rcond=None)[0]


def fit(train: DataFrame, features: int = FEATURES, ridge: float = 1e-2, gamma: float = 0.04, seed: int = 17) -> Model:
    """train: key (any type), stats and label 0/1. With no rows, or one class
    only, every score is the share of label 1 (0.5 without rows)."""
    train = train.select("stats", F.col("label").cast("double").alias("label"), F.pmod(F.xxhash64("key", F.lit("fold")), F.lit(2)).cast("int").alias("fold"))
    train = write_table(train.repartition(16), "train")
    s = F.col("stats")
    first = train.agg(F.count("*").alias("n"), F.avg("label").alias("p"), *[F.avg(s[i]).alias(f"m{i}") for i in range(N_STATS)], *[F.stddev_pop(s[i]).alias(f"s{i}") for i in range(N_STATS)]).first()
    rng = np.random.default_rng(seed)
    omega, phase = rng.normal(0, np.sqrt(2 * gamma), (N_STATS, features)), rng.uniform(0, 2 * np.pi, features)
    mean = np.array([first[f"m{i}"] or 0 for i in range(N_STATS)])
    scale = np.array([first[f"s{i}"] or 1 for i in range(N_STATS)])
    blank = Model(mean, np.where(scale > 1e-9, scale, 1), omega, phase, np.zeros(features + 1), np.zeros(1), np.full(1, 0.5 if first["p"] is None else first["p"]))
    if first["p"] in (None, 0.0, 1.0):
        return blank
    found = train.mapInArrow(_equations(blank), "fold int, sums binary").groupBy("fold").applyInArrow(_added, "fold int, sums binary").collect()
    sums = {r["fold"]: np.frombuffer(r["sums"]).reshape(features + 1, features + 2) for r in found}
    blank.weights = _solve(sum(sums.values()), ridge)
    halves = {f: _solve(sums.get(1 - f, sums[f]), ridge) for f in sums}

    def held(batches):
        for batch in batches:
            x = blank.features(np.array(batch.column("stats").to_pylist(), np.float64).reshape(-1, N_STATS))
            raw = np.einsum("ij,ij->i", x, np.array([halves[f] for f in batch.column("fold").to_pylist()]).reshape(len(x), -1))
            yield pa.RecordBatch.from_arrays([pa.array(np.round(np.clip(raw, -1, 2), 3)), batch.column("label")], ["raw", "label"])

    bins = train.mapInArrow(held, "raw double, label double").groupBy("raw").agg(F.avg("label").alias("y"), F.count("*").alias("w")).orderBy("raw").toPandas()  # 3,001 bins at most
    blank.knots, blank.levels = isotonic(bins["raw"].to_numpy(), bins["y"].to_numpy(), bins["w"].to_numpy(float))
    return blank


def held_out(doc_id) -> F.Column:
    """Rows whose crc32(doc_id as text) mod 5 is 0 are never learnt from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def _sampled(df: DataFrame, key: str, train_rows: int) -> DataFrame:
    """About train_rows of the rows, picked by a hash of the key; all of them
    where there are no more."""
    share = min(1, train_rows / max(1, df.count()))
    return df.where(F.pmod(F.xxhash64(key, F.lit("quality")), F.lit(1 << 20)) < int(share * (1 << 20)))


def labelled_rows(labels: DataFrame, label: str = "quality", train_rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id and label of the rows to learn from: no held out row, no null
    doc_id or label, and about train_rows at most."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).alias("label"))
    return _sampled(known.where(~held_out(F.col("doc_id"))), "doc_id", train_rows)


def labelled_statistics(docs: DataFrame, labels: DataFrame, label: str = "quality", train_rows: int = TRAIN_ROWS) -> DataFrame:
    """key, stats, label: statistics of the documents to learn from only."""
    known = labelled_rows(labels, label, train_rows)
    some = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(known, "doc_id")
    return some.mapInArrow(_labelled_stats, "key long, stats array<double>, label double")


def fit_quality(train: DataFrame, **options) -> Model:
    """From labelled_statistics(), or rows of that kind."""
    return fit(train, **options)


def _scores(model: Model):
    def run(batches):
        for batch in batches:
            stats = np.array(batch.column("stats").to_pylist(), np.float64).reshape(-1, N_STATS)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(stats))], ["doc_id", "score"])

    return run


def quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, train_rows: int = TRAIN_ROWS, **options) -> DataFrame:
    """One row for each row of docs: doc_id, held_out, score, predicted.

    score is from 0 to 1, higher for texts likelier to be labelled 1; null and
    empty texts are scored as texts without words. A null doc_id is scored, and
    its held_out is false. predicted is 1 from threshold on.
    """
    stats = write_table(document_statistics(docs), "stats")
    known = labelled_rows(labels, train_rows=train_rows)
    model = fit_quality(stats.join(known, "doc_id").select(F.col("doc_id").alias("key"), "stats", F.col("label").cast("double").alias("label")), **options)
    scored = stats.mapInArrow(_scores(model), "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def _passing(model: Model, text_col: str, threshold: float):
    def run(batches):
        for batch in batches:
            stats = np.array([statistics(t) for t in batch.column(text_col).to_pylist()], np.float64).reshape(-1, N_STATS)
            yield batch.filter(pa.array(model.score(stats) >= threshold))

    return run


def keep_quality(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with all their columns, that score threshold or more:
    one pass that moves no text. A null text is scored as an empty one, null
    and repeated doc_ids like any other row."""
    return docs.mapInArrow(_passing(model, text_col, threshold), docs.schema)
