"""Toxicity by a classifier chain.

Categories are predicted one after another by linear (logistic) models over the
words of a text and the beginnings of words, by which words of one stem tell
alike; each model also gets the probabilities of the categories
before it. In training these are out-of-fold predictions, so that a later model
learns from probabilities such as it will see.

The fit takes a bounded sample of labelled rows; all texts are scored whole.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import to_bytes, write_table

#: About so many labelled rows at most are fitted on, chosen by a hash of doc_id.
TRAIN_ROWS = 8_000
#: Words and beginnings that the models see: those that tell toxic rows best.
VOCABULARY = 1024
#: Characters of a beginning; it stands for all words that are longer.
PREFIXES = (5, 6, 7)
FOLDS = 4
THRESHOLD = 0.5

#: Narrower categories have no labels of their own: the words that tell toxic
#: rows, whatever their language, are dealt into so many groups. A labelled row
#: has the category if it is labelled toxic and holds a word of the group.
GROUPS = 3
CHAIN = (*(f"group{k + 1}" for k in range(GROUPS)), "toxic")

_FOLD_CASE = bytes(c + 32 if 65 <= c <= 90 else 32 if c < 128 and not chr(c).isalnum() else c for c in range(256))


def word_set(text) -> set[bytes]:
    """The distinct words, A-Z lower-cased, ASCII punctuation as white space;
    and the beginnings of longer words, marked by a space before them."""
    words = set(to_bytes(text).translate(_FOLD_CASE).split())
    out = set(words)
    for w in words:
        if len(w) > PREFIXES[0]:
            s = w.decode("utf-8", "replace")
            out.update((" " + s[:n]).encode() for n in PREFIXES if len(s) > n)
    return out


@dataclass
class Chain:
    names: tuple[str, ...]
    vocabulary: dict[bytes, int]
    weights: list[np.ndarray]  # words, earlier probabilities, intercept

    def design(self, texts) -> np.ndarray:
        x = np.zeros((len(texts), len(self.vocabulary)), np.float32)
        known = self.vocabulary.keys()
        for row, t in zip(x, texts):
            for w in known & word_set(t):
                row[self.vocabulary[w]] = 1
        return x

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), 0))
        for w in self.weights:
            out = np.column_stack([out, logistic(x, out, w)])
        return out


def logistic(x, earlier, w):
    n, k = x.shape[1], earlier.shape[1]
    return 1 / (1 + np.exp(-np.clip(x @ w[:n].astype(x.dtype) + earlier @ w[n : n + k] + w[-1], -30, 30)))


def fit_logistic(x, earlier, y, l2: float = 3e-5, rounds: int = 10) -> np.ndarray:
    """Newton steps; the intercept isn't penalised."""
    z = np.column_stack([x, earlier.astype(np.float32), np.ones(len(x), np.float32)]).astype(np.float32)
    w = np.zeros(z.shape[1])
    if not len(y) or y.min() == y.max():
        w[-1] = 0.0 if not len(y) else 8.0 if y.max() > 0 else -8.0
        return w
    penalty = np.full(len(w), l2 * len(y))
    penalty[-1] = 0
    w[-1] = np.log(y.mean() / (1 - y.mean()))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w.astype(np.float32), -30, 30).astype(float)))
        s = np.sqrt(np.maximum(p * (1 - p), 1e-5)).astype(np.float32)
        half = z * s[:, None]
        hess = (half.T @ half).astype(float) + np.diag(penalty + 1e-4)
        move = np.linalg.solve(hess, (z.T @ (y - p).astype(np.float32)).astype(float) - penalty * w)
        w = w + move
        if np.abs(move).max() < 1e-2:
            break
    return w


def fit_chain(names, vocabulary, x: np.ndarray, labels: np.ndarray, folds: np.ndarray, l2: float = 3e-5) -> Chain:
    """labels: a column of 0/1 for each name. folds: the fold of each row."""
    weights, earlier = [], np.zeros((len(x), 0))
    for k in range(len(names)):
        y, held = labels[:, k].astype(float), np.zeros(len(x))
        for f in np.unique(folds):
            out = folds == f
            held[out] = logistic(x[out], earlier[out], fit_logistic(x[~out], earlier[~out], y[~out], l2))
        weights.append(fit_logistic(x, earlier, y, l2))
        earlier = np.column_stack([earlier, held])
    return Chain(tuple(names), vocabulary, weights)


def category_marks(x: np.ndarray, toxic: np.ndarray, telling) -> np.ndarray:
    """A column of 0/1 for each group. telling: columns of x, those that tell
    toxic rows best first; each goes to the group that has the fewest rows."""
    marks = np.zeros((len(x), GROUPS), bool)
    for k in telling:
        marks[:, marks.sum(axis=0).argmin()] |= (x[:, k] > 0) & (toxic > 0)
    return marks


def _words(batches):
    """(key, toxic, text hash, distinct words) of labelled rows."""
    for batch in batches:
        texts = batch.column("text").to_pylist()
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("toxic"), pa.array([xxhash.xxh64_intdigest(to_bytes(t)) - (1 << 63) for t in texts], pa.int64()), pa.array([sorted(word_set(t)) for t in texts], pa.list_(pa.binary()))],
            ["doc_id", "toxic", "same", "words"],
        )


def train(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, vocabulary: int = VOCABULARY) -> Chain:
    """labels: doc_id, toxic. Copies of one text teach once. Rows without a
    doc_id, a label or a text teach nothing."""
    known = labels.where("toxic is not null and doc_id is not null").select(F.col("doc_id").cast("long"), F.col("toxic").cast("int"))
    known = known.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)  # the rest is for measuring
    share = min(1.0, train_rows / max(1, known.count()))
    known = known.where(F.pmod(F.xxhash64("doc_id", F.lit("toxicity")), F.lit(1 << 20)) < int(share * (1 << 20)))
    # At most about train_rows ids and labels: a broadcast of bounded size.
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null").join(F.broadcast(known), "doc_id")
    rows = write_table(picked.mapInArrow(_words, "doc_id long, toxic int, same long, words array<binary>"), "toxic_words")
    one = rows.groupBy("same").agg(F.min(F.struct("doc_id", "toxic", "words")).alias("r")).select("r.*")
    n = one.agg(F.count("*").alias("n"), F.sum("toxic").alias("pos")).first()
    pos, neg = n["pos"] or 0, n["n"] - (n["pos"] or 0)
    df = one.select(F.explode("words").alias("word"), "toxic").groupBy("word").agg(F.sum("toxic").alias("a"), F.count("*").alias("df"))
    p = (F.col("a") + 0.5) / (pos + 1)
    q = (F.col("df") - F.col("a") + 0.5) / (neg + 1)
    telling = F.abs(F.log(p / q)) / F.sqrt(1 / (F.col("a") + 0.5) + 1 / (F.col("df") - F.col("a") + 0.5))
    best = df.where("df >= 3").orderBy(telling.desc(), "word").limit(vocabulary).select("word", (p > q).alias("for_toxic")).collect()
    index = {w: i for i, w in enumerate(sorted(bytes(r["word"]) for r in best))}
    found = one.select("doc_id", "toxic", F.array_intersect("words", F.array(*[F.lit(w) for w in index]).cast("array<binary>")).alias("words")).toArrow()
    x = np.zeros((found.num_rows, len(index)), np.float32)
    for row, ws in zip(x, found["words"].to_pylist()):
        for w in ws:
            row[index[w]] = 1
    toxic = np.array(found["toxic"].to_pylist(), float)
    marks = category_marks(x, toxic, [index[bytes(r["word"])] for r in best if r["for_toxic"]])
    folds = np.array([xxhash.xxh32_intdigest(str(i)) % FOLDS for i in found["doc_id"].to_pylist()], int)
    return fit_chain(CHAIN, index, x, np.column_stack([marks, toxic]).astype(float), folds)


def _scores(chain: Chain, threshold: float):
    def run(batches):
        for batch in batches:
            p = chain.probabilities(chain.design(batch.column("text").to_pylist()))
            cols = [pa.array(p[:, k]) for k in range(len(chain.names))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *cols, pa.array(p[:, -1] >= threshold)], ["doc_id", *[f"p_{n}" for n in chain.names], "toxic"])

    return run


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **options) -> DataFrame:
    """One row for each row of docs: doc_id, a probability p_<category> for each
    category of the chain, and toxic (p_toxic is threshold or more). A null
    text counts as empty; a null doc_id is scored like any other."""
    chain = train(docs, labels, **options)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_scores(chain, threshold), "doc_id long, " + ", ".join(f"p_{n} double" for n in chain.names) + ", toxic boolean")
