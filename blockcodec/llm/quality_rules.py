"""Quality rules: counts of a text, and a line sequence model for the verdict.

A linear-chain conditional random field labels the lines of a text as content
or boilerplate; Viterbi decoding gives the best labelling as a whole, so that a
line is judged with its neighbours. The share of the text in content lines
decides whether it stays.

Lines have no labels of their own: the field learns from the quality labels of
documents. At first a line has its document's label; then, by hard
expectation-maximisation, the lines of bad documents are labelled anew by the
field itself, at least one of each document staying boilerplate. As the lines of
a document have mostly one label, the field learns that neighbours agree, and a
line that could be either is judged by them.
"""

from __future__ import annotations

from collections import Counter
from operator import eq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import to_bytes
from .quality import labelled_rows

SYMBOLS = b"#*$%&|<>"
HIGH_PART = bytes(range(128, 192))
N_FEATURES = 14
CONTENT, BOILERPLATE = 0, 1
#: The fit takes about so many labelled documents, chosen by a hash of doc_id,
#: and of each at most RUNS runs of RUN_LINES lines, from anywhere in it.
TRAIN_DOCS, RUNS, RUN_LINES = 3_000, 3, 48
#: How often the lines of bad documents are labelled anew.
RELABELLED = 2
CONTENT_SHARE = 0.5


def _count(raw: bytes, which: bytes) -> int:
    return len(raw) - len(raw.translate(None, which))


def repeated_words(words: list[bytes], width: int = 3) -> int:
    """Words covered by windows of width words that occur twice or more."""
    grams = list(zip(*(words[i:] for i in range(width))))
    if len(set(grams)) == len(grams):
        return 0
    often = Counter(grams)
    total = until = 0
    for i, g in enumerate(grams):
        if often[g] > 1:
            total += i + width - max(i, until)
            until = i + width
    return total


def base_counts(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    raw = to_bytes(text)
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.split()] if b"\n" in raw else []
    return len(words), sum(map(len, words)) - _count(raw, HIGH_PART), _count(raw, SYMBOLS), len(lines) - len(set(lines)), repeated_words(words)


def line_features(lines: list[bytes]) -> np.ndarray:
    """A row of N_FEATURES for each line; a line should have a word."""
    out, seen = np.zeros((len(lines), N_FEATURES)), set()
    for row, line in zip(out, lines):
        words = line.split()
        n, size = max(1, len(words)), max(1, len(line))
        symbols = _count(line, SYMBOLS)
        repeats = sum(map(eq, words, words[1:]))
        row[:] = (
            1,
            min(n, 60) / 30,
            min(1.5, symbols / n),
            symbols >= 0.3 * n,
            min(1.5, line.count(b"!") / n),
            repeats / n,
            repeats >= 0.3 * n,
            len(set(words)) / n,
            2 * _count(line, bytes(range(65, 91))) / size,
            2 * _count(line, bytes(range(48, 58))) / size,
            line.rstrip()[-1:] in b".!?:\"')" if line.strip() else 0,
            line in seen,
            n <= 3,
            _count(line, b"/@=_{}[]\\") / n,
        )
        seen.add(line)
    return out


def _side_by_side(sequences):
    """Batches of sequences of about one length: (features, labels, which
    places are used), so that a step works on many at once and few are empty."""
    groups: dict[int, list] = {}
    for x, y in sequences:
        if len(x):
            groups.setdefault((len(x) - 1).bit_length(), []).append((x, y))
    for _, group in sorted(groups.items()):
        n, longest = len(group), max(len(x) for x, _ in group)
        x, y, on = np.zeros((n, longest, group[0][0].shape[1])), np.zeros((n, longest), int), np.zeros((n, longest), bool)
        for i, (a, b) in enumerate(group):
            x[i, : len(a)], y[i, : len(a)], on[i, : len(a)] = a, b, True
        yield x, y, on


def _expected(x, on, w, t):
    """Expected counts of states by feature and of pairs of states."""
    e, longest = x @ w, x.shape[1]
    fwd, bwd = np.zeros_like(e), np.zeros_like(e)
    fwd[:, 0] = e[:, 0]
    for k in range(1, longest):
        fwd[:, k] = np.logaddexp(fwd[:, k - 1, :1] + t[0], fwd[:, k - 1, 1:] + t[1]) + e[:, k]
        fwd[:, k] = np.where(on[:, k, None], fwd[:, k], fwd[:, k - 1])
    for k in range(longest - 2, -1, -1):
        after = bwd[:, k + 1] + e[:, k + 1]
        bwd[:, k] = np.where(on[:, k + 1, None], np.logaddexp(after[:, :1] + t[:, 0], after[:, 1:] + t[:, 1]), 0)
    z = np.logaddexp(fwd[:, -1, 0], fwd[:, -1, 1])
    p = np.exp(fwd + bwd - z[:, None, None]) * on[..., None]
    joint = np.exp(fwd[:, :-1, :, None] + t + (e + bwd)[:, 1:, None, :] - z[:, None, None, None]) * on[:, 1:, None, None]
    return np.einsum("nlf,nls->fs", x, p), joint.sum((0, 1))


def train_crf(sequences, rounds: int = 120, rate: float = 0.5, l2: float = 1e-4, start=None):
    """sequences: (features, labels). Returns (weights by state, transitions)
    that maximise the penalised likelihood; forward-backward gives the
    expectations of the gradient. start: a field to go on from."""
    w, t = start or (np.zeros((N_FEATURES, 2)), np.zeros((2, 2)))
    batches = list(_side_by_side(sequences))
    if not batches:
        return w, t
    total, seen_w, seen_t = 0, np.zeros_like(w), np.zeros_like(t)
    for x, y, on in batches:
        hot = np.eye(2)[y] * on[..., None]
        total += on.sum()
        seen_t = seen_t + np.einsum("nla,nlb->ab", hot[:, :-1], hot[:, 1:])
        seen_w = seen_w + np.einsum("nlf,nls->fs", x, hot)
    g_w, g_t = np.zeros_like(w), np.zeros_like(t)
    for _ in range(rounds):
        found = [_expected(x, on, w, t) for x, _, on in batches]
        d_w = (seen_w - sum(f[0] for f in found)) / total - l2 * w
        d_t = (seen_t - sum(f[1] for f in found)) / total - l2 * t
        g_w, g_t = g_w + d_w**2, g_t + d_t**2
        w, t = w + rate * d_w / np.sqrt(g_w + 1e-12), t + rate * d_t / np.sqrt(g_t + 1e-12)
    return w, t


def learn(runs, rounds: int = 60):
    """runs: (features, quality) of runs of lines -> a field."""
    runs = [(x, q) for x, q in runs if len(x)]
    labels = [np.full(len(x), CONTENT if q else BOILERPLATE) for x, q in runs]
    field = train_crf(list(zip((x for x, _ in runs), labels)), rounds)
    for _ in range(RELABELLED):
        for i, (x, q) in enumerate(runs):
            if not q:
                y, e = np.array(viterbi(x, *field)), x @ field[0]
                y[int(np.argmax(e[:, BOILERPLATE] - e[:, CONTENT]))] = BOILERPLATE
                labels[i] = y
        field = train_crf(list(zip((x for x, _ in runs), labels)), rounds // 2, start=field)
    return field


def viterbi(x: np.ndarray, w: np.ndarray, t: np.ndarray) -> list[int]:
    """The best labelling of a sequence of lines; a tie goes to content."""
    emit = (x @ w).tolist()
    if not emit:
        return []
    (aa, ab), (ba, bb) = t.tolist()
    back, (a, b) = [], emit[0]
    for ea, eb in emit[1:]:
        from_a, from_b = a + aa < b + ba, a + ab < b + bb
        back.append((from_a, from_b))
        a, b = (b + ba if from_a else a + aa) + ea, (b + bb if from_b else a + ab) + eb
    state = int(b > a)
    path = [state]
    for step in reversed(back):
        state = int(step[state])
        path.append(state)
    return path[::-1]


def content_share(text, w, t) -> float:
    """The share of bytes in lines with a word that content lines have; 0 for
    a text without words."""
    lines = [x for x in to_bytes(text).split(b"\n") if x.split()]
    labels = viterbi(line_features(lines), w, t)
    total = sum(map(len, lines))
    return sum(len(x) for x, s in zip(lines, labels) if s == CONTENT) / total if total else 0.0


def chosen_runs(text) -> list[np.ndarray]:
    """The features of RUNS runs of lines at most, by a hash of the text and
    the run's number; of all lines, where there are no more."""
    raw = to_bytes(text)
    x = line_features([line for line in raw.split(b"\n") if line.split()])
    runs = [x[at : at + RUN_LINES] for at in range(0, len(x), RUN_LINES)]
    seed = xxhash.xxh64_intdigest(raw)
    order = sorted(range(len(runs)), key=lambda k: xxhash.xxh64_intdigest(str(k), seed))
    return [runs[k] for k in sorted(order[:RUNS])]


def _training_lines(batches):
    for batch in batches:
        rows, quality = [], []
        for t, q in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist()):
            for x in chosen_runs(t):
                rows.append(x.tolist())
                quality.append(int(q))
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.list_(pa.float64()))), pa.array(quality, pa.int32())], ["x", "quality"])


def train(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS):
    """A field from about train_docs labelled documents at most (doc_id, text;
    doc_id, quality). Held out rows teach nothing, nor do those without a
    doc_id or a label. Without any, the field holds all lines for content."""
    known = labelled_rows(labels, train_rows=train_docs)
    some = docs.join(known, "doc_id").select("text", "label")
    found = some.mapInArrow(_training_lines, "x array<array<double>>, quality int").toArrow()
    runs = [(np.array(x, float).reshape(-1, N_FEATURES), q) for x, q in zip(found["x"].to_pylist(), found["quality"].to_pylist())]
    return learn(sorted(runs, key=lambda r: (len(r[0]), r[0].tobytes(), r[1])))


OUT = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_share double"


def _rules(w, t, least: float):
    def run(batches):
        for batch in batches:
            rows = []
            for key, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                n, chars, symbols, dups, repeats = base_counts(text)
                failed, share = n < 50 or 100 * repeats > 50 * n, content_share(text, w, t)
                rows.append((key, n, chars, symbols, dups, repeats, failed, not failed and share >= least, share))
            kinds = [pa.int64()] * 6 + [pa.bool_()] * 2 + [pa.float64()]
            names = [c.split()[0] for c in OUT.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names) if rows else pa.RecordBatch.from_arrays([pa.array([], k) for k in kinds], names)

    return run


def quality_rules(docs: DataFrame, labels: DataFrame | None = None, least_share: float = CONTENT_SHARE, field=None, **options) -> DataFrame:
    """One row for each row of docs: doc_id, the counts, base_failed, kept and
    content_share.

    Words are the runs between bytes 09-0D and 20; a null text has none and
    fails the base rules (n_words under 50, or more than half of the words in
    repeated three-word windows). kept is false where those fail, else whether
    content lines have at least least_share of the text. field: (weights,
    transitions) of a trained field; trained on docs and labels where it is not
    given. Null and repeated doc_ids pass through; a line is a line however
    long it is; columns of other names are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    w, t = field or train(rows, labels, **options)
    return rows.mapInArrow(_rules(w, t, least_share), OUT)
