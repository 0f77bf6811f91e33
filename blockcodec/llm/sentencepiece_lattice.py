"""SentencePiece encoding and decoding over a relational lattice.

Distinct words are exploded into their substrings of bounded length, which are
equi-joined to the piece table; the joined edges are grouped by word, and a
Spark higher-order aggregate folds each word's lattice into its pieces.

For unigram models the fold is Viterbi: the path of the greatest score. Models
of type BPE are not defined by a best path but by the order of merges, and
Viterbi is wrong for many words there, so their fold makes the merges: at each
step, of the edges that join two neighbouring pieces, the one of the best score
and then the leftmost.

Texts stay in blocks as word numbers. Only a block's distinct words, and then
their ids, are shuffled, so neither follows how often a word occurs.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import zlib
from dataclasses import dataclass
from operator import add

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shuffle_partitions, write_buckets

SPACE = "▁"
#: Longer words are cut into pieces outside the lattice, whose positions are
#: the bits of a long. The result is the same.
LONGEST = 60
BLOCK_BYTES = 16 << 20
WORDS_A_PARTITION = 60_000


@dataclass
class Pieces:
    """A SentencePiece model: its pieces, ranked by score (equal scores tie)."""

    ids: dict[str, int]
    rank: dict[str, int]
    score: dict[str, float]
    text: list[bytes]  # by id, for decoding
    byte: list[int]  # the id of each byte piece
    longest: int
    pattern: str
    dummy_prefix: bool = True
    cuts_lines: bool = True  # no piece has a line end
    pairs: frozenset[str] = frozenset()  # neighbouring characters within pieces

    def words(self, text: str) -> list[str]:
        """No piece reaches over the end of a word."""
        if not text:
            return []
        s = text.replace(" ", SPACE)
        return re.findall(self.pattern, SPACE + s if self.dummy_prefix else s)

    def keys(self, text: str) -> list[str]:
        """words(), each as word_of() reads it. Nearly all words follow one
        space: those are their plain text, others have a mark before them."""
        if not text:
            return []
        if SPACE in text or "  " in text or "\0" in text or "\t" in text or "\r" in text or text[0] == " " or not self.dummy_prefix or not self.cuts_lines:
            return ["\0" + w for w in self.words(text)]
        if "\n" not in text:
            return text.split(" ")
        out = []
        for k, line in enumerate(text.split("\n")):
            parts = line.split(" ")
            if k:
                out.append("\0\n")
                if parts[0]:
                    out.append("\0" + parts[0])
                del parts[0]
            elif not line:
                parts = [""]  # the prefix alone
            out += parts
        return out

    def parts(self, words: list[str]) -> tuple[list[str], np.ndarray]:
        """Words cut where no piece has the two neighbours: a piece never
        reaches over such a place, and fewer different parts are left. The
        parts of all words in turn, and how many each word has."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        starts = np.cumsum(lengths) - lengths
        whole = "".join(words)
        code = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        used = np.zeros(0x110000, np.int32)
        used[code] = 1
        chars = np.nonzero(used)[0]
        used[chars] = np.arange(len(chars))
        number = used[code]
        index = {chr(c): i for i, c in enumerate(chars.tolist())}
        joined = np.zeros((len(chars), len(chars)), bool)
        for pair in self.pairs:
            if pair[0] in index and pair[1] in index:
                joined[index[pair[0]], index[pair[1]]] = True
        cut = np.ones(len(code), bool)
        cut[1:] = ~joined[number[:-1], number[1:]]
        cut[starts] = True
        at = np.nonzero(cut)[0]
        counts = np.diff(np.append(np.searchsorted(at, starts), len(at)))
        bounds = [*at.tolist(), len(code)]
        return [whole[i:j] for i, j in zip(bounds, bounds[1:])], counts

    @staticmethod
    def word_of(key: str) -> str:
        return key[1:] if key[:1] == "\0" else SPACE + key

    def spell(self, part: str) -> list[int]:
        """The id of a piece; bytes for a character that has none."""
        known = self.ids.get(part)
        return [known] if known is not None else [self.byte[b] for b in part.encode("utf-8", "replace")]


#: What the model file says of itself, by field number of its two specs.
TRAINER, NORMALIZER = 2, 3
UNIGRAM, BPE = 1, 2


def _fields(raw: bytes) -> dict[int, object]:
    """The last value of each field of a protocol buffers message."""
    out, at = {}, 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            b = raw[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(raw):
        key = varint()
        kind = key & 7
        if kind == 0:
            out[key >> 3] = varint()
        else:
            size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            out[key >> 3] = raw[at : at + size]
            at += size
    return out


def check_kind(raw: bytes) -> None:
    """Refuse a model that these operators would encode wrongly: they know BPE
    with byte fallback, white space kept as it is, a space put before a text
    and no rules that change characters."""
    model = _fields(raw)
    trainer, normalizer = _fields(model.get(TRAINER, b"")), _fields(model.get(NORMALIZER, b""))
    wrong = []
    if trainer.get(3, UNIGRAM) != BPE:
        wrong.append("it is no BPE model")
    if not trainer.get(35, 0):
        wrong.append("it has no byte fallback")
    if trainer.get(24, 0):
        wrong.append("white space is a suffix")
    if normalizer.get(2, b""):
        wrong.append("it changes characters")
    if not normalizer.get(3, 1):
        wrong.append("it puts no space before a text")
    if normalizer.get(4, 1):
        wrong.append("it drops white space")
    if not normalizer.get(5, 1):
        wrong.append("it leaves spaces as they are")
    if wrong:
        raise ValueError("not a model that can be used here: " + "; ".join(wrong))


def load(path: str) -> Pieces:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    check_kind(model.serialized_model_proto())
    ids, score, text, byte = {}, {}, [], [0] * 256
    for i in range(model.vocab_size()):
        p = model.id_to_piece(i)
        if model.is_byte(i):
            byte[int(p[3:5], 16)] = i
            text.append(bytes([int(p[3:5], 16)]))
        elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            text.append(b"")
        else:
            ids[p], score[p] = i, model.get_score(i)
            text.append(p.encode())
    return pieces(ids, score, text, byte)


def pieces(ids, score, text, byte, dummy_prefix=True) -> Pieces:
    order = {s: r for r, s in enumerate(sorted(set(score.values()), reverse=True))}
    joined = {c for p in ids if len(p) > 1 for c in p}
    cut = "".join(re.escape(c) for c in "\n\r\t" if c not in joined)
    if any(SPACE in p.lstrip(SPACE) for p in ids):
        raise ValueError("pieces reach over white space: words cannot be told apart")
    pattern = f"{SPACE}*[^{SPACE}{cut}]+|{SPACE}+" + (f"|[{cut}]" if cut else "")
    return Pieces(ids, {p: order[s] for p, s in score.items()}, score, text, byte, max(map(len, ids), default=1), pattern, dummy_prefix, "\n" not in joined, frozenset(p[i : i + 2] for p in ids for i in range(len(p) - 1)))


def merged(word: str, model: Pieces) -> list[int]:
    """The ids of one word by merges from a heap: for words over LONGEST."""
    parts: list[str | None] = list(word)
    before, after = list(range(-1, len(parts) - 1)), [*range(1, len(parts)), -1]
    heap: list[tuple[int, int, int, str]] = []

    def offer(i):
        j = after[i]
        if j >= 0 and (rank := model.rank.get(parts[i] + parts[j])) is not None:
            heapq.heappush(heap, (rank, i, j, parts[i] + parts[j]))

    for i in range(len(parts) - 1):
        offer(i)
    while heap:
        _, i, j, both = heapq.heappop(heap)
        if parts[i] is None or parts[j] is None or after[i] != j or parts[i] + parts[j] != both:
            continue
        parts[i], parts[j] = both, None
        after[i] = after[j]
        if after[j] >= 0:
            before[after[j]] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    return [x for p in parts if p is not None for x in model.spell(p)]


# The lattice, on DataFrames.


def piece_table(spark: SparkSession, model: Pieces) -> DataFrame:
    """Bounded by the vocabulary. The empty piece keeps words without edges."""
    rows = [(p, r, float(model.score[p])) for p, r in model.rank.items()]
    return spark.createDataFrame([*rows, ("", 0, 0.0)], "piece string, rank int, score double")


def lattice(words: DataFrame, table: DataFrame, longest: int) -> DataFrame:
    """words (word, ...) of at most LONGEST characters -> (word, s, l, rank,
    score, ...): an edge for each substring of two characters or more that is
    a piece, and for each word two that start at 0, of no and of one character."""
    n = F.char_length("word")
    starts = words.withColumn("s", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), n - 2))))
    least = F.when(F.col("s") == 0, F.lit(0)).otherwise(F.lit(2))
    edges = starts.withColumn("l", F.explode(F.sequence(least, F.least(F.lit(longest), n - F.col("s")))))
    return edges.withColumn("piece", F.expr("substring(word, s + 1, l)")).join(F.broadcast(table), "piece").drop("piece")


def _bits(k):
    """The start and end of an edge key rank << 12 | start << 6 | end."""
    return F.shiftright(k, 6).bitwiseAND(F.lit(63)).cast("int"), k.bitwiseAND(F.lit(63)).cast("int")


def _let(value, body):
    """body(value), with value computed once however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _at(b, i):
    return F.getbit(b, i) == 1


def fold_merges(edges, n):
    """edges: array of keys; the boundaries that are left, as bits of a long.

    Each step takes the least key among the edges with one boundary inside.
    An edge that has lost an end, or has been made, is dropped for good."""

    def inside(b, s, e):
        return F.call_function("shiftright", b, s + 1).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), e - s - 1) - 1)

    def joins(b):
        def test(k):
            return F.bit_count(inside(b, *_bits(k))) == 1

        return test

    def alive(b):
        def test(k):
            s, e = _bits(k)
            return _at(b, s) & _at(b, e) & (inside(b, s, e) != 0)

        return test

    def step(state, _):
        b, live = state["b"], state["live"]

        def merge(best):
            s, e = _bits(best)
            inner = F.call_function("shiftleft", F.call_function("shiftleft", F.lit(1).cast("long"), e - s - 1) - 1, s + 1)
            after = _let(b.bitwiseAND(F.bitwise_not(inner)), lambda left: F.struct(left.alias("b"), F.filter(live, alive(left)).alias("live")))
            return F.when(best.isNull(), state).otherwise(after)

        return F.when(F.size(live) == 0, state).otherwise(_let(F.array_min(F.filter(live, joins(b))), merge))

    whole = F.call_function("shiftleft", F.lit(1).cast("long"), n + 1) - 1
    start = F.struct(whole.alias("b"), edges.alias("live"))
    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), n - 1)), start, step, lambda x: x["b"])


def fold_viterbi(edges, n, unknown: float = -100.0):
    """edges: array of struct<s, e, score>; the boundaries of the path of the
    greatest sum of scores, as bits of a long. A character without a piece
    costs `unknown`; of equal paths, the one whose last piece is longest."""

    def step(paths, e):
        into = F.transform(F.filter(edges, lambda x: x["e"] == e), lambda x: F.struct((F.get(paths, x["s"])["score"] + x["score"]).alias("score"), (-x["s"]).alias("from")))
        single = F.struct((F.get(paths, e - 1)["score"] + F.lit(unknown)).alias("score"), (F.lit(1) - e).alias("from"))

        def extend(best):
            bits = F.get(paths, -best["from"])["bits"].bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), e))
            return F.concat(paths, F.array(F.struct(best["score"].alias("score"), bits.alias("bits"))))

        return _let(F.array_max(F.concat(into, F.array(single))), extend)

    start = F.array(F.struct(F.lit(0.0).alias("score"), F.lit(1).cast("long").alias("bits")))
    return F.aggregate(F.sequence(F.lit(1), n), start, step, lambda paths: F.get(paths, n)["bits"])


def segment(words: DataFrame, model: Pieces, table: DataFrame, viterbi: bool = False) -> DataFrame:
    """words (word, place), each word once and partitioned by word -> (word,
    place, bits): bit i is set where a piece starts or ends."""
    edges = lattice(words, table, model.longest)
    s, e = F.col("s"), F.col("s") + F.col("l")
    if viterbi:
        edge = F.when(F.col("l") > 0, F.struct(s.alias("s"), e.alias("e"), F.col("score")))
    else:
        key = F.shiftleft(F.col("rank").cast("long"), 12).bitwiseOR(F.shiftleft(s.cast("long"), 6)).bitwiseOR(e.cast("long"))
        edge = F.when(F.col("l") > 1, key)
    grouped = edges.groupBy("word").agg(F.first("place").alias("place"), F.collect_list(edge).alias("edges"))
    n = F.char_length("word")
    return grouped.select("word", "place", (fold_viterbi if viterbi else fold_merges)(F.col("edges"), n).alias("bits"))


# Blocks of texts as word numbers.

NUMBERED = "block long, loc long, word string, docs binary"
NUMBERED_SCHEMA = pa.schema([("block", pa.int64()), ("loc", pa.int64()), ("word", pa.string()), ("docs", pa.binary())])
#: Blocks whose places of a word are listed together.
LISTED = 4096


class Numbers(dict):
    """key -> its number, in the order of first use."""

    def __missing__(self, key):
        n = self[key] = len(self)
        return n


def _squeeze(*arrays) -> bytes:
    """Integer arrays, byte planes apart, compressed."""
    parts = [np.array([len(a) for a in arrays], np.int64).tobytes()]
    for a in arrays:
        parts.append(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes())
    return zstandard.compress(b"".join(parts), 3)


def _expand(blob: bytes, *kinds):
    raw, out = zstandard.decompress(blob), []
    sizes, at = np.frombuffer(raw, np.int64, len(kinds)), 8 * len(kinds)
    for n, k in zip(sizes.tolist(), kinds):
        width = np.dtype(k).itemsize
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n).T).reshape(-1).view(k) if n else np.zeros(0, k))
        at += n * width
    return out


def _number(model: Pieces, limit: int):
    """Per block: the distinct parts of its words, its texts as numbers of
    words, the most frequent first, and the words as numbers of parts."""

    def run(batches):
        task, made = TaskContext.get().partitionId(), 0
        index = Numbers()
        codes: list[np.ndarray] = []
        ids: list[int | None] = []  # of documents
        held = 0

        def close():
            nonlocal made, held
            flat = np.concatenate(codes) if codes else np.zeros(0, np.int32)
            order = np.argsort(-np.bincount(flat, minlength=len(index)), kind="stable")
            number = np.empty(len(index), np.int32)
            number[order] = np.arange(len(index), dtype=np.int32)
            keys_, parts = list(index), Numbers()
            cut, made_of = model.parts([model.word_of(keys_[i]) for i in order.tolist()])
            parts_of = np.fromiter(map(parts.__getitem__, cut), np.int32, len(cut))
            names = list(parts)
            long_ids = [(i, merged(p, model)) for i, p in enumerate(names) if len(p) > LONGEST]
            keys = [np.array([k or 0 for k in ids], np.int64), np.array([k is None for k in ids], np.uint8)]
            extra = [np.array([k for k, _ in long_ids], np.int32), np.array([len(x) for _, x in long_ids], np.int32), np.array([i for _, x in long_ids for i in x], np.int32)]
            block = (task << 16) + made
            words = [made_of.astype(np.int32), parts_of]
            blob = _squeeze(*keys, np.array([len(c) for c in codes], np.int32), number[flat], *words, *extra)
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.string()), pa.array([blob], pa.binary())], schema=NUMBERED_SCHEMA)
            # In order of their letters they take less room in files and shuffles.
            rest = sorted((i for i, p in enumerate(names) if len(p) <= LONGEST), key=names.__getitem__)
            for at in range(0, len(rest), 50_000):
                some = rest[at : at + 50_000]
                loc = (np.int64(block) << 24) + np.array(some, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([block] * len(some), pa.int64()), pa.array(loc), pa.array([names[i] for i in some]), pa.nulls(len(some), pa.binary())], schema=NUMBERED_SCHEMA)
            made, held = made + 1, 0
            index.clear()
            codes.clear()
            ids.clear()

        for batch in batches:
            for key, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                words = model.keys(text or "")
                codes.append(np.fromiter(map(index.__getitem__, words), np.int32, len(words)))
                ids.append(key)
                held += len(text or "") + 64
                if held >= limit:
                    yield from close()
        if ids:
            yield from close()

    return run


SPELT = "block long, ids binary"


def _spelt(model: Pieces):
    """(word, locs, bits) -> the ids of the words, a blob for each block."""

    def run(batches):
        for batch in batches:
            by: dict[int, list[tuple[int, list[int]]]] = {}
            for word, locs, bits in zip(batch.column("word").to_pylist(), batch.column("locs").to_pylist(), batch.column("bits").to_pylist()):
                cuts = [i for i in range(len(word) + 1) if bits >> i & 1]
                ids = [x for a, b in zip(cuts, cuts[1:]) for x in model.spell(word[a:b])]
                for loc in locs:
                    by.setdefault(loc >> 24, []).append((loc & 0xFFFFFF, ids))
            blobs = [_squeeze(np.array([k for k, _ in rows], np.int32), np.array([len(x) for _, x in rows], np.int32), np.array([i for _, x in rows for i in x], np.int32)) for rows in by.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(by), pa.int64()), pa.array(blobs, pa.binary())], ["block", "ids"])

    return run


def decode_ids(ids, model: Pieces) -> str:
    raw = b"".join([model.text[i] for i in ids])
    s = raw.decode("utf-8", "replace").replace(SPACE, " ")
    return s[1:] if model.dummy_prefix and s.startswith(" ") else s


def _taken(start, count):
    """The places start[i], ..., start[i] + count[i] - 1 for each i in turn."""
    before = np.concatenate([[0], np.cumsum(count)[:-1]]) if len(count) else np.zeros(0, np.int64)
    return np.repeat(start - before, count) + np.arange(int(count.sum()))


def _in_parts(codes, sizes, made_of, parts_of):
    """Texts as numbers of words -> as numbers of parts, and their sizes."""
    made_of = made_of.astype(np.int64)
    start, count = np.cumsum(made_of) - made_of, made_of[codes]
    ends = np.concatenate([[0], np.cumsum(count)])[np.cumsum(sizes)] if len(sizes) else np.zeros(0, np.int64)
    return parts_of[_taken(start[codes], count)], np.diff(ends, prepend=0)


def _assembled(model: Pieces, digest: bool):
    def run(key, docs, told):
        out = []
        for blob in docs["docs"].to_pylist():
            keys, nameless, sizes, codes, made_of, parts_of, k, n, flat = _expand(blob, np.int64, np.uint8, *[np.int32] * 7)
            codes, sizes = _in_parts(codes, sizes, made_of, parts_of)
            parts = [(k, n, flat)] + [_expand(x, np.int32, np.int32, np.int32) for x in told["ids"].to_pylist()]
            number, length, flat = (np.concatenate([p[i] for p in parts]) for i in range(3))
            start, count = np.zeros(len(number), np.int64), np.zeros(len(number), np.int64)
            start[number], count[number] = np.concatenate([[0], np.cumsum(length)[:-1]]) if len(length) else 0, length
            text = [b"".join([model.text[i] for i in flat[a : a + c].tolist()]) for a, c in zip(start.tolist(), count.tolist())]
            ends = np.cumsum(sizes)
            for doc, end, size in zip((None if x else k for k, x in zip(keys.tolist(), nameless.tolist())), ends.tolist(), sizes.tolist()):
                own = codes[end - size : end]
                c = count[own]
                total = int(c.sum())
                ids = flat[_taken(start[own], c)]
                decoded = b"".join([text[i] for i in own.tolist()]).decode("utf-8", "replace").replace(SPACE, " ")
                decoded = decoded[1:] if model.dummy_prefix and decoded.startswith(" ") else decoded
                if digest:
                    out.append((doc, total, zlib.crc32(ids.astype("<u4")), hashlib.sha256(decoded.encode()).hexdigest()))
                else:
                    out.append((doc, ids.tolist(), decoded))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()] if digest else [pa.int64(), pa.list_(pa.int32()), pa.string()]
        names = ["doc_id", "n_pieces", "ids_crc32", "decoded_sha256"] if digest else ["doc_id", "ids", "decoded"]
        cols = list(zip(*out)) or [()] * len(names)
        return pa.table([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

    return run


def sentencepiece(docs: DataFrame, model: Pieces, digest: bool = False, viterbi: bool = False, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row for each row of docs: doc_id, ids and decoded, the text that the
    ids spell; or, with digest, doc_id, n_pieces, ids_crc32 (of the ids as
    little-endian 32-bit integers) and decoded_sha256.

    Null and empty texts have no ids and decode to an empty text; U+2581
    decodes to a space, as in the library. Null and repeated doc_ids pass
    through; other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    total = rows.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    buckets = max(shuffle_partitions(spark), -(-2 * total // block_bytes))
    blocks = write_buckets(rows.mapInArrow(_number(model, block_bytes), NUMBERED), "numbered", "block", buckets)
    words = blocks.where("word is not null").select("word", "loc")
    parts = int(max(shuffle_partitions(spark), -(-words.count() // WORDS_A_PARTITION)))
    # One exchange: the lattice, its groups and the lists of places stay
    # partitioned by word. The lattice carries words alone; a word has one place
    # for each block that holds it, listed by runs of blocks.
    dealt = words.repartition(parts, "word")
    runs = F.expr(f"loc >> 24 & {(1 << 39) - 1}") % F.lit(max(1, -(-int(total) // block_bytes) // LISTED))
    listed = dealt.groupBy("word", runs.alias("run")).agg(F.collect_list("loc").alias("locs"))
    # One place of each word goes along, so that both sides read one exchange.
    distinct = dealt.groupBy("word").agg(F.min("loc").alias("place"))
    cut = segment(distinct, model, piece_table(spark, model), viterbi)
    spelt = listed.select("word", "locs").join(cut.hint("shuffle_hash"), "word").mapInArrow(_spelt(model), SPELT)
    out = "doc_id long, n_pieces long, ids_crc32 long, decoded_sha256 string" if digest else "doc_id long, ids array<int>, decoded string"
    return blocks.where("docs is not null").select("block", "docs").groupBy("block").cogroup(spelt.groupBy("block")).applyInArrow(_assembled(model, digest), out)
