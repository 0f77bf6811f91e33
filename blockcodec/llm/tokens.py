"""Encoding whole texts with a public tokenizer, word by word.

The tokenizer's splitter never lets a token reach over ASCII white space, so
the ids of a text are those of its words in turn, and the library encodes each
distinct word once. Words of Latin letters skip the library's normaliser and
splitter, which take most of its time: what those do to such words is done here
and the library's model gets the parts.
"""

from __future__ import annotations

import json
import os
import re
import sys
import types
from array import array

import numpy as np

from .common import to_bytes

#: Words that a Python worker keeps, over all its tasks. Beyond it, it starts afresh.
KEEP_WORDS = 600_000

# The splitter that the short way stands for, and the same for
# lower-cased words below U+0180 that have no ASCII white space.
SPLITTER = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMALIZERS = ["NFC", "Replace", "Lowercase"]
LETTERS = "a-zªµºß-öø-ſ"
NUMBERS = "0-9²³¹¼-¾"
LATIN_PARTS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{NUMBERS}]|[^{LETTERS}{NUMBERS}\x85\xa0]+")
LATIN_WORD = re.compile("[\x00-įı-ſ]*")  # U+0130 changes its length in lower case


def byte_characters() -> dict[int, str]:
    """The character that byte-level models read for each byte: printable ones
    stand for themselves, the others for U+0100 and on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def _is_known(spec: dict) -> bool:
    """Whether a tokenizer has the normaliser and splitter of SPLITTER."""
    normal = [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])]
    split = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    return normal == NORMALIZERS and [x["type"] for x in split] == ["Split", "ByteLevel"] and split[0]["pattern"] == {"Regex": SPLITTER} and split[0]["invert"] and not split[1]["add_prefix_space"] and not split[1]["use_regex"]


class WordIds(dict):
    """Word -> its ids as the bytes of uint32, encoded when first asked for."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.characters = self.tokenizer.model, byte_characters()
        self.latin = _is_known(json.loads(self.tokenizer.to_str()))

    def __missing__(self, raw: bytes) -> bytes:
        word = raw.decode()
        # Special tokens are found in texts as they are written.
        if not self.latin or "<|" in word or not LATIN_WORD.fullmatch(word):
            ids = self.tokenizer.encode(word, add_special_tokens=False).ids
        else:
            ids = []
            for p in LATIN_PARTS.findall(word.lower()):
                mapped = p if p.isascii() and p.isprintable() else p.encode().decode("latin-1").translate(self.characters)
                ids += [t.id for t in self.model.tokenize(mapped)]
        out = self[raw] = array("I", ids).tobytes()
        return out


class WordEncoder:
    """encode(texts) -> a uint32 array for each text. Only for tokenizers whose
    normaliser and splitter treat ASCII white space as a boundary and drop it."""

    def __init__(self, path: str, keep_words: int = KEEP_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        # A worker runs many tasks: what it has encoded stays in its process.
        held = sys.modules.setdefault("_blockcodec_words", types.ModuleType("_blockcodec_words"))
        if getattr(held, "path", None) != path:
            held.path, held.ids = path, WordIds(path)
        self.ids, self.keep = held.ids, keep_words

    def encode(self, texts) -> list[np.ndarray]:
        if len(self.ids) > self.keep:
            self.ids.clear()
        get = self.ids.__getitem__
        return [np.frombuffer(b"".join(map(get, to_bytes(t).split())), np.uint32) for t in texts]


def batched(items, limit: int = 256, size: int = 4 << 20):
    """Slices of a list of texts, of at most limit texts and about size
    characters (one text at least)."""
    start = held = 0
    for i, t in enumerate(items):
        n = len(t) if t else 0
        if i > start and (i - start >= limit or held + n > size):
            yield start, i
            start, held = i, 0
        held += n
    if start < len(items):
        yield start, len(items)
