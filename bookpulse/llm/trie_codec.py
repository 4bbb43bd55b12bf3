"""BPE encoding and decoding (byte level) by prefix-sharing trie traversal.

``encode`` cuts texts into pretokens, inserts the distinct ones into a trie and walks it depth first
(``BpeModel.encode_words``), so that prefixes shared by words are encoded once. ``decode`` maps ids back to bytes.
Null and empty texts have no ids. Repeated rows are encoded alike. Texts of any length are encoded whole.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from bookpulse.llm.bpe import SPACE, PieceCache, byte_alphabet, load_model, special_split
from bookpulse.llm.common import map_text

# The published pretoken pattern of byte-level BPE.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_pretoken = regex.compile(PRETOKEN.replace(r"\s", f"[{SPACE}]").replace(f"[^[{SPACE}]", f"[^{SPACE}").replace(r"\S", f"[^{SPACE}]"))
_inner = re.compile(f"[{SPACE[SPACE.index(chr(0x85)):]}] ")


_SPACED = [c + " " for c in "\t\n\v\f\r "]


def _cut(key: str) -> list[str]:
    """Pretokens of a chunk, written as the chunk after a space, or as what follows the space that it starts with."""
    if key[:1] == " ":
        return _pretoken.findall(key[1:])
    # A space and a word, or that and one character after it, need no pattern.
    if key.isascii() or max(key) < "\u0250":
        if key.isalpha():
            return [" " + key]
        if key[:-1].isalpha():
            return [" " + key[:-1], key[-1]]
    return _pretoken.findall(" " + key)


class TrieCodec:
    """Encoder and decoder of one tokenizer file; keeps encoded words of a worker up to a bound."""

    def __init__(self, path: str):
        self.model = load_model(path)
        self.split = special_split(self.model.special) if self.model.special else None
        self.cache = PieceCache(_cut, self.model.encode_words, b"".join, 160_000)

    def chunks(self, text: str) -> list[str]:
        """Parts whose pretokens are those of the text: a border before white space is one between pretokens."""
        if text[:1] == " " or any(x in text for x in _SPACED) or not text.isascii() and _inner.search(text):
            return [" " + c for c in regex.split(f"(?<=[^{SPACE}])(?=[{SPACE}])", text) if c]
        found = text.split(" ")
        found[0] = " " + found[0]
        return found

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, special strings in texts included as the library's default has it."""
        special, parts = self.model.special, []
        for t in texts:
            t = t or ""
            segments = self.split.split(t) if any(x in t for x in special) else [t]
            parts.append([special[s] if k % 2 else self.chunks(s) for k, s in enumerate(segments) if s])
        value = self.cache.values(set().union(*(x for p in parts for x in p if not isinstance(x, int))))
        get, mark = value.__getitem__, {i: np.uint32(i).astype("<u4").tobytes() for i in special.values()}
        return [np.frombuffer(b"".join([mark[x] if isinstance(x, int) else b"".join(map(get, x)) for x in p]), dtype="<u4") for p in parts]


class Decoder:
    """Bytes of each id of a tokenizer file, special tokens included."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        alphabet = byte_alphabet()
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes = [b""] * (max([*spec["model"]["vocab"].values(), *special.values()]) + 1)
        for token, i in spec["model"]["vocab"].items():
            if token not in special:
                self.bytes[i] = bytes(alphabet[c] for c in token)
        for token, i in special.items():
            self.bytes[i] = token.encode()

    def decode(self, ids: list[int]) -> str:
        """The text of ids; bytes that aren't UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(path: str) -> TrieCodec:
    return TrieCodec(path)


@lru_cache(maxsize=2)
def decoder(path: str) -> Decoder:
    return Decoder(path)


def encode(docs: DataFrame, tokenizer: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Add ``ids`` (array of int) of each text; other columns pass through."""

    def make():
        c = codec(tokenizer)

        def f(texts: list) -> list:
            found = c.encode(texts)
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
            flat = np.concatenate([np.zeros(0, "<u4"), *found]).astype(np.int32)
            return [pa.ListArray.from_arrays(offsets, flat)]

        return f

    return map_text(docs, text, T.StructType([T.StructField(ids, T.ArrayType(T.IntegerType(), False), False)]), make)


def decode(docs: DataFrame, tokenizer: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Add the text of each row's ids (null: no ids); special tokens are kept."""

    def make():
        c = decoder(tokenizer)

        def f(rows: pa.ListArray) -> list:
            at, flat = rows.offsets.to_pylist(), rows.values.to_numpy(zero_copy_only=False)
            return [pa.array([c.decode(flat[i:j].tolist()) for i, j in zip(at, at[1:])], pa.string())]

        return f

    return map_text(docs, ids, T.StructType([T.StructField(text, T.StringType(), False)]), make, raw=True)


def recode(docs: DataFrame, tokenizer: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``encode``, then ``decode`` of the ids, in one Python worker a task: half the workers, so half their memory."""

    def make():
        c, d = codec(tokenizer), decoder(tokenizer)

        def f(texts: list) -> list:
            found = c.encode(texts)
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
            flat = np.concatenate([np.zeros(0, "<u4"), *found]).astype(np.int32)
            return [pa.ListArray.from_arrays(offsets, flat), pa.array([d.decode(x.tolist()) for x in found], pa.string())]

        return f

    return map_text(docs, text, T.StructType([T.StructField(ids, T.ArrayType(T.IntegerType(), False), False), T.StructField(decoded, T.StringType(), False)]), make)
