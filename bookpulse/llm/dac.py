"""Token-id files of directly addressable codes.

Ids are split into chunks of ``WIDTH`` bits; chunk level k holds the k-th chunk of every id that has one, and a bitmap
tells which of them continue on level k + 1. With a rank directory over each bitmap, id number i is found by one rank a
level, without decoding what stands before it.

A file holds segments, each of a run of documents in ascending doc_id order:

    magic "DACS", header length (uint32), header (JSON: documents, levels, where each array lies), arrays
    arrays: doc_id int64 and first token int64 of each document; per level the chunks, the continuation bitmap
    (bits from the lowest), and the number of set bits before each block of RANK_BITS bits (uint32)

It ends with a directory of its segments (JSON: where each begins, its tokens, its documents), the directory's length
(uint32) and the magic "DACE". So a position is found by reading a file's end, one segment's header and one rank a level.

Documents of a dataset are range-partitioned by doc_id, then by the text's hash, so file names in order give ascending
ids and rows of one doc_id, or of none, are dealt over files; rows equal in both are repeated rows. A null doc_id comes
first and a null or empty text has the end id only. Files are renamed when complete; a task that is
run again writes an equal file. ``manifest`` has one row a file.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bookpulse.llm.bpe import space_free, special_split, word_normal, word_pieces
from bookpulse.llm.common import SLICE_ROWS, filesystem, put_atomically, slices

MAGIC, END, WIDTH, RANK_BITS = b"DACS", b"DACE", 8, 512
#: Tokens after which a writer closes a segment; a document is never divided.
SEGMENT_TOKENS = 1 << 20
_NULL_ID = -(1 << 63)  # stands for a null doc_id inside files
_ODDITIES = r"[^\x21-\x7e\xa1-ɏ]"
# WORD_PRETOKEN with the letters and numbers up to U+024F written out, for texts that have no others.
_plain_pretokens = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[A-Za-zªµºÀ-ÖØ-öø-ɏ]+|[0-9²³¹¼-¾]|[^\sA-Za-zªµºÀ-ÖØ-öø-ɏ0-9²³¹¼-¾]+").findall


# ---- one segment ----------------------------------------------------------------------------------------------


def encode_segment(doc_ids: np.ndarray, starts: np.ndarray, ids: np.ndarray) -> bytes:
    """Bytes of a segment: ``starts`` are the first tokens of the documents within ``ids`` (unsigned 32-bit)."""
    arrays, levels = {"doc_id": doc_ids.astype("<i8"), "start": starts.astype("<i8")}, 0
    rest = ids.astype("<u4")
    while levels == 0 or len(rest):
        more = rest >> WIDTH
        goes_on = more > 0
        bits = np.packbits(goes_on, bitorder="little")
        bits = np.pad(bits, (0, -len(bits) % (RANK_BITS // 8)))
        ones = np.bitwise_count(bits).reshape(-1, RANK_BITS // 8).sum(1, dtype=np.int64)
        arrays |= {f"chunk{levels}": (rest & (1 << WIDTH) - 1).astype("u1"), f"bits{levels}": bits, f"rank{levels}": np.concatenate([[0], np.cumsum(ones)]).astype("<u4")}
        rest, levels = more[goes_on], levels + 1
    where, at = {}, 0
    for name, a in arrays.items():
        where[name] = [at, len(a), a.dtype.str]
        at += a.nbytes
    header = json.dumps({"docs": len(doc_ids), "tokens": len(ids), "levels": levels, "size": at, "at": where}).encode()
    return MAGIC + struct.pack("<I", len(header)) + header + b"".join(a.tobytes() for a in arrays.values())


class Segment:
    """Reads one segment of an open file, by ranges; ``token(i)`` touches a few bytes only."""

    def __init__(self, file, at: int = 0):
        self.file = file
        file.seek(at)
        if file.read(4) != MAGIC:
            raise ValueError(f"no segment at byte {at}")
        n = struct.unpack("<I", file.read(4))[0]
        self.head = json.loads(file.read(n))
        self.base = at + 8 + n
        self.end = self.base + self.head["size"]

    def array(self, name: str, first: int = 0, count: int | None = None) -> np.ndarray:
        at, n, kind = self.head["at"][name]
        dtype = np.dtype(kind)
        self.file.seek(self.base + at + first * dtype.itemsize)
        return np.frombuffer(self.file.read((n - first if count is None else count) * dtype.itemsize), dtype)

    def token(self, i: int) -> int:
        """Id number i of the segment."""
        if not 0 <= i < self.head["tokens"]:
            raise IndexError(i)
        value = 0
        for level in range(self.head["levels"]):
            value |= int(self.array(f"chunk{level}", i, 1)[0]) << WIDTH * level
            block = i // RANK_BITS
            bits = np.unpackbits(self.array(f"bits{level}", block * RANK_BITS // 8, RANK_BITS // 8), bitorder="little")
            if not bits[i % RANK_BITS]:
                break
            i = int(self.array(f"rank{level}", block, 1)[0]) + int(bits[: i % RANK_BITS].sum())
        return value

    def tokens(self) -> np.ndarray:
        """All ids."""
        levels = self.head["levels"]
        value = np.zeros(0, "<u4")
        for level in reversed(range(levels)):
            chunk = self.array(f"chunk{level}").astype("<u4")
            goes_on = np.unpackbits(self.array(f"bits{level}"), count=len(chunk), bitorder="little").astype(bool)
            chunk[goes_on] |= value << WIDTH
            value = chunk
        return value


def directory(file) -> list[list[int]]:
    """Offset, tokens and documents of each segment of an open file."""
    size = file.seek(0, 2) or file.tell()
    file.seek(max(0, size - 8))
    n, end = struct.unpack("<I4s", file.read(8))
    if end != END:
        raise ValueError("no directory at the file's end")
    file.seek(size - 8 - n)
    return json.loads(file.read(n))


def segments(file) -> Iterator[Segment]:
    for at, _, _ in directory(file):
        yield Segment(file, at)


def token(file, i: int) -> int:
    """Id number i of an open file."""
    for at, tokens, _ in directory(file):
        if i < tokens:
            return Segment(file, at).token(i)
        i -= tokens
    raise IndexError(i)


# ---- tokenizing -----------------------------------------------------------------------------------------------


class WordEncoder:
    """The tokenizers library on the distinct pieces of texts; characters beyond plain Latin go to it as whole chunks.

    The ids of all known space-free chunks and pretokens lie in one array; a batch of texts is looked up piece by
    piece and its ids are gathered at once. Up to ``bound`` of them are kept (frequent ones come early); what
    comes later, or is longer than ``LONG`` characters, stays for one call. Both bounds change time, never results.
    """

    LONG, TOGETHER = 64, 2000

    def __init__(self, path: str, bound: int = 400_000):
        import regex
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.odd = regex.compile(_ODDITIES).search
        self.plain = re.compile(r"[\t-\r\x20-\x7e\xa1-ɏ]*").fullmatch
        vocab = self.library.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        added = {t.content: i for i, t in self.library.get_added_tokens_decoder().items()}
        self.split = special_split(added)
        self.bound = bound
        self.codes: dict[str, int] = {}  # the number of each kept chunk or piece; its ids are ids[first : first + size]
        self.first, self.size, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, "<u4")
        # (a space comes before special tokens, as no chunk has one)
        self.keep({" " + s: np.array([i], "<u4").tobytes() for s, i in added.items()})

    def chunks(self, text: str) -> list[str]:
        """The pretokens of a text that is plain in either case; space-free chunks of any other."""
        low = text.lower()
        if self.plain(text) and self.plain(low):
            return _plain_pretokens(low)
        return space_free(low if text.isascii() else text)

    def cut(self, chunk: str) -> list[str]:
        if chunk.isascii():
            low = chunk.lower()
            return [low] if low.isalpha() else word_pieces(low)
        return [chunk] if self.odd(chunk) else word_pieces(word_normal(chunk))

    def solve(self, pieces: list) -> dict[str, bytes]:
        """Ids of distinct pieces. Plain ones are pretokens: they go to the library side by side, and a mark ends the last token of each."""
        found = {}
        plain = [p for p in pieces if not self.odd(p)]
        for at in range(0, len(plain), self.TOGETHER):
            some = plain[at : at + self.TOGETHER]
            ids = np.array(self.library.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            ends = [0, *(4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()]
            if len(ends) == len(some) + 1 and ends[-1] == ids.nbytes:
                coded = ids.tobytes()
                found |= {p: coded[a:b] for p, a, b in zip(some, ends, ends[1:])}
        todo = [p for p in pieces if p not in found]
        each = self.library.encode_batch_fast(todo, add_special_tokens=False)
        return found | {p: np.array(e.ids, "<u4").tobytes() for p, e in zip(todo, each)}

    def more(self, values: Iterable[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The three arrays with further entries."""
        values = list(values)
        sizes = np.fromiter(map(len, values), np.int64, len(values)) // 4
        first = len(self.ids) + np.cumsum(sizes) - sizes
        return np.concatenate([self.first, first]), np.concatenate([self.size, sizes]), np.concatenate([self.ids, np.frombuffer(b"".join(values), "<u4")])

    def keep(self, new: dict[str, bytes]) -> None:
        self.codes.update(zip(new, range(len(self.first), len(self.first) + len(new))))
        self.first, self.size, self.ids = self.more(new.values())

    def learn(self, unseen: list) -> tuple[dict, tuple]:
        """Numbers of unseen chunks, and the arrays that these are for."""
        known = self.codes
        cuts = {c: self.cut(c) for c in unseen}
        new = self.solve(list(set().union(*cuts.values()).difference(known)))

        def value(piece: str) -> bytes:
            if piece in new:
                return new[piece]
            k = known[piece]
            return self.ids[self.first[k] : self.first[k] + self.size[k]].tobytes()

        new.update([(c, b"".join(map(value, pieces))) for c, pieces in cuts.items() if c not in new])
        if len(known) < self.bound:
            self.keep({c: v for c, v in new.items() if len(c) <= self.LONG})
        passing = [c for c in unseen if c not in known]
        number = dict(zip(passing, range(len(self.first), len(self.first) + len(passing))))
        return number | {c: known[c] for c in unseen if c in known}, self.more(new[c] for c in passing)

    def encode(self, texts: list) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        flat, upto = [], [0]
        for t in texts:
            for k, s in enumerate(self.split.split(t) if t and "<|" in t else [t or ""]):
                flat += [" " + s] if k % 2 else self.chunks(s)
            upto.append(len(flat))
        codes = np.fromiter(map(self.codes.get, flat, repeat(-1)), np.int64, len(flat))
        first, size, ids = self.first, self.size, self.ids
        if missing := np.flatnonzero(codes < 0).tolist():
            number, (first, size, ids) = self.learn(list({flat[i]: None for i in missing}))
            codes[missing] = [number[flat[i]] for i in missing]
        held = size[codes]
        ends = np.concatenate([[0], np.cumsum(held)])
        coded = ids[np.repeat(first[codes] - ends[:-1], held) + np.arange(ends[-1])].tobytes()
        bounds = (4 * ends[upto]).tolist()
        return [coded[a:b] for a, b in zip(bounds, bounds[1:])]


@lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


# ---- datasets -------------------------------------------------------------------------------------------------

_WRITTEN = T.StructType([T.StructField("path", T.StringType(), False), T.StructField("docs", T.LongType(), False), T.StructField("tokens", T.LongType(), False), T.StructField("bytes", T.LongType(), False)])


def write(docs: DataFrame, path: str, make_encoder: Callable, end_id: int | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the ids of each text (and ``end_id``) in ascending doc_id order; gives the manifest: path, docs, tokens, bytes.

    ``make_encoder()`` gives f(texts) -> list of bytes (little-endian unsigned 32-bit ids), once a task.
    """
    end = b"" if end_id is None else struct.pack("<I", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = make_encoder()
        target = f"{path}/part-{TaskContext.get().partitionId():07d}.dac"
        total = [0, 0]

        def body(stream) -> None:
            ids, parts, held, listed = [], [], 0, []

            def close() -> None:
                listed.append([stream.tell(), sum(map(len, parts)) // 4, len(ids)])
                sizes = np.array([len(p) // 4 for p in parts], np.int64)
                stream.write(encode_segment(np.array(ids, np.int64), np.cumsum(sizes) - sizes, np.frombuffer(b"".join(parts), "<u4")))
                total[0] += len(ids)
                total[1] += int(sizes.sum())

            for whole in batches:
                for b in slices(whole, 1):
                    for d, e in zip(b.column(0).to_pylist(), encode(b.column(1).to_pylist())):
                        ids.append(_NULL_ID if d is None else d)
                        parts.append(e + end)
                        held += len(parts[-1]) // 4
                        if held >= SEGMENT_TOKENS:
                            close()
                            ids, parts, held = [], [], 0
            if ids:
                close()
            tail = json.dumps(listed).encode()
            stream.write(tail + struct.pack("<I4s", len(tail), END))

        size = put_atomically(target, body)
        yield pa.RecordBatch.from_pydict({"path": [target], "docs": [total[0]], "tokens": [total[1]], "bytes": [size]})

    ordered = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("tie"))
    ordered = ordered.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text").select("doc_id", "text")
    done = ordered.mapInArrow(run, _WRITTEN).collect()  # one row a file; this is the write job
    manifest = sorted(r for r in done if r["docs"])
    return docs.sparkSession.createDataFrame(manifest, _WRITTEN)


_READ = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType(), False), T.StructField("n_tokens", T.LongType(), False), T.StructField("ids", T.BinaryType(), False)])


def read(spark: SparkSession, manifest: DataFrame, with_ids: bool = True) -> DataFrame:
    """Read files back: doc_id, start (ids of all documents before it), n_tokens, ids (little-endian unsigned 32-bit).

    The driver holds the manifest only, one row a file; each file is read by one task, segment by segment.
    """
    files, before = [], 0
    for r in manifest.orderBy("path").collect():
        files.append((r["path"], before))
        before += r["tokens"]
    schema = T.StructType([T.StructField("path", T.StringType(), False), T.StructField("before", T.LongType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                fs, inner = filesystem(uri)
                with fs.open_input_file(inner) as file:
                    for s in segments(file):
                        first, ids = s.array("start"), s.array("doc_id").tolist()
                        flat = s.tokens().tobytes() if with_ids else b""
                        bounds = [*first.tolist(), s.head["tokens"]]
                        for i in range(0, len(ids), SLICE_ROWS):
                            j = min(i + SLICE_ROWS, len(ids))
                            yield pa.RecordBatch.from_arrays(
                                [
                                    pa.array([None if d == _NULL_ID else d for d in ids[i:j]], pa.int64()),
                                    pa.array([start + x for x in bounds[i:j]], pa.int64()),
                                    pa.array([bounds[k + 1] - bounds[k] for k in range(i, j)], pa.int64()),
                                    pa.array([flat[4 * bounds[k] : 4 * bounds[k + 1]] for k in range(i, j)], pa.binary()),
                                ],
                                names=_READ.fieldNames(),
                            )
                        start += s.head["tokens"]

    listed = spark.createDataFrame(files, schema)
    return listed.repartition(max(1, len(files))).mapInArrow(run, _READ)


def token_at(manifest: DataFrame, i: int) -> int:
    """Id number i of a written dataset, by random access."""
    for r in manifest.orderBy("path").collect():
        if 0 <= i < r["tokens"]:
            fs, inner = filesystem(r["path"])
            with fs.open_input_file(inner) as file:
                return token(file, i)
        i -= r["tokens"]
    raise IndexError(i)


def tokens_at(positions: DataFrame, manifest: DataFrame, position: str = "position", into: str = "token_id") -> DataFrame:
    """Add the id at each position of a written dataset by random access, in parallel; null where there is none.

    Positions are sorted inside their tasks, so a task opens a file once; the manifest, one row a file, goes to all tasks.
    """
    rows = manifest.orderBy("path").collect()
    paths, ends = [r["path"] for r in rows], np.cumsum([0, *(r["tokens"] for r in rows)])
    at = positions.columns.index(position)
    schema = T.StructType([*(f for f in positions.schema if f.name.lower() != into.lower()), T.StructField(into, T.LongType())])
    keep = [i for i, c in enumerate(positions.columns) if c.lower() != into.lower()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple = (None, None)
        for b in batches:
            found = []
            for p in b.column(at).to_pylist():
                k = -1 if p is None or not 0 <= p < ends[-1] else int(np.searchsorted(ends, p, side="right")) - 1
                if k >= 0 and held[0] != k:
                    if held[1]:
                        held[1].close()
                    fs, inner = filesystem(paths[k])
                    held = k, fs.open_input_file(inner)
                found.append(token(held[1], int(p - ends[k])) if k >= 0 else None)
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in keep), pa.array(found, pa.int64())], names=schema.fieldNames())
        if held[1]:
            held[1].close()

    return positions.sortWithinPartitions(position).mapInArrow(run, schema)


def crc32(ids: bytes) -> int:
    """Unsigned CRC-32 of ids as they lie in ``ids``."""
    return zlib.crc32(ids)
