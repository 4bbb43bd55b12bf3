"""Benchmark decontamination with an FM-index of each shard of training text.

Texts are lower-cased (A-Z) and cut into words of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``. A window is ``WINDOW``
consecutive words of a benchmark item; an item of fewer words, but not none, is one window. A shard is what a task holds
at a time (``SHARD_BYTES`` of text or ``SHARD_ROWS`` documents at most). Its words are turned into symbols of the
benchmark's vocabulary. A word outside it lies in no window, so it only separates: runs of vocabulary words too short for
the shortest window are left out and runs are joined by a separator, which changes no occurrence. Windows whose words all
occur in the shard are then searched backward in the FM-index of that text, occurrences located by sampled suffix
positions, and spans of hit words merged.

The benchmark is taken in blocks of at most ``BLOCK_CHARS`` characters of items (a query set, never a function of the
corpus), or one item. Each block is one pass over all documents; with more than one, a pass's results are written before
the next begins, so one block is in memory at a time. Null texts, on either side, have no words; the windows of an item
without an id are searched and hit words, the missing id isn't listed; equal item_ids are one item.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from bookpulse.llm.common import discard, map_text, materialize, sealed
from bookpulse.llm.fm_index import FMIndex

WINDOW = 13
BLOCK_CHARS = 8 << 20
SHARD_ROWS, SHARD_BYTES = 4096, 8 << 20

# Word characters are 0-9, a-z and everything beyond ASCII; others separate.
_WORDS = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else (b + 32 if 0x41 <= b <= 0x5A else 0x20) for b in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORDS).split(b" ") if text else []


def word_list(text: str | None) -> list[bytes]:
    return [w for w in words(text) if w]


class Benchmark:
    """Windows of a block of items as symbol rows, and the items of each window."""

    def __init__(self, items: list[tuple]):
        self.vocabulary: dict[bytes, int] = {}
        of: dict[tuple, set] = defaultdict(set)
        for item, text in items:
            found = word_list(text)
            if not found:
                continue
            symbols = [self.vocabulary.setdefault(w, len(self.vocabulary) + 2) for w in found]
            for i in range(max(1, len(symbols) - WINDOW + 1)):
                of[tuple(symbols[i : i + WINDOW])] |= {item} - {None}
        self.items = [sorted(s) for s in of.values()]
        self.lengths = np.array([len(w) for w in of], np.int64)
        self.patterns = np.zeros((len(of), WINDOW), np.int64)
        for i, w in enumerate(of):
            self.patterns[i, WINDOW - len(w) :] = w
        self.shortest = int(self.lengths.min()) if len(of) else 0

    def hits(self, texts: list) -> list[tuple[int, list[tuple[int, int]], list]]:
        """Of each text of a shard: number of words, merged spans of hit words (end exclusive), items that occur."""
        get = self.vocabulary.get
        lists = [word_list(t) for t in texts]
        sizes = np.array([len(w) for w in lists], np.int64)
        starts = np.cumsum(sizes + 1) - sizes - 1  # a separator after each text
        out = [(len(w), [], []) for w in lists]
        if not self.items:
            return out
        symbols = np.ones(int((sizes + 1).sum()), np.int64)
        for w, s in zip(lists, starts.tolist()):
            symbols[s : s + len(w)] = [get(x, 1) for x in w]
        # Runs of vocabulary words as long as the shortest window, each with the separator after it.
        inside = np.concatenate([[False], symbols > 1, [False]])
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        begin, end = edge[::2], edge[1::2]
        long = end - begin >= self.shortest
        begin, end = begin[long], end[long]
        if not len(begin):
            return out
        held = end - begin + 1
        where = np.repeat(begin - (np.cumsum(held) - held), held) + np.arange(held.sum())
        index = FMIndex(symbols[where], len(self.vocabulary) + 2)
        present = np.zeros(len(self.vocabulary) + 2, bool)
        present[0] = True  # pads short windows
        present[symbols[where]] = True
        able = np.flatnonzero(present[self.patterns].all(1))
        low, high = index.search(self.patterns[able], self.lengths[able])
        some = np.flatnonzero(high > low)
        found, low, times = able[some], low[some], (high - low)[some]
        if not len(found):
            return out
        rows = np.repeat(low - (np.cumsum(times) - times), times) + np.arange(times.sum())
        window = np.repeat(found, times)
        at = where[index.locate(rows)]
        text = np.searchsorted(starts, at, side="right") - 1
        for i in np.unique(text).tolist():
            mine = text == i
            first = at[mine] - starts[i]
            hit = np.zeros(int(sizes[i]) + 1, np.int64)
            np.add.at(hit, first, 1)
            np.add.at(hit, first + self.lengths[window[mine]], -1)
            covered = np.concatenate([[False], hit.cumsum()[:-1] > 0, [False]])
            turn = np.flatnonzero(covered[1:] != covered[:-1])
            items = set().union(*(self.items[w] for w in np.unique(window[mine]).tolist()))
            out[i] = (len(lists[i]), list(zip(turn[::2].tolist(), turn[1::2].tolist())), sorted(items))
        return out


_SPAN = T.StructType([T.StructField("start", T.LongType(), False), T.StructField("end", T.LongType(), False)])


def blocks(benchmark: DataFrame, item_id: str, text: str) -> Iterator[list[tuple]]:
    """Items in blocks of bounded size, one at a time."""
    block, size = [], 0
    for r in benchmark.select(item_id, text).toLocalIterator():
        if block and size + len(r[1] or "") > BLOCK_CHARS:
            yield block
            block, size = [], 0
        block.append((r[0], r[1]))
        size += len(r[1] or "")
    yield block


def _merged(spans: Column) -> Column:
    """Sorted spans with those that touch made one."""

    def add(done: Column, s: Column) -> Column:
        last = F.element_at(done, -1)
        wider = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))
        touch = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(wider))
        return F.when(F.size(done) == 0, F.array(s)).when(s["start"] <= last["end"], touch).otherwise(F.concat(done, F.array(s)))

    return F.aggregate(F.array_sort(spans), F.array().cast(T.ArrayType(_SPAN)), add)


_built: dict[str, Benchmark] = {}


def _benchmark(key: str, block) -> Benchmark:
    """The worker's one block at hand, built once however many tasks it runs."""
    if key not in _built:
        _built.clear()
        _built[key] = Benchmark(block.value)
    return _built[key]


def _find_block(docs: DataFrame, block: list[tuple], kind: T.DataType, text: str, names: list[str]) -> DataFrame:
    fields = [T.StructField(names[0], T.LongType(), False), T.StructField(names[1], T.ArrayType(_SPAN, False), False), T.StructField(names[2], T.ArrayType(kind, False), False)]
    arrow = [to_arrow_type(f.dataType) for f in fields]
    shared, key = docs.sparkSession.sparkContext.broadcast(block), uuid.uuid4().hex  # at most BLOCK_CHARS of text, or one item

    def make():
        built = _benchmark(key, shared)

        def f(texts: list) -> list:
            found = built.hits(texts)
            spans = [[{"start": a, "end": b} for a, b in s] for _, s, _ in found]
            return [pa.array([n for n, _, _ in found], arrow[0]), pa.array(spans, arrow[1]), pa.array([i for _, _, i in found], arrow[2])]

        return f

    return map_text(docs, text, T.StructType(fields), make, rows=SHARD_ROWS, size=SHARD_BYTES)


def find(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Add n_words, hit_spans (merged spans in words), items (ids of items that occur); other columns pass through."""
    plain, name, _ = sealed(docs)
    kind, out, before = benchmark.schema[item_id].dataType, None, None
    for block in blocks(benchmark, item_id, item_text):
        if out is None:
            out = _find_block(plain, block, kind, name[text], ["n_words", "hit_spans", "items"])
            continue
        out = materialize(out)
        if before:
            discard(before)
        before = out
        more = _find_block(out, block, kind, name[text], ["n", "spans", "more"])
        out = more.withColumns({"hit_spans": _merged(F.concat("hit_spans", "spans")), "items": F.array_sort(F.array_union("items", "more"))})
    new = ["n_words", "hit_spans", "items"]
    return out.select(*(F.col(n).alias(c) for c, n in name.items() if c.lower() not in new), *new)


def hit_words() -> Column:
    return F.aggregate("hit_spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])


def contaminated() -> Column:
    """Contamination rule: any hit, and at least one word in twenty is hit."""
    return (hit_words() > 0) & (20 * hit_words() >= F.col("n_words"))
