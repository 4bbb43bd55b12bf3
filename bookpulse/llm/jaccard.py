"""Exact Jaccard join of texts by their sets of word n-grams: rare-first prefixes with length, positional and suffix filters.

A text's set holds its distinct n-grams, as 64-bit hashes; texts with one set are one node from the start. All n-grams
are ordered rare first. Two sets that link share one of each other's first ``n - ceil(t n) + 1`` n-grams, so nodes meet
in the lists of these. At the first n-gram that two nodes share, i and j n-grams stand before it and are not shared; a
pair goes on only if

* length: the smaller set is at least t of the larger;
* position: the shared n-gram and all that may follow suffice for the threshold;
* suffix: i + j, and the differences of the counts of the later n-grams in ``PARTS`` parts, don't exceed the differences
  that the threshold allows (each shared n-gram counts in the same part on both sides).

A pair that isn't at its first shared n-gram may be dropped there: it is kept at the first. What is left is verified
once on the whole sets. Only components are asked for, so a list doesn't give all its pairs. First each node is paired
with the list's first nodes by position; of its pairs that pass, a node's nearest by what is known is verified. The
links found join nodes to components. Of all other pairs, those of the lists included, only such of different components
are verified. A list longer than ``LIST``
is dealt in chunks, each two of which meet in a task. Short lists give all their pairs at once.

The order is by counts over all texts in ``2 ** BITS`` hashed buckets, a table of bounded size that is sent to all tasks
as one byte a bucket (a logarithm); equal counts go by hash. Any order common to all gives the same links: collisions of
buckets cost time only. Lists of n-grams that are much more frequent than most are dealt over several tasks when they are
gathered. Texts are read five times (counts, lists, tallies of nodes that share a list, twice the sets of nodes that may link);
nothing of their size is written.

Null texts and texts without words have an empty set and link with nothing, whatever their number. A null doc_id takes
part; the smallest doc_id of a component is the smallest that isn't null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bookpulse.llm.common import discard, materialize, slices
from bookpulse.llm.simhash import components

SHINGLE, SHARE, WHOLE = 3, 90, 100
#: Buckets of the count table (a power of two), and buckets in a row of it.
BITS, BLOCK = 24, 1 << 16
#: Parts in which the n-grams behind a shared one are counted.
PARTS = 64
#: A list of one node more than HUBS gives all its pairs at once; of a longer one all are paired with LARGE_HUBS nodes
#: first. Nodes of a list that one task compares.
HUBS, LARGE_HUBS, LIST = 4, 2, 4096
#: Nodes that a hub is compared with in one task.
GROUP = 2048
#: A list is dealt over tasks from so many n-grams of its bucket on, and so many times the mean.
HOT, HOT_TIMES = 4096, 16
#: Nodes that a task remembers, so that it gives copies once.
SEEN = 1 << 18
#: Bytes of text over which one running sum goes.
CHUNK = 1 << 18


# ---- sets -----------------------------------------------------------------------------------------------------


# Hashes of words are polynomials of a byte table at an odd point, modulo 2 to the 64: differences of one running sum.
_POINT = 0x9E3779B97F4A7C15
_MIX = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB], np.uint64)
_BYTE = np.array([xxhash.xxh3_64_intdigest(bytes([k])) | 1 for k in range(256)], np.uint64)
_BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def _powers(point: int) -> np.ndarray:
    return np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(CHUNK, point % (1 << 64), np.uint64))])


_POWERS, _INVERSES = _powers(_POINT), _powers(pow(_POINT, -1, 1 << 64))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _MIX[0]
    h = (h ^ (h >> np.uint64(27))) * _MIX[1]
    return h ^ (h >> np.uint64(31))


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of each word of a text's bytes; a word longer than CHUNK has a hash of its own kind."""
    edges = np.diff(_BLANK[data].astype(np.int8), prepend=1, append=1)
    starts, ends = np.flatnonzero(edges == -1), np.flatnonzero(edges == 1)
    out, i = np.empty(len(starts), np.uint64), 0
    while i < len(starts):
        base = int(starts[i])
        j = int(np.searchsorted(ends, base + CHUNK, side="right"))
        if j <= i:
            out[i] = xxhash.xxh3_64_intdigest(data[base : ends[i]].tobytes())
            i += 1
            continue
        part = _BYTE[data[base : ends[j - 1]]]
        part *= _POWERS[: len(part)]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(part)])
        first, last = starts[i:j] - base, ends[i:j] - base
        out[i:j] = (sums[last] - sums[first]) * _INVERSES[first] + (last - first).astype(np.uint64)
        i = j
    return _mixed(out), starts


def gram_sets(texts: list[str | None], size: int = SHINGLE) -> list[np.ndarray]:
    """Of each text the sorted hashes of its distinct n-grams; of all its words as one where they are fewer."""
    pieces = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]  # bytes: A-Z only
    h, starts = word_hashes(np.frombuffer(b"\n".join(pieces), np.uint8))
    cuts = np.searchsorted(starts, np.concatenate([[0], np.cumsum([len(p) + 1 for p in pieces])]))

    def joined(k: int) -> np.ndarray:  # each k words in a row
        out = np.full(max(0, len(h) - k + 1), k, np.uint64)
        for i in range(k):
            out = _mixed(out * np.uint64(_POINT) + h[i : len(h) - k + 1 + i])
        return out

    full, out = joined(size), []
    for i, j in zip(cuts.tolist(), cuts[1:].tolist()):
        if j - i >= size:
            found = np.sort(full[i : j - size + 1])
            found = found[np.concatenate([[True], found[1:] != found[:-1]])]
        else:
            found = np.zeros(0, np.uint64)
            if j > i:
                short = h[i:j]
                found = np.array([j - i], np.uint64)
                for k in range(j - i):
                    found = _mixed(found * np.uint64(_POINT) + short[k : k + 1])
        out.append(found)
    return out


def node(found: np.ndarray) -> bytes | None:
    """Sixteen bytes that stand for a set: twelve of a hash and its size; nothing for an empty one."""
    return xxhash.xxh3_128_digest(found.tobytes())[:12] + len(found).to_bytes(4, "big") if len(found) else None


def prefix_length(n: int) -> int:
    return n - -(-SHARE * n // WHOLE) + 1


def ordered(found: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The n-grams rare first: by the bucket's byte, then by hash (they come sorted by it)."""
    return found[np.argsort(rank[found & np.uint64(len(rank) - 1)], kind="stable")]


def _each(docs: DataFrame, schema: str, make: Callable[[], Callable], keep: int = 0) -> DataFrame:
    """Rows that ``make()(columns before the text, texts)`` gives of each slice; after the last it is called with None."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for whole in batches:
            for b in slices(whole, keep):
                yield from f(b.columns[:keep], b.column(keep).to_pylist())
        yield from f(None, None)

    return docs.mapInArrow(run, schema)


def _fixed(keys: np.ndarray) -> pa.Array:
    """Nodes, rows of sixteen bytes, as a binary column."""
    keys = np.ascontiguousarray(keys)
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(keys), [None, pa.py_buffer(keys)]).cast(pa.binary())


def _keys(c: pa.Array) -> np.ndarray:
    """A binary column of nodes as rows of sixteen bytes."""
    return np.frombuffer(b"".join(c.to_pylist()), np.uint8).reshape(-1, 16)


def _sizes(keys: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(keys[:, 12:]).view(">u4").reshape(-1).astype(np.int64)


def _new(seen: set, key: bytes | None) -> bool:
    """Whether a task hasn't met a node; it forgets all when it knows too many."""
    if key is None or key in seen:
        return False
    if len(seen) >= SEEN:
        seen.clear()
    seen.add(key)
    return True


# ---- counts in buckets ----------------------------------------------------------------------------------------


def _packed(counts: np.ndarray) -> bytes:
    """Counts in as many bytes each as the largest takes, compressed; the first byte says how many."""
    size = 1 if counts.max() < 1 << 8 else 2 if counts.max() < 1 << 16 else 4
    return bytes([size]) + pa.compress(counts.astype(f"<u{size}").tobytes(), codec="zstd", asbytes=True)


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(pa.decompress(data[1:], data[0] * BLOCK, codec="zstd", asbytes=True), f"<u{data[0]}").astype(np.int64)


class Buckets:
    """Counts of hashes in buckets inside a task, given as the rows that aren't zero."""

    def __init__(self) -> None:
        self.counts = np.zeros(1 << BITS, np.uint32)

    def add(self, hashes: np.ndarray) -> None:
        at, n = np.unique(hashes & np.uint64((1 << BITS) - 1), return_counts=True)
        self.counts[at.astype(np.int64)] += n.astype(np.uint32)

    def blocks(self) -> tuple[pa.Array, pa.Array]:
        rows = self.counts.reshape(-1, BLOCK)
        at = np.flatnonzero(rows.any(1))
        return pa.array(at.astype(np.int32)), pa.array([_packed(rows[k]) for k in at], pa.binary())


def gather_counts(blocks: DataFrame) -> np.ndarray:
    """The sum of all tasks' counts as logarithms, a byte a bucket: 2 ** BITS bytes at the driver, whatever the input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                sums[k] = sums.get(k, 0) + _unpacked(c)
        logs = [np.minimum(255, np.ceil(8 * np.log2(1 + s))).astype(np.uint8).tobytes() for s in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(logs, pa.binary())], names=["block", "logs"])

    out = np.zeros((1 << BITS) // BLOCK * BLOCK, np.uint8).reshape(-1, BLOCK)
    for r in blocks.repartition("block").mapInArrow(run, "block int, logs binary").collect():
        out[r.block] = np.frombuffer(r.logs, np.uint8)
    return out.reshape(-1)


def marked(docs: DataFrame) -> DataFrame:
    """doc_id, node and n_shingles of each row of (doc_id, text); after them, where block isn't null, counts of n-grams."""

    names = ["doc_id", "node", "n_shingles", "block", "counts"]
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, node binary, n_shingles long, block int, counts binary"

    def make():
        counts, kind = Buckets(), []

        def f(before, texts):
            if texts is None:
                at, data = counts.blocks()
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.nulls(len(at), kind[0]), pa.nulls(len(at), pa.binary()), pa.nulls(len(at), pa.int64()), at, data], names=names)
                return
            kind[:] = [before[0].type]
            sets = gram_sets(texts)
            counts.add(np.concatenate(sets))
            n = len(sets)
            yield pa.RecordBatch.from_arrays([before[0], pa.array(map(node, sets), pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names=names)

        return f

    return _each(docs.select("doc_id", "text"), schema, make, keep=1)


# ---- lists ----------------------------------------------------------------------------------------------------


def postings(docs: DataFrame, rank) -> DataFrame:
    """g, share, node, pos: a row for each n-gram of a node's prefix, each node once a task; share deals hot lists."""
    held = rank.value
    mean = max(1.0, float((2 ** (held[held > 0] / 8)).mean()) if held.any() else 1.0)
    # (the byte from which a bucket is hot; 256: none)
    hot = int(np.ceil(8 * np.log2(1 + max(HOT, HOT_TIMES * mean))))

    def make():
        seen, order = set(), rank.value

        def f(_, texts):
            parts = []
            for found in gram_sets(texts or []):
                if _new(seen, key := node(found)):
                    first = ordered(found, order)[: prefix_length(len(found))]
                    parts.append((first, np.frombuffer(key, np.uint8)))
            if not parts:
                return
            lengths = [len(p) for p, _ in parts]
            g = np.concatenate([p for p, _ in parts])
            keys = np.repeat(np.stack([k for _, k in parts]), lengths, axis=0)
            pos = np.concatenate([np.arange(n, dtype=np.int32) for n in lengths])
            level = order[g & np.uint64(len(order) - 1)].astype(np.int64)
            spread = np.ceil(2.0 ** ((level - hot) / 8)).astype(np.int64)
            share = np.where(level >= hot, np.ascontiguousarray(keys[:, :4]).view("<u4").reshape(-1) % np.maximum(1, spread), -1)
            yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(share.astype(np.int32)), _fixed(keys), pa.array(pos)], names=["g", "share", "node", "pos"])

        return f

    return _each(docs.select("text"), "g long, share int, node binary, pos int", make)


def _meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by g, share and node: each node of a list once, lists of one node left out (but for parts of hot ones)."""
    last = None  # the last row and whether it has been given
    for b in batches:
        if not b.num_rows:
            continue
        g, share, pos = (b.column(k).to_numpy() for k in (0, 1, 3))
        keys, given = _keys(b.column(2)), np.zeros(b.num_rows, bool)
        if last:
            g, share, pos, keys, given = (np.concatenate([x, y]) for x, y in zip(last, (g, share, pos, keys, given)))
        halves = np.ascontiguousarray(keys).view("<u8")
        same_list = np.concatenate([[False], (g[1:] == g[:-1]) & (share[1:] == share[:-1])])
        again = np.concatenate([[False], (halves[1:] == halves[:-1]).all(1)]) & same_list
        g, share, pos, keys, given, same_list = (x[~again] for x in (g, share, pos, keys, given, same_list))
        out = (same_list | np.concatenate([same_list[1:], [False]]) | (share >= 0)) & ~given
        last = tuple(x[-1:] for x in (g, share, pos, keys, given | out))
        if out.any():
            yield pa.RecordBatch.from_arrays([pa.array(g[out]), _fixed(keys[out]), pa.array(pos[out])], names=["g", "node", "pos"])


def _of_nodes(docs: DataFrame, wanted, schema: str, make_row: Callable) -> DataFrame:
    """node and what ``make_row(set)`` gives, of nodes in the wanted buckets (of a few others as well), each once a task."""

    def make():
        seen = set()

        def f(_, texts):
            rows = []
            for found in gram_sets(texts or []):
                key = node(found)
                if key and wanted.value[int.from_bytes(key[:8], "little") & (len(wanted.value) - 1)] and _new(seen, key):
                    rows.append((key, make_row(found)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*rows)], names=names)

        return f

    names = ["node", schema]
    return _each(docs.select("text"), f"node binary, {schema} binary", make)


def tallies(docs: DataFrame, rank, wanted) -> DataFrame:
    """node and tally: counts of the set in parts, then the part of each n-gram of the prefix."""

    def row(found: np.ndarray) -> bytes:
        part = ((found >> np.uint64(32)) % np.uint64(PARTS)).astype(np.int64)
        first = ordered(found, rank.value)[: prefix_length(len(found))]
        return np.bincount(part, minlength=PARTS).astype("<u4").tobytes() + ((first >> np.uint64(32)) % np.uint64(PARTS)).astype(np.uint8).tobytes()

    return _of_nodes(docs, wanted, "tally", row)


def whole_sets(docs: DataFrame, wanted) -> DataFrame:
    """node and grams: the whole set."""
    return _of_nodes(docs, wanted, "grams", lambda found: found.tobytes())


def node_buckets(nodes: DataFrame):
    """A broadcast table of the buckets that hold a node of column ``node``: 2 ** BITS bytes."""

    def run(batches):
        counts = Buckets()
        for b in batches:
            if b.num_rows:
                counts.add(np.ascontiguousarray(_keys(b.column(0))[:, :8]).view("<u8").reshape(-1))
        at, data = counts.blocks()
        if len(at):
            yield pa.RecordBatch.from_arrays([at, data], names=["block", "counts"])

    return nodes.sparkSession.sparkContext.broadcast(gather_counts(nodes.select("node").mapInArrow(run, "block int, counts binary")))


def _suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """g, node, pos and the counts in parts (255 at most) of the node's n-grams behind g."""
    for b in batches:
        out = []
        for pos, tally in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
            counts = np.frombuffer(tally, "<u4", PARTS).astype(np.int64)
            counts -= np.bincount(np.frombuffer(tally, np.uint8, pos + 1, 4 * PARTS), minlength=PARTS)
            out.append(np.minimum(counts, 255).astype(np.uint8).tobytes())
        yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(out, pa.binary())], names=["g", "node", "pos", "suffix"])


def may_link(n: np.ndarray, pos: np.ndarray, suffix: np.ndarray, m: int, at: int, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether sets of sizes n, with positions and suffix counts in a list, pass the filters against one of size m.

    And, of those that do, the differences that are known of.
    """
    small, total = np.minimum(n, m), n + m
    least = -(-SHARE * total // (SHARE + WHOLE))  # shared n-grams that the threshold takes
    ok = (WHOLE * small >= SHARE * np.maximum(n, m)) & (1 + np.minimum(n - pos - 1, m - at - 1) >= least)
    known = pos[ok] + at + np.abs(suffix[ok].astype(np.int16) - other.astype(np.int16)).sum(1, dtype=np.int64)
    fits = known <= total[ok] - 2 * least[ok]
    ok[ok] = fits
    return ok, known[fits]


def _pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([_fixed(a), _fixed(b)], names=["a", "b"])


def _columns(b: pa.RecordBatch) -> tuple:
    keys = _keys(b.column(1))
    return b.column(0).to_numpy(), keys, _sizes(keys), b.column(2).to_numpy().astype(np.int64), np.frombuffer(b"".join(b.column(3).to_pylist()), np.uint8).reshape(-1, PARTS)


_MEMBER = "g long, node binary, pos int, suffix binary, a binary, b binary, known int"


def _with_hubs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by g, pos and node: all pairs of a list of HUBS + 1 nodes, and of a longer one its rows and those with few hubs.

    A node's rows from several tasks count once.

    Pairs have a, b and the differences known of, rows of longer lists the columns they came with. Only the hubs are held.
    """
    key, hubs, seen, last = None, [], 0, None

    def rows(g, keys, pos, suffix) -> pa.RecordBatch:
        n = len(g)
        return pa.RecordBatch.from_arrays([pa.array(g), _fixed(keys), pa.array(pos.astype(np.int32)), pa.array([x.tobytes() for x in suffix], pa.binary()), *(pa.nulls(n, k) for k in (pa.binary(), pa.binary(), pa.int32()))], names=names)

    names = ["g", "node", "pos", "suffix", "a", "b", "known"]
    for b in batches:
        if not b.num_rows:
            continue
        g, keys, n, pos, suffix = _columns(b)
        new = np.concatenate([[last != (int(g[0]), keys[0].tobytes())], (g[1:] != g[:-1]) | (keys[1:] != keys[:-1]).any(1)])
        last = int(g[-1]), keys[-1].tobytes()
        g, keys, n, pos, suffix = (x[new] for x in (g, keys, n, pos, suffix))
        cuts = np.flatnonzero(np.diff(g)) + 1
        left, right, known, large = [], [], [], np.zeros(len(g), bool)

        def meet(hub: tuple, i: int, j: int) -> None:
            own, m, at, other = hub
            ok, apart = may_link(n[i:j], pos[i:j], suffix[i:j], m, at, other)
            if len(apart):
                left.append(np.broadcast_to(own, (len(apart), 16)))
                right.append(keys[i:j][ok])
                known.append(apart)

        for i, j in zip([0, *cuts.tolist()] if len(g) else [], [*cuts.tolist(), len(g)]):
            if key is None or g[i] != key:
                key, hubs, seen = g[i], [], 0
            for k in range(i, min(j, i + HUBS + 1 - seen)):  # the first rows: each with those before it
                for hub in hubs:
                    meet(hub, k, k + 1)
                hubs.append((keys[k], int(n[k]), int(pos[k]), suffix[k]))
            start = max(i, i + HUBS + 1 - seen)
            if start < j:
                for hub in hubs[:LARGE_HUBS]:
                    meet(hub, start, j)
                large[start:j] = True
                if seen <= HUBS + 1:  # (the first time)
                    yield rows(np.full(len(hubs), key), np.stack([h[0] for h in hubs]), np.array([h[2] for h in hubs]), [h[3] for h in hubs])
            seen += j - i
        if large.any():
            yield rows(g[large], keys[large], pos[large], suffix[large])
        if left:
            found = [_fixed(np.concatenate(left)), _fixed(np.concatenate(right)), pa.array(np.concatenate(known).astype(np.int32))]
            k = len(found[2])
            yield pa.RecordBatch.from_arrays([pa.nulls(k, pa.int64()), pa.nulls(k, pa.binary()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary()), *found], names=names)


def _between(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of different components in a list or in two chunks of one, of rows sorted by g, low, high; LIST rows or two chunks are held."""

    def close(held: list) -> Iterator[pa.RecordBatch]:
        g, keys, n, pos, suffix, root, chunk, low, high = (np.concatenate(c) for c in zip(*held))
        for i in range(len(g) - 1):
            rest = slice(i + 1, None)
            ok = (root[rest] != root[i]).any(1)
            if low[i] != high[i]:
                ok &= chunk[rest] != chunk[i]
            ok[ok] = may_link(n[rest][ok], pos[rest][ok], suffix[rest][ok], int(n[i]), int(pos[i]), suffix[i])[0]
            if ok.any():
                yield _pairs(np.broadcast_to(keys[i], (int(ok.sum()), 16)), keys[rest][ok])

    held, key = [], None
    for b in batches:
        if not b.num_rows:
            continue
        columns = (*_columns(b), _keys(b.column(4)), *(b.column(k).to_numpy() for k in (5, 6, 7)))
        ids = np.stack([columns[0], columns[-2], columns[-1]], axis=1)
        cuts = np.flatnonzero((ids[1:] != ids[:-1]).any(1)) + 1
        for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), len(ids)]):
            if key is not None and tuple(ids[i]) != key:
                yield from close(held)
                held = []
            key = tuple(ids[i])
            held.append([c[i:j] for c in columns])
    if held:
        yield from close(held)


# ---- links ----------------------------------------------------------------------------------------------------

_PAIR = "a binary, b binary"


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs that reach the threshold, of rows (hub, share, member, node, grams) sorted so: a hub's set, then those to compare it with."""
    key = node_before = hub = None
    for b in batches:
        left, right = [], []
        for h, share, member, k, grams_of in zip(*(b.column(c).to_pylist() for c in range(4)), b.column(4)):
            if (h, share) != key:
                key, node_before, hub = (h, share), None, None
            if (member, k) == node_before:
                continue  # the same set from another task
            node_before, own = (member, k), np.frombuffer(grams_of.as_buffer(), np.uint64)
            if not member:
                hub = own.copy()
                continue
            p, q = (own, hub) if len(own) <= len(hub) else (hub, own)
            shared = int((q[np.minimum(np.searchsorted(q, p), len(q) - 1)] == p).sum())
            if WHOLE * shared >= SHARE * (len(p) + len(q) - shared):
                left.append(h)
                right.append(k)
        yield pa.RecordBatch.from_arrays([pa.array(left, pa.binary()), pa.array(right, pa.binary())], names=["a", "b"])


def verified(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """a and b of the pairs (hub, node) whose whole sets reach the threshold; each pair has to be there once.

    Sets are made from the texts again, those of the pairs' nodes only, and sent to their hubs: a set goes once for each
    of its hubs, a hub's own once for each GROUP nodes it is compared with.
    """
    shares = pairs.groupBy("hub").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("shares"))
    member = pairs.join(shares, "hub").select("node", "hub", F.pmod(F.xxhash64("node"), "shares").cast("int").alias("share"), F.lit(True).alias("member"))
    own = shares.select(F.col("hub").alias("node"), "hub", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), F.lit(False).alias("member"))
    sent = materialize(member.unionByName(own))
    sets = whole_sets(docs, node_buckets(sent))
    met = sets.join(sent, "node").select("hub", "share", "member", "node", "grams").repartition("hub", "share").sortWithinPartitions("hub", "share", "member", "node")
    found = materialize(met.mapInArrow(_compared, _PAIR))
    discard(sent)
    return found


def linked(docs: DataFrame, rank) -> DataFrame | None:
    """u (a node with a link) and v (the smallest node of its component), materialized; None where no list has two nodes."""
    lists = materialize(postings(docs, rank).repartition("g", "share").sortWithinPartitions("g", "share", "node").mapInArrow(_meetings, "g long, node binary, pos int"))
    met = node_buckets(lists)
    if not met.value.any():
        discard(lists)
        return None
    placed = lists.join(tallies(docs, rank, met), "node").select("g", "node", "pos", "tally").mapInArrow(_suffixes, "g long, node binary, pos int, suffix binary")
    starred = materialize(placed.repartition("g").sortWithinPartitions("g", "pos", "node").mapInArrow(_with_hubs, _MEMBER))
    discard(lists)
    large = starred.where("g is not null").select("g", "node", "pos", "suffix")
    pairs = materialize(starred.where("g is null").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min("known").alias("known")))

    # Each node with the one that it may differ least from.
    either = pairs.select("a", "b", "known").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "known"))
    nearest = either.groupBy(F.col("a").alias("node")).agg(F.min_by("b", F.struct("known", "b")).alias("hub"))
    first = materialize(nearest.groupBy(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).agg(F.max("hub").alias("hub")).select("hub", F.when(F.col("hub") == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("node"), "a", "b"))
    links = verified(first.select("hub", "node"), docs)
    roots = components(links)

    # All other pairs that passed the filters, of two components; and such pairs of long lists of several components.
    root_of = lambda node, into: roots.select(F.col("u").alias(node), F.col("v").alias(into))
    others = pairs.join(first.select("a", "b"), ["a", "b"], "left_anti").join(root_of("a", "x"), "a", "left").join(root_of("b", "y"), "b", "left").where(F.coalesce("x", "a") != F.coalesce("y", "b"))
    label = materialize(large.join(root_of("node", "root"), "node", "left").withColumn("root", F.coalesce("root", "node")))
    apart = label.groupBy("g").agg(F.count("*").alias("n"), F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("g", F.ceil(F.col("n") / LIST).cast("int").alias("chunks"))
    dealt = label.join(apart, "g").withColumn("chunk", F.pmod(F.xxhash64("node"), "chunks").cast("int"))
    # A chunk meets each chunk, itself included, in one place.
    dealt = dealt.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select("g", "node", "pos", "suffix", "root", "chunk", F.least("chunk", "k").alias("low"), F.greatest("chunk", "k").alias("high"))
    cross = dealt.repartition("g", "low", "high").sortWithinPartitions("g", "low", "high").mapInArrow(_between, _PAIR)
    ends = [F.least("a", "b").alias("hub"), F.greatest("a", "b").alias("node")]
    # (verified once each: pairs of the first round are left out)
    rest = materialize(cross.select(*ends).unionByName(others.select(*ends)).distinct().join(first.select(F.col("a").alias("hub"), F.col("b").alias("node")), ["hub", "node"], "left_anti"))
    discard(starred, label)
    found = roots
    if not rest.isEmpty():
        more = verified(rest, docs)
        found = components(roots.select(F.col("u").alias("a"), F.col("v").alias("b")).unionByName(more))
        discard(roots, more)
    discard(pairs, first, links, rest)
    return found


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """For each row of ``docs``: doc_id, n_shingles (size of its set), component_id (smallest doc_id that links reach)."""
    plain = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    noted = materialize(marked(plain))
    rank = docs.sparkSession.sparkContext.broadcast(gather_counts(noted.where("block is not null").select("block", "counts")))  # 2 ** BITS bytes
    rows = noted.where("block is null").select("doc_id", "node", "n_shingles")
    roots = linked(plain, rank)
    own = rows.where("node is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    least = rows.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("first"))
    if roots is None:
        known = least.withColumnRenamed("first", "component_id")
    else:
        joined = materialize(least.join(roots, least.node == roots.u, "left").select("node", "first", F.coalesce("v", "node").alias("root")))
        smallest = materialize(joined.groupBy("root").agg(F.min("first").alias("component_id")))
        known = materialize(joined.join(smallest, "root").select("node", "component_id"))
        discard(joined, smallest, roots)
    return rows.join(known, "node").select("doc_id", "n_shingles", "component_id").unionByName(own)
