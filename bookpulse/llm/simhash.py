"""SimHash near duplicates: fingerprints, a byte-position index with count filtering, and components.

A fingerprint has 64 bits, eight positional bytes. Fingerprints that differ in at most ``RADIUS`` = 2 bits differ in at
most two bytes, so at least ``MATCHES`` = 6 of 8 positional bytes are shared: the guaranteed minimum of the count
filter. A posting list of one positional byte holds a 256th of all rows, and tallying pairs inside it is quadratic;
posting lists are therefore keyed by four positional bytes. The positions form four pairs, two bad bytes spoil at most
two of them, so the two others are shared: the six choices of two pairs reach every link, with 32 bits of selectivity.
Inside a posting list the shared positional bytes of each pair are tallied, pairs with six or more are retained, and
their differing bits counted.

Only distinct fingerprints are indexed: copies are one class with its smallest doc_id from the start. A posting list
gives no pairs but a spanning forest of its links. Lists are counted first, which combines before the shuffle; one longer
than ``POSTING`` fingerprints is not gathered in one task. Its fingerprints take an exact way of linear size instead: two
fingerprints link exactly if some number lies within one bit of both, so each emits the 65 numbers within one bit, and
those that meet at a number are linked to its smallest.

Components come from alternating large-star and small-star steps over the links, each written to the shared folder and
deleted when a later step no longer reads it.

Null and empty texts and texts without words have fingerprint zero and link like any other. A null doc_id takes part;
the smallest doc_id of its class is the smallest that isn't null.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bookpulse.llm.common import discard, map_text, materialize

RADIUS, MATCHES, SHINGLE, SEED = 2, 6, 3, 42
#: Fingerprints of a posting list that are tallied pair by pair; longer lists take the linear way.
POSTING = 2048
#: The byte positions of each posting key: two of four pairs of positions.
KEYS = [(2 * a, 2 * a + 1, 2 * b, 2 * b + 1) for a, b in combinations(range(4), 2)]

_LOWER = bytes(b + 32 if 65 <= b <= 90 else (32 if 9 <= b <= 13 else b) for b in range(256))


def fingerprint(text: str | None) -> int:
    """The unsigned fingerprint of a whole text: a bit is set if over half of the shingles' hashes have it."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split(b" ")
    words = [w for w in words if w]
    if not words:
        return 0
    if len(words) < SHINGLE:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(words, words[1:], words[2:]))
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(s, SEED) for s in shingles], dtype="<u8")
    set_bits = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 14):  # bounded memory for texts of any length
        part = h[i : i + (1 << 14)]
        set_bits += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * set_bits > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", into: str = "fp") -> DataFrame:
    """Add the fingerprint of each text as a (signed) long; other columns pass through."""

    def make():
        return lambda texts: [pa.array(np.array([fingerprint(t) for t in texts], dtype=np.uint64).view(np.int64))]

    return map_text(docs, text, T.StructType([T.StructField(into, T.LongType(), False)]), make)


# ---- links ----------------------------------------------------------------------------------------------------


def _postings(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Posting keys of fingerprints: number of the choice of positions, and the four bytes there as one number."""
    by = fps.view(np.uint8).reshape(-1, 8)
    kinds = np.repeat(np.arange(len(KEYS), dtype=np.int64), len(fps))
    values = np.concatenate([np.ascontiguousarray(by[:, k]).view("<u4").reshape(-1) for k in KEYS]).astype(np.int64)
    return kinds << 32 | values, np.tile(fps, len(KEYS))


def link_posting(fps: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links among the distinct fingerprints of one posting list, by tallying shared bytes."""
    n = len(fps)
    fps = np.sort(fps.view(np.int64)).view(np.uint64)  # a link's hub is its smaller end
    by = fps.view(np.uint8).reshape(n, 8)
    root = list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    out = []
    for i in range(n - 1):
        tally = (by[i + 1 :] == by[i]).sum(1)
        near = np.flatnonzero(tally >= MATCHES)
        near = near[np.bitwise_count(fps[i + 1 :][near] ^ fps[i]) <= RADIUS] + i + 1
        for j in near.tolist():
            a, b = find(i), find(j)
            if a != b:
                root[b] = a
                out.append((i, j))
    signed = fps.view(np.int64).tolist()
    return [(signed[i], signed[j]) for i, j in out]


_KEYED = T.StructType([T.StructField("posting", T.LongType(), False), T.StructField("fp", T.LongType(), False)])
_LINK = T.StructType([T.StructField("a", T.LongType(), False), T.StructField("b", T.LongType(), False)])


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keys, fps = _postings(b.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fps.view(np.int64))], names=["posting", "fp"])


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of postings that come sorted by key, none of them longer than POSTING."""
    held: list[np.ndarray] = []
    key = None

    def close() -> list:
        fps = np.concatenate(held) if held else []
        return link_posting(fps.view(np.uint64)) if len(fps) > 1 else []

    def batch(found: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=["a", "b"])

    for b in batches:
        keys = b.column(0).to_numpy(zero_copy_only=False)
        fps = b.column(1).to_numpy(zero_copy_only=False)
        if not len(keys):
            continue
        cuts = np.flatnonzero(np.diff(keys)) + 1
        found: list = []
        for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)]):
            if key is None or keys[i] != key:
                found += close()
                held, key = [], keys[i]
            held.append(fps[i:j])
        if found:
            yield batch(found)
    if found := close():
        yield batch(found)


def links(distinct: DataFrame) -> DataFrame:
    """Links (a, b) that connect exactly the linked classes among the distinct fingerprints of column ``fp``."""
    postings = distinct.select("fp").mapInArrow(_index, _KEYED)
    size = postings.groupBy("posting").agg(F.count("*").alias("n")).where("n > 1")  # a list of one has no links
    sized = materialize(postings.join(size, "posting"))
    short = sized.where(F.col("n") <= POSTING).select("posting", "fp").repartition("posting").sortWithinPartitions("posting").mapInArrow(_tally, _LINK).distinct()
    # The long postings' fingerprints: all numbers within one bit, and the smallest fingerprint that meets there.
    long = sized.where(F.col("n") > POSTING).select(F.col("fp").alias("a")).distinct()
    near = F.concat(F.array("a"), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("a").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))))
    spread = long.select("a", F.explode(near).alias("at"))
    # (the minimum of a number's meeting is combined before the shuffle; a link is in both ends' numbers, so one link an end and number)
    least = spread.groupBy("at").agg(F.min("a").alias("b"), F.count("*").alias("n")).where("n > 1").drop("n")
    met = spread.join(least, "at").where("a <> b").select("a", "b").distinct()
    return short.unionByName(met)


# ---- components -----------------------------------------------------------------------------------------------


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Nodes (u) with the smallest node (v) of their component, nodes with an edge only; a materialized table.

    Large-star and small-star steps alternate until nothing changes; each halves paths, so their number grows with the
    logarithm of the longest one. Minima are combined before the shuffle, and hot nodes' joins can be split.
    """
    pairs = materialize(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    before = None
    while True:
        # Large star: every larger neighbour of a node is linked to the node's smallest neighbour (or the node). The
        # minima are a table of their own, so the join's two sides are plain exchanges and a hot node's can be split.
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        nearest = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("m")))
        large = materialize(pairs.join(nearest, pairs.v == nearest.node).select("u", F.col("m").alias("v")).where("u <> v").distinct())
        # Small star: a node and its smaller neighbours are linked to the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        done, pairs = pairs, materialize(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        discard(done, nearest, large)
        now = pairs.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))).first()
        if now == before:
            return pairs
        before = now


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", component: str | None = None) -> DataFrame:
    """For each row of ``docs``: doc_id, fp (long), component_id (smallest doc_id that links reach, its own included).

    ``component`` names a further column, the component's smallest fingerprint: it tells components apart whatever their
    doc_ids are.
    """
    marked = materialize(fingerprints(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))).drop("text"))
    least = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(links(least))
    # Of each component the smallest doc_id, given to its fingerprints; fingerprints without links keep their own.
    joined = materialize(least.join(roots, least.fp == roots.u, "left").select("fp", "first", F.coalesce("v", "fp").alias("root")))
    smallest = materialize(joined.groupBy("root").agg(F.min("first").alias("component_id")))
    known = materialize(joined.join(smallest, "root").select("fp", "component_id", "root"))
    discard(least, roots, joined, smallest)
    return marked.join(known, "fp").select("doc_id", "fp", "component_id", *([F.col("root").alias(component)] if component else []))


def hex_digits(fp: str = "fp"):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
