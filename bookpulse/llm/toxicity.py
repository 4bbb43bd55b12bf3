"""Toxicity scores by a factorization machine over hashed terms.

Terms of a text are its distinct lower-case words and the first 3 to 6 letters of its longer words, hashed to
``BUCKETS``. The machine scores bias + sum of weights + sum over pairs of the dot products of their factors, so an
insult beside a mention of a group counts for more than both alone, which additive weights can't say.

Fit: a bounded sample of labelled rows (at most ``SAMPLE`` rows, those of smallest hash, whatever their number; of each
the ``TERMS`` smallest hashes at most) gives its rows' hashes to the driver. Terms that speak for label 1 (chi-square over
``CHI``, in ``LEAST_ROWS`` rows and one row of 500 at least, ``FEATURES`` at most) become features, and so do both terms
of a pair that stands for label 1 by more than either term alone (``pair_terms``), however neutral or clean they are
alone; such terms' weights may be negative. The bias is the sample's log odds; weights and factors are fitted by
mini-batch Adagrad on the logistic loss, each row counting the same. The model's size is bounded by FEATURES. Scoring
reads every whole text.

Null and empty texts have no terms and get the bias's score. Rows with a null label or no text row aren't used to fit. Of
labelled rows that are near copies (equal label, equal smallest hashes and ``ALIKE`` of their terms shared) the first
counts, as a text's copies would make its odd words look telling. With labels of one kind only, every text scores as the
share of label 1 among them says (one of each kind added), so all-positive labels score high; without any, a half.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bookpulse.llm.common import map_text, slices

BUCKETS, SAMPLE, TERMS, FEATURES, SKETCH, ALIKE = 1 << 22, 8_000, 2048, 4096, 4, 0.5
#: A feature stands in LEAST_ROWS rows at least, and in one of 500. Chosen by fits to one half of the rows outside the held-out third, judged on the other half.
CHI, LEAST_ROWS, FACTORS, STEPS, BATCH, RATE, DECAY, SEED = 40.0, 4, 4, 1500, 256, 0.5, 1e-6, 7
PREFIXES = range(3, 7)

# Lower-case ASCII letters and everything beyond ASCII are letters; the rest separates.
_LETTERS = bytes(b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def _bucket(term: bytes) -> int:
    return xxhash.xxh32_intdigest(term) % BUCKETS


class Terms:
    """Hashed terms of texts; keeps those of words met up to a bound."""

    def __init__(self, bound: int = 200_000):
        self.known: dict[bytes, tuple[int, ...]] = {}
        self.bound = bound

    def of_word(self, word: bytes) -> tuple[int, ...]:
        text = word.decode("utf-8", "ignore")
        # A prefix's hash is told from a word's by a mark that no word holds.
        found = (_bucket(word), *(_bucket(text[:n].encode() + b"*") for n in PREFIXES if len(text) > n))
        if len(self.known) < self.bound:
            self.known[word] = found
        return found

    def of_text(self, text: str | None) -> set[int]:
        words = set((text or "").lower().encode("utf-8", "surrogatepass").translate(_LETTERS).split())
        known, of_word = self.known, self.of_word
        return set().union(*(known.get(w) or of_word(w) for w in words))


@dataclass
class Machine:
    """buckets: the feature of each used bucket (sorted), with bias, weights and factors."""

    buckets: np.ndarray
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def raw(self, rows: list[np.ndarray]) -> np.ndarray:
        """Scores before the logistic function; rows hold feature numbers."""
        sizes = np.array([len(r) for r in rows])
        flat = np.concatenate([np.zeros(0, np.int64), *rows]).astype(np.int64)
        at = np.repeat(np.arange(len(rows)), sizes)
        out = np.full(len(rows), self.bias) + np.bincount(at, self.weights[flat], len(rows))
        for v in self.factors.T:
            x = v[flat]
            out += 0.5 * (np.bincount(at, x, len(rows)) ** 2 - np.bincount(at, x * x, len(rows)))
        return out

    def scores(self, terms: list[set]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw([self.features(t) for t in terms]), -30, 30)))

    def features(self, terms: set) -> np.ndarray:
        found = np.intersect1d(np.fromiter(terms, np.int64, len(terms)), self.buckets)
        return np.searchsorted(self.buckets, found)


def select(rows: list[np.ndarray], labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature buckets, sorted, and the least weight of each.

    First the buckets met more in rows of label 1 than chance has it (largest chi-square first, ties by bucket; least
    weight 0), then, while there is room, those of ``pair_terms`` (no least weight).
    """
    flat = np.concatenate(rows)
    sizes = [len(r) for r in rows]
    y = np.repeat(labels, sizes)
    buckets, where = np.unique(flat, return_inverse=True)
    n, k = np.bincount(where), np.bincount(where, y)
    rate = labels.mean()
    chi = (k - n * rate) ** 2 / (n * rate * (1 - rate))
    often = (n >= LEAST_ROWS) & (500 * n >= len(rows))
    ok = np.flatnonzero((k > n * rate) & often & (chi >= CHI))
    best = ok[np.lexsort((buckets[ok], -chi[ok]))][:FEATURES]
    # A pair with all its k rows of label 1 has G = 2k log(1 / rate) against the overall rate; each of its terms needs as many.
    able = np.flatnonzero(often & (k >= 1) & (2 * k * np.log(1 / rate) >= CHI))
    at = np.full(len(buckets), -1)
    at[able] = np.arange(len(able))
    inside = at[where] >= 0
    strength = pair_terms(np.repeat(np.arange(len(rows)), sizes)[inside], at[where][inside], labels, len(able))
    strength[np.isin(able, best)] = 0
    more = np.flatnonzero(strength > 0)
    more = able[more[np.lexsort((buckets[able[more]], -strength[more]))]][: FEATURES - len(best)]
    chosen = np.concatenate([best, more])
    order = np.argsort(buckets[chosen])
    return buckets[chosen][order], np.where(np.arange(len(chosen)) < len(best), 0.0, -np.inf)[order]


def pair_terms(row: np.ndarray, term: np.ndarray, labels: np.ndarray, n_terms: int, block: int = 256) -> np.ndarray:
    """For each term the largest G of a pair that it is in, or 0 without a pair whose G is large enough.

    A pair counts if its rows have label 1 more often than those of either term; G is the likelihood ratio against the
    larger of the two rates. All pairs are counted, a block of terms at a time. So many pairs are tested that CHI alone
    lets chance in: G must pass it by 2 log of their number, which makes it as rare over all pairs as CHI is for one.
    """
    enough = CHI + 2 * np.log(max(1, n_terms * (n_terms - 1) / 2))
    out = np.zeros(n_terms)
    order = np.argsort(-labels, kind="stable")  # label 1 first
    ones, place = int(labels.sum()), np.empty(len(labels), np.int64)
    place[order] = np.arange(len(labels))
    held = np.zeros((len(labels), n_terms), np.uint8)
    held[place[row], term] = 1
    n, k = held.sum(0, dtype=np.int64), held[:ones].sum(0, dtype=np.int64)
    rate = (k / np.maximum(n, 1)).astype(np.float32)
    cuts = [*range(0, ones, 1024), *range(ones, len(labels), 1024), len(labels)]
    for i in range(0, n_terms, block):
        j = min(i + block, n_terms)
        both = [np.zeros((j - i, n_terms - i), np.float32) for _ in range(2)]  # in rows of label 1, in the others
        for a, b in zip(cuts, cuts[1:]):
            x = held[a:b, i:].astype(np.float32)
            both[int(a >= ones)] += x[:, : j - i].T @ x
        top = np.maximum(rate[i:j, None], rate[None, i:])
        s, t = np.nonzero((both[0] > top * (both[0] + both[1])) & (-2 * both[0] * np.log(np.maximum(top, 1e-9)) >= CHI))
        kp, np_, r = both[0][s, t].astype(float), (both[0] + both[1])[s, t].astype(float), top[s, t].astype(float)
        miss = np_ - kp
        g = 2 * (kp * np.log(kp / np_ / r) + miss * np.log(np.maximum(miss, 1e-9) / np_ / (1 - r)))
        g[(g < enough) | (np_ < LEAST_ROWS) | (500 * np_ < len(labels))] = 0
        np.maximum.at(out, i + s, g)
        np.maximum.at(out, i + t, g)
    return out


def first_copies(rows: list[np.ndarray], labels: np.ndarray) -> list[int]:
    """Rows without those that are near copies of an earlier one of their label."""
    seen: dict[tuple, list[int]] = {}
    for i, (r, y) in enumerate(zip(rows, labels.tolist())):
        like = seen.setdefault((y, *r[:SKETCH].tolist()), [])
        shared = (len(np.intersect1d(r, rows[j], assume_unique=True)) for j in like)
        if not any(n >= ALIKE * (len(r) + len(rows[j]) - n) for n, j in zip(shared, like)):
            like.append(i)
    return sorted(i for like in seen.values() for i in like)


def fit(rows: list[np.ndarray], labels: np.ndarray) -> Machine:
    """Fit to rows of distinct term hashes (sorted) and their 0/1 labels."""
    once = first_copies(rows, labels)
    rows, labels = [rows[i] for i in once], labels[once]
    if not len(labels) or labels.min() == labels.max():
        ones = int(labels.sum())
        return Machine(np.zeros(0, np.int64), float(np.log((ones + 1) / (len(labels) - ones + 1))), np.zeros(0), np.zeros((0, FACTORS)))
    buckets, least = select(rows, labels)
    x = [np.searchsorted(buckets, np.intersect1d(r, buckets)) for r in rows]
    random = np.random.default_rng(SEED)
    m = Machine(buckets, float(np.log(labels.mean() / (1 - labels.mean()))), np.zeros(len(buckets)), random.normal(0, 0.01, (len(buckets), FACTORS)))
    seen_w, seen_v = np.full(len(buckets), 1e-8), np.full(m.factors.shape, 1e-8)
    for _ in range(-(-STEPS // max(1, len(x) // BATCH))):  # as many steps for small samples as for large ones
        for part in np.array_split(random.permutation(len(x)), max(1, len(x) // BATCH)):
            batch = [x[i] for i in part]
            p = 1 / (1 + np.exp(-np.clip(m.raw(batch), -30, 30)))
            g = (p - labels[part]) / len(part)
            sizes = np.array([len(r) for r in batch])
            flat, at = np.concatenate([np.zeros(0, np.int64), *batch]).astype(np.int64), np.repeat(np.arange(len(batch)), sizes)
            gw = np.bincount(flat, g[at], len(buckets)) + DECAY * m.weights
            seen_w += gw**2
            gv = np.empty_like(m.factors)
            for k, v in enumerate(m.factors.T):
                s = np.bincount(at, v[flat], len(batch))
                gv[:, k] = np.bincount(flat, g[at] * (s[at] - v[flat]), len(buckets)) + DECAY * v
            seen_v += gv**2
            m.weights = np.maximum(m.weights - RATE * gw / np.sqrt(seen_w), least)  # what is selected alone is evidence for label 1, never against it
            m.factors -= RATE * gv / np.sqrt(seen_v)
    return m


_ROW = T.StructType([T.StructField("label", T.IntegerType()), T.StructField("terms", T.ArrayType(T.IntegerType(), False), False)])


def sample(labels: DataFrame, doc_id: str = "doc_id", label: str = "label") -> DataFrame:
    """At most SAMPLE labelled rows, those whose doc_id has the smallest hash: the same on every run.

    Where there are many, only hashes below a bound that twice as many rows are expected to pass come to the selection, so
    that it doesn't grow with the number of tasks.
    """
    rows = labels.where(F.col(label).isNotNull())
    share = 2 * SAMPLE / max(1, rows.count())
    if share < 1:
        rows = rows.where(F.xxhash64(doc_id) < int(-(1 << 63) + share * (1 << 64)))
    return rows.orderBy(F.xxhash64(doc_id), doc_id, label).limit(SAMPLE)


def train(labelled: DataFrame, text: str = "text", label: str = "label") -> Machine:
    """Fit on labelled texts: a ``sample`` with its texts. Of more than SAMPLE rows (doc_ids repeated) those of smallest hash count."""
    chosen = labelled.where(F.col(label).isNotNull()).select(F.col(label).cast("int").alias("label"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms()
        for whole in batches:
            for b in slices(whole, 1):
                # (hashes only: bounded by SAMPLE and TERMS)
                found = [sorted(terms.of_text(t))[:TERMS] for t in b.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.int32()))], names=_ROW.fieldNames())

    got = chosen.mapInArrow(run, _ROW).orderBy(F.xxhash64("terms"), "label", "terms").limit(SAMPLE).toArrow()
    lists = got.column("terms").combine_chunks()
    flat, at = (np.zeros(0, np.int64), [0]) if not got.num_rows else (lists.values.to_numpy(), lists.offsets.to_pylist())
    return fit([flat[i:j].astype(np.int64) for i, j in zip(at, at[1:])], np.array(got.column("label").to_pylist(), np.int64))


def score(docs: DataFrame, machine: Machine, text: str = "text", into: str = "score") -> DataFrame:
    """Add the score of each whole text, 0 to 1; other columns pass through."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)  # at most FEATURES rows of 1 + FACTORS numbers

    def make():
        terms, m = Terms(), shared.value
        used = set(m.buckets.tolist())
        return lambda texts: [pa.array(m.scores([terms.of_text(t) & used for t in texts]), pa.float64())]

    return map_text(docs, text, T.StructType([T.StructField(into, T.DoubleType(), False)]), make)
