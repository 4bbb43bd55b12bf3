"""Fill-in-the-middle: texts cut at two unit boundaries and put in the order prefix-suffix-middle or suffix-prefix-middle.

A unit is a run of ASCII letters or any other single character. A text isn't tokenized into units: it is stored as
maximal runs of one character class (letters or the rest) with the units before each run. A cut after u units is found
by a binary search for the run that contains it; its offset is the run's start plus the units left over, as a letter
run has one unit and in any other run units are characters.

Draws come from the hex SHA-256 of ``seed:id`` and so are the same wherever and whenever a row is read. A null text is
an empty one, a null id the empty string; texts without a character and texts that hold a sentinel stay plain. Each row
is transformed by itself, whatever its length: repeated rows, ties and skewed keys change nothing, nothing is shuffled.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bookpulse.llm.common import map_text

#: Marks before prefix, suffix and middle; of 100 texts so many stay plain, and of 100 others so many start with the suffix.
SENTINELS, PLAIN, SPM = ("<P>", "<S>", "<M>"), 10, 20

_NEW = T.StructType(
    [
        T.StructField("fim_units", T.LongType(), False), T.StructField("fim_form", T.StringType(), False), T.StructField("fim_prefix_chars", T.LongType()),
        T.StructField("fim_middle_chars", T.LongType()), T.StructField("fim_output", T.StringType(), False),
    ]
)


class Runs(NamedTuple):
    """Class runs of a text: each one's first character, the units before it, and both totals at the end."""

    starts: np.ndarray
    units: np.ndarray

    def cut(self, units: int) -> int:
        """Characters in the first ``units`` units."""
        run = int(np.searchsorted(self.units, units, side="right")) - 1
        return int(self.starts[run] + units - self.units[run])


def runs(text: str) -> Runs:
    codes = np.frombuffer(text.encode("ascii"), np.uint8) if text.isascii() else np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    lower = codes | 32
    letter = (lower >= 97) & (lower <= 122)
    starts = np.concatenate([np.zeros(min(1, len(codes)), np.int64), np.flatnonzero(letter[1:] != letter[:-1]) + 1, [len(codes)]])
    units = np.where(letter[starts[:-1]], 1, np.diff(starts))
    return Runs(starts, np.concatenate([[0], np.cumsum(units)]))


def arrange(text: str, draws: tuple[int, int, int, int], sentinels: tuple[str, str, str] = SENTINELS, plain: int = PLAIN, spm: int = SPM) -> tuple:
    """Units, form, characters of prefix and middle, and the output of one text."""
    r = runs(text)
    n = int(r.units[-1])
    if not text or draws[2] % 100 >= 100 - plain or any(s in text for s in sentinels):
        return n, "plain", None, None, text
    i, j = sorted(r.cut(d % (n + 1)) for d in draws[:2])
    p, s, m = sentinels
    if draws[3] % 100 < spm:
        return n, "spm", i, j - i, f"{s}{text[j:]}{p}{text[:i]}{m}{text[i:j]}"
    return n, "psm", i, j - i, f"{p}{text[:i]}{s}{text[j:]}{m}{text[i:j]}"


def draws(key: Column, seed: int = 1) -> list[Column]:
    """The first four groups of eight digits of the hex SHA-256 of ``seed:key``, as longs."""
    digits = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digits, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def _check(sentinels: tuple[str, str, str]) -> None:
    """Sentinels that could be read across a boundary would make texts that can't be taken apart again."""
    overlap = any(a[-k:] == b[:k] for a in sentinels for b in sentinels for k in range(1, min(len(a), len(b)) + (a != b)))
    if not all(sentinels) or len(set(sentinels)) < 3 or overlap or any(a in b for a in sentinels for b in sentinels if a != b):
        raise ValueError("the three sentinels have to differ, and none may begin or lie where another ends")


def transform(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 1, sentinels: tuple[str, str, str] = SENTINELS, plain: int = PLAIN, spm: int = SPM) -> DataFrame:
    """Add fim_units, fim_form (plain, psm, spm), fim_prefix_chars and fim_middle_chars (null if plain), fim_output."""
    _check(sentinels)

    def make():
        def f(rows: pa.StructArray) -> list[pa.Array]:
            texts, drawn = rows.field(0).to_pylist(), zip(*(rows.field(k).to_pylist() for k in range(1, 5)))
            made = [arrange(t or "", d, sentinels, plain, spm) for t, d in zip(texts, drawn)]
            columns = zip(*made) if made else [[]] * 5
            return [pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()))]

        return f

    # (the column of texts and draws has the name of a new one, which takes its place)
    held = docs.withColumn("fim_output", F.struct(F.col(text).alias("t"), *(d.alias(f"h{k}") for k, d in enumerate(draws(F.col(key), seed), 1))))
    return map_text(held, "fim_output", _NEW, make, raw=True)


def restore(output: str = "fim_output", form: str = "fim_form", sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that an output was made from, by built-in functions."""
    p, s, m = sentinels
    head, middle = F.substring_index(output, m, 1), F.substring_index(output, m, -1)
    after = lambda c, mark: c.substr(F.lit(len(mark) + 1), F.char_length(c))
    psm = F.concat(after(F.substring_index(head, s, 1), p), middle, F.substring_index(head, s, -1))
    spm = F.concat(F.substring_index(head, p, -1), middle, after(F.substring_index(head, p, 1), s))
    return F.when(F.col(form) == "psm", psm).when(F.col(form) == "spm", spm).otherwise(F.col(output))
