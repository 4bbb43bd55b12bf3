"""Quality rules as a bitmask ledger, in DataFrame functions only.

``ledger`` measures each text once and evaluates every rule once: it adds the measurements and ``fail_bits``, in which
bit k says that rule k fails. Policies are versioned masks over that ledger: ``apply_policy`` keeps a row exactly if
none of the policy's bits is set, and ``ablation`` counts by bitwise aggregation what each rule rejects, alone and
beside others, with no text read again.

Words are runs of characters other than space and U+0009 to U+000D. A null text is an empty one: no words, too short.
Everything happens inside a row, so repeated rows, ties and skewed keys change nothing and nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bookpulse.llm.common import sealed

_BLANK, _SYMBOL = r"[ \t-\r]+", r"[#*$%&|<>]"
_BLANKS = " \t\n\u000b\u000c\r"
#: Added columns besides fail_bits.
MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]

#: Bit, name and failing condition of each rule, over the measurements. Bits are never reused.
RULES: dict[str, tuple[int, str]] = {
    "few_words": (0, "n_words < 50"),
    "repeated_windows": (1, "100 * n_repeat_words > 50 * n_words"),
    "symbols": (2, "10 * n_symbols > n_words"),
    "short_words": (3, "word_chars < 2 * n_words"),
    "long_words": (4, "word_chars > 12 * n_words"),
    "repeated_lines": (5, "2 * n_dup_lines > n_lines"),
}


def mask(*rules: str) -> int:
    return sum(1 << RULES[r][0] for r in rules)


BASE = mask("few_words", "repeated_windows")
#: Policies by version; a version, once used, stays as it is.
POLICIES = {"base": BASE, "v1": BASE | mask("symbols", "short_words", "long_words"), "v2": BASE | mask("symbols", "short_words", "long_words", "repeated_lines")}
CURRENT = "v2"


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the measurements; a column of that name is replaced, any other passes through whatever its name.

    Windows found twice are found by sorting (hash, position) packed into 64-bit numbers; where two windows of equal
    hash differ, which the distinct texts of the found ones tell, the row is done over with the windows' own texts.
    """
    plain, names, _ = sealed(docs)
    back = {n: c for c, n in names.items() if c.lower() not in {*MEASURES, "fail_bits"}}
    keep = list(back)
    # Each step reads the columns of the one before; Catalyst doesn't inline what is dear and used more than once.
    step = plain.select(*keep, F.coalesce(F.col(names[text]), F.lit("")).alias("_text"))
    step = step.select(
        *keep, "_text",
        F.array_remove(F.split("_text", _BLANK), "").alias("_words"),
        F.filter(F.split("_text", "\n"), lambda line: F.ltrim(line, F.lit(_BLANKS)) != "").alias("_lines"),
    )
    step = step.select(
        *keep, "_text", "_words",
        F.size("_words").cast("long").alias("n_words"),
        F.char_length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        (F.size(F.split("_text", _SYMBOL)) - 1).cast("long").alias("n_symbols"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.expr("coalesce(cast(ceil(log2(size(_words) + 1)) as int), 0)").alias("_bits"),
    )
    step = step.select(
        *keep, "_words", *MEASURES[:5], "_bits",
        F.expr("sort_array(transform(slice(_words, 1, greatest(size(_words) - 2, 0)), (w, i) -> shiftleft(xxhash64(w, get(_words, i + 1), get(_words, i + 2)), _bits) | i))").alias("_packed"),
    )
    step = step.select(
        *keep, "_words", *MEASURES[:5], "_bits",
        F.expr("filter(_packed, (p, i) -> shiftright(p, _bits) = shiftright(get(_packed, i + 1), _bits) or (i > 0 and shiftright(p, _bits) = shiftright(get(_packed, i - 1), _bits)))").alias("_twice"),
    )
    step = step.select(
        *keep, "_words", *MEASURES[:5],
        F.expr("transform(_twice, p -> cast(p & (shiftleft(1L, _bits) - 1) as int))").alias("_at"),
        F.expr("size(array_distinct(transform(_twice, p -> shiftright(p, _bits))))").alias("_hashes"),
    )
    step = step.withColumn("_exact", F.expr("_hashes = size(array_distinct(transform(_at, i -> concat_ws(' ', _words[i], _words[i + 1], _words[i + 2]))))"))
    covered = "size(array_distinct(flatten(transform({}, i -> array(i, i + 1, i + 2)))))"
    named = "array_sort(transform(slice(_words, 1, greatest(size(_words) - 2, 0)), (w, i) -> struct(concat_ws(' ', w, _words[i + 1], _words[i + 2]) as w, i as i)))"
    slow = f"transform(array({named}), s -> transform(filter(s, (p, k) -> p.w = get(s, k + 1).w or (k > 0 and p.w = get(s, k - 1).w)), p -> p.i))[0]"
    repeats = F.expr(f"cast(case when _exact then {covered.format('_at')} else {covered.format(slow)} end as long)")
    # As a generator's output the measurements aren't recomputed by filters on them, which would be pushed below a projection.
    return step.select(*(F.col(n).alias(c) for n, c in back.items()), F.inline(F.array(F.struct(*MEASURES[:5], repeats.alias("n_repeat_words")))))


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add measurements and ``fail_bits`` (int)."""
    bits = " | ".join(f"cast(if({condition}, {1 << bit}, 0) as int)" for bit, condition in RULES.values())
    return measure(docs, text).withColumn("fail_bits", F.expr(bits))


def apply_policy(measured: DataFrame, version: str = CURRENT, into: str = "kept") -> DataFrame:
    """Add whether the policy keeps a row of the ledger."""
    return measured.withColumn(into, F.col("fail_bits").bitwiseAND(F.lit(POLICIES[version])) == 0)


def ablation(measured: DataFrame, version: str = CURRENT) -> DataFrame:
    """For each rule of a policy: rows that it rejects, and rows that only it rejects (kept if the rule were gone)."""
    chosen = F.col("fail_bits").bitwiseAND(F.lit(POLICIES[version]))
    # One row for each pattern of bits: at most two to the number of rules.
    patterns = measured.groupBy(chosen.alias("bits")).agg(F.count("*").alias("n"))
    rules = F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(1 << b).alias("bit")) for r, (b, _) in RULES.items() if POLICIES[version] >> b & 1))
    hit = F.col("bits").bitwiseAND(F.col("bit")) != 0
    return (
        patterns.select("bits", "n", F.inline(rules))
        .groupBy("rule")
        .agg(F.coalesce(F.sum(F.when(hit, F.col("n"))), F.lit(0)).alias("rejected"), F.coalesce(F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n"))), F.lit(0)).alias("rejected_alone"))
    )
