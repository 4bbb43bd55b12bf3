"""The corpus pipeline: five stages, each applying one training-data operator to all that the stage before kept.

1. quality: rows that the current policy of the quality rules rejects go
2. near_dedup: of each group of SimHash near duplicates the row with the smallest doc_id stays, then the smallest text
3. decontaminate: documents that the benchmark contaminates go
4. secrets: found secrets are replaced in the text, n_chars follows; no document goes
5. encode: BPE ids of each text, decoded again; gives their number and digests

Rows are told apart by their texts, not by doc_id: rows that share a doc_id, or have none, stay or go each by its own
group. A null doc_id comes after all others. All but the last stage return the columns of their input with its values,
whatever the columns' names: operators see them renamed by place, so that none of their own columns clashes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bookpulse.llm import decontaminate, quality, queries, secrets, simhash, trie_codec
from bookpulse.llm.common import discard, materialize, sealed, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    plain, name, back = sealed(docs)
    return quality.apply_policy(quality.ledger(plain, text=name["text"])).where("kept").select(back)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    plain, name, back = sealed(docs)
    doc_id, text = name["doc_id"], name["text"]
    first = F.col("doc_id").eqNullSafe(F.col("component_id"))
    stay = simhash.classes(docs, component="group").where(first).select(F.col("doc_id").alias("stays"), F.col("fp").alias("fp_stays"), "group").distinct()
    marked = simhash.fingerprints(plain, text=text, into="fp")
    found = marked.join(stay, F.col(doc_id).eqNullSafe(F.col("stays")) & (F.col("fp") == F.col("fp_stays")))
    # (several rows of a group are left only where they share its smallest doc_id; minima are combined before the shuffle)
    ordered = [n for n in plain.columns if n not in (doc_id, text) and isinstance(plain.schema[n].dataType, T.AtomicType)]
    others = [n for n in plain.columns if n not in (doc_id, text, *ordered)]  # maps and the like have no order
    row = F.struct(doc_id, text, *ordered)
    least = found.groupBy("group").agg(F.min(row).alias("row"), *([F.min_by(F.struct(*others), row).alias("others")] if others else []))
    return least.select("row.*", *(["others.*"] if others else [])).select(back)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    plain, name, back = sealed(docs)
    found = decontaminate.find(plain, table(spark, sf_dir, "benchmark"), text=name["text"])
    return found.where(~decontaminate.contaminated()).select(back)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    plain, name, back = sealed(docs)
    words = secrets.dictionary(plain, text=name["text"])
    scanned = secrets.scan(plain, secrets.train(words=words), text=name["text"], path=name.get("source"))
    new = {"text": F.col("redacted").alias("text")}
    if "n_chars" in name:
        new["n_chars"] = F.char_length("redacted").cast(docs.schema["n_chars"].dataType).alias("n_chars")
    return scanned.select([new.get(c, b) for c, b in zip(docs.columns, back)])


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    path = queries.tokenizer_path("byte_bpe_50k.json")
    return queries.digests(trie_codec.recode(docs.select("doc_id", "text"), path))


STAGES = [("quality", keep_quality), ("near_dedup", near_dedup), ("decontaminate", drop_contaminated), ("secrets", redact_secrets), ("encode", encode)]

#: Fingerprints, forests and tokenizers aren't SQL's: tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over ``documents``; each stage's output is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES[:-1]):
        kept = materialize(stage(spark, docs, sf_dir))
        if i:
            discard(docs)  # the stage before wrote it for this one
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
