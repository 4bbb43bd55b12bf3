"""The queries of the training-data operators: thin wrappers that derive the contracted columns from operator outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bookpulse.llm import centroids, dac, decontaminate, fim, jaccard, pii, q_quality, q_sql, secrets, simhash, token_counts, toxicity, trie_codec, warc
from bookpulse.llm.common import shared_dir, table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the ids of ``documents`` as directly addressable codes, read the files back, sum them up per document."""
    path = tokenizer_path("word_bpe_49k.json")
    manifest = dac.write(table(spark, sf_dir, "documents"), shared_dir(spark), lambda: dac.word_encoder(path).encode, end_id=1)
    return dac.read(spark, manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op4_trie_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode ``documents`` through the prefix trie, decode the ids, and give digests of both."""
    path = tokenizer_path("byte_bpe_50k.json")
    return digests(trie_codec.recode(table(spark, sf_dir, "documents").select("doc_id", "text"), path))


def digests(coded: DataFrame) -> DataFrame:
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each document by the compiled transducer, and whether they exceed 2048."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = token_counts.token_counts(docs, tokenizer_path("word_bpe_49k.json"))
    return counted.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"))


def op2_fm_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document that lie in benchmark windows, the items, and the contamination verdict."""
    found = decontaminate.find(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        decontaminate.hit_words().alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(F.col("items").cast("array<string>")), ",").cast("binary"), 256).alias("items_sha256"),
        decontaminate.contaminated().alias("contaminated"),
    )


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write ``pages`` as WARC records with revisits, salvage-read the archives, give what the records say.

    A gap in the archives fails the query: no page is lost in silence.
    """
    manifest = warc.write(warc.plan_revisits(table(spark, sf_dir, "pages")), shared_dir(spark))
    head = lambda name: F.element_at("headers", name)
    lost = F.raise_error(F.concat(F.lit("quarantined: "), "path", F.lit(" at "), F.col("offset").cast("string"), F.lit(", "), "reason"))
    return warc.read(spark, manifest, payloads=False).where(F.when(F.col("kind") == "record", True).otherwise(lost.cast("boolean"))).select(
        F.expr("try_cast(headers['x-page-id'] as long)").alias("page_id"),
        head("x-payload-length").cast("long").alias("payload_bytes"),
        F.substring_index(head("warc-payload-digest"), ":", -1).alias("payload_digest"),
        head("warc-type").alias("record_type"),
        head("x-refers-to-page-id").cast("long").alias("refers_to"),
    )


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates and found secrets of each document; the digest of its redacted text (null text: null)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    found = secrets.scan(docs, secrets.train(words=secrets.dictionary(docs)))
    return found.select(
        "doc_id",
        F.size("secret_candidates").cast("long").alias("n_candidates"),
        F.size("secrets").cast("long").alias("n_secrets"),
        F.array_join(F.transform("secrets", lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",").alias("spans"),
        F.sha2(F.col("redacted").cast("binary"), 256).alias("redacted_sha256"),
    )


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of each document by a machine fitted to labelled rows outside the held-out third."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    chosen = labels.where(F.col("toxic").isNotNull() & ~held_out).select("doc_id", F.col("toxic").alias("label"))
    machine = toxicity.train(docs.join(F.broadcast(toxicity.sample(chosen)), "doc_id"))  # SAMPLE rows at most
    scored = toxicity.score(docs, machine)
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))


def op7_simhash_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of each document."""
    return simhash.classes(table(spark, sf_dir, "documents")).select("doc_id", simhash.hex_digits().alias("fingerprint"), "component_id")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of each document: counts and digest of the base spans; all spans, the added ones included."""
    found = pii.find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id",
        *(pii.count("base_spans", k).alias(f"n_{k}") for k in pii.KINDS),
        F.sha2(pii.joined("base_spans").cast("binary"), 256).alias("base_sha256"),
        pii.joined("pii_spans").alias("spans"),
        F.size("pii_spans").cast("long").alias("n_spans"),
    )


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cut and rearrange each document; digests of the output and of the text restored from it."""
    made = fim.transform(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return made.select(
        "doc_id",
        F.col("fim_units").alias("n"),
        F.col("fim_form").alias("form"),
        F.col("fim_prefix_chars").alias("prefix_chars"),
        F.col("fim_middle_chars").alias("middle_chars"),
        F.sha2(F.col("fim_output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(fim.restore().cast("binary"), 256).alias("restored_sha256"),
    )


def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster and squared distance of each vector, inertias, digest of its centroid."""
    return centroids.cluster(table(spark, sf_dir, "embeddings")).drop("n_exact")


def op13_jaccard_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of each document's set of shingles and its component of Jaccard links."""
    return jaccard.classes(table(spark, sf_dir, "documents"))


def pii_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base columns of ``op10_pii``, which SQL can express."""
    return op10_pii(spark, sf_dir).drop("spans", "n_spans")


QUERIES = {
    f.__name__: f
    for f in (
        op1_token_files, op2_fm_decontamination, op3_warc, op4_trie_codec, op5_secret_scan, op6_toxicity, op7_simhash_classes, op8_token_counts, q_quality.op9_quality_rules, op10_pii,
        op11_fill_in_middle, op12_centroid_clusters, op13_jaccard_classes,
        q_quality.quality_ablation, pii_base,
    )
}

#: DuckDB SQL of the queries that SQL can express.
ORACLES: dict[str, str] = {"op2_fm_decontamination": q_sql.DECONTAMINATION, "op3_warc": q_sql.WARC, "op9_quality_rules": q_quality.ORACLE, "quality_ablation": q_sql.ABLATION, "pii_base": q_sql.PII_BASE, "op11_fill_in_middle": q_sql.FILL_IN_MIDDLE, "op12_centroid_clusters": q_sql.CENTROIDS, "op13_jaccard_classes": q_sql.JACCARD}
