"""The registered queries of the numbered operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumora.llm import lm, media, merkle, mixing, oracles, packing, pii, quality, shards, simhash, tokens, toxicity, url_trust, whiten
from lumora.session import load

URL_RULES = {
    "com/en/": "block",
    "example.com/en/7": "allow",
    "net/de/": "allow",
    "example.net/de/8": "block",
    "org/es/": "block",
}


def op1_url_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = url_trust.judge_urls(load(spark, sf_dir, "pages"), URL_RULES)
    return out.withColumnRenamed("id", "page_id").withColumns({c: F.round(c, 8) for c in ("trust", "distrust")})


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shards.shard_by_bytes(load(spark, sf_dir, "documents"), 24)
    return out.select(
        F.col("id").alias("doc_id"),
        "size",
        F.col("crc").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(load(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), simhash.hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = media.media_columns(load(spark, sf_dir, "documents"))
    size = F.octet_length("payload")
    return out.select(
        F.col("id").alias("doc_id"),
        "n_bytes",
        size.cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -32, 32)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.lower(F.hex("feature")).alias("feature"),
    )


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = quality.ledger(load(spark, sf_dir, "documents"))
    base = ~quality.verdict(F.col("failed"), "v1")
    return book.select(
        F.col("id").alias("doc_id"),
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        base.alias("base_failed"),
        (~base & quality.verdict(F.col("failed"), "v2")).alias("kept"),
        "failed",
    )


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rule of op5's policy: documents that it rejects, that it alone rejects, and that stay without it."""
    return quality.ablations(quality.ledger(load(spark, sf_dir, "documents")), "v2")


def op6_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.pseudonymise(load(spark, sf_dir, "documents"), key="query-key")
    return out.select("doc_id", "text", "n_entities")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = tokens.prefix_tables(load(spark, sf_dir, "documents"), tokenizer_path())
    return out.select(
        F.col("id").alias("doc_id"),
        "n_bytes",
        "n_tokens",
        (F.col("n_tokens") > 2048).alias("over_limit"),
        F.col("chars_within").alias("chars_in_limit"),
        "prefix_table",
    )


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.best_fit(load(spark, sf_dir, "documents"), tokenizer_path())
    return out.withColumnRenamed("id", "doc_id").drop("free")


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lm.score_documents(load(spark, sf_dir, "documents"))
    return out.select(
        F.col("id").alias("doc_id"), "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"
    )


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(load(spark, sf_dir, "documents"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return merkle.manifest(docs, merkle.tampered(docs)).withColumnRenamed("id", "doc_id")


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxic_documents(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten.whitened(load(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


QUERIES = {
    f.__name__: f
    for f in (
        op1_url_trust, op2_sharding, op3_simhash, op4_media, op5_quality, quality_ablations, op6_surrogates, op7_token_counts, op8_packing, op9_lm_scoring, op10_mixing, op11_merkle, op12_toxicity, op13_whitening
    )
}
ORACLES: dict[str, str] = {
    "op1_url_trust": oracles.url_sql(URL_RULES, url_trust.rounds_for(1e-4, 0.85)),
    "op5_quality": oracles.quality_sql(),
    "quality_ablations": oracles.ablations_sql({name: quality.mask((name,)) for name in quality.POLICIES["v2"]}),
    "op11_merkle": oracles.merkle_sql(merkle.FIELDS),
}
