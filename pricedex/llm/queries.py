"""The registered queries of the training-data operators: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricedex.llm.sql import ORACLE_SQL  # noqa: F401

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pricedex.llm.url_filter import Rule, judge

    rules = [
        Rule("allow", "org", "/"), Rule("block", "example.org", "/es/"), Rule("block", "example.org", "/en/1"),
        Rule("allow", "com", "/fr/"), Rule("block", "com", "/de/")
    ]
    return judge(table(spark, sf_dir, "pages"), rules).select("page_id", "host", "path", "rule", "verdict")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pricedex.llm.language_id import identify
    from pricedex.llm.sampling import crc_part

    found = identify(table(spark, sf_dir, "documents"), crc_part("doc_id", 3) != 1)
    return found.select("doc_id", (crc_part("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pricedex.llm.decontamination import leaks

    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), percent=75, size=5)


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pricedex.llm.similarity_join import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"), percent=75, size=5)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pricedex.llm.bpe import token_counts

    return token_counts(table(spark, sf_dir, "documents"), tokenizer_path(), limit=512)


def op6_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pricedex.llm.bpe import encode_decode, sha_digest

    return encode_decode(
        table(spark, sf_dir, "documents"), tokenizer_path(), sha_digest, "n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    )


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pricedex.llm.quality_rules import judge

    return judge(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pricedex.llm.pii import digest

    return digest(table(spark, sf_dir, "documents"))


def op9_quality_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pricedex.llm.quality_mil import score_quality
    from pricedex.llm.sampling import crc_part

    scored = score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), crc_part("doc_id", 3) != 1)
    return scored.select(
        "doc_id", (crc_part("doc_id", 3) == 1).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted")
    )


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pricedex.llm.sampling import crc_part
    from pricedex.llm.toxicity import score_toxicity

    scored = score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), crc_part("doc_id", 4) != 2)
    return scored.select(
        "doc_id", (crc_part("doc_id", 4) == 2).alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted")
    )


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pricedex.llm.conversation_trie import prefix_trie

    return prefix_trie(table(spark, sf_dir, "conversations"), family=20, most=4)


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pricedex.llm.license_scan import scan

    return scan(table(spark, sf_dir, "documents"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pricedex.llm.resampling import resample

    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), percent=5, least_words=20, seed=42)


QUERIES: dict[str, Query] = {
    f.__name__: f for f in (
        op1_url_filter, op2_language_id, op3_decontamination, op4_jaccard_join, op5_token_counts, op6_bpe_roundtrip, op7_quality_rules,
        op8_pii, op9_quality_mil, op10_toxicity, op11_conversation_trie, op12_license_scan, op13_importance_resampling
    )
}
