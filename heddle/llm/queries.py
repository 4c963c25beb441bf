"""Registered queries of the training-data operators; each applies its operator to the whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import centroids, embedding_dedup, hard_negatives, license_scan, packing, quality, sentencepieces, setsketch, suffix_dedup, surrogates, token_output, warc, wrappers
from ._common import reachable


def tokenizer(name: str) -> str:
    """Place of a public tokenizer's file; operators take such a path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reachable(spark).read.parquet(f"{sf_dir}/documents.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licenses in every document. Null and empty texts hold none; repeated rows come out as often as they stand."""
    return license_scan.license_scan(_docs(spark, sf_dir))


def op2_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Surrogates in every document; nulls, empty tables, repeats and long texts as in replace_entities, and other columns play no part."""
    return surrogates.surrogate_digest(_docs(spark, sf_dir))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text to piece ids and back; null is empty, repeated rows come out as often as they stand."""
    return sentencepieces.round_trip(_docs(spark, sf_dir), tokenizer("piece_bpe_32k.model"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of 200-byte strings that occur again, removed over all texts; null is empty, an empty table gives no row."""
    return suffix_dedup.remove_repeats(_docs(spark, sf_dir).select("doc_id", "text")).drop("text")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 1024 to 8192 tokens; null and empty texts are the end id alone, repeated rows are pieces of their own."""
    return packing.best_fit_documents(_docs(spark, sf_dir), tokenizer("word_bpe_49k.json"))


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of three-word shingles are alike by 85 % or more; null and wordless texts link with nothing, repeated ids are documents of their own."""
    return setsketch.near_duplicates(_docs(spark, sf_dir), k=3, percent=85)


def op7_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document written and read back in order of doc_id; null text is empty, as write_token_files says."""
    return token_output.token_output(_docs(spark, sf_dir), tokenizer("word_bpe_49k.json"), end_id=2)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and verdict of every document; null text has no words and fails."""
    return quality.quality_rules(_docs(spark, sf_dir))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page; null html is empty and gives an empty text."""
    return wrappers.extract(reachable(spark).read.parquet(f"{sf_dir}/pages.parquet"))


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors; nulls, repeats and empty tables as in embedding_duplicates."""
    return embedding_dedup.embedding_duplicates(reachable(spark).read.parquet(f"{sf_dir}/embeddings.parquet"))


def op11_warc_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page through monolithic archives, the normaliser and reads by offset; nulls, ties and repeats as in warc_round_trip."""
    return warc.warc_round_trip(reachable(spark).read.parquet(f"{sf_dir}/pages.parquet"))


def op12_four_russians_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of the rows whose id is divisible by 50; nulls, ties and repeats as in hard_negatives."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(reachable(spark).read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0, label)


def op13_simplex_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen clusters in three rounds; nulls, ties and repeats as in centroid_clusters."""
    return centroids.centroid_clusters(reachable(spark).read.parquet(f"{sf_dir}/embeddings.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_license_scan, op2_pii_surrogates, op3_sentencepiece, op4_suffix_dedup, op5_best_fit_packing, op6_minhash_near_dedup, op7_token_output, op8_quality_rules, op9_html_extraction, op10_embedding_near_dedup, op11_warc_normaliser, op12_four_russians_negatives, op13_simplex_clusters)}


def oracle_sql() -> dict[str, str]:
    return {"op1_license_scan": license_scan.oracle(), "op8_quality_rules": quality.ORACLE, "op11_warc_normaliser": warc.ORACLE, "op12_four_russians_negatives": hard_negatives.ORACLE, "op13_simplex_clusters": centroids.oracle()}
