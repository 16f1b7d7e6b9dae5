"""The registered queries of this subpackage: production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def vocabulary(name: str) -> str:
    """Where the public vocabulary file of that name lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from latticework.llm.license_scan import scan_licenses

    return scan_licenses(spark.read.parquet(f"{sf_dir}/pages.parquet"), "page_id", "url", "html")


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from latticework.llm.lm_scoring import score_corpus

    return score_corpus(documents(spark, sf_dir))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from latticework.llm.toxicity import score_held_out

    return score_held_out(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"), folds=5, fold=0)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from latticework.llm.token_counts import count_tokens

    return count_tokens(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"), limit=512)


def op5_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    from latticework.llm.imatch import fingerprint_edits

    return fingerprint_edits(documents(spark, sf_dir))


def op6_chroma(spark: SparkSession, sf_dir: str) -> DataFrame:
    from latticework.llm.chroma import search_recordings

    return search_recordings(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from latticework.llm.packing import pack_documents

    return pack_documents(documents(spark, sf_dir), vocabulary("word_bpe_49k.json"), capacity=4096, end_id=2)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from latticework.llm.language_id import identify_held_out

    return identify_held_out(documents(spark, sf_dir), folds=4, fold=2)


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from latticework.llm.jaccard_join import link_components

    return link_components(documents(spark, sf_dir), n=4, percent=85)


def op10_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    from latticework.llm.piece_codec import encode_digests

    return encode_digests(documents(spark, sf_dir), vocabulary("piece_bpe_32k.model"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_license_scan": op1_license_scan,
        "op2_lm_scoring": op2_lm_scoring,
        "op3_toxicity": op3_toxicity,
        "op4_token_counts": op4_token_counts,
        "op5_imatch": op5_imatch,
        "op6_chroma": op6_chroma,
        "op7_packing": op7_packing,
        "op8_language_id": op8_language_id,
        "op9_ngram_jaccard": op9_ngram_jaccard,
        "op10_piece_codec": op10_piece_codec,
    }


def oracle_sql() -> dict[str, str]:
    return {}
