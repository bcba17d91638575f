"""The queries of this subpackage, one for each operator, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

BYTE_VOCABULARY = "byte_bpe_50k.json"
PIECE_MODEL = "piece_bpe_32k.model"


def tokenizer_file(name: str) -> str:
    """The place of a public vocabulary file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sentencepiece_codec import op1

    return op1(table(spark, sf_dir, "documents"), tokenizer_file(PIECE_MODEL))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import op2

    return op2(table(spark, sf_dir, "documents"), tokenizer_file(BYTE_VOCABULARY))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import op3

    return op3(table(spark, sf_dir, "documents"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import op4

    return op4(table(spark, sf_dir, "pages"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import op5

    return op5(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filter import op6

    return op6(table(spark, sf_dir, "pages"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import op7

    return op7(table(spark, sf_dir, "documents"))


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .personal_data import op8

    return op8(table(spark, sf_dir, "documents"))


def op9_cross_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .cross_entropy import op9

    return op9(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import op10

    return op10(table(spark, sf_dir, "documents"))


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import op11

    return op11(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .vector_codes import op12

    return op12(table(spark, sf_dir, "embeddings"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .conversation_repair import op13

    return op13(table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_sentencepiece, op2_token_counts, op3_quality, op4_warc, op5_decontamination, op6_url_filter, op7_simhash, op8_personal_data, op9_cross_entropy, op10_line_dedup, op11_toxicity, op12_vector_codes, op13_conversation_repair)}


def oracle_sql() -> dict[str, str]:
    from . import oracles

    return oracles.SQL
