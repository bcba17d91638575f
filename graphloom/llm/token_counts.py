"""Exact token counts by the prefix programme of ``bpe.ByteCounter``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField

from .batches import map_text, without
from .bpe import ByteCounter

COUNTERS: dict[str, ByteCounter] = {}


def counter(path: str) -> ByteCounter:
    """The counter of a vocabulary file, made once in each Python worker."""
    if path not in COUNTERS:
        COUNTERS[path] = ByteCounter(path)
    return COUNTERS[path]


def token_counts(docs: DataFrame, vocabulary: str, text: str = "text", out: str = "n_tokens") -> DataFrame:
    """``docs`` and the tokens of each whole text; 0 for a null or empty one.

    Rows are neither dropped nor merged, and other columns pass through; a column
    named ``out`` is replaced.
    """
    return map_text(docs, text, [StructField(out, LongType(), False)], lambda texts: [[counter(vocabulary).count(t) for t in texts]])


def prefix_counts(docs: DataFrame, vocabulary: str, text: str = "text", out: str = "prefix_tokens") -> DataFrame:
    """``docs`` and an array of the tokens of each text cut after 0, 1, 2, ... code points.

    Entry i answers how many tokens the first i characters take; the array is as
    long as the text and one more.
    """
    return map_text(docs, text, [StructField(out, ArrayType(IntegerType(), False), False)], lambda texts: [[counter(vocabulary).prefix_counts(t) for t in texts]])


def fit(stored: DataFrame, budget: int | str, prefixes: str = "prefix_tokens", out: str = "truncated") -> DataFrame:
    """``stored`` and, by its arrays of prefix counts alone, the code points of the longest prefix within ``budget`` tokens, and whether that is the whole text.

    ``budget`` is a number or the name of a column with one.  No text is read, and a
    null array or budget gives nulls.
    """
    most = F.col(budget) if isinstance(budget, str) else F.lit(budget)
    at = F.when(most.isNotNull(), F.array_max(F.transform(prefixes, lambda x, i: F.when(x <= most, i).otherwise(-1))))
    kept = [c for c in stored.columns if c in without([c], [f"{out}_at", f"{out}_whole"])]
    return stored.select(*[F.col(f"`{c}`") for c in kept], at.alias(f"{out}_at"), (at == F.size(prefixes) - 1).alias(f"{out}_whole"))


def truncate(docs: DataFrame, vocabulary: str, budget: int, text: str = "text", out: str = "truncated") -> DataFrame:
    """``docs``, the code points of the longest prefix of each text within ``budget`` tokens, and whether that is the whole text.

    A null text counts as empty, whose prefix is whole; repeated rows stay.
    """
    return fit(prefix_counts(docs, vocabulary, text, "__prefixes"), budget, "__prefixes", out).drop("__prefixes")


def op2(docs: DataFrame, vocabulary: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit: of each document, a null text counted as empty."""
    sized = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    counted = token_counts(sized, vocabulary)
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
