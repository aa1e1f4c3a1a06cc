"""Tokens and 1-2-grams of a text column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailsift.functions.patterns import WORD_CHAR

TOKEN = rf"[{WORD_CHAR}]{{2,}}+"


def tokens(text: Column) -> Column:
    """Lower-case runs of at least two word characters."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def with_pairs(df: DataFrame, words: str = "_tokens", out: str = "pairs") -> DataFrame:
    """Append the pairs (first, second) of adjacent tokens."""
    n = F.greatest(F.size(words) - 1, F.lit(0))
    return df.withColumn(out, F.zip_with(
        F.slice(words, 1, n), F.slice(words, 2, n), lambda a, b: F.struct(a.alias("first"), b.alias("second"))
    ))


def pair_term(first: Column, second: Column) -> Column:
    return F.concat_ws(" ", first, second)


def with_tokens(df: DataFrame, text: str = "text") -> DataFrame:
    return df.withColumn("_tokens", tokens(F.coalesce(F.col(text), F.lit(""))))


def with_terms(df: DataFrame, text: str = "text", out: str = "terms") -> DataFrame:
    """Append tokens followed by the bigrams of adjacent tokens, joined by a blank."""
    paired = with_pairs(with_tokens(df, text))
    bigrams = F.transform("pairs", lambda p: pair_term(p.first, p.second))
    return paired.withColumn(out, F.concat("_tokens", bigrams)).drop("_tokens", "pairs")
