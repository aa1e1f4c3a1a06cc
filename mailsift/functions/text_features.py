"""Lexicon and structural features of a text column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailsift.functions import fixed_values as V
from mailsift.functions.patterns import SPACE, whole_phrases

URGENCY = whole_phrases(V.URGENCY_PHRASES)
HEALTHCARE = whole_phrases(V.HEALTHCARE_TERMS)

WORD = V.WORD.replace("[A-Za-z0-9]+", r"\p{Alnum}++")

# A run of at least two letters between white space, none lower or title case, one upper case.
# The first three guards are ASCII table lookups and reject most positions.
SHOUTED = (
    r"(?<!\p{Graph})(?=\p{Upper}|\P{ASCII})(?!\p{Upper}\p{Lower})"
    rf"(?<![^{SPACE}])(?=[\p{{L}}]*\p{{IsUppercase}})"
    rf"[\p{{L}}&&[^\p{{IsLowercase}}\p{{Lt}}]]{{2,}}+(?![^{SPACE}])"
)


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def urgency_matches(text: Column) -> Column:
    return F.regexp_count(text, F.lit(URGENCY))


def healthcare_term_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(HEALTHCARE))


def exclamation_count(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("!"), F.lit("")))


def capitalized_word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(SHOUTED))


def with_text_features(df: DataFrame, text: str = "text") -> DataFrame:
    """Append the six text features. The word list is extracted once per row and shared."""
    body = F.coalesce(F.col(text), F.lit(""))
    counted = df.withColumns(
        {
            "_words": words(body),
            "_urgent": urgency_matches(body),
            "healthcare_term_count": healthcare_term_count(body),
            "exclamation_count": exclamation_count(body),
            "capitalized_word_count": capitalized_word_count(body),
        }
    )
    totals = counted.withColumns(
        {"word_count": F.size("_words"), "_letters": F.length(F.array_join("_words", ""))}
    )

    def per_word(value: Column) -> Column:
        n = F.col("word_count")
        return F.when(n > 0, value / n).otherwise(F.lit(0.0))

    featured = totals.withColumns(
        {
            "urgency_score": per_word(F.col("_urgent")) * 100,
            "avg_word_length": per_word(F.col("_letters")),
        }
    )
    return featured.select(*df.columns, *V.TEXT_FEATURES)
