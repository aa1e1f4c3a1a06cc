"""Bring every raw source to one mail schema and union them."""

from __future__ import annotations

from functools import reduce
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailsift.functions import fixed_values as V
from mailsift.functions.patterns import trim_space, with_computed
from mailsift.sources.json_tree import json_tree_text


def recode(code: Column, mapping: dict) -> Column:
    """Dictionary lookup; a code outside the dictionary becomes NULL."""
    return F.element_at(F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in mapping.items())), code)


def compose_mail(subject: Column, body: Column) -> Column:
    """Subject, blank line, body, trimmed; the body alone where there is no subject."""
    subject, body = F.coalesce(subject, F.lit("")), F.coalesce(body, F.lit(""))
    return trim_space(F.when(subject != "", F.concat(subject, F.lit("\n\n"), body)).otherwise(body))


def _unified(df: DataFrame, source: str, text: Column, label: Column, included: Column,
             subcategory: Column | None = None) -> DataFrame:
    return df.select(
        "message_no",
        F.lit(V.SOURCE_ORDER.index(source)).alias("source_rank"),
        text.alias("text"),
        label.alias("label"),
        F.lit(source).alias("source_dataset"),
        (F.lit(None) if subcategory is None else subcategory).cast("string").alias("subcategory"),
        included.alias("included_in_training"),
    )


def conform_spam_corpus(df: DataFrame, json_trees: bool = True) -> DataFrame:
    """Columns text, label (0 spam, 1 ham). Spam is kept for reference but not for training."""
    text = json_tree_text(F.col("text")) if json_trees else F.col("text")
    code = F.col("label").cast("int")
    return _unified(df, V.SPAM_CORPUS, text, recode(code, V.SPAM_CODE_LABELS), recode(code, V.SPAM_CODE_INCLUDED))


def conform_mailbox(df: DataFrame) -> DataFrame:
    """Columns subject, body of phishing mail; messages without any text are skipped."""
    mails = with_computed(df, "_mail", compose_mail(F.col("subject"), F.col("body"))).filter(F.col("_mail") != "")
    return _unified(mails, V.PHISHING_MBOX, F.col("_mail"), F.lit(V.PHISHING), F.lit(True))


def conform_general_corpus(df: DataFrame) -> DataFrame:
    """Columns Email Text, Email Type; rows without text are dropped."""
    present = df.na.drop(subset=["Email Text"])
    return _unified(present, V.GENERAL_CORPUS, F.col("Email Text"),
                    recode(F.col("Email Type"), V.EMAIL_TYPE_LABELS), F.lit(True))


def conform_synthetic(df: DataFrame) -> DataFrame:
    """Columns email_type, subcategory, subject, body; never trimmed."""
    text = F.concat(F.coalesce("subject", F.lit("")), F.lit("\n\n"), F.coalesce("body", F.lit("")))
    return _unified(df, V.SYNTHETIC_HEALTHCARE, text, recode(F.col("email_type"), V.EMAIL_TYPE_LABELS),
                    F.lit(True), F.col("subcategory"))


def merge_sources(*parts: DataFrame) -> DataFrame:
    """Union of the conformed sources with one row id over all of them.

    Numbers stay numbers (message_no * sources + rank); ids from files are strings and get the
    rank in front, so in both cases ids are unique and sort like the source within one source.
    """
    merged = reduce(DataFrame.unionByName, parts)
    if dict(merged.dtypes)["message_no"] == "string":
        row_id = F.concat_ws("#", F.col("source_rank").cast("string"), "message_no")
    else:
        row_id = F.col("message_no") * len(V.SOURCE_ORDER) + F.col("source_rank")
    return merged.select(row_id.alias("row_id"), "source_rank", *V.MAIL_COLUMNS)
