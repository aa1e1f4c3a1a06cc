"""Row-level cleaning of the mail table and its reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailsift.functions import cleaning as C
from mailsift.functions import fixed_values as V
from mailsift.functions.patterns import with_computed
from mailsift.workspace import sized

QUALITY_FLAGS = ["html_tags", "mime_leftover", "mojibake_hint", "replacement_char"]
# Row ids of later copies that are sent to all tasks, some 16 bytes each there.
SENT_COPIES = 1_000_000


def eligible(df: DataFrame) -> DataFrame:
    """Only rows meant for training; unknown eligibility counts as not eligible."""
    return df.filter(F.col("included_in_training"))


def eligibility_report(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count("*").alias("total_rows"),
        F.count_if(~F.coalesce("included_in_training", F.lit(False))).alias("excluded_rows"),
        F.count_if("included_in_training").alias("eligible_rows"),
    )


def without_blank(df: DataFrame) -> DataFrame:
    return df.filter(~C.is_blank_or_placeholder(F.col("text")))


def blank_report(df: DataFrame) -> DataFrame:
    """Removed rows for every source, 0 included."""
    return df.groupBy("source_dataset").agg(
        F.count("*").alias("rows"),
        F.count_if(C.is_blank_or_placeholder(F.col("text"))).alias("removed"),
    )


def first_copies(df: DataFrame) -> DataFrame:
    """One row per exact text: that of the earliest source, then the lowest row id.

    Texts stay where they are. Only 256-bit digests are written, once, and grouped, copies are combined before the shuffle,
    and the later copies of digests seen more than once are written and taken out by row id; up to ``SENT_COPIES``
    of them are broadcast, as otherwise texts would be shuffled for a few ids.
    """
    ids = sized(df.select("row_id", "source_rank", F.unhex(F.sha2("text", 256)).alias("digest")), "digests")
    order = F.struct("source_rank", "row_id")
    # Text is compared by digest here as in the report below; NULL is a text of its own.
    firsts = ids.groupBy("digest").agg(F.min(order).alias("first"), F.count("*").alias("n")).filter("n > 1")
    later = ids.join(firsts, ids.digest.eqNullSafe(firsts.digest)).filter(order != F.col("first")).select("row_id")
    copies = sized(later, "copies")
    if copies.count() <= SENT_COPIES:
        copies = F.broadcast(copies)
    return df.join(copies, "row_id", "left_anti").select(*df.columns)


def duplicate_report(df: DataFrame) -> DataFrame:
    """Per source: rows, removed copies, and those whose first copy is in another source.

    Counts are taken per (text digest, source) first, so at most one row per source and text
    reaches the second step.
    """
    per_source = df.groupBy(F.sha2("text", 256).alias("digest"), "source_rank", "source_dataset").agg(
        F.count("*").alias("n")
    )
    firsts = per_source.groupBy("digest").agg(
        F.min("source_rank").alias("first_rank"),
        F.collect_list(F.struct("source_rank", "source_dataset", "n")).alias("by_source"),
    )
    rows = firsts.select("first_rank", F.inline("by_source"))
    is_first = F.col("source_rank") == F.col("first_rank")
    return rows.groupBy("source_dataset").agg(
        F.sum("n").alias("rows"),
        F.sum(F.col("n") - is_first.cast("int")).alias("removed"),
        F.sum(F.when(is_first, 0).otherwise(F.col("n"))).alias("cross_source"),
    )


def quality_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows with each quality flag, per source, before and after cleaning."""
    return _flag_counts(before, "before").unionByName(_flag_counts(after, "after"))


def cleaning_report(df: DataFrame) -> DataFrame:
    """``quality_report`` of a table and its cleaned form from one pass: a row's flags are told before and after its text is cleaned."""
    names = {stage: [f"_{stage}_{name}" for name in QUALITY_FLAGS] for stage in ("before", "after")}

    def flagged(rows: DataFrame, stage: str) -> DataFrame:
        flags = C.quality_flags(F.col("text"))
        return rows.withColumns({column: flags[name] for column, name in zip(names[stage], QUALITY_FLAGS)})

    before = flagged(df.select("source_dataset", "text"), "before")
    after = flagged(C.with_clean_text(before), "after").withColumn("_kept", ~C.is_blank_or_placeholder(F.col("text")))
    counts = after.groupBy("source_dataset").agg(
        F.count_if("_kept").alias("_rows"), *[F.count_if(c).alias(c) for c in names["before"]],
        *[F.count_if(F.col(c) & F.col("_kept")).alias(c) for c in names["after"]])
    # A source that keeps no row after cleaning has none there.
    stages = [F.struct(F.lit(stage).alias("stage"), (F.lit(stage == "before") | (F.col("_rows") > 0)).alias("_there"), *[
        F.col(c).alias(name) for c, name in zip(columns, QUALITY_FLAGS)]) for stage, columns in names.items()]
    return counts.select("source_dataset", F.inline(F.array(*stages))).filter("_there").select("stage", "source_dataset", *QUALITY_FLAGS)


def _flag_counts(df: DataFrame, stage: str) -> DataFrame:
    flags = C.quality_flags(F.col("text"))
    return df.groupBy(F.lit(stage).alias("stage"), "source_dataset").agg(
        *[F.count_if(flags[name]).alias(name) for name in QUALITY_FLAGS]
    )


def clean(df: DataFrame) -> DataFrame:
    """Clean the text, then drop rows that became blank."""
    return without_blank(C.with_clean_text(df))


def with_non_email_tags(df: DataFrame, source: str = V.SPAM_CORPUS) -> DataFrame:
    """Append ``tags``: all matching non-mail classes of rows of one source, else an empty array."""
    # A condition, not a join or filter: rows of other sources never reach the patterns.
    tags = F.when(F.col("source_dataset") == source, C.non_email_tags(F.col("text")))
    return with_computed(df, "tags", F.coalesce(tags, F.array().cast("array<string>")))


def tagged_rows(df: DataFrame) -> DataFrame:
    """Rows that would be removed, with their classes joined by ";"."""
    tagged = with_non_email_tags(df.filter(F.col("source_dataset") == V.SPAM_CORPUS))
    return tagged.filter(F.size("tags") > 0).select(
        "row_id", "source_dataset", F.array_join("tags", ";").alias("matched"),
        F.element_at("tags", 1).alias("first_matched"),
    )


def without_non_email(df: DataFrame) -> DataFrame:
    return with_non_email_tags(df).filter(F.size("tags") == 0).drop("tags")


def tag_rate(df: DataFrame) -> DataFrame:
    """Share of tagged rows within the source; NULL for an empty source."""
    tagged = with_non_email_tags(df.filter(F.col("source_dataset") == V.SPAM_CORPUS))
    hit = F.size("tags") > 0
    return tagged.agg(
        F.count("*").alias("rows"),
        F.count_if(hit).alias("tagged"),
        (F.count_if(hit) / F.nullif(F.count("*"), F.lit(0))).alias("share"),
    )


def first_tag_counts(df: DataFrame) -> DataFrame:
    return tagged_rows(df).groupBy("first_matched").agg(F.count("*").alias("rows"))


def became_blank_report(cleaned: DataFrame) -> DataFrame:
    """Rows per source that hold no text any more after cleaning (before they are dropped)."""
    return blank_report(cleaned).filter(F.col("removed") > 0).select("source_dataset", "removed")


def tagged_preview(df: DataFrame, rows: int = 10, characters: int = 220, seed: int = V.SEED) -> DataFrame:
    """A few tagged rows with the start of their text on one line; a seeded draw."""
    tagged = with_non_email_tags(df.filter(F.col("source_dataset") == V.SPAM_CORPUS)).filter(F.size("tags") > 0)
    draw = F.md5(F.concat_ws("-", F.lit(str(seed)), F.col("row_id").cast("string")))
    preview = F.replace(F.substring("text", 1, characters), F.lit("\n"), F.lit(" | "))
    return tagged.select(
        "row_id", F.array_join("tags", ";").alias("matched"), preview.alias("preview"), draw.alias("draw")
    ).orderBy("draw", "row_id").limit(rows).drop("draw")
