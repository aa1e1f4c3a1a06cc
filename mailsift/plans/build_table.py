"""Merged mail to cleaned table, splits and confound slice (merge, clean and split stages)."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailsift.functions import fixed_values as V
from mailsift.operators import cleaning, sampling
from mailsift.workspace import at_once, materialise, materialise_checked


@dataclass
class TrainingTable:
    cleaned: DataFrame
    splits: DataFrame
    confound: DataFrame
    # Rows of each output and those that broke a rule, counted in what was written.
    observed: dict[str, dict[str, int]] = field(default_factory=dict)


def cleaned_table(merged: DataFrame, apply_non_email_filter: bool = False, dedup_after_clean: bool = False) -> DataFrame:
    """Eligibility, blanks, exact copies, cleaning, blanks again, optionally the non-mail filter.

    By default copies are removed before cleaning only, so texts that become equal through
    cleaning stay; ``dedup_after_clean`` removes those too.
    """
    unique = cleaning.first_copies(cleaning.without_blank(cleaning.eligible(merged)))
    result = cleaning.clean(unique)
    if dedup_after_clean:
        result = cleaning.first_copies(result)
    return cleaning.without_non_email(result) if apply_non_email_filter else result


def build(merged: DataFrame, out: str, quota: Column | None = None, confound_per_label: int = V.CONFOUND_PER_LABEL,
          apply_non_email_filter: bool = False, dedup_after_clean: bool = False) -> TrainingTable:
    """Write ``cleaned``, ``splits`` (by split) and ``confound`` below ``out``.

    The cleaned table is written once because sample, splits and confound slice all read it. What must hold of a row is
    counted in what was written, and a row that breaks a rule, or splits that do not add up to the sample, end the run.
    """
    rules = {
        "not_eligible": ~F.col("included_in_training"), "no_label": ~F.col("label").isin(V.PHISHING, V.LEGITIMATE),
        "blank_text": F.trim("text") == "", "no_id": F.col("row_id").isNull()}
    seen: dict[str, dict[str, int]] = {}
    cleaned = materialise(cleaned_table(merged, apply_non_email_filter, dedup_after_clean), f"{out}/cleaned")
    if quota is None:
        short = sampling.missing_strata(cleaned).collect()
        if short:
            raise ValueError(f"too few rows for the sample: {[tuple(r) for r in short]}")
        quota = sampling.quota_by_source_label()
    sample, seen["sample"] = materialise_checked(sampling.stratified_sample(cleaned, quota), f"{out}/sample", rules)
    # Both are drawn from the sample and do not depend on each other.
    (splits, seen["splits"]), (confound, seen["confound"]) = at_once(
        merged.sparkSession,
        lambda: materialise_checked(
            sampling.train_val_test(sample), f"{out}/splits", {**rules, "no_split": ~F.col("split").isin("train", "val", "test")}, ["split"]),
        lambda: materialise_checked(sampling.confound_slice(cleaned, sample, confound_per_label), f"{out}/confound", rules))
    if seen["splits"]["rows"] != seen["sample"]["rows"]:
        raise ValueError(f"{seen['sample']['rows']} rows were drawn and {seen['splits']['rows']} split")
    return TrainingTable(cleaned, splits, confound, seen)
