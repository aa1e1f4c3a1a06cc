"""Seeded exact-size draws and splits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailsift.functions import fixed_values as V
from mailsift.operators.ordering import draw_cuts, draw_key, up_to_cut
from mailsift.workspace import sized

STRATA = ["source_dataset", "label"]
SPLIT_SHARES = {"train": 0.70, "val": 0.85}


def _with_cuts(df: DataFrame, strata: list[str], ranks: dict[str, Column], seed: int) -> DataFrame:
    """Join the cut keys, one row per stratum. They are written, so Spark sees that they are few and
    broadcasts them; the mails themselves are not shuffled."""
    cuts = sized(draw_cuts(df, strata, ranks, seed), "cuts")
    return df.join(cuts, strata, "left")


def quota_by_source_label(targets: dict[tuple[str, str], int] = V.SAMPLE_TARGETS) -> Column:
    """The wanted rows of a stratum; 0 for strata without a target."""
    quota = F.lit(0)
    for (source, label), rows in targets.items():
        quota = F.when((F.col("source_dataset") == source) & (F.col("label") == label), rows).otherwise(quota)
    return quota


def quota_by_share(share: float) -> Column:
    """A fixed share of every stratum, rounded down; for corpora of other sizes."""
    return F.floor(F.col("stratum_rows") * F.lit(share))


def stratified_sample(df: DataFrame, quota: Column, seed: int = V.SEED) -> DataFrame:
    """Exactly the quota of every stratum, or an error if a stratum holds fewer rows."""
    enough = F.when(
        quota > F.col("stratum_rows"),
        F.raise_error(F.concat(F.lit("too few rows in "), F.concat_ws("/", *STRATA))).cast("bigint"),
    ).otherwise(quota)
    return _with_cuts(df, STRATA, {"_quota": enough}, seed).filter(up_to_cut("_quota", seed)).select(*df.columns)


def missing_strata(df: DataFrame, targets: dict[tuple[str, str], int] = V.SAMPLE_TARGETS) -> DataFrame:
    """Strata whose target cannot be met, absent ones included; empty means the draw will work."""
    rows = [(source, label, n) for (source, label), n in targets.items()]
    wanted = df.sparkSession.createDataFrame(rows, "source_dataset string, label string, target bigint")
    have = df.groupBy(*STRATA).agg(F.count("*").alias("available"))
    return wanted.join(have, STRATA, "left").withColumn(
        "available", F.coalesce("available", F.lit(0))
    ).filter(F.col("available") < F.col("target"))


def train_val_test(sample: DataFrame, seed: int = V.SEED) -> DataFrame:
    """Append ``split``. Per stratum of n rows: floor(0.70 n) train, up to floor(0.85 n) val, rest test.

    The draw uses another key than the sample, so the split is independent of it.
    """
    split_seed = seed + 1
    ranks = {f"_{name}": F.floor(F.col("stratum_rows") * F.lit(share)) for name, share in SPLIT_SHARES.items()}
    cut = _with_cuts(sample, STRATA, ranks, split_seed)
    split = F.when(up_to_cut("_train", split_seed), "train").when(up_to_cut("_val", split_seed), "val").otherwise("test")
    return cut.select(*sample.columns, split.alias("split"))


def leftover(df: DataFrame, sample: DataFrame) -> DataFrame:
    """Rows that are not in the sample; row ids are unique, so no key can be hot."""
    return df.join(sample.select("row_id"), "row_id", "left_anti")


def confound_slice(df: DataFrame, sample: DataFrame, per_label: Column | int = V.CONFOUND_PER_LABEL,
                   seed: int = V.SEED) -> DataFrame:
    """Equal numbers of both labels from the rows left over, two-class sources only; an error if there are too few.

    Drawn with a key of its own: rows up to the cut are few before the sample is taken out of
    them, so no mail text is shuffled.
    """
    draw_seed = seed + 2
    eligible = df.filter(F.col("source_dataset").isin(V.CONFOUND_SOURCES))
    wanted = per_label if isinstance(per_label, Column) else F.lit(per_label)
    enough = F.when(
        wanted > F.col("stratum_rows"), F.raise_error(F.concat(F.lit("too few rows left over of "), "label")).cast("bigint")
    ).otherwise(wanted)
    cuts = sized(draw_cuts(leftover(eligible, sample), ["label"], {"_quota": enough}, draw_seed), "cuts")
    missing = {V.PHISHING, V.LEGITIMATE} - {r.label for r in cuts.select("label").collect()}
    if missing and not isinstance(per_label, Column) and per_label > 0:
        raise ValueError(f"too few rows left over of {', '.join(sorted(missing))}")
    near = eligible.join(cuts, "label").filter(up_to_cut("_quota", draw_seed)).select(*df.columns)
    return leftover(near, sample)


def seeded_rows(df: DataFrame, rows: int, seed: int = V.SEED) -> DataFrame:
    """A repeatable handful of rows (previews, background samples): a top-k, not a sort."""
    return df.withColumn("_draw", draw_key(F.col("row_id"), seed)).orderBy("_draw", "row_id").limit(rows).drop("_draw")


def _checks(counts: DataFrame, names: list[str]) -> DataFrame:
    """One row (check, observed, expected, ok) per count; all of them must be 0."""
    rows = F.array(*[F.struct(F.lit(n).alias("check"), F.coalesce(F.col(n), F.lit(0)).cast("bigint").alias("observed"))
                     for n in names])
    return counts.select(F.inline(rows)).select(
        "check", "observed", F.lit(0).cast("bigint").alias("expected"), (F.col("observed") == 0).alias("ok"))


def split_integrity(splits: DataFrame, sample: DataFrame, confound: DataFrame) -> DataFrame:
    """Overlaps must be empty, all rows eligible, and the splits must add up to the sample.

    The three tables are put under each other and grouped by row id once.
    """
    ineligible = (~F.coalesce("included_in_training", F.lit(False))).cast("int")
    tables = [
        splits.select("row_id", F.lit(1).alias("bit"), "split", ineligible.alias("bad")),
        sample.select("row_id", F.lit(2).alias("bit"), F.lit(None).cast("string").alias("split"), F.lit(0).alias("bad")),
        confound.select("row_id", F.lit(4).alias("bit"), F.lit(None).cast("string").alias("split"), ineligible.alias("bad")),
    ]
    rows = reduce(DataFrame.unionByName, tables).groupBy("row_id").agg(
        F.bit_or("bit").alias("bits"), (F.min("split") != F.max("split")).alias("twice"), F.sum("bad").alias("bad"))
    bits = F.col("bits")
    counts = rows.agg(
        F.count_if(bits.bitwiseAND(6) == 6).alias("sample_confound_overlap"),
        F.count_if("twice").alias("split_overlap"),
        F.count_if(bits.bitwiseAND(3) == 2).alias("sample_rows_without_split"),
        F.sum("bad").alias("not_eligible"),
    )
    return _checks(counts, ["sample_confound_overlap", "split_overlap", "sample_rows_without_split", "not_eligible"])


def feature_alignment(mails: DataFrame, text_features: DataFrame, url_features: DataFrame) -> DataFrame:
    """Both feature tables must have exactly the mails' rows, and the labels must be the mails' own.

    The three tables are put under each other and grouped by row id once; repeated ids show as a
    difference in how often each table has them.
    """
    none = F.lit(None).cast("string").alias("label")
    tables = [
        mails.select("row_id", F.lit(0).alias("part"), "label"),
        text_features.select("row_id", F.lit(1).alias("part"), "label"),
        url_features.select("row_id", F.lit(2).alias("part"), none),
    ]
    n = lambda part: F.count_if(F.col("part") == part)
    label = lambda part: F.max(F.when(F.col("part") == part, F.col("label")))
    rows = reduce(DataFrame.unionByName, tables).groupBy("row_id").agg(
        n(0).alias("mails"), n(1).alias("texts"), n(2).alias("urls"),
        label(0).alias("own"), label(1).alias("given"))
    more = lambda a, b: F.sum(F.greatest(F.col(a) - F.col(b), F.lit(0)))
    both = (F.col("mails") > 0) & (F.col("texts") > 0)
    counts = rows.agg(
        more("mails", "texts").alias("mails_without_text_features"),
        more("texts", "mails").alias("text_features_without_mail"),
        more("mails", "urls").alias("mails_without_url_features"),
        more("urls", "mails").alias("url_features_without_mail"),
        F.count_if(both & ~F.col("own").eqNullSafe(F.col("given"))).alias("changed_labels"),
    )
    return _checks(counts, ["mails_without_text_features", "text_features_without_mail", "mails_without_url_features",
                            "url_features_without_mail", "changed_labels"])


def output_sizes(splits: DataFrame, confound: DataFrame) -> DataFrame:
    """Rows and class counts of every output."""
    outputs = splits.select("split", "label").unionByName(confound.select(F.lit("confound").alias("split"), "label"))
    return outputs.groupBy("split").agg(
        F.count("*").alias("rows"),
        F.count_if(F.col("label") == V.PHISHING).alias("phishing"),
        F.count_if(F.col("label") == V.LEGITIMATE).alias("legitimate"),
    )
