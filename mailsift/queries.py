"""All queries by name. Each takes (spark, sf_dir) and runs over whole tables.

Ratios, weights and entropies are rounded to six digits, so engines that add in another order
agree; ``+ 0.0`` turns a rounded minus zero into zero.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mailsift.functions import cleaning as text_cleaning
from mailsift.functions import fixed_values as V
from mailsift.functions.html_text import with_visible_text
from mailsift.functions.patterns import trim_space
from mailsift.functions.text_features import with_text_features
from mailsift.functions.url_features import with_url_features, with_url_parts, with_urls
from mailsift.operators import cleaning, explain, metrics, models, sampling
from mailsift.operators.assemble import (
    FeatureModel,
    Scaler,
    feature_means,
    join_features, stored_features,
    spot_check,
    with_dense_features,
    zero_url_breakdown,
)
from mailsift.operators.models import BASE_MODELS, Detector
from mailsift.operators.tfidf import Tfidf, long_form, vocabulary
from mailsift.plans import train as training
from mailsift.plans.build_table import build, cleaned_table
from mailsift.plans.score import MALFORMED, NO_TEXT, NOT_A_NUMBER, classification, responses, with_scores
from mailsift.sources import files, mime
from mailsift.sources.inbox import inbox, raw_sources, read_table
from mailsift.sources.json_tree import json_tree_text
from mailsift.sources.merge import compose_mail
from mailsift.streaming import scoring as streaming
from mailsift.workspace import materialise, run_dir

SAMPLE_SHARE = 0.8
CONFOUND_PER_LABEL = 15
VOCABULARY_TERMS = V.MAX_VOCABULARY

_trained: dict[tuple[str, str], training.Trained] = {}
_splits: dict[tuple[str, str], DataFrame] = {}
_stored: dict[tuple[str, str], str] = {}


def rounded(value: Column) -> Column:
    return F.round(value.cast("double"), 6) + F.lit(0.0)


def round_columns(df: DataFrame, names: list[str]) -> DataFrame:
    return df.withColumns({n: rounded(F.col(n)) for n in names})


def _usable(spark, sf_dir):
    return cleaning.without_blank(cleaning.eligible(inbox(spark, sf_dir)))


def _unique(spark, sf_dir):
    return cleaning.first_copies(_usable(spark, sf_dir))


def _cleaned(spark, sf_dir):
    return cleaned_table(inbox(spark, sf_dir))


def _kept(spark, sf_dir):
    """The cleaned table, written once per session and data folder for queries that read it several times."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _stored:
        _stored[key] = f"{run_dir(spark, 'cleaned')}/cleaned"
        _cleaned(spark, sf_dir).write.parquet(_stored[key])
    return spark.read.parquet(_stored[key])


def _kept_dense(spark, sf_dir):
    """The cleaned table with its dense features, written once, as a scaler and what it scales both read them."""
    key = (spark.sparkContext.applicationId, f"{sf_dir} dense")
    if key not in _stored:
        _stored[key] = f"{run_dir(spark, 'dense')}/dense"
        with_dense_features(_cleaned(spark, sf_dir)).write.parquet(_stored[key])
    return spark.read.parquet(_stored[key])


# --- sources, merging, cleaning -------------------------------------------------------------


def merge_sources_summary(spark, sf_dir):
    return inbox(spark, sf_dir).groupBy("source_dataset", "label", "included_in_training").agg(
        F.count("*").alias("rows"), F.count("text").alias("rows_with_text"), F.sum(F.length("text")).alias("characters")
    )


def eligible_rows(spark, sf_dir):
    return cleaning.eligibility_report(inbox(spark, sf_dir))


def blank_placeholder_filter(spark, sf_dir):
    return cleaning.blank_report(cleaning.eligible(inbox(spark, sf_dir)))


def exact_dedup_first_source(spark, sf_dir):
    return _unique(spark, sf_dir).select(
        "row_id", "source_dataset", "label", "subcategory", F.md5("text").alias("text_md5")
    )


def duplicates_by_source(spark, sf_dir):
    return cleaning.duplicate_report(_usable(spark, sf_dir))


def cleaned_text(spark, sf_dir):
    return _cleaned(spark, sf_dir).select(
        "row_id", "source_dataset", F.length("text").alias("characters"), F.md5("text").alias("text_md5")
    )


def quality_flags_before_after(spark, sf_dir):
    return cleaning.cleaning_report(_unique(spark, sf_dir))


def non_email_tags(spark, sf_dir):
    return cleaning.tagged_rows(_cleaned(spark, sf_dir))


def non_email_filtered(spark, sf_dir):
    return cleaning.without_non_email(_cleaned(spark, sf_dir)).groupBy("source_dataset", "label").agg(
        F.count("*").alias("rows")
    )


def non_email_rate(spark, sf_dir):
    return round_columns(cleaning.tag_rate(_cleaned(spark, sf_dir)), ["share"])


def non_email_first_tags(spark, sf_dir):
    return cleaning.first_tag_counts(_cleaned(spark, sf_dir))


def non_email_preview(spark, sf_dir):
    return cleaning.tagged_preview(_cleaned(spark, sf_dir))


def became_blank(spark, sf_dir):
    return cleaning.became_blank_report(text_cleaning.with_clean_text(_unique(spark, sf_dir)))


# Code points of an encoded word: four bytes each in the longest encoding stay within its 75 characters.
ENCODED_PIECE = 5


def encoded_words(spark, sf_dir):
    """The documents' whole texts as encoded words of legal length, in four encodings, decoded again."""
    hexed = lambda text, charset: F.regexp_replace(F.hex(F.encode(text, charset)), "(..)", "=$1")

    def word(piece: Column) -> Column:
        kind, latin = F.col("doc_id") % 4, F.regexp_replace(piece, r"[^\x00-\xFF]", "?")
        return F.concat(
            F.when(kind == 0, F.concat(F.lit("=?UTF-8?b?"), F.base64(F.encode(piece, "UTF-8"))))
            .when(kind == 1, F.concat(F.lit("=?utf-8?Q?"), hexed(piece, "UTF-8")))
            .when(kind == 2, F.concat(F.lit("=?iso-8859-1?q?"), hexed(latin, "ISO-8859-1")))
            .otherwise(F.concat(F.lit("=?utf-16be?B?"), F.base64(F.encode(piece, "UTF-16BE")))), F.lit("?="))

    pieces = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{ENCODED_PIECE}}}"), F.lit(0))
    text = F.concat(F.lit("a "), F.array_join(F.transform(pieces, word), " "), F.lit(" z"))
    documents = read_table(spark, sf_dir, "documents").filter("text is not null")
    return documents.select("doc_id", text_cleaning.decode_mime_words(text).alias("decoded"))


def html_strip_pages(spark, sf_dir):
    return with_visible_text(read_table(spark, sf_dir, "pages").select("page_id", F.col("html").alias("text")), "text")


def class_balance(spark, sf_dir):
    """Labels of the general corpus as it comes; a fifth of the documents belongs to another source of the inbox."""
    return files.class_balance(raw_sources(spark, sf_dir)["general_corpus"])


def seeded_class_rows(spark, sf_dir):
    phishing = inbox(spark, sf_dir).filter(
        (F.col("source_dataset") == V.GENERAL_CORPUS) & (F.col("label") == V.PHISHING)
    )
    return sampling.seeded_rows(phishing.select("row_id", "text"), 15)


# --- sampling -----------------------------------------------------------------------------------


def _sample(cleaned: DataFrame) -> DataFrame:
    return sampling.stratified_sample(cleaned, sampling.quota_by_share(SAMPLE_SHARE))


def _stored_unique(spark, sf_dir):
    """The de-duplicated table written once: a draw reads it for the counts, the cuts and the rows."""
    return materialise(_unique(spark, sf_dir), f"{run_dir(spark, 'unique')}/unique")


def stratified_sample(spark, sf_dir):
    return _sample(_stored_unique(spark, sf_dir)).select("row_id", "source_dataset", "label")


def train_val_test_split(spark, sf_dir):
    return sampling.train_val_test(_sample(_stored_unique(spark, sf_dir))).select("row_id", "source_dataset", "label", "split")


def confound_slice(spark, sf_dir):
    rows = _stored_unique(spark, sf_dir)
    return sampling.confound_slice(rows, _sample(rows), CONFOUND_PER_LABEL).select("row_id", "source_dataset", "label")


def _outputs(spark, sf_dir):
    rows = _stored_unique(spark, sf_dir)
    sample = _sample(rows)
    return sampling.train_val_test(sample), sample, sampling.confound_slice(rows, sample, CONFOUND_PER_LABEL)


def split_integrity_checks(spark, sf_dir):
    return sampling.split_integrity(*_outputs(spark, sf_dir))


def observed_build_checks(spark, sf_dir):
    """Rows of each output and rows that broke a rule, as the build counted them."""
    table = build(inbox(spark, sf_dir), run_dir(spark, "observed"), sampling.quota_by_share(SAMPLE_SHARE), CONFOUND_PER_LABEL)
    rows = [(name, seen["rows"], sum(n for rule, n in seen.items() if rule != "rows")) for name, seen in table.observed.items()]
    written = table.splits.select(F.lit("splits").alias("output")).unionByName(table.confound.select(F.lit("confound").alias("output")))
    stored = written.groupBy("output").agg(F.count("*").alias("stored"))
    return spark.createDataFrame(rows, "output string, rows bigint, broken bigint").join(stored, "output", "left").select(
        "output", "rows", (F.col("broken") + F.abs(F.col("rows") - F.coalesce("stored", "rows"))).alias("failing"))


def output_sizes(spark, sf_dir):
    splits, _, confound = _outputs(spark, sf_dir)
    return sampling.output_sizes(splits, confound)


# --- features ----------------------------------------------------------------------------------


def text_features(spark, sf_dir):
    return round_columns(
        with_text_features(_cleaned(spark, sf_dir)).select("row_id", *V.TEXT_FEATURES), ["urgency_score", "avg_word_length"]
    )


def _means(df: DataFrame, features: list[str]) -> DataFrame:
    return round_columns(feature_means(df, features), [f"mean_{c}" for c in features])


def text_features_by_label(spark, sf_dir):
    return _means(with_text_features(_cleaned(spark, sf_dir)), V.TEXT_FEATURES)


def url_extract(spark, sf_dir):
    """URLs of the texts as merged, markup included, with host, suffix and domain."""
    parts = with_url_parts(with_urls(inbox(spark, sf_dir).select("row_id", "text")))
    numbered = F.transform(
        F.arrays_zip(F.col("urls"), F.col("_parts")),
        lambda z, i: F.struct((i + 1).alias("url_no"), z.urls.alias("url"), z["_parts"].host.alias("host"),
                              z["_parts"].suffix.alias("suffix"), z["_parts"].domain.alias("domain")),
    )
    return parts.select("row_id", F.inline_outer(numbered)).filter(F.col("url").isNotNull())


def url_features(spark, sf_dir):
    return round_columns(
        with_url_features(_cleaned(spark, sf_dir)).select("row_id", *V.URL_FEATURES), ["avg_domain_entropy"]
    )


def url_features_by_label(spark, sf_dir):
    return _means(with_url_features(_cleaned(spark, sf_dir)), V.URL_FEATURES)


def zero_url_report(spark, sf_dir):
    return round_columns(zero_url_breakdown(with_url_features(_cleaned(spark, sf_dir))), ["zero_share"])


def joined_features(spark, sf_dir):
    rows = _kept(spark, sf_dir)
    joined = join_features(*stored_features(
        with_text_features(rows).select("row_id", "label", *V.TEXT_FEATURES),
        with_url_features(rows).select("row_id", *V.URL_FEATURES),
    ))
    return round_columns(joined, ["urgency_score", "avg_word_length", "avg_domain_entropy"])


def feature_alignment_checks(spark, sf_dir):
    rows = _kept(spark, sf_dir)
    return sampling.feature_alignment(
        rows, with_text_features(rows).select("row_id", "label"), with_url_features(rows).select("row_id")
    )


def _train_rows(rows: DataFrame) -> DataFrame:
    """The train split of all rows."""
    return sampling.train_val_test(rows).filter(F.col("split") == "train")


def tfidf_vocabulary(spark, sf_dir):
    return round_columns(vocabulary(_train_rows(_kept(spark, sf_dir)), max_terms=VOCABULARY_TERMS), ["idf"])


def tfidf_weights(spark, sf_dir):
    rows = _kept(spark, sf_dir)
    weighted = Tfidf.fit(_train_rows(rows), max_terms=VOCABULARY_TERMS).transform(rows)
    return round_columns(long_form(weighted, "tfidf", ["row_id"]), ["value"])


def scaled_dense(spark, sf_dir):
    dense = _kept_dense(spark, sf_dir)
    scaler = Scaler.fit(_train_rows(dense))
    names = [f"scaled_{c}" for c in V.DENSE_FEATURES]
    return round_columns(scaler.transform(dense).select("row_id", *names), names)


def assembled_matrix(spark, sf_dir):
    rows = _kept_dense(spark, sf_dir)
    fitted = FeatureModel.fit(_train_rows(rows), VOCABULARY_TERMS)
    return round_columns(long_form(fitted.transform(rows), "features", ["row_id"]), ["value"]).filter("value <> 0")


# --- metrics on pseudo-scores ------------------------------------------------------------------


def pseudo_scores(spark, sf_dir) -> DataFrame:
    """Four models' scores from integer arithmetic on row id and label."""
    rows = inbox(spark, sf_dir).filter("included_in_training").select(
        "row_id", "source_dataset", (F.col("label") == V.PHISHING).cast("int").alias("y")
    )
    numbered = rows.select("*", F.posexplode(F.array(*map(F.lit, [*BASE_MODELS, metrics.ENSEMBLE]))).alias("k", "model"))
    noise = F.floor(((F.col("row_id") * 7919 + F.col("k") * 131) % 1000) / 2)
    points = F.least(F.lit(999), noise + F.col("y") * (350 + F.col("k") * 30) + 60)
    return numbered.select("model", "row_id", "source_dataset", "y", (points / F.lit(1000.0)).alias("score"))


_RATES = ["precision", "recall", "f1", "false_positive_rate"]


def metrics_overall_by_source(spark, sf_dir):
    table = metrics.metrics(pseudo_scores(spark, sf_dir)).withColumn("notes", F.array_join("notes", "; "))
    return round_columns(table, [*_RATES, "accuracy"])


def roc_auc_by_source(spark, sf_dir):
    return round_columns(metrics.roc_auc(pseudo_scores(spark, sf_dir)), ["auc_roc"])


def threshold_sweep(spark, sf_dir):
    return round_columns(metrics.threshold_sweep(pseudo_scores(spark, sf_dir)), _RATES)


def threshold_pick(spark, sf_dir):
    return round_columns(metrics.pick_thresholds(metrics.threshold_sweep(pseudo_scores(spark, sf_dir))), _RATES)


def recall_cost(spark, sf_dir):
    return round_columns(metrics.recall_cost(pseudo_scores(spark, sf_dir), 0.67), ["recall_drop"])


def best_baseline_vs_ensemble(spark, sf_dir):
    overall = metrics.full_metrics(pseudo_scores(spark, sf_dir)).filter(F.col("source_dataset").isNull())
    compared = metrics.compare_with_baselines(overall, BASE_MODELS)
    return round_columns(compared, [n for n, kind in compared.dtypes if kind == "double"])


def synthetic_slice(spark, sf_dir):
    return round_columns(metrics.slice_summary(metrics.metrics(pseudo_scores(spark, sf_dir))), ["fpr", "recall"])


# --- models ----------------------------------------------------------------------------------------


def trained(spark: SparkSession, sf_dir: str) -> training.Trained:
    """Train once per session and data folder, with full settings; the model queries share the result."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _trained:
        out = run_dir(spark, "training")
        table = build(inbox(spark, sf_dir), out, sampling.quota_by_share(SAMPLE_SHARE), CONFOUND_PER_LABEL)
        _splits[key] = table.splits
        _trained[key] = training.train(table.splits, out)
    return _trained[key]


def _training_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The splits that the session's models were trained and judged on."""
    trained(spark, sf_dir)
    return _splits[(spark.sparkContext.applicationId, sf_dir)]


def test_scores(spark, sf_dir):
    return trained(spark, sf_dir).test_scores


def model_metrics(spark, sf_dir):
    return metrics.full_metrics(trained(spark, sf_dir).test_scores)


def model_threshold_sweep(spark, sf_dir):
    return metrics.threshold_sweep(trained(spark, sf_dir).val_scores)


def feature_importance_top20(spark, sf_dir):
    return models.top_importances(models.importances(trained(spark, sf_dir).detector, spark))


def dense_importance(spark, sf_dir):
    return models.dense_share(models.importances(trained(spark, sf_dir).detector, spark))


def _selected(result: training.Trained) -> float | None:
    """The threshold that validation selects; None where none reaches the target."""
    try:
        return training.select_threshold(result.val_scores)
    except ValueError:
        return None


def evaluation_report(spark, sf_dir):
    result = trained(spark, sf_dir)
    report = training.evaluation_report(result, _selected(result))
    path = f"{run_dir(spark, 'report')}/report"
    files.write_report(report, path)
    return files.read_report(spark, path, report.schema)


def _mails(spark, sf_dir) -> DataFrame:
    return inbox(spark, sf_dir).filter("text IS NOT NULL").select(
        "row_id", "text", F.lit(None).cast("double").alias("threshold"), F.lit("raw_text").alias("input_method")
    )


def score_mails(spark, sf_dir):
    return responses(trained(spark, sf_dir).detector, _mails(spark, sf_dir), False)


def _explained(spark, sf_dir) -> DataFrame:
    return with_scores(trained(spark, sf_dir).detector, _mails(spark, sf_dir), explained=True).drop("text")


def explain_top10(spark, sf_dir):
    return explain.top_contributions(_explained(spark, sf_dir))


# --- checks of the models: what must hold of every row, counted, so that SQL can supply the row counts -------


def _failing(condition: Column) -> Column:
    return F.count_if(~F.coalesce(condition, F.lit(False))).alias("failing")


def _close(a: Column, b: Column) -> Column:
    return F.abs(a - b) < 1e-6


def _logistic(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def explanation_checks(spark, sf_dir):
    """Per model over all mails: base value and Shapley values give the score, and the strongest ones are in order."""
    rows = _explained(spark, sf_dir).select(
        F.map_from_arrays(F.array(*map(F.lit, BASE_MODELS)), F.array(*BASE_MODELS)).alias("scores"), F.inline("explained"))
    raw = F.col("base") + F.col("total")
    probability = F.when(F.col("model") == "random_forest", raw).otherwise(_logistic(raw))
    size = F.transform("top", lambda e: F.abs(e.contribution))
    widths = F.forall("top", lambda e: (
        _close(e.bar_width * size[0], F.abs(e.contribution) * 100) & e.bar_width.between(0, 100 + 1e-9)))
    holds = (
        _close(probability, F.col("scores")[F.col("model")])
        & (F.size("top") <= V.TOP_EXPLANATIONS)
        & (F.transform("top", lambda e: e["rank"]) == F.slice(F.sequence(F.lit(1), F.lit(V.TOP_EXPLANATIONS)), F.lit(1), F.size("top")))
        & (F.sort_array(size, False) == size) & widths
        & F.forall("top", lambda e: (e.direction == V.PHISHING) == (e.contribution > 0))
    )
    return rows.groupBy("model").agg(F.count("*").alias("rows"), _failing(holds))


def test_score_checks(spark, sf_dir):
    """Per model and source over the test split: scores are probabilities, the ensemble's the stored logistic of the others."""
    result = trained(spark, sf_dir)
    wide = result.test_scores.groupBy("row_id", "source_dataset", "y").pivot("model", result.detector.names).agg(F.first("score"))
    meta = result.detector.meta
    raw = F.lit(float(meta.intercept))
    for weight, name in zip(meta.coefficients, BASE_MODELS):
        raw = raw + F.lit(float(weight)) * F.col(name)
    wide = wide.withColumn("expected", _logistic(raw))
    long = wide.select("source_dataset", "y", "expected", F.inline(F.array(*[
        F.struct(F.lit(n).alias("model"), F.col(n).alias("score")) for n in result.detector.names])))
    ensemble = F.col("model") == metrics.ENSEMBLE
    holds = F.col("score").between(0, 1) & F.col("y").isin(0, 1) & (~ensemble | _close(F.col("score"), F.col("expected")))
    return long.groupBy("model", "source_dataset").agg(
        F.count("*").alias("rows"), F.sum("y").alias("phishing"), _failing(holds))


def importance_checks(spark, sf_dir):
    """Per model: importances add up to 1, the first twenty are ranked by size, and the dense share is their part."""
    table = models.importances(trained(spark, sf_dir).detector, spark)
    dense = F.col("feature").isin(V.DENSE_FEATURES)
    named = dense | F.col("feature").startswith("tfidf:")
    sums = table.groupBy("model").agg(
        F.sum("importance").alias("total"), F.sum(F.when(dense, F.col("importance")).otherwise(0.0)).alias("dense"),
        F.count_if(~named | (F.col("importance") < 0)).alias("odd"))
    top = models.top_importances(table)
    ordered = top.groupBy("model").agg(F.array_sort(F.collect_list(F.struct("rank", "importance"))).alias("top"))
    sizes = F.transform("top", lambda e: e.importance)
    holds = (
        _close(F.col("total"), F.lit(1.0)) & (F.col("odd") == 0) & _close(F.col("dense"), F.col("dense_importance"))
        & (F.transform("top", lambda e: e["rank"]) == F.sequence(F.lit(1), F.size("top")))
        & (F.sort_array(sizes, False) == sizes) & (F.size("top") <= V.TOP_FEATURES)
    )
    joined = sums.join(ordered, "model").join(models.dense_share(table), "model")
    return joined.select("model", F.when(holds, 0).otherwise(1).alias("failing"))


def model_metric_checks(spark, sf_dir):
    """Per model: its metrics by source and over all are those counted row by row from its scores."""
    result = trained(spark, sf_dir)
    table = metrics.full_metrics(result.test_scores)
    hit, y = F.col("score") >= V.DEFAULT_CUT, F.col("y")
    counted = result.test_scores.rollup("model", "source_dataset").agg(
        F.sum(F.when(hit, y).otherwise(0)).alias("TP"), F.sum(F.when(hit, 1 - y).otherwise(0)).alias("FP"),
        F.sum(F.when(hit, 0).otherwise(y)).alias("FN"), F.sum(F.when(hit, 0).otherwise(1 - y)).alias("TN"),
    ).filter("model is not null").withColumnsRenamed({"model": "m", "source_dataset": "s"})
    both = table.join(counted, F.expr("model = m and source_dataset <=> s"), "full")
    holds = (
        (F.col("cells") == F.col("own")) & F.coalesce(_close(F.col("recall"), F.col("own_recall")), F.col("recall").isNull())
        & F.coalesce(_close(F.col("false_positive_rate"), F.col("own_fpr")), F.col("false_positive_rate").isNull())
        & F.col("auc_roc").isNull().eqNullSafe(F.col("one_class")))
    both = both.select(
        F.coalesce("model", "m").alias("model"), "recall", "false_positive_rate", "auc_roc",
        F.array(table.tp, table.fp, table.fn, table.tn).alias("cells"),
        F.array(counted.TP, counted.FP, counted.FN, counted.TN).cast("array<bigint>").alias("own"),
        (counted.TP / F.nullif(counted.TP + counted.FN, F.lit(0))).alias("own_recall"),
        (counted.FP / F.nullif(counted.FP + counted.TN, F.lit(0))).alias("own_fpr"),
        ((counted.TP + counted.FN == 0) | (counted.FP + counted.TN == 0)).alias("one_class"))
    return both.groupBy("model").agg(F.count("*").alias("rows"), _failing(holds))


def threshold_checks(spark, sf_dir):
    """The selected threshold is the one that a search over the validation scores finds; one row, nothing failing."""
    result = trained(spark, sf_dir)
    val = result.val_scores.filter(F.col("model") == metrics.ENSEMBLE)
    selected = _selected(result)
    by_step = val.select("y", "score", F.explode(F.array(*map(F.lit, metrics.threshold_grid()))).alias("t")).groupBy("t").agg(
        (F.count_if((F.col("y") == 0) & (F.col("score") >= F.col("t"))) / F.count_if(F.col("y") == 0)).alias("fpr"),
        F.count_if((F.col("y") == 1) & (F.col("score") >= F.col("t"))).alias("found"))
    low = by_step.filter(F.col("fpr") < V.SELECTED_FPR_TARGET).agg(F.min(F.struct(-F.col("found"), "t")).alias("best"))
    return low.select(F.lit(1).alias("rows"), F.when(
        F.col("best.t").eqNullSafe(F.lit(selected).cast("double")), 0).otherwise(1).alias("failing"))


def report_checks(spark, sf_dir):
    """The report of newly trained models, written and read back, and the benchmark of the stored ones agree with the tables."""
    result = trained(spark, sf_dir)
    again = training.benchmark(_training_table(spark, sf_dir), result.detector.path.rsplit("/", 1)[0])
    parts = evaluation_report(spark, sf_dir).select(F.inline("headline")).alias("r")
    stored = again.select(F.inline("headline")).alias("b")
    overall = metrics.full_metrics(result.test_scores).filter(F.col("source_dataset").isNull()).alias("m")
    rows = overall.join(parts, "model", "left").join(stored, "model", "left")
    rates = ["precision", "recall", "f1", "false_positive_rate", "auc_roc"]
    same = [_close(F.col(f"m.{c}"), F.col(f"r.{c}")) & _close(F.col(f"m.{c}"), F.col(f"b.{c}")) for c in rates]
    holds = same[0]
    for one in same[1:]:
        holds = holds & one
    return rows.groupBy("model").agg(F.count("*").alias("rows"), _failing(holds))


def matrix_checks(spark, sf_dir):
    """Per split: the stored matrix has a row for every mail, with the vector that the stored feature model makes of its text."""
    splits = _training_table(spark, sf_dir)
    detector = Detector.load(spark, trained(spark, sf_dir).detector.path)
    stored = spark.read.parquet(f"{detector.path.rsplit('/', 1)[0]}/features").select("row_id", F.col("features").alias("stored"))
    made = detector.features.transform(splits).select("row_id", "split", "features")
    both = made.join(stored, "row_id", "left").select(
        "split", vector_to_array("features").alias("a"), vector_to_array("stored").alias("b"))
    holds = F.forall(F.arrays_zip("a", "b"), lambda x: F.abs(x.a - x.b) < 1e-12) & (F.size("a") == F.size("b"))
    return both.groupBy("split").agg(F.count("*").alias("rows"), _failing(holds))


def meta_model_checks(spark, sf_dir):
    """Per weight of the stacked model: the slope of its regularised log loss over the validation rows is zero there."""
    result = trained(spark, sf_dir)
    wide = result.val_scores.groupBy("row_id", "y").pivot("model", result.detector.names).agg(F.first("score"))
    missed, meta = F.col(metrics.ENSEMBLE) - F.col("y"), result.detector.meta
    slopes = [(name, F.avg(missed * F.col(name)) + float(weight) / F.count("*")) for name, weight in zip(BASE_MODELS, meta.coefficients)]
    slopes.append(("intercept", F.avg(missed)))
    found = wide.agg(F.count("*").alias("rows"), *[slope.alias(name) for name, slope in slopes])
    return found.select("rows", F.inline(F.array(*[F.struct(F.lit(n).alias("model"), F.col(n).alias("slope")) for n, _ in slopes]))).select(
        "model", "rows", F.when(F.abs("slope") < 1e-4, 0).otherwise(1).alias("failing"))


def threshold_summary_checks(spark, sf_dir):
    """The threshold summary's parts are the metrics they name, at the default and at the selected threshold, over the test rows."""
    result = trained(spark, sf_dir)
    selected = _selected(result) or V.SERVING_THRESHOLD
    report = training.tuning_report(result.val_scores, result.test_scores, selected)
    test = result.test_scores.filter(F.col("model") == metrics.ENSEMBLE)
    hit = lambda t: (F.col("score") >= t) & (F.col("y") == 1)
    own = test.agg(
        F.count("*").alias("rows"), F.count_if(F.col("y") == 1).alias("phishing"),
        F.count_if(hit(V.DEFAULT_CUT)).alias("at_default"), F.count_if(hit(selected)).alias("at_selected"))
    overall = lambda part: F.filter(part, lambda m: m.source_dataset.isNull())[0]
    parts = report.select(
        overall("test_at_default").tp.alias("d"), overall("test_at_selected").tp.alias("s"),
        F.col("test_recall_cost")[0].alias("cost"), F.size("validation_fpr_targets").alias("targets"), "selected_threshold")
    holds = (
        (F.col("d") == F.col("at_default")) & (F.col("s") == F.col("at_selected")) & (F.col("selected_threshold") == selected)
        & (F.col("cost.additional_missed") == F.col("at_default") - F.col("at_selected"))
        & _close(F.col("cost.recall_drop"), (F.col("at_default") - F.col("at_selected")) / F.col("phishing"))
        & (F.col("targets") == len(V.FPR_TARGETS)))
    # Two tables of one row each.
    one = lambda df: df.withColumn("k", F.lit(1))
    return one(own).join(one(parts), "k").select("rows", F.when(holds, 0).otherwise(1).alias("failing"))


def response_checks(spark, sf_dir):
    """Responses to JSON requests, by turn: invalid thresholds give errors, the others a class by their threshold."""
    rows = stream_score_json(spark, sf_dir).withColumn("turn", F.split("row_id", "-")[1].cast("bigint"))
    kind = F.col("turn") % 3
    wanted = F.when(kind == 1, 0.5).when(kind == 2, 1.5).otherwise(V.SERVING_THRESHOLD)
    judged = classification(F.col("ensemble_probability"), F.col("threshold_used")) == F.col("classification")
    holds = (F.col("threshold_used") == wanted) & F.when(
        kind == 2, F.col("error").isNotNull() & F.col("classification").isNull()).otherwise(F.col("error").isNull() & judged)
    return rows.groupBy(kind.alias("kind")).agg(
        F.count("*").alias("rows"), F.count("error").alias("errors"), _failing(holds))


def stream_batch_checks(spark, sf_dir):
    """Message files scored as a stream and as a batch give the same classes, scores and explanations."""
    folder = _eml_folder(spark, sf_dir)
    detector = trained(spark, sf_dir).detector
    out = run_dir(spark, "stream-check")
    query = streaming.score_stream(detector, streaming.eml_stream(spark, folder, "*.txt"), out, f"{out}/state")
    streamed = _drain(query, out, spark).alias("s")
    mails = mime.read_eml(spark, folder, "*.txt").select(
        F.col("message_no").alias("row_id"), compose_mail(F.col("subject"), F.col("body")).alias("text"),
        F.lit(None).cast("double").alias("threshold"), F.lit("eml_upload").alias("input_method"))
    batch = responses(detector, mails).alias("b")
    same = F.expr("s.classification = b.classification and s.input_method = b.input_method"
                  " and to_json(s.explanation) = to_json(b.explanation)")
    both = streamed.join(batch, "row_id", "full")
    return both.agg(F.count("*").alias("rows"), _failing(
        same & _close(F.col("s.ensemble_probability"), F.col("b.ensemble_probability"))))


def formatted_metrics(spark, sf_dir):
    """Rates as reports show them: four decimals, n/a for missing ones."""
    table = round_columns(metrics.metrics(pseudo_scores(spark, sf_dir)), _RATES)
    return table.select("model", "source_dataset", *[metrics.shown(F.col(c)).alias(c) for c in _RATES])


def feature_spot_check(spark, sf_dir):
    """The features of a handful of seeded rows."""
    rows = _kept(spark, sf_dir)
    ids = [r.row_id for r in sampling.seeded_rows(rows.select("row_id"), 5).collect()]
    return round_columns(spot_check(with_dense_features(rows), ids, ["label", "urgency_score", "word_count", "url_count"]),
                         ["urgency_score", "word_count", "url_count"])


# --- file sources: the tables written in each source's format and read back --------------------------


def _mbox_folder(spark, sf_dir) -> str:
    """Conversations as mbox messages: plain, base64 and HTML-only multipart."""
    turns = read_table(spark, sf_dir, "conversations")
    # Mail programs quote body lines that look like a separator.
    safe = F.regexp_replace("text", "(?m)^From ", ">From ")
    head = F.concat(
        F.lit("From sender@example.org Thu Jan  1 00:00:00 2015\nSubject: turn "), F.col("turn").cast("string"),
        F.lit(" of "), F.col("conv_id").cast("string"), F.lit("\nMIME-Version: 1.0\n"),
    )
    plain = F.concat(F.lit('Content-Type: text/plain; charset="utf-8"\nContent-Transfer-Encoding: 8bit\n\n'), safe)
    coded = F.concat(
        F.lit('Content-Type: text/plain; charset="utf-8"\nContent-Transfer-Encoding: base64\n\n'),
        F.base64(F.encode("text", "UTF-8")),
    )
    multipart = F.concat(
        F.lit('Content-Type: multipart/alternative; boundary="b0"\n\n--b0\n'
              'Content-Type: text/html; charset="utf-8"\nContent-Transfer-Encoding: 8bit\n\n<html><p>'),
        safe, F.lit("</p><hr>end &amp; out</html>\n--b0--"),
    )
    kind = F.col("turn") % 3
    body = F.when(kind == 0, plain).when(kind == 1, coded).otherwise(multipart)
    folder = f"{run_dir(spark, 'mbox')}/mail"
    turns.select(F.concat(head, body, F.lit("\n")).alias("value")).write.text(folder)
    return folder


def mbox_messages(spark, sf_dir):
    return mime.read_mbox(spark, _mbox_folder(spark, sf_dir)).select("subject", trim_space(F.col("body")).alias("body"))


def mbox_file_states(spark, sf_dir):
    """Mail files by state, with the records that were read."""
    states = mime.file_states(spark, _mbox_folder(spark, sf_dir))
    return states.groupBy("state").agg(F.sum("records").alias("records"))


def mbox_without_mirror_files(spark, sf_dir):
    """Leftovers of a mirrored web folder among the mail files are passed over."""
    folder = _mbox_folder(spark, sf_dir)
    java = spark.sparkContext._jvm.org.apache.hadoop.fs
    store = java.Path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for name in ("robots.txt", "index.html?C=M;O=A", "index.html"):
        out = store.create(java.Path(f"{folder}/{name}"))
        out.write(bytearray(b"From nobody Thu Jan  1 00:00:00 2015\nSubject: no mail\n\nno mail\n"))
        out.close()
    return mime.read_mbox(spark, folder).agg(
        F.count("*").alias("messages"), F.count_if(F.col("subject") == "no mail").alias("leftovers"))


def mbox_message_total(spark, sf_dir):
    counts = mime.message_counts(mime.read_mbox(spark, _mbox_folder(spark, sf_dir)))
    return counts.filter(F.col("source_file").isNull()).select("messages")


def _eml_folder(spark, sf_dir) -> str:
    """Benchmark items as single message files, those of a task in one folder."""
    items = read_table(spark, sf_dir, "benchmark")
    message = F.concat(
        F.lit("Subject: item "), F.col("item_id").cast("string"),
        F.lit('\nContent-Type: text/plain; charset="utf-8"\nContent-Transfer-Encoding: base64\n\n'),
        F.base64(F.encode("text", "UTF-8")),
    )
    folder = f"{run_dir(spark, 'eml')}/mail"
    items.select(message.alias("value")).write.option("maxRecordsPerFile", 1).text(folder)
    return folder


def eml_messages(spark, sf_dir):
    return mime.read_eml(spark, _eml_folder(spark, sf_dir), "*.txt").select("subject", "body")


def json_tree_texts(spark, sf_dir):
    turns = read_table(spark, sf_dir, "conversations")
    kind = (F.col("conv_id") + F.col("turn")) % 5
    flat = F.to_json(F.array("role", "text"))
    nested = F.to_json(F.array(F.array(F.lit("…"), F.col("text")), F.array(F.col("role"), F.lit(""))))
    with_object = F.concat(F.lit('[{"hidden": "value"}, '), F.substr(flat, F.lit(2)))
    raw = (
        F.when(kind == 0, flat).when(kind == 1, nested).when(kind == 2, F.to_json(F.struct("role", "text")))
        .when(kind == 3, with_object).otherwise(F.col("text"))
    )
    stored = turns.select("conv_id", "turn", raw.alias("raw"))
    return stored.select("conv_id", "turn", json_tree_text(F.col("raw")).alias("text"))


def csv_round_trip(spark, sf_dir):
    folder = f"{run_dir(spark, 'csv')}/general"
    documents = read_table(spark, sf_dir, "documents")
    files.write_csv(documents.select("doc_id", F.col("text").alias("Email Text"), F.col("source").alias("Email Type")), folder)
    schema = "doc_id bigint, `Email Text` string, `Email Type` string"
    back = files.read_csv_folder(spark, f"{folder}/*.csv", schema)
    return back.select("doc_id", F.col("Email Type").alias("email_type"), F.md5("Email Text").alias("text_md5"))


def materialise_status(spark, sf_dir):
    path = f"{run_dir(spark, 'status')}/merged"
    rows = inbox(spark, sf_dir)
    first = files.materialise_once(rows, path, "merged")
    again = files.materialise_once(rows, path, "merged")
    absent = files.status(spark, f"{path}-absent", "absent", "")
    return first.unionByName(again).unionByName(absent)


# --- streaming -------------------------------------------------------------------------------------


def _drain(query, out: str, spark) -> DataFrame:
    query.awaitTermination()
    return spark.read.parquet(f"{out}/responses")


def stream_score_eml(spark, sf_dir):
    out = run_dir(spark, "stream-eml")
    mails = streaming.eml_stream(spark, _eml_folder(spark, sf_dir), "*.txt")
    query = streaming.score_stream(trained(spark, sf_dir).detector, mails, out, f"{out}/state")
    return _drain(query, out, spark).drop("batch")


def stream_score_json(spark, sf_dir):
    out = run_dir(spark, "stream-json")
    turns = read_table(spark, sf_dir, "conversations")
    threshold = F.when(F.col("turn") % 3 == 1, 0.5).when(F.col("turn") % 3 == 2, 1.5)
    turns.select(
        F.concat_ws("-", F.col("conv_id"), F.col("turn")).alias("request_id"),
        F.col("text").alias("email_text"), threshold.alias("threshold"),
    ).write.json(f"{out}/requests")
    mails = streaming.request_stream(spark, f"{out}/requests")
    query = streaming.score_stream(trained(spark, sf_dir).detector, mails, out, f"{out}/state", with_explanation=False)
    return _drain(query, out, spark).drop("batch")


def rescued_request_checks(spark, sf_dir):
    """Requests by kind of line: a malformed line, a threshold that is no number and a missing text each get one error row,
    good lines a class, as in a batch of the same requests."""
    out = run_dir(spark, "stream-rescued")
    turns = read_table(spark, sf_dir, "conversations")
    kind = (F.col("conv_id") + F.col("turn")) % 4
    name = F.concat_ws("-", F.col("conv_id"), F.col("turn"), kind)
    line = F.when(kind == 1, F.expr("left(line, length(line) - 2)")).otherwise(F.col("line"))
    turns = turns.withColumn("line", F.to_json(F.struct(
        name.alias("request_id"), F.when(kind != 3, F.col("text")).alias("email_text"),
        F.when(kind == 2, "high").otherwise("0.5").alias("threshold"))))
    turns.select(line.alias("value")).write.text(f"{out}/requests")
    detector = trained(spark, sf_dir).detector
    requests = streaming.request_stream(spark, f"{out}/requests")
    rows = _drain(streaming.score_stream(detector, requests, out, f"{out}/state", with_explanation=False), out, spark)
    good = turns.filter(kind == 0).select(
        name.alias("row_id"), "text", F.lit(0.5).alias("threshold"), F.lit("raw_text").alias("input_method"))
    batch = responses(detector, good, False).select(F.col("row_id").alias("id"), F.col("ensemble_probability").alias("p"))
    found = F.when(F.col("row_id").isNull(), 1).otherwise(F.element_at(F.split("row_id", "-"), -1).cast("int"))
    rows = rows.withColumn("kind", found).join(batch, F.col("row_id") == F.col("id"), "left")
    message = F.element_at(F.create_map(
        F.lit(1), F.lit(MALFORMED), F.lit(2), F.lit(NOT_A_NUMBER), F.lit(3), F.lit(NO_TEXT)), F.col("kind"))
    holds = F.when(F.col("kind") == 0, F.col("error").isNull() & F.col("classification").isNotNull()
                   & _close(F.col("ensemble_probability"), F.col("p"))).otherwise(
        F.startswith("error", message) & F.col("classification").isNull() & F.col("ensemble_probability").isNull())
    return rows.groupBy("kind").agg(F.count("*").alias("rows"), _failing(holds))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in [
        merge_sources_summary, eligible_rows, blank_placeholder_filter, exact_dedup_first_source, duplicates_by_source,
        cleaned_text, quality_flags_before_after, non_email_tags, non_email_filtered, non_email_rate,
        non_email_first_tags, non_email_preview, became_blank, encoded_words, html_strip_pages, class_balance, seeded_class_rows,
        stratified_sample, train_val_test_split, confound_slice, split_integrity_checks, observed_build_checks, output_sizes,
        text_features, text_features_by_label, url_extract, url_features, url_features_by_label, zero_url_report,
        joined_features, feature_alignment_checks, tfidf_vocabulary, tfidf_weights, scaled_dense, assembled_matrix,
        metrics_overall_by_source, roc_auc_by_source, threshold_sweep, threshold_pick, recall_cost,
        best_baseline_vs_ensemble, synthetic_slice,
        test_scores, model_metrics, model_threshold_sweep, feature_importance_top20, dense_importance,
        evaluation_report, score_mails, explain_top10,
        explanation_checks, test_score_checks, importance_checks, model_metric_checks, threshold_checks, report_checks, matrix_checks, meta_model_checks,
        threshold_summary_checks,
        response_checks, rescued_request_checks, stream_batch_checks, formatted_metrics, feature_spot_check,
        mbox_file_states, mbox_without_mirror_files, mbox_messages, mbox_message_total, eml_messages, json_tree_texts, csv_round_trip, materialise_status,
        stream_score_eml, stream_score_json,
    ]
}
