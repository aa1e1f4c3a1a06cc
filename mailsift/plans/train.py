"""Splits to fitted detector, metrics, tuned threshold and report (feature, train, tune, report stages).

Order of use: vocabulary, scaler and base models see train only; the meta-model and the
threshold see val; test is only judged.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailsift.functions import fixed_values as V
from mailsift.operators import explain, metrics, models
from mailsift.operators.assemble import FeatureModel, Scaler, with_dense_features
from mailsift.operators.models import BASE_MODELS, Detector, TrainingOptions
from mailsift.operators.tfidf import Tfidf
from mailsift.workspace import at_once, materialise


@dataclass
class Trained:
    detector: Detector
    val_scores: DataFrame
    test_scores: DataFrame


def train(splits: DataFrame, out: str, options: TrainingOptions = TrainingOptions(),
          max_terms: int = V.MAX_VOCABULARY) -> Trained:
    """Fit everything and write features, models and score tables below ``out``."""
    spark = splits.sparkSession
    # The scaler and the features both need the dense block; it is computed once, while the vocabulary is counted.
    plain = splits
    splits, tfidf = at_once(
        spark, lambda: materialise(with_dense_features(plain), f"{out}/dense", ["split"]),
        lambda: Tfidf.fit(plain.filter("split = 'train'"), max_terms=max_terms))
    fitted = FeatureModel(tfidf, Scaler.fit(splits.filter("split = 'train'")))
    kept = ["row_id", "source_dataset", "label", "included_in_training", "split", "features"]
    # Training reads its input many times; the features are computed and written once.
    features = models.labelled(materialise(fitted.transform(splits).select(*kept), f"{out}/features", ["split"]))

    base = models.fit_base_models(features.filter("split = 'train'"), options)
    # Base scores of val and test come from one pass; the meta-model sees those of val only.
    judged = models.with_base_scores(features.filter(F.col("split").isin("val", "test")), base)
    judged = materialise(judged.drop("features"), f"{out}/base_scores", ["split"])
    of = lambda split: judged.filter(F.col("split") == split).drop("split")
    detector = Detector(fitted, base, models.fit_meta_model(of("val"))).save(
        spark, f"{out}/detector", explain.background(features.filter("split = 'train'")))

    def scores(split: str) -> DataFrame:
        return materialise(models.score_table(models.with_ensemble_score(of(split), detector.meta), detector.names), f"{out}/{split}_scores")

    val_scores, test_scores = at_once(spark, lambda: scores("val"), lambda: scores("test"))
    return Trained(detector, val_scores, test_scores)


def select_threshold(val_scores: DataFrame, target: float = V.SELECTED_FPR_TARGET) -> float:
    """The ensemble's threshold for the FPR target; an error if no threshold reaches it."""
    sweep = metrics.threshold_sweep(val_scores.filter(F.col("model") == metrics.ENSEMBLE))
    picked = metrics.pick_thresholds(sweep, [target]).first()
    if picked is None or picked.threshold is None:
        raise ValueError(f"no threshold in the sweep has a validation FPR below {target}")
    return picked.threshold


def tuning_report(val_scores: DataFrame, test_scores: DataFrame, selected: float) -> DataFrame:
    """One row: picks on val, and test at the default and the selected threshold."""
    ensemble = lambda df: df.filter(F.col("model") == metrics.ENSEMBLE)
    sweep = metrics.threshold_sweep(ensemble(val_scores))
    picks = metrics.pick_thresholds(sweep).drop("model")
    parts = {
        "validation_default": sweep.filter(F.col("threshold") == V.DEFAULT_CUT).drop("model"),
        "validation_fpr_targets": picks,
        "test_at_default": metrics.full_metrics(ensemble(test_scores), V.DEFAULT_CUT).drop("model"),
        "test_at_selected": metrics.full_metrics(ensemble(test_scores), selected).drop("model"),
        "test_recall_cost": metrics.recall_cost(ensemble(test_scores), selected).drop("model"),
    }
    return _document(parts).withColumn("selected_threshold", F.lit(selected))


def evaluate(splits: DataFrame, out: str) -> Trained:
    """Score val and test with the detector stored below ``out``; nothing is fitted."""
    detector = Detector.load(splits.sparkSession, f"{out}/detector")
    judged = splits.filter(F.col("split").isin("val", "test"))
    scored = detector.score_features(models.labelled(detector.features.transform(judged))).drop("features", "text")
    stored = materialise(scored, f"{out}/evaluated", ["split"])
    table = lambda split: models.score_table(stored.filter(F.col("split") == split), detector.names)
    return Trained(detector, table("val"), table("test"))


def benchmark(splits: DataFrame, out: str, retrain: bool = False, options: TrainingOptions = TrainingOptions(),
              max_terms: int = V.MAX_VOCABULARY) -> DataFrame:
    """The report of the stored models, or of newly trained ones. Without a meta-model the ensemble
    and the threshold summary are left out."""
    result = train(splits, out, options, max_terms) if retrain else evaluate(splits, out)
    selected = None
    if result.detector.meta is not None:
        sweep = metrics.threshold_sweep(result.val_scores.filter(F.col("model") == metrics.ENSEMBLE))
        picked = metrics.pick_thresholds(sweep, [V.SELECTED_FPR_TARGET]).first()
        selected = picked.threshold if picked is not None else None
    return evaluation_report(result, selected, retrain)


def evaluation_report(trained: Trained, selected: float | None, retrained: bool = True) -> DataFrame:
    """One row: all models on test, headline, slice, comparison, importance and, for a selected
    threshold, the threshold summary."""
    spark = trained.test_scores.sparkSession
    results = metrics.full_metrics(trained.test_scores)
    overall = results.filter(F.col("source_dataset").isNull())
    headline = overall.select("model", "precision", "recall", "f1", "false_positive_rate", "auc_roc")
    importance = models.importances(trained.detector, spark)
    parts = {
        "results_by_model": results,
        "headline": headline,
        "synthetic_slice": metrics.slice_summary(results),
        "ensemble_against_baselines": metrics.compare_with_baselines(overall, BASE_MODELS),
        "top_features": models.top_importances(importance),
        "dense_share": models.dense_share(importance),
    }
    if selected is not None:
        parts["threshold_tuning"] = tuning_report(trained.val_scores, trained.test_scores, selected)
    return _document(parts).select(
        F.current_timestamp().alias("created_utc"),
        F.lit(retrained).alias("retrained"),
        F.lit(V.PHISHING).alias("positive_class"),
        F.lit(V.DEFAULT_CUT).alias("decision_threshold"),
        F.lit(list(trained.detector.names)).alias("models_evaluated"),
        "*",
    )


def _document(parts: dict[str, DataFrame]) -> DataFrame:
    """Put small tables (a few rows per model) side by side as arrays of one report row."""
    columns = [
        part.agg(F.collect_list(F.struct(*part.columns)).alias(name)) for name, part in parts.items()
    ]
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), columns)
    return stacked.agg(*[F.first(name, ignorenulls=True).alias(name) for name in parts])
