"""Confusion-matrix metrics, AUC, threshold sweep and model comparison.

Input is a score table (model, row_id, source_dataset, y, score). Rows are reduced to counts
first; everything after works on small tables.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mailsift.functions import fixed_values as V
from mailsift.operators.ordering import running_total_below
from mailsift.workspace import materialise, run_dir

CELLS = ["tn", "fp", "fn", "tp"]
ENSEMBLE = "stacked_ensemble"


def ratio(numerator: Column, denominator: Column) -> Column:
    return numerator / F.nullif(denominator, F.lit(0))


def precision() -> Column:
    """NULL without phishing rows; 0 if there are some but none is predicted."""
    return F.when(F.col("tp") + F.col("fn") > 0, F.coalesce(ratio(F.col("tp"), F.col("tp") + F.col("fp")), F.lit(0.0)))


def recall() -> Column:
    return ratio(F.col("tp"), F.col("tp") + F.col("fn"))


def f1() -> Column:
    return ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")) * F.when(
        F.col("tp") + F.col("fn") > 0, F.lit(1.0)
    )


def false_positive_rate() -> Column:
    return ratio(F.col("fp"), F.col("fp") + F.col("tn"))


def notes() -> Column:
    return F.array_compact(F.array(
        F.when(F.col("tp") + F.col("fn") == 0, F.lit(V.NOTE_NO_PHISHING)),
        F.when(F.col("tn") + F.col("fp") == 0, F.lit(V.NOTE_NO_LEGITIMATE)),
    ))


def with_rates(cells: DataFrame) -> DataFrame:
    """Append precision, recall, f1 and false_positive_rate to the four cells."""
    return cells.withColumns(
        {"precision": precision(), "recall": recall(), "f1": f1(), "false_positive_rate": false_positive_rate()}
    )


def confusion(scores: DataFrame, groups: list[str], predicted: Column) -> DataFrame:
    actual = F.col("y") == 1
    return scores.groupBy(*groups).agg(
        F.count_if(~actual & ~predicted).alias("tn"),
        F.count_if(~actual & predicted).alias("fp"),
        F.count_if(actual & ~predicted).alias("fn"),
        F.count_if(actual & predicted).alias("tp"),
    )


def overall_and_by_source(by_source: DataFrame, values: list[str]) -> DataFrame:
    """Add the overall level (source_dataset NULL) to additive counts per model and source."""
    return by_source.groupingSets(
        [[F.col("model")], [F.col("model"), F.col("source_dataset")]], F.col("model"), F.col("source_dataset")
    ).agg(*[F.sum(v).alias(v) for v in values])


def metrics(scores: DataFrame, cut: float = V.DEFAULT_CUT) -> DataFrame:
    """All metrics at one cut, overall and per source, without AUC."""
    cells = overall_and_by_source(confusion(scores, ["model", "source_dataset"], F.col("score") >= cut), CELLS)
    n = F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")
    return with_rates(cells).withColumns(
        {
            "n": n,
            "n_phishing": F.col("fn") + F.col("tp"),
            "n_legitimate": F.col("tn") + F.col("fp"),
            "accuracy": ratio(F.col("tp") + F.col("tn"), n),
            "notes": notes(),
        }
    )


def roc_auc(scores: DataFrame) -> DataFrame:
    """Exact area under the ROC curve, ties counted half, overall and per source; NULL for one class.

    Equal scores are merged first. The number of legitimate rows below each distinct score comes
    from a bucketed running sum, so no group of scores is sorted in one task.
    """
    per_score = scores.groupBy("model", "source_dataset", "score").agg(
        F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") == 0).alias("neg")
    )
    levels = per_score.groupingSets(
        [[F.col("model"), F.col("score")], [F.col("model"), F.col("source_dataset"), F.col("score")]],
        F.col("model"), F.col("source_dataset"), F.col("score"),
    ).agg(
        F.sum("pos").alias("pos"), F.sum("neg").alias("neg"),
        F.coalesce("source_dataset", F.lit("")).alias("level"),
    ).select("model", "level", "score", "pos", "neg")
    # Written once: it is read for the bucket borders, the bucket totals and the ranks.
    levels = materialise(levels, f"{run_dir(scores.sparkSession, 'auc')}/levels")
    ranked = running_total_below(levels, ["model", "level"], "score", "neg", "neg_below")
    pairs = F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") / 2))
    return ranked.groupBy("model", "level").agg(
        (pairs / F.nullif(F.sum("pos") * F.sum("neg"), F.lit(0))).alias("auc_roc")
    ).select("model", F.nullif("level", F.lit("")).alias("source_dataset"), "auc_roc")


def full_metrics(scores: DataFrame, cut: float = V.DEFAULT_CUT) -> DataFrame:
    """Metrics and AUC together; both sides have one row per model and source."""
    auc = roc_auc(scores).withColumnsRenamed({"model": "_model", "source_dataset": "_source"})
    base = metrics(scores, cut)
    same = (F.col("model") == F.col("_model")) & F.col("source_dataset").eqNullSafe(F.col("_source"))
    return base.join(auc, same, "left").drop("_model", "_source")


def threshold_grid() -> list[float]:
    """0.50 to 0.98 by 0.01 and 0.990 to 0.999 by 0.001: 59 values."""
    return sorted({i / 100 for i in range(50, 99)} | {i / 1000 for i in range(990, 1000)})


def threshold_sweep(scores: DataFrame, thresholds: list[float] | None = None) -> DataFrame:
    """Metrics of every model at every threshold.

    Each score falls between two thresholds; counts per interval are accumulated from the top, so
    scores are read once and never paired with thresholds.
    """
    grid = thresholds or threshold_grid()
    placed = Bucketizer(
        splits=[float("-inf"), *grid, float("inf")], inputCol="score", outputCol="interval"
    ).transform(scores.select("model", "y", F.col("score").cast("double").alias("score")))
    counted = placed.groupBy("model", F.col("interval").cast("int").alias("interval")).agg(
        F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") == 0).alias("neg")
    )
    # Every interval must exist, also those no score falls into; a model has at most 60 of them.
    steps = F.array(*[F.struct(F.lit(i).alias("interval"), F.lit(t).alias("threshold")) for i, t in enumerate([None, *grid])])
    per_model = counted.groupBy("model").agg(
        F.map_from_entries(F.collect_list(F.struct("interval", F.struct("pos", "neg")))).alias("counts")
    )
    here = F.col("counts")[F.col("interval")]
    filled = per_model.select("model", "counts", F.inline(steps)).select(
        "model", "interval", "threshold",
        F.coalesce(here["pos"], F.lit(0)).alias("pos"), F.coalesce(here["neg"], F.lit(0)).alias("neg"),
    )
    above = Window.partitionBy("model").orderBy(F.desc("interval"))
    below = Window.partitionBy("model").orderBy("interval").rowsBetween(Window.unboundedPreceding, -1)
    cells = filled.select(
        "model", "threshold",
        F.coalesce(F.sum("neg").over(below), F.lit(0)).alias("tn"), F.sum("neg").over(above).alias("fp"),
        F.coalesce(F.sum("pos").over(below), F.lit(0)).alias("fn"), F.sum("pos").over(above).alias("tp"),
    ).filter(F.col("threshold").isNotNull())
    return with_rates(cells)


def pick_thresholds(sweep: DataFrame, targets: list[float] = V.FPR_TARGETS) -> DataFrame:
    """Per model and target: the threshold of highest recall with FPR below the target.

    Ties go to the lowest threshold. A target nothing reaches has NULLs.
    """
    chosen = ["threshold", "precision", "recall", "f1", "false_positive_rate", *CELLS]
    per_target = sweep.select("*", F.explode(F.array(*map(F.lit, targets))).alias("fpr_target"))
    qualifies = (F.col("false_positive_rate") < F.col("fpr_target")) & F.col("recall").isNotNull()
    best = F.max_by(
        F.when(qualifies, F.struct(*chosen)), F.when(qualifies, F.struct("recall", -F.col("threshold")))
    )
    return per_target.groupBy("model", "fpr_target").agg(best.alias("best")).select("model", "fpr_target", "best.*")


def recall_cost(scores: DataFrame, selected: float, default: float = V.DEFAULT_CUT) -> DataFrame:
    """What the stricter threshold costs: recall lost and phishing rows missed on top."""
    per_model = scores.groupBy("model").agg(
        F.count_if(F.col("y") == 1).alias("n_phishing"),
        F.count_if((F.col("y") == 1) & (F.col("score") >= default)).alias("found_default"),
        F.count_if((F.col("y") == 1) & (F.col("score") >= selected)).alias("found_selected"),
    )
    drop = ratio(F.col("found_default"), F.col("n_phishing")) - ratio(F.col("found_selected"), F.col("n_phishing"))
    return per_model.select(
        "model", "n_phishing", drop.alias("recall_drop"),
        F.rint(drop * F.col("n_phishing")).cast("bigint").alias("additional_missed"),
    )


def compare_with_baselines(overall: DataFrame, baselines: list[str], ensemble: str = ENSEMBLE) -> DataFrame:
    """Best single model by F1, FPR and AUC against the ensemble, with deltas. One row.

    Equal values go to the model listed first. Missing values never win; without the ensemble the
    comparison is empty.
    """
    place = F.array_position(F.array(*map(F.lit, baselines)), F.col("model"))
    single = F.col("model").isin(baselines)

    def best(metric: str, highest: bool) -> Column:
        value = F.col(metric)
        usable = single & value.isNotNull()
        order = F.struct((value if highest else -value).alias("v"), (-place).alias("p"))
        return F.max_by(F.when(usable, F.struct("model", value.alias("value"))), F.when(usable, order))

    def of_ensemble(metric: str) -> Column:
        return F.max(F.when(F.col("model") == ensemble, F.col(metric)))

    kinds = [("f1", "f1", True), ("fpr", "false_positive_rate", False), ("auc", "auc_roc", True)]
    summary = overall.agg(
        F.count_if(F.col("model") == ensemble).alias("ensembles"),
        *[best(metric, highest).alias(f"best_{short}") for short, metric, highest in kinds],
        *[of_ensemble(metric).alias(f"ensemble_{short}") for short, metric, _ in kinds],
    ).filter("ensembles > 0")
    columns = []
    for short, _, highest in kinds:
        own, other = F.col(f"ensemble_{short}"), F.col(f"best_{short}.value")
        wins = own > other if highest else own < other
        columns += [
            F.col(f"best_{short}.model").alias(f"best_baseline_by_{short}"),
            other.alias(f"best_baseline_{short}"),
            own.alias(f"ensemble_{short}"),
            (own - other).alias(f"{short}_delta"),
            F.coalesce(wins, F.lit(False)).alias(f"ensemble_better_{short}"),
        ]
    return summary.select(*columns)


def slice_summary(by_source: DataFrame, source: str = V.SYNTHETIC_HEALTHCARE) -> DataFrame:
    """FPR and recall of every model on one source."""
    return by_source.filter(F.col("source_dataset") == source).select(
        "model", F.col("false_positive_rate").alias("fpr"), "recall"
    )


def shown(value: Column) -> Column:
    """Four decimals for reports, n/a for missing."""
    return F.coalesce(F.format_number(value, 4), F.lit("n/a"))
