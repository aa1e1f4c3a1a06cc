"""Base classifiers, stacked meta-model, scores and feature importance."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mailsift.functions import fixed_values as V
from mailsift.operators import boosting, forest, kernels
from mailsift.operators.assemble import FeatureModel
from mailsift.operators.metrics import ENSEMBLE
from mailsift.workspace import at_once, ensure_checkpoint_dir

BASE_MODELS = ["random_forest", "boosting_a", "boosting_b"]
_LOADERS = {
    "random_forest": forest.Forest,
    "boosting_a": boosting.Boosted,
    "boosting_b": boosting.Boosted,
}


@dataclass(frozen=True)
class TrainingOptions:
    """Full-size settings; trials pass smaller ones."""

    trees: int = 200
    forest_depth: int | None = None
    rounds: int = 200
    boosting_depth: int = 6
    step: float = 0.1
    seed: int = V.SEED


def growths(options: TrainingOptions) -> dict[str, boosting.Growth]:
    """Level-wise trees with L2, and best-leaf-first trees of 31 leaves of at least 20 rows. Both look at all features."""
    same = dict(rounds=options.rounds, depth=options.boosting_depth, step=options.step)
    return {
        "boosting_a": boosting.Growth(**same, l2=1.0, least_hessian=1.0),
        "boosting_b": boosting.Growth(**same, l2=0.0, least_hessian=1e-3, least_rows=20, leaves=31),
    }


def labelled(features: DataFrame) -> DataFrame:
    """Only rows meant for training, with y = 1 for phishing."""
    return features.filter(F.col("included_in_training")).withColumn(
        "y", (F.col("label") == V.PHISHING).cast("double")
    )


# Least rows of a training task, as the stages of training are many and short.
TRAINING_TASK_ROWS = 4_000


def fit_base_models(train: DataFrame, options: TrainingOptions) -> dict:
    """Fit all base models. They do not depend on each other and are fitted side by side.

    Boosting begins first: its rounds follow each other, and the forest's many tasks fill the cores beside them.
    """
    spark = train.sparkSession
    ensure_checkpoint_dir(spark)
    rows = train.select("features", "y")
    count = rows.count()
    # Few rows make few tasks; many keep the partitions they are read in.
    if count < TRAINING_TASK_ROWS * spark.sparkContext.defaultParallelism:
        rows = rows.coalesce(max(1, -(-count // TRAINING_TASK_ROWS)))
    rows = rows.persist()
    first = rows.select("features").first()
    bins = boosting.find_bins(rows, first.features.size if first else 0)
    blocks = boosting.write_blocks(rows, bins)
    rows.unpersist()
    size = boosting.sizes(blocks)
    entries = blocks.agg(F.sum(F.length("bin"))).first()[0] or 0
    table = kernels.table(blocks, bins, count, entries // np.dtype(np.int32).itemsize)
    fits = {name: lambda growth=growth: boosting.fit(rows, growth, bins, blocks, size=size, table=table) for name, growth in growths(options).items()}
    fits["random_forest"] = lambda: forest.fit(rows, bins, blocks, options.trees, options.forest_depth, options.seed, table=table)
    fitted = dict(zip(fits, at_once(spark, *fits.values())))
    if table is not None:
        table.blocks.unpersist()
    return {name: fitted[name] for name in BASE_MODELS}


def with_base_scores(features: DataFrame, models: dict) -> DataFrame:
    """Append one phishing probability per base model."""
    scored = features
    for name, model in models.items():
        scored = scored.withColumn(name, boosting.probability(model))
    return scored


def _with_meta_features(scored: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=BASE_MODELS, outputCol="_base_scores").transform(scored)


def fit_meta_model(val_scores: DataFrame) -> LogisticRegressionModel:
    """Logistic regression on the base probabilities of the validation rows, unit-strength L2."""
    estimator = LogisticRegression(
        featuresCol="_base_scores", labelCol="y", regParam=1.0 / max(val_scores.count(), 1),
        elasticNetParam=0.0, standardization=False, maxIter=200, tol=1e-8,
    )
    return estimator.fit(_with_meta_features(val_scores).select("_base_scores", "y"))


def with_ensemble_score(scored: DataFrame, meta: LogisticRegressionModel) -> DataFrame:
    named = meta.copy().setPredictionCol("").setRawPredictionCol("_raw").setProbabilityCol("_probability")
    result = named.transform(_with_meta_features(scored)).withColumn(ENSEMBLE, vector_to_array("_probability")[1])
    return result.drop("_base_scores", "_raw", "_probability")


@dataclass
class Detector:
    """Fitted features, base models and, if trained, the meta-model."""

    features: FeatureModel
    base: dict
    meta: LogisticRegressionModel | None = None
    path: str | None = None
    # What explanations need, sent to the workers once.
    explainers: object | None = None

    @property
    def names(self) -> list[str]:
        return [*self.base, *([ENSEMBLE] if self.meta is not None else [])]

    def score_features(self, features: DataFrame) -> DataFrame:
        scored = with_base_scores(features, self.base)
        return with_ensemble_score(scored, self.meta) if self.meta is not None else scored

    def save(self, spark, path: str, background: DataFrame | None = None) -> "Detector":
        """Store the detector, with the rows that the forest's explanations refer to."""
        self.features.save(spark, f"{path}/features")
        for name, model in self.base.items():
            model.save(spark, f"{path}/{name}")
        if self.meta is not None:
            self.meta.write().overwrite().save(f"{path}/meta")
        if background is not None:
            background.coalesce(1).write.mode("overwrite").parquet(f"{path}/background")
        self.path = path
        return self

    @classmethod
    def load(cls, spark, path: str) -> "Detector":
        """A missing base model is an error; a missing meta-model only drops the ensemble."""
        from mailsift.sources.files import path_exists

        missing = [name for name in BASE_MODELS if not path_exists(spark, f"{path}/{name}/metadata")]
        if missing:
            raise FileNotFoundError(f"missing base models: {', '.join(missing)}; train first")
        meta = LogisticRegressionModel.load(f"{path}/meta") if path_exists(spark, f"{path}/meta/metadata") else None
        base = {name: kind.load(spark, f"{path}/{name}") for name, kind in _LOADERS.items()}
        return cls(FeatureModel.load(spark, f"{path}/features"), base, meta, path)


def score_table(scored: DataFrame, models: list[str]) -> DataFrame:
    """Long form (model, row_id, source_dataset, y, score)."""
    return scored.select("row_id", "source_dataset", F.col("y").cast("int").alias("y"), *models).unpivot(
        ["row_id", "source_dataset", "y"], models, "model", "score"
    )


def importances(detector: Detector, spark) -> DataFrame:
    """(model, feature_idx, feature, importance) of all used features; sums to 1 per model."""
    rows = []
    for name, model in detector.base.items():
        rows += [(name, int(i), float(model.importance[i])) for i in np.flatnonzero(model.importance)]
    table = spark.createDataFrame(rows, "model string, feature_idx int, importance double")
    names = detector.features.name_table(spark)
    return table.join(names, "feature_idx").select("model", "feature_idx", F.col("report_name").alias("feature"), "importance")


def top_importances(table: DataFrame, top: int = V.TOP_FEATURES) -> DataFrame:
    order = Window.partitionBy("model").orderBy(F.desc("importance"), "feature")
    return table.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def dense_share(table: DataFrame) -> DataFrame:
    """Importance held by the dense features."""
    dense = F.col("feature").isin(V.DENSE_FEATURES)
    return table.groupBy("model").agg(F.sum(F.when(dense, F.col("importance")).otherwise(0.0)).alias("dense_importance"))
