"""Per-mail explanations of the tree ensembles: Shapley values.

Both boosting models are explained in their margin (log-odds), path-dependent; the forest in its probability, against
a seeded background of train rows that is stored with the detector. Base value and contributions of all
features give the model's score exactly. All that is needed is the mail's own feature vector, so nothing is
shuffled and ids play no part. The models' arrays are sent to the tasks, as scoring does with the models.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mailsift.functions.fixed_values import BACKGROUND_ROWS, TOP_EXPLANATIONS
from mailsift.operators import kernels
from mailsift.operators.models import Detector
from mailsift.operators.ordering import draw_key
from mailsift.operators.trees import BackgroundShapley, PathShapley, rows_of

ROWS_AT_ONCE = 256
# Nodes of a forest from which on its values are found in Java.
HELPED_NODES = 1 << 16

_ENTRY = "struct<rank: int, feature: string, contribution: double, direction: string, bar_width: double>"
EXPLAINED = f"array<struct<model: string, base: double, total: double, top: array<{_ENTRY}>>>"


def background(train: DataFrame, rows: int = BACKGROUND_ROWS) -> DataFrame:
    """``features`` of so many train rows, the first in the seeded order of their ids."""
    return train.select("features", draw_key(F.col("row_id")).alias("draw"), "row_id").orderBy("draw", "row_id").limit(rows).select("features")


def explainers(detector: Detector, spark: SparkSession) -> dict:
    """One explainer per base model, in the detector's order."""
    out = {}
    for name, model in detector.base.items():
        if name == "random_forest":
            # At most BACKGROUND_ROWS rows.
            rows = spark.read.parquet(f"{detector.path}/background").toArrow().column("features").combine_chunks()
            out[name] = BackgroundShapley(model.trees, rows_of(rows, model.trees.used_features()))
        else:
            out[name] = PathShapley(model.trees, model.base)
    return out


def strongest(values: np.ndarray, names: list[str], top: int) -> list[dict]:
    """The strongest contributions in order, ties by name's place, with direction and relative bar width."""
    found = np.flatnonzero(values)
    found = found[np.lexsort((found, -np.abs(values[found])))[:top]]
    widest = float(np.abs(values[found[0]])) if len(found) else 0.0
    return [
        {"rank": k + 1, "feature": names[f], "contribution": float(values[f]),
         "direction": "phishing" if values[f] > 0 else "legitimate",
         "bar_width": float(abs(values[f])) / widest * 100}
        for k, f in enumerate(found.tolist())
    ]


def with_explanations(scored: DataFrame, detector: Detector, top: int = TOP_EXPLANATIONS) -> DataFrame:
    """Append ``explained``: per model the base value, the sum of all contributions and the strongest ones.

    ``scored`` has the mail's ``features``.
    """
    spark = scored.sparkSession
    if detector.explainers is None:
        made, every = explainers(detector, spark), detector.features.names
        names = {model: [every[f] for f in one.features] for model, one in made.items()}
        helped = made["random_forest"].nodes >= HELPED_NODES
        detector.explainers = spark.sparkContext.broadcast((made, names, uuid.uuid4().hex, kernels.code(spark) if helped else None))
    shared = detector.explainers
    entry = pa.struct([("rank", pa.int32()), ("feature", pa.string()), ("contribution", pa.float64()),
                       ("direction", pa.string()), ("bar_width", pa.float64())])
    kind = pa.list_(pa.struct([("model", pa.string()), ("base", pa.float64()), ("total", pa.float64()), ("top", pa.list_(entry))]))

    def explain(vectors: pa.Array) -> pa.Array:
        models, labels, token, classes = shared.value
        # Nodes, paths, and values in and out.
        java = kernels.beside(token, classes, 64 * models["random_forest"].nodes + (256 << 20)) if classes else None
        out: list[list[dict]] = []
        for start in range(0, len(vectors), ROWS_AT_ONCE):
            part = vectors.slice(start, ROWS_AT_ONCE)
            per_model = [(n, m.base, m.values(rows_of(part, m.used), java)) for n, m in models.items()]
            out += [[{"model": n, "base": base, "total": float(v[i].sum()), "top": strongest(v[i], labels[n], top)}
                     for n, base, v in per_model] for i in range(len(part))]
        return pa.array(out, kind)

    return scored.withColumn("explained", F.arrow_udf(explain, EXPLAINED)("features"))


def top_contributions(explained: DataFrame) -> DataFrame:
    """(row_id, model, rank, feature, contribution, direction, bar_width), row by row."""
    per_model = explained.select("row_id", F.inline("explained"))
    return per_model.select("row_id", "model", F.inline("top"))


def explanation_map() -> Column:
    """Model -> its top contributions in order, from ``explained``."""
    return F.map_from_entries(F.transform("explained", lambda m: F.struct(m.model, F.transform(
        m.top, lambda e: F.struct(e.feature.alias("feature"), e.contribution.alias("contribution"),
                                  e.direction.alias("direction"))))))
