"""Dense features, scaling and the final feature vector."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailsift.functions import fixed_values as V
from mailsift.functions.text_features import with_text_features
from mailsift.functions.url_features import with_url_features
from mailsift.operators.tfidf import Tfidf
from mailsift.workspace import bucket_count, bucketed, local_table


def with_dense_features(df: DataFrame, text: str = "text") -> DataFrame:
    """Text and URL features side by side as doubles.

    Both are computed from the same row, so putting them together needs no join. Rows that were stored with them keep them.
    """
    if set(V.DENSE_FEATURES) <= set(df.columns):
        return df
    featured = with_url_features(with_text_features(df, text), text)
    return featured.withColumns({c: F.col(c).cast("double") for c in V.DENSE_FEATURES})


def join_features(text_features: DataFrame, url_features: DataFrame) -> DataFrame:
    """Put separately stored feature tables together, one to one by row id.

    Tables that ``stored_features`` wrote are joined bucket by bucket, without a shuffle.
    """
    return text_features.join(url_features.hint("merge"), "row_id")


def stored_features(*tables: DataFrame) -> list[DataFrame]:
    """Feature tables written by row id, in as many buckets each as the first has need of."""
    buckets = bucket_count(tables[0])
    return [bucketed(table, "row_id", buckets, "features") for table in tables]


def feature_means(df: DataFrame, features: list[str]) -> DataFrame:
    """Means by label and by source and label (A4) from one pass over the rows.

    Sums per source and label are few; the label level is added up from them.
    """
    fine = df.groupBy("source_dataset", "label").agg(
        F.count("*").alias("n"), *[F.sum(F.col(c).cast("double")).alias(c) for c in features]
    )
    return fine.groupingSets(
        [[F.col("label")], [F.col("source_dataset"), F.col("label")]], F.col("source_dataset"), F.col("label")
    ).agg(F.sum("n").alias("rows"), *[(F.sum(c) / F.sum("n")).alias(f"mean_{c}") for c in features])


def zero_url_breakdown(df: DataFrame) -> DataFrame:
    """Mails without URLs per source and label, and their share."""
    none = F.col("url_count") == 0
    return df.groupBy("source_dataset", "label").agg(
        F.count_if(none).alias("zero_urls"), F.count("*").alias("total"), F.avg(none.cast("double")).alias("zero_share")
    )


def scaler_statistics(train: DataFrame) -> DataFrame:
    """One row: mean and population standard deviation of every dense feature."""
    return train.agg(
        *[F.avg(c).alias(f"mean_{c}") for c in V.DENSE_FEATURES],
        *[F.stddev_pop(c).alias(f"std_{c}") for c in V.DENSE_FEATURES],
    )


def scaled(value: Column, mean: float, std: float) -> Column:
    """A constant feature is only centred."""
    return (value - F.lit(mean)) / F.lit(std or 1.0)


@dataclass
class Scaler:
    means: dict[str, float]
    stds: dict[str, float]

    @classmethod
    def fit(cls, train: DataFrame) -> "Scaler":
        return cls.from_table(scaler_statistics(train))

    @classmethod
    def from_table(cls, table: DataFrame) -> "Scaler":
        row = table.first()
        return cls(
            {c: row[f"mean_{c}"] for c in V.DENSE_FEATURES}, {c: row[f"std_{c}"] for c in V.DENSE_FEATURES}
        )

    def table(self, spark) -> DataFrame:
        names = [f"mean_{c}" for c in V.DENSE_FEATURES] + [f"std_{c}" for c in V.DENSE_FEATURES]
        return spark.createDataFrame([(*self.means.values(), *self.stds.values())], ", ".join(f"{n} double" for n in names))

    def transform(self, df: DataFrame) -> DataFrame:
        """Append ``scaled_<feature>`` columns."""
        return df.withColumns(
            {f"scaled_{c}": scaled(F.col(c), self.means[c], self.stds[c]) for c in V.DENSE_FEATURES}
        )


@dataclass
class FeatureModel:
    """Everything fitted on train that turns mail text into the final feature vector."""

    tfidf: Tfidf
    scaler: Scaler

    @classmethod
    def fit(cls, train: DataFrame, max_terms: int = V.MAX_VOCABULARY) -> "FeatureModel":
        return cls(Tfidf.fit(train, max_terms=max_terms), Scaler.fit(with_dense_features(train)))

    @property
    def names(self) -> list[str]:
        return [*self.tfidf.terms, *V.DENSE_FEATURES]

    def transform(self, df: DataFrame) -> DataFrame:
        """Append ``features``: TF-IDF entries, then the scaled dense block. TF-IDF stays sparse
        and unscaled. No shuffle: mails keep their partition."""
        block = self.scaler.transform(with_dense_features(df))
        assembled = VectorAssembler(
            inputCols=["tfidf", *[f"scaled_{c}" for c in V.DENSE_FEATURES]], outputCol="features"
        ).transform(self.tfidf.transform(block))
        return assembled.drop("tfidf", *[f"scaled_{c}" for c in V.DENSE_FEATURES])

    def name_table(self, spark) -> DataFrame:
        """(feature_idx, feature, report_name); reports mark terms with a prefix."""
        size = len(self.tfidf.terms)
        rows = [(i, n, f"tfidf:{n}" if i < size else n) for i, n in enumerate(self.names)]
        return local_table(spark, rows, "feature_idx int, feature string, report_name string")

    def save(self, spark, path: str) -> None:
        self.tfidf.save(f"{path}/tfidf")
        self.scaler.table(spark).write.mode("overwrite").parquet(f"{path}/scaler")

    @classmethod
    def load(cls, spark, path: str) -> "FeatureModel":
        return cls(Tfidf.load(f"{path}/tfidf"), Scaler.from_table(spark.read.parquet(f"{path}/scaler")))


def spot_check(df: DataFrame, row_ids: list, columns: list[str]) -> DataFrame:
    return df.filter(F.col("row_id").isin(row_ids)).select("row_id", *columns)
