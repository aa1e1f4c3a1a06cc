"""Exact ranks and running sums over all rows without one big sorted group.

Rows are put into ordered buckets. Bucket totals are few and are accumulated in a small table;
within a bucket a window suffices. The result is exact for any number of buckets.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mailsift.functions.fixed_values import SEED
from mailsift.workspace import sized

# Rows of a bucket, about; the number of buckets follows from the counted rows.
BUCKET_ROWS = 50_000


def _draw_bucket_chars(rows: int) -> int:
    """Leading hexadecimal digits of a draw key that cut the rows into buckets; a draw key is uniform."""
    chars = 1
    while rows > BUCKET_ROWS * 16**chars:
        chars += 1
    return chars


def draw_key(row_id: Column, seed: int = SEED) -> Column:
    """A uniform, repeatable sort key per row; equal on every engine and partitioning."""
    return F.md5(F.concat_ws("-", F.lit(str(seed)), row_id.cast("string")))


def draw_cuts(df: DataFrame, strata: list[str], ranks: dict[str, Column], seed: int = SEED) -> DataFrame:
    """For every stratum and named rank r, the draw key of its r-th row in draw order.

    ``ranks`` maps a name to a Column over ``stratum_rows`` and the strata. The result has the
    strata, ``stratum_rows`` and per name a struct (draw, row_id); NULL where r is 0. Taking all
    rows up to that key draws exactly r rows, so no row but those of the cut buckets is sorted.
    """
    keyed = df.select(*strata, "row_id", draw_key(F.col("row_id"), seed).alias("draw")).withColumn(
        "bucket", F.substring("draw", 1, _draw_bucket_chars(df.count()))
    )
    whole = Window.partitionBy(*strata)
    running = whole.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = keyed.groupBy(*strata, "bucket").agg(F.count("*").alias("n")).select(
        *strata, "bucket", "n",
        F.coalesce(F.sum("n").over(running), F.lit(0)).alias("before"),
        F.sum("n").over(whole).alias("stratum_rows"),
    )
    wanted = buckets.select(
        "*",
        F.explode(F.array(*[
            F.struct(F.lit(name).alias("cut"), rank.cast("bigint").alias("rank")) for name, rank in ranks.items()
        ])).alias("w"),
    ).select("*", "w.cut", "w.rank")
    hit = (F.col("rank") > F.col("before")) & (F.col("rank") <= F.col("before") + F.col("n"))
    # One row per stratum and cut: where the cut falls, NULL for rank 0. Spark sees that these rows are
    # few and broadcasts them, so finding the cut rows filters the keys instead of shuffling them.
    places = sized(
        wanted.groupBy(*strata, "cut").agg(
            F.max("stratum_rows").alias("stratum_rows"),
            F.max(F.when(hit, F.struct("bucket", "rank", "before"))).alias("place"),
        ).select(*strata, "cut", "stratum_rows", "place.*"),
        "places",
    )
    in_bucket = Window.partitionBy(*strata, "bucket", "cut").orderBy("draw", "row_id")
    cut_rows = (
        keyed.join(places.filter(F.col("bucket").isNotNull()), [*strata, "bucket"])
        .withColumn("position", F.col("before") + F.row_number().over(in_bucket))
        .filter(F.col("position") == F.col("rank"))
        .groupBy(*strata)
        .agg(*[F.max(F.when(F.col("cut") == name, F.struct("draw", "row_id"))).alias(name) for name in ranks])
    )
    sizes = places.groupBy(*strata).agg(F.max("stratum_rows").alias("stratum_rows"))
    return sizes.join(cut_rows, strata, "left")


def up_to_cut(cut: str, seed: int = SEED) -> Column:
    """True for rows drawn by the named cut; False where the cut is NULL."""
    own = F.struct(draw_key(F.col("row_id"), seed).alias("draw"), F.col("row_id"))
    return F.coalesce(own <= F.col(cut), F.lit(False))


def running_total_below(df: DataFrame, groups: list[str], order: str, value: str, out: str, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Append, per row, the sum of ``value`` over rows of its group with a smaller ``order``.

    ``order`` is a double, unique within a group. Bucket borders are quantiles of the data, so no
    bucket is much larger than the others whatever the distribution; they are one number on the
    driver for ``bucket_rows`` rows.
    """
    buckets = max(2, df.count() // bucket_rows)
    shares = [i / buckets for i in range(1, buckets)]
    borders = sorted(set(df.agg(F.percentile_approx(order, shares, max(10_000, 10 * buckets)).alias("q")).first().q or []))
    splits = [float("-inf"), *(borders or [0.0]), float("inf")]
    bucketed = Bucketizer(splits=splits, inputCol=order, outputCol="_bucket").transform(df)
    earlier = Window.partitionBy(*groups).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = bucketed.groupBy(*groups, "_bucket").agg(F.sum(value).alias("_n")).select(
        *groups, "_bucket", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset")
    )
    within = Window.partitionBy(*groups, "_bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    total = F.col("_offset") + F.coalesce(F.sum(value).over(within), F.lit(0))
    return bucketed.join(offsets, [*groups, "_bucket"]).withColumn(out, total).drop("_bucket", "_offset")
