"""Contiguous shards of near equal bytes, from global prefix sums over per-partition totals.

Documents are put in one order: by the MD5 of their text, then by id, so equal texts stand together and
every shard gets a fair mix of the corpus. The order is dealt to partitions by ranges, each partition sums
its bytes and rows, the few totals are accumulated, and a document's global place is that of its
partition plus its place within it. The line of all bytes is cut at equal targets. A cut that falls into a
group of equal texts moves to the nearer end of the group if the group is small beside a shard, else to
the nearer end of the document it falls into; so no shard is off its target by more than that.
Column functions and windows alone; texts are read once and never shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mailsift.llm.common import Workspace

SHARDS = 8
# Groups of equal texts of at most this part of a shard's target are never divided.
GROUP_SHARE = 100
# Rows of one range of the order; more rows, more ranges.
RANGE_ROWS = 500_000


def _measured(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        (F.octet_length(text) + 1).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).cast("bigint").alias("text_crc32"),
        F.unhex(F.md5(text.cast("binary"))).alias("digest"),
    )


def line_up(docs: DataFrame, work: Workspace, range_rows: int = RANGE_ROWS) -> tuple[DataFrame, DataFrame]:
    """All documents with ``before`` and ``place``, bytes and rows in front of them, and the ranges' totals."""
    rows = work.keep(_measured(docs))
    ranges = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // range_rows))
    # The id is part of the key, so a text that most documents share is spread over many ranges.
    ranged = work.keep(
        rows.repartitionByRange(ranges, "digest", "doc_id").withColumn("part", F.spark_partition_id()))
    totals = ranged.groupBy("part").agg(F.sum("size").alias("part_size"), F.count("*").alias("part_rows"))
    # One row for each range.
    upto = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = work.keep(totals.select(
        "part", "part_size",
        (F.sum("part_size").over(upto) - F.col("part_size")).alias("part_before"),
        (F.sum("part_rows").over(upto) - F.col("part_rows")).alias("part_place"),
        F.sum("part_size").over(Window.partitionBy()).alias("total"),
    ))
    within = Window.partitionBy("part").orderBy("digest", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = ranged.withColumn("upto", F.sum("size").over(within)).withColumn("number", F.row_number().over(within))
    placed = placed.join(totals, "part").select(
        "doc_id", "size", "text_crc32", "digest", "part", "total",
        (F.col("part_before") + F.col("upto") - F.col("size")).alias("before"),
        (F.col("part_place") + F.col("number") - 1).alias("place"))
    return work.keep(placed), totals


def edges(placed: DataFrame, work: Workspace, shards: int = SHARDS, group_share: int = GROUP_SHARE) -> DataFrame:
    """``shard, at, row``: the bytes and rows in front of each shard but the first."""
    cut = placed.withColumn("k", F.expr(
        f"sequence(greatest((before * {shards} + total - 1) div total, 1),"
        f" least(((before + size) * {shards} - 1) div total, {shards - 1}))"
    )).filter(
        f"greatest((before * {shards} + total - 1) div total, 1) <= least(((before + size) * {shards} - 1) div total, {shards - 1})")
    # At most one row for each cut.
    cut = work.keep(cut.select(F.explode("k").alias("k"), "digest", "before", "size", "place", "total"))
    groups = placed.select("digest", "before", "size", "place").join(cut.select("digest").distinct(), "digest").groupBy("digest").agg(
        F.min("before").alias("group_start"), F.sum("size").alias("group_size"),
        F.min("place").alias("group_place"), F.count("*").alias("group_rows"))
    whole = F.expr(f"group_size * {shards} * {group_share} <= total")
    unit = cut.join(groups, "digest").select(
        "k", "total",
        F.when(whole, F.col("group_start")).otherwise(F.col("before")).alias("start"),
        F.when(whole, F.col("group_start") + F.col("group_size")).otherwise(F.col("before") + F.col("size")).alias("end"),
        F.when(whole, F.col("group_place")).otherwise(F.col("place")).alias("first"),
        F.when(whole, F.col("group_place") + F.col("group_rows")).otherwise(F.col("place") + 1).alias("next"))
    nearer_start = F.expr(f"k * total - start * {shards} <= end * {shards} - k * total")
    return work.keep(unit.select(
        F.col("k").cast("int").alias("shard"),
        F.when(nearer_start, F.col("start")).otherwise(F.col("end")).alias("at"),
        F.when(nearer_start, F.col("first")).otherwise(F.col("next")).alias("row")))


def assign(docs: DataFrame, work: Workspace, shards: int = SHARDS, group_share: int = GROUP_SHARE) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard``: one row for every row of ``docs``.

    ``size`` is the UTF-8 bytes of the text plus 1; a null text counts as an empty one (size 1, CRC-32 0) and
    shares its group. Rows that repeat another, and rows that share an id, are documents of their own; a null
    id stays null and comes first among equal texts. ``slot`` numbers the documents of a shard from 0 in
    the order. The law is ``bytes``, under which ``grown_shard`` is null. A document larger than a shard's
    target leaves neighbouring shards smaller or empty; with fewer documents than shards some are empty. Of
    other columns none is read; an empty table gives an empty one.
    """
    placed, totals = line_up(docs, work)
    found = edges(placed, work, shards, group_share)
    ends = found.agg(F.array_sort(F.collect_list(F.struct("shard", "at", "row"))).alias("edges"))
    first = F.array(F.struct(F.lit(0).alias("shard"), F.lit(0).cast("bigint").alias("at"), F.lit(0).cast("bigint").alias("row")))
    # A range needs the last edge in front of it and those within it.
    near = totals.select("part", "part_before", "part_size", F.concat(first, ends.scalar()).alias("edges")).select(
        "part", F.expr(
            "filter(edges, e -> e.at < part_before + part_size"
            " and e.shard >= array_max(transform(filter(edges, f -> f.at <= part_before), f -> f.shard)))").alias("edges"))
    return placed.join(near, "part").withColumn(
        "edge", F.expr("element_at(filter(edges, e -> e.at <= before), -1)")
    ).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("edge.shard").alias("shard"),
        (F.col("place") - F.col("edge.row")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
