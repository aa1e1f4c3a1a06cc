"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

Every source's documents are dealt by hash to shards of about a million words and stand there in a seeded
order; their words, laid end to end, are cut into blocks of equal numbers of words. Blocks are seats:
sources get them by their targets, and a source's shards by their sizes, each by the highest quotients
v / 1, v / 3, v / 5, ... A shard then takes its quota: every block as often as the quota goes round,
and for the rest a run of blocks from a seeded start. All of it is row-wise arithmetic, three
aggregations and windows over one shard; only the list of sources is put in one order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from mailsift.llm.common import Workspace

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_COPIES = 2
BLOCK_WORDS = 64
SHARD_WORDS = 1_000_000
SHARD_ROWS = 10_000
SEED = "mix"


def word_count(text: Column | str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def _number(text: Column, start: int, length: int) -> Column:
    """Hexadecimal digits of an MD5 as a number."""
    return F.conv(F.substring(F.md5(text), start, length), 16, 10).cast("bigint")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST_COPIES) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size``.

    Weights repeat over the sources in code-point order, null last. ``share`` of all words is split by
    weight; a target stops at ``most`` times its source's size and the excess goes to the others by weight.
    With the sources ordered by the level at which they are full, the level that is reached follows from
    the sums of the sizes before and the weights from there on.
    """
    cycle = F.array(*[F.lit(w) for w in weights])
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    rows = sizes.withColumn("weight", cycle[F.pmod(place, F.lit(len(weights))).cast("int")])
    rows = rows.withColumn("full", most * F.col("source_size")).withColumn("level", F.col("full") / F.col("weight"))
    everything = W.partitionBy()
    by_level = W.orderBy("level", F.col("source").asc_nulls_last())
    total = share * F.sum("source_size").over(everything)
    before = F.coalesce(F.sum("full").over(by_level.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    open_weight = F.sum("weight").over(by_level.rowsBetween(0, W.unboundedFollowing))
    rows = rows.withColumn("reached", (total - before) / open_weight)
    level = F.max(F.when(F.col("reached") <= F.col("level"), F.col("reached"))).over(everything)
    # Without such a source all are full.
    target = F.least(F.col("full").cast("double"), F.coalesce(level * F.col("weight"), F.col("full").cast("double")))
    return rows.select("source", "source_size", target.alias("target"))


def seats(votes: DataFrame, group: list[str], vote: str, total: str, order: list[str]) -> DataFrame:
    """Add ``seats``: Sainte-Laguë's share of ``total`` (a column, equal within ``group``) by ``vote``.

    The divisor lies between V / (N + n) and V / (N - n) for n rows, N seats and V votes. Seats at the
    upper end are certain; of the candidates from there to the lower end, three a row on average, those
    with the highest quotients fill the total. Ties go to the first by ``order``.
    """
    inside = W.partitionBy(*group)
    rows = votes.withColumn("_v", F.col(vote).cast("double"))
    rows = rows.withColumn("_sum", F.sum("_v").over(inside)).withColumn("_n", F.count("*").over(inside))
    few, many = F.greatest(F.col(total) - F.col("_n"), F.lit(0)), F.col(total) + F.col("_n")
    quota = F.col("_v") / F.when(F.col("_sum") > 0, F.col("_sum"))
    low = F.coalesce(F.greatest(F.floor(quota * few + 0.5) - 1, F.lit(0)), F.lit(0)).cast("bigint")
    high = F.coalesce(F.floor(quota * many + 0.5) + 1, F.lit(0)).cast("bigint")
    rows = rows.withColumn("_low", low).withColumn("_high", F.when(F.col("_v") > 0, high).otherwise(low))
    rows = rows.withColumn("_left", F.col(total) - F.sum("_low").over(inside))
    # One candidate seat a row, and a row with seat 0 that keeps those without candidates.
    rows = rows.withColumn("_seat", F.explode(F.concat(
        F.array(F.lit(0).cast("bigint")),
        F.when(F.col("_high") > F.col("_low"), F.sequence(F.col("_low") + 1, F.col("_high")))
        .otherwise(F.array().cast("array<bigint>")))))
    quotient = F.when(F.col("_seat") > 0, F.col("_v") / (2 * F.col("_seat") - 1))
    ranked = W.partitionBy(*group).orderBy(quotient.desc_nulls_last(), *[F.col(o).asc_nulls_last() for o in order])
    rows = rows.withColumn("_rank", F.row_number().over(ranked))
    kept = [c for c in votes.columns]
    won = F.sum(((F.col("_seat") > 0) & (F.col("_rank") <= F.col("_left"))).cast("bigint"))
    return rows.groupBy(*kept, "_low").agg(won.alias("_won")).select(
        *kept, (F.col("_low") + F.col("_won")).alias("seats"))


def mix(
    docs: DataFrame, work: Workspace, weights=WEIGHTS, share: float = SHARE, most: int = MOST_COPIES,
    block: int = BLOCK_WORDS, seed: str = SEED,
) -> DataFrame:
    """The rows of ``docs`` with a struct ``mix_plan``: what the mix takes of each document.

    Fields: ``size`` (words of ``text`` between ASCII white space; null: 0), ``source_size`` and ``target``
    of its source, ``taken`` (words, repeats counted), ``whole`` (whole copies), ``ranges`` (word ranges
    [from, to) of one further copy in parts, at most two). Sources hold all rows of one ``source``, null
    included. Rows that repeat a document are documents; ties in the seeded order are broken by doc_id and
    size. A null doc_id is an id of its own. A source without words has target 0. Other columns pass
    through unread, whatever their names (but ``mix_plan``); an empty table gives an empty one.
    """
    source, ident = F.col("source").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    key = F.concat(F.lit(f"{seed}:"), ident)
    small = work.keep(docs.select(
        source.alias("source"), word_count("text").alias("size"), _number(key, 1, 8).alias("deal")))
    per_source = small.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    rows_of = per_source.select("source", F.greatest(
        F.ceil(F.col("source_size") / SHARD_WORDS), F.ceil(F.col("rows") / SHARD_ROWS), F.lit(1)
    ).cast("bigint").alias("shards"))
    aims = targets(per_source.select("source", "source_size"), weights, share, most)
    whole = W.partitionBy()
    aims = aims.withColumn("blocks", F.round(F.sum("target").over(whole) / block).cast("bigint"))
    aims = seats(aims, [], "target", "blocks", ["source"]).withColumnRenamed("seats", "source_blocks").drop("blocks")
    aims = aims.alias("a").join(rows_of.alias("r"), F.expr("a.source <=> r.source")).select("a.*", "shards")
    aims = work.keep(aims)

    shard = F.pmod(F.col("deal"), F.col("shards"))
    shards = small.alias("d").join(aims.alias("a"), F.expr("d.source <=> a.source")).groupBy(
        F.col("a.source").alias("source"), shard.alias("shard")).agg(
        F.sum("size").alias("shard_size"), F.first("source_size").alias("source_size"),
        F.first("target").alias("target"), F.first("source_blocks").alias("source_blocks"),
        F.first("shards").alias("shards"))
    quotas = seats(shards, ["source"], "shard_size", "source_blocks", ["shard"])
    held = F.ceil(F.col("shard_size") / block).cast("bigint")
    start_key = F.concat(F.lit(f"{seed}/"), F.coalesce("source", F.lit("")), F.lit("/"), F.col("shard").cast("string"))
    quotas = quotas.withColumn("held", held)
    quotas = quotas.withColumn(
        "copies", F.when(F.col("held") > 0, F.least(F.floor(F.col("seats") / F.col("held")), F.lit(most))).otherwise(0)
        .cast("bigint"))
    quotas = quotas.withColumn(
        "rest", F.when(F.col("copies") < most, F.col("seats") - F.col("copies") * F.col("held")).otherwise(0)
        .cast("bigint"))
    quotas = quotas.withColumn("first", F.when(
        F.col("held") > 0, F.pmod(_number(start_key, 1, 15), F.col("held"))).otherwise(0).cast("bigint"))
    quotas = work.keep(quotas.select("source", "shard", "shards", "shard_size", "source_size", "target", "held",
                                     "copies", "rest", "first"))

    # Names of our own beside those of the rows; columns that nobody asks for are not carried along.
    own = "_mix_"
    while any(c.startswith(own) for c in docs.columns):
        own = f"_{own}"

    def mine(name: str) -> Column:
        return F.col(own + name)

    def renamed(df: DataFrame) -> DataFrame:
        return df.select([F.col(c).alias(own + c) for c in df.columns])

    rows = docs.withColumns({
        f"{own}key": source, f"{own}size": word_count("text"), f"{own}deal": _number(key, 1, 8),
        f"{own}order": F.substring(F.md5(key), 9, 16), f"{own}id": F.col("doc_id").cast("bigint")})
    of_source = renamed(aims.select(F.col("source").alias("s"), F.col("shards").alias("of")))
    rows = rows.join(of_source, mine("key").eqNullSafe(mine("s"))).withColumn(f"{own}dealt", F.pmod(mine("deal"), mine("of")))
    rows = rows.join(renamed(quotas), mine("key").eqNullSafe(mine("source")) & (mine("dealt") == mine("shard")))
    order = W.partitionBy(mine("key"), mine("dealt")).orderBy(mine("order"), mine("id"), mine("size"))
    end = F.sum(mine("size")).over(order.rowsBetween(W.unboundedPreceding, 0))
    rows = rows.withColumn(f"{own}end", end)
    begin, end = mine("end") - mine("size"), mine("end")
    low, high = mine("first") * block, (mine("first") + mine("rest")) * block
    around = F.greatest((mine("first") + mine("rest") - mine("held")) * block, F.lit(0))

    def cut(a: Column, b: Column) -> Column:
        return F.struct((F.greatest(begin, a) - begin).alias("from"), (F.least(end, b) - begin).alias("to"))

    parts = F.filter(F.array(cut(F.lit(0).cast("bigint"), around), cut(low, high)), lambda p: p["to"] > p["from"])
    rows = rows.withColumn(f"{own}parts", parts)
    rows = rows.withColumn(f"{own}cut", F.aggregate(
        mine("parts"), F.lit(0).cast("bigint"), lambda n, p: n + p["to"] - p["from"]))
    full = (mine("cut") >= mine("size")) & (mine("size") > 0)
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns], F.struct(
        mine("size").alias("size"), mine("source_size").alias("source_size"), mine("target").alias("target"),
        (mine("copies") * mine("size") + mine("cut")).alias("taken"),
        (mine("copies") + full.cast("bigint")).alias("whole"),
        F.when(full, F.array().cast("array<struct<from:bigint,to:bigint>>")).otherwise(mine("parts")).alias("ranges"),
    ).alias("mix_plan"))


def mixed_rows(planned: DataFrame) -> DataFrame:
    """The mix itself: a row for each whole copy, and one with the words of the ranges for a copy in parts."""
    names = [c for c in planned.columns if c != "mix_plan"]
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    part = F.array_join(F.flatten(F.transform(
        "mix_plan.ranges", lambda r: F.slice(words, (r["from"] + 1).cast("int"), (r["to"] - r["from"]).cast("int")))), " ")
    copies = F.when(F.col("mix_plan.whole") > 0, F.sequence(F.lit(1), F.col("mix_plan.whole").cast("int"))).otherwise(
        F.array().cast("array<int>"))
    copies = F.concat(copies, F.when(F.size("mix_plan.ranges") > 0, F.array(F.lit(0))).otherwise(
        F.array().cast("array<int>")))
    rows = planned.withColumn("_copy", F.explode(copies))
    text = F.when(F.col("_copy") > 0, F.col("text")).otherwise(part)
    rows = rows.withColumn("text", text)
    if "n_chars" in names:
        rows = rows.withColumn("n_chars", F.when(F.col("_copy") > 0, F.col("n_chars")).otherwise(
            F.length("text").cast("bigint")))
    return rows.select(*[F.col(f"`{c}`") for c in names])
