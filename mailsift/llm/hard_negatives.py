"""Hard negatives by exact integer products in a residue number system.

Vectors become integers. Blocks of anchors are multiplied with blocks of rows modulo several small
primes: residues are centred about zero and the inner dimension is cut so that every float32 sum stays
below 2^24, where float32 counts exactly; the remainders are put together by the Chinese remainder
theorem in mixed radix, which gives the signed inner product, exact for any product of primes above twice
the largest squared length. As many primes are taken as that bound asks for.

Two passes: rows of the anchor's label give its positives, then rows of other labels are chosen whose
score lies in the window below each positive. A task holds one block of anchors and streams rows past
it; what a block of rows returns is a few rows for each anchor, ranked once more over all blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailsift.llm.common import Workspace

SCALE = 256
POSITIVES, NEGATIVES = 5, 5
LEAST_PERCENT = 80
EVERY = 100
# Anchors that one task holds, rows of a block, and scores of one tile.
BLOCK_ANCHORS = 8_192
BLOCK_ROWS = 32_768
TILE = 1 << 21
# Residues are below half of this; 64 products of two of them stay below 2^24.
LARGEST_MODULUS = 1_024
EXACT_FLOAT = 1 << 24


def primes(bound: int, largest: int = LARGEST_MODULUS) -> list[int]:
    """The largest primes below ``largest`` whose product exceeds twice the bound (two of them at least)."""
    chosen, product = [], 1
    candidate = largest - 1
    while product <= 2 * bound or len(chosen) < 2:
        if all(candidate % d for d in range(2, int(candidate**0.5) + 1)):
            chosen.append(candidate)
            product *= candidate
        candidate -= 1
    return chosen


def residues(values: np.ndarray, moduli: list[int]) -> list[np.ndarray]:
    """Remainders about zero, one float32 matrix for each prime."""
    out = []
    for p in moduli:
        r = values % p
        out.append(np.where(r > p // 2, r - p, r).astype(np.float32))
    return out


def scores(left: list[np.ndarray], right: list[np.ndarray], moduli: list[int]) -> np.ndarray:
    """Exact inner products of all rows on the left with all on the right, from their residues."""
    width = left[0].shape[1]
    value, radix = None, 1
    for a, b, p in zip(left, right, moduli):
        step = EXACT_FLOAT // (p // 2) ** 2
        rest = np.zeros((len(a), len(b)), np.int64)
        for start in range(0, width, step):
            rest += (a[:, start : start + step] @ b[:, start : start + step].T).astype(np.int64)
        rest %= p
        if value is None:
            value = rest
        else:
            # The next digit of the mixed radix: what is still missing, divided by the radix modulo p.
            digit = (rest - value % p) * pow(radix, -1, p) % p
            value = value + digit * radix
        radix *= p
    return np.where(value > radix // 2, value - radix, value)


def _chosen(wanted: np.ndarray, found: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (row, column) of wanted scores that are among the k highest of their row, ties included."""
    many = wanted.sum(axis=1) > k
    if many.any():
        low = np.iinfo(np.int64).min
        part = np.where(wanted[many], found[many], low)
        kth = np.partition(part, part.shape[1] - k, axis=1)[:, part.shape[1] - k]
        wanted = wanted.copy()
        wanted[many] &= found[many] >= kth[:, None]
    return np.nonzero(wanted)


def _first(group: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the first k of every group: higher scores first, then smaller ids."""
    order = np.lexsort((ids, -score, group))
    sorted_ = group[order]
    new = np.ones(len(order), bool)
    new[1:] = sorted_[1:] != sorted_[:-1]
    start = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    return order[np.arange(len(order)) - start < k]


def whole_numbers(
    vectors: DataFrame, scale: int = SCALE, id_column: str = "vec_id", vector_column: str = "embedding",
    label_column: str = "label",
) -> DataFrame:
    """``id, label, dimension, vector`` (whole numbers) of the rows that take part."""
    rows = vectors.select(
        F.col(id_column).cast("bigint").alias("id"), F.col(label_column).cast("bigint").alias("label"),
        F.col(vector_column).cast("array<double>").alias("x"))
    finite = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    rows = rows.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull() & finite & (F.size("x") > 0))
    return rows.select(
        "id", "label", F.size("x").alias("dimension"),
        F.transform("x", lambda v: F.floor(v * scale).cast("double")).alias("x"),
    ).withColumn("length", F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v)).withColumn(
        "vector", F.transform("x", lambda v: v.cast("bigint"))).drop("x")


def _blocks(rows: DataFrame, anchors: DataFrame, blocks: dict[str, int]) -> DataFrame:
    """Anchors sent to all blocks of rows, rows to all blocks of anchors; anchors come first in a pair."""
    place = F.xxhash64("id")
    given = rows.select(
        "dimension", F.pmod(place, F.lit(blocks["rows"])).cast("int").alias("r"),
        F.explode(F.sequence(F.lit(0), F.lit(blocks["anchors"] - 1))).alias("a"), F.lit(1).alias("kind"),
        "id", "label", "vector", F.lit(None).cast("array<bigint>").alias("aims"))
    asked = anchors.select(
        "dimension", F.explode(F.sequence(F.lit(0), F.lit(blocks["rows"] - 1))).alias("r"),
        F.pmod(place, F.lit(blocks["anchors"])).cast("int").alias("a"), F.lit(0).alias("kind"),
        "id", "label", "vector", "aims")
    count = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    keys = ["dimension", "a", "r"]
    return given.unionByName(asked).repartition(count, *keys).sortWithinPartitions(*keys, "kind", "id", "label", "vector")


def _pairs(batches: Iterator[pa.RecordBatch], moduli: list[int]) -> Iterator[tuple]:
    """(key, anchors, rows) for tiles of a stream that ``_blocks`` made; ``rows`` is None at a pair's end.

    Anchors are (ids, labels, residues, aims), rows (ids, labels, residues). A pair's anchors are gathered,
    its rows pass by; of equal rows the first is taken, and of anchors that share an id the first.
    """
    key, waiting, anchors, last = None, [], None, None

    def gathered():
        ids, labels, vectors, aims = zip(*waiting)
        keep = np.ones(sum(map(len, ids)), bool)
        flat = np.concatenate(ids)
        keep[1:] = flat[1:] != flat[:-1]
        values = np.concatenate(vectors)[keep]
        return flat[keep], np.concatenate(labels)[keep], residues(values, moduli), [a for a, k in zip(sum(aims, []), keep) if k]

    for batch in batches:
        if not batch.num_rows:
            continue
        parts = {n: np.asarray(batch.column(n)) for n in ("dimension", "a", "r", "kind", "id", "label")}
        change = np.flatnonzero(np.any(
            [parts[n][1:] != parts[n][:-1] for n in ("dimension", "a", "r", "kind")], axis=0)) + 1
        for start, end in zip([0, *change], [*change, batch.num_rows]):
            now = tuple(int(parts[n][start]) for n in ("dimension", "a", "r"))
            if now != key:
                if anchors is not None:
                    yield key, anchors, None
                key, waiting, anchors, last = now, [], None, None
            part = batch.slice(start, end - start)
            ids, labels = parts["id"][start:end], parts["label"][start:end]
            values = np.asarray(part.column("vector").flatten()).reshape(-1, now[0])
            if parts["kind"][start] == 0:
                waiting.append((ids, labels, values, part.column("aims").to_pylist()))
                continue
            if anchors is None:
                if not waiting:
                    continue
                anchors = gathered()
            step = max(1, TILE // len(anchors[0]))
            for i in range(0, len(ids), step):
                tile = ids[i : i + step], labels[i : i + step], values[i : i + step]
                keep = np.ones(len(tile[0]), bool)
                keep[1:] = (tile[0][1:] != tile[0][:-1]) | (tile[1][1:] != tile[1][:-1]) | (tile[2][1:] != tile[2][:-1]).any(axis=1)
                if last is not None:
                    keep[0] = last[0] != tile[0][0] or last[1] != tile[1][0] or bool((last[2] != tile[2][0]).any())
                last = tile[0][-1], tile[1][-1], tile[2][-1].copy()
                yield key, anchors, (tile[0][keep], tile[1][keep], residues(tile[2][keep], moduli))
    if anchors is not None:
        yield key, anchors, None


class _Best:
    """The first k found so far for every group."""

    def __init__(self, k: int):
        self._k, self._held = k, (np.zeros(0, np.int64),) * 3

    def add(self, group: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if len(group):
            every = [np.concatenate(x) for x in zip(self._held, (group, score, ids))]
            best = _first(*every, self._k)
            self._held = tuple(x[best] for x in every)

    def taken(self):
        return self._held


def _positives(pairs: DataFrame, moduli: list[int], k: int) -> DataFrame:
    def work(batches):
        best = _Best(k)
        for _, (ids, labels, left, _aims), rows in _pairs(batches, moduli):
            if rows is None:
                anchor, score, other = best.taken()
                yield pa.record_batch([pa.array(ids[anchor]), pa.array(other), pa.array(score)], ["anchor_id", "positive_id", "positive_score"])
                best = _Best(k)
                continue
            found = scores(left, rows[2], moduli)
            i, j = _chosen((labels[:, None] == rows[1][None, :]) & (ids[:, None] != rows[0][None, :]), found, k)
            best.add(i, found[i, j], rows[0][j])

    return pairs.mapInArrow(work, "anchor_id bigint, positive_id bigint, positive_score bigint")


def _negatives(pairs: DataFrame, moduli: list[int], k: int, least: int) -> DataFrame:
    """``anchor_id, positive_score, negative_id, negative_score``: per anchor and different positive score."""

    def work(batches):
        best = _Best(k)
        for _, (ids, labels, left, aims), rows in _pairs(batches, moduli):
            wide = max(map(len, aims), default=0)
            if rows is None:
                group, score, other = best.taken()
                if len(group):
                    aim = np.array([aims[g // wide][g % wide] for g in group.tolist()], np.int64)
                    yield pa.record_batch(
                        [pa.array(ids[group // wide]), pa.array(aim), pa.array(other), pa.array(score)],
                        ["anchor_id", "positive_score", "negative_id", "negative_score"])
                best = _Best(k)
                continue
            found = scores(left, rows[2], moduli)
            other = labels[:, None] != rows[1][None, :]
            for n in range(wide):
                has = np.array([len(a) > n for a in aims])
                aim = np.array([a[n] if len(a) > n else 0 for a in aims], np.int64)[:, None]
                inside = other & has[:, None] & (100 * found >= least * aim) & (found <= aim)
                i, j = _chosen(inside, found, k)
                best.add(i * wide + n, found[i, j], rows[0][j])

    return pairs.mapInArrow(work, "anchor_id bigint, positive_score bigint, negative_id bigint, negative_score bigint")


def mine(
    vectors: DataFrame, work: Workspace, every: int = EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES,
    least_percent: int = LEAST_PERCENT, scale: int = SCALE, id_column: str = "vec_id", vector_column: str = "embedding",
    label_column: str = "label",
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Anchors are the rows whose id ``every`` divides; a score is the inner product of ``floor(scale * x)``. Rows
    with a null id, label or vector, with an empty vector, or with a null or non-finite component take no
    part; vectors of different length are not compared. The same row twice counts once; rows that share
    an id but differ are candidates of their own, and the least of them (label, then vector) is the anchor; a
    row with the anchor's id is neither positive nor negative. Fewer candidates than asked for give all;
    a positive without negatives in its window gives no row. An empty table gives an empty one, other
    columns are not read. Scores that a 64-bit number cannot hold a hundredfold are an error.
    """
    rows = work.keep(whole_numbers(vectors, scale, id_column, vector_column, label_column))
    size = rows.agg(
        F.count("*").alias("rows"), F.coalesce(F.sum((F.col("id") % every == 0).cast("int")), F.lit(0)).alias("anchors"),
        F.coalesce(F.max("length"), F.lit(0.0)).alias("longest")).first()
    if not 128 * size.longest < float(1 << 63):
        raise ValueError("components are too large for exact 64-bit scores")
    moduli = primes(int(size.longest * (1 + 1e-9)) + 1)
    blocks = {"rows": max(1, -(-size.rows // BLOCK_ROWS)), "anchors": max(1, -(-size.anchors // BLOCK_ANCHORS))}
    # Few rows are still dealt to as many tasks as there are.
    blocks["rows"] = max(blocks["rows"], min(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size.rows // 1024)))
    rows = rows.drop("length")
    asked = rows.filter(F.col("id") % every == 0).withColumn("aims", F.lit(None).cast("array<bigint>"))
    order = "row_number() over (partition by anchor_id order by positive_score desc, positive_id)"
    first = _positives(_blocks(rows, asked, blocks), moduli, positives)
    first = work.keep(first.withColumn("place", F.expr(order)).filter(F.col("place") <= positives).drop("place"))
    aims = first.groupBy("anchor_id").agg(F.sort_array(F.collect_set("positive_score"), asc=False).alias("aims"))
    asked = asked.drop("aims").join(aims, F.col("id") == F.col("anchor_id")).drop("anchor_id")
    found = _negatives(_blocks(rows, asked, blocks), moduli, negatives, least_percent)
    order = "row_number() over (partition by anchor_id, positive_score order by negative_score desc, negative_id)"
    found = found.withColumn("rank", F.expr(order)).filter(F.col("rank") <= negatives)
    return first.join(found, ["anchor_id", "positive_score"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
