"""Nearest neighbours by inner product with randomly rotated one-bit codes.

A vector is rotated at random into ``bits`` dimensions and only the signs of its coordinates are kept,
packed, with two correction scalars: its length, and the inner product of its direction with the code.
The inner product of a query with a vector is estimated from the rotated query, the code's bits and the
scalars; the second scalar also bounds the error. Within a block of vectors the bounds give, for every
query, a score that its k-th best is sure to reach; the vectors whose upper bound reaches it are ranked
by the exact inner product. Blocks of queries meet blocks of vectors, so memory in a task is fixed, and
each pair of blocks returns k rows a query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailsift.llm.common import grouped

BITS = 256
SEED = 20_240
# Vectors of one block and queries of one block.
BLOCK_VECTORS = 16_384
BLOCK_QUERIES = 2_048
# Width of the error bound in standard deviations of the estimate.
BOUND = 3.0


def rotation(dimension: int, bits: int = BITS, seed: int = SEED) -> np.ndarray:
    """``dimension`` orthonormal rows of ``max(bits, dimension)`` coordinates, drawn at random."""
    bits = -(-max(bits, dimension) // 64) * 64
    drawn = np.random.default_rng([seed, dimension]).standard_normal((bits, dimension))
    return np.ascontiguousarray(np.linalg.qr(drawn)[0].T)


def encode(vectors: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed sign bits, lengths, and inner products of each direction with its code."""
    length = np.sqrt((vectors * vectors).sum(axis=1))
    turned = (vectors / length[:, None]) @ turn
    agreement = np.abs(turned).sum(axis=1) / np.sqrt(turn.shape[1])
    return np.packbits(turned > 0, axis=1), length, agreement


def usable(column: str):
    """No null, no null or non-finite component, not zero, not empty."""
    finite = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.col(column).isNotNull() & finite & F.exists(column, lambda x: x != 0)


def index(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", bits: int = BITS) -> DataFrame:
    """``id, dimension, vector, code, length, agreement`` for every usable row."""
    rows = vectors.select(
        F.col(id_column).cast("bigint").alias("id"),
        F.col(vector_column).cast("array<double>").alias("vector"),
    ).filter(usable("vector"))
    rows = rows.withColumn("dimension", F.size("vector"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns: dict[int, np.ndarray] = {}
        for batch in batches:
            sizes = np.asarray(batch.column("dimension"))
            for size in np.unique(sizes).tolist():
                part = batch.filter(pa.array(sizes == size))
                turn = turns.setdefault(size, rotation(size, bits))
                values = np.asarray(part.column("vector").flatten()).reshape(-1, size)
                code, length, agreement = encode(values, turn)
                yield pa.record_batch(
                    [part.column("id"), part.column("dimension"),
                     pa.array([v.tobytes() for v in values], pa.binary()),
                     pa.array([c.tobytes() for c in code], pa.binary()), pa.array(length), pa.array(agreement)],
                    ["id", "dimension", "vector", "code", "length", "agreement"],
                )

    return rows.mapInArrow(
        work, "id bigint, dimension int, vector binary, code binary, length double, agreement double")


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -scores))[:k]


def search_block(queries, vectors, turn, k: int, bound: float = BOUND):
    """For each query the k nearest of a block: lists of (query position, vector position, score).

    ``queries`` is (ids, vectors); ``vectors`` is (ids, vectors, packed codes, lengths, agreements).
    """
    q_ids, q = queries
    ids, exact, codes, length, agreement = vectors
    bits = turn.shape[1]
    signs = np.unpackbits(codes, axis=1, count=bits).astype(np.float32) * 2 - 1
    q_length = np.sqrt((q * q).sum(axis=1))
    scale = (length / (agreement * np.sqrt(bits))).astype(np.float32)
    spread = length * np.sqrt(np.maximum(1 - agreement**2, 0)) / agreement * bound / np.sqrt(max(bits - 1, 1))
    out = []
    step = max(1, (1 << 23) // max(len(ids), 1))
    for start in range(0, len(q), step):
        part = q[start : start + step]
        guess = (part @ turn).astype(np.float32) @ signs.T * scale
        error = (q_length[start : start + step, None] * spread[None, :]).astype(np.float32)
        mine = q_ids[start : start + step, None] == ids[None, :]
        low = np.where(mine, -np.inf, guess - error)
        n = len(ids)
        if n > k:
            sure = np.partition(low, n - k, axis=1)[:, n - k]
            near = ~mine & (guess + error >= sure[:, None])
        else:
            near = ~mine
        for i in range(len(part)):
            found = np.flatnonzero(near[i])
            # Added up component by component, so the score is the same double on any engine.
            scores = np.cumsum(exact[found] * part[i], axis=1)[:, -1]
            for j in _best(ids[found], scores, k):
                out.append((start + i, found[j], scores[j]))
    return out


def nearest(
    vectors: DataFrame, k: int = 20, every: int = 20, id_column: str = "vec_id", vector_column: str = "embedding",
    bits: int = BITS,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k nearest rows of every row whose id ``every`` divides.

    Nearness is the inner product in double precision, ties go to the smaller id; the query's own id is
    no candidate. Rows with a null id, and vectors that are null, empty, zero or hold null or non-finite
    components take no part. Only vectors of equal dimension are compared. Rows that repeat an id count
    once per different vector as candidates and once (the smallest vector) as a query. Fewer candidates
    than k give all of them; an empty table gives an empty one. Other columns are not read.
    """
    coded = index(vectors, id_column, vector_column, bits).filter("id is not null")
    ids = vectors.select(
        F.col(id_column).cast("bigint").alias("id"), F.col(vector_column).cast("array<double>").alias("vector")
    ).filter(usable("vector")).filter("id is not null")
    sizes = ids.groupBy(F.size("vector").alias("dimension")).agg(
        F.greatest(F.ceil(F.count("*") / BLOCK_VECTORS), F.lit(1)).cast("int").alias("blocks"),
        F.greatest(F.ceil(F.sum((F.col("id") % every == 0).cast("int")) / BLOCK_QUERIES), F.lit(1)).cast("int")
        .alias("query_blocks"),
    )
    # One row for each length of vector that occurs.
    rows = coded.join(F.broadcast(sizes), "dimension")
    spot = F.xxhash64("id")
    candidates = rows.select(
        "dimension", F.pmod(spot, F.col("blocks")).cast("int").alias("c"),
        F.explode(F.sequence(F.lit(0), F.col("query_blocks") - 1)).alias("q"), F.lit(0).alias("is_query"),
        "id", "vector", "code", "length", "agreement")
    asked = rows.filter(F.col("id") % every == 0).select(
        "dimension", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("c"),
        F.pmod(spot, F.col("query_blocks")).cast("int").alias("q"), F.lit(1).alias("is_query"),
        "id", "vector", "code", "length", "agreement")
    keys = ["dimension", "c", "q"]

    def work(batches):
        turns: dict[int, np.ndarray] = {}

        def block(group: pa.Table):
            dimension = group.column("dimension")[0].as_py()
            turn = turns.setdefault(dimension, rotation(dimension, bits))
            asks = np.asarray(group.column("is_query").combine_chunks()) == 1
            ids_ = np.asarray(group.column("id").combine_chunks())
            raw = group.column("vector").combine_chunks().to_pylist()
            new = np.zeros(len(ids_), bool)
            seen = set()
            for i, (one, text) in enumerate(zip(ids_.tolist(), raw)):  # sorted by id, then vector
                key = (one, True) if asks[i] else (one, text)
                if key not in seen:
                    seen.add(key)
                    new[i] = True
            values = np.frombuffer(b"".join(raw), np.float64).reshape(-1, dimension)
            asked_, given = np.flatnonzero(asks & new), np.flatnonzero(~asks & new)
            if not (len(asked_) and len(given)):
                return
            code = np.frombuffer(b"".join(group.column("code").combine_chunks().take(pa.array(given)).to_pylist()), np.uint8)
            found = search_block(
                (ids_[asked_], values[asked_]),
                (ids_[given], values[given], code.reshape(len(given), -1),
                 np.asarray(group.column("length").combine_chunks())[given],
                 np.asarray(group.column("agreement").combine_chunks())[given]), turn, k)
            if found:
                yield pa.record_batch(
                    [pa.array(ids_[asked_][[f[0] for f in found]]), pa.array(ids_[given][[f[1] for f in found]]),
                     pa.array([float(f[2]) for f in found])], ["query_id", "vec_id", "score"])

        yield from grouped(batches, keys, block)

    count = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # One dimension, block and query block at a time; each task holds one pair of blocks.
    found = (
        candidates.unionByName(asked).repartition(count, *keys).sortWithinPartitions(*keys, "is_query", "id", "vector")
        .mapInArrow(work, "query_id bigint, vec_id bigint, score double")
    )
    order = F.expr("row_number() over (partition by query_id order by score desc, vec_id)")
    return found.withColumn("rank", order).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
