"""Packing by powers of two: documents are cut into pieces of binary length, equal lengths are bucketed.

A document of n tokens gives n // limit pieces of the limit and one piece for each binary digit of the
rest, longest first. Every piece is a sequence of its own, so no sequence crosses documents, and as its
length is a power of two nothing is padded. Sequences are numbered by bucket: those of one length come
one after the other, so batches of equal length are ranges of numbers.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailsift.llm.chunk_encoder import worker_encoder
from mailsift.llm.common import Workspace, runs

LIMIT = 4096
END = 2
# Pieces of a group that numbers its sequences on its own; more pieces, more groups.
GROUP_ROWS = 250_000


def binary_lengths(tokens: int, limit: int) -> list[int]:
    """Pieces of a document: as many of the limit as fit, then the binary digits of the rest."""
    rest = tokens % limit
    return [limit] * (tokens // limit) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def piece_table(
    docs: DataFrame, tokenizer: str, limit: int = LIMIT, end: int | None = END, with_ids: bool = True,
    chunks_kept: int | None = None,
) -> DataFrame:
    """``doc_id, start, length, ids, ids_crc32, doc_tokens``: the pieces with their token ids, or null for these.

    ``chunks_kept`` bounds what the tokenizer remembers in a task, if memory is short; the result is the same.
    """
    if limit & (limit - 1):
        raise ValueError("the limit must be a power of two")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with worker_encoder(tokenizer, "word", kept=chunks_kept) as encoder:
            for batch in batches:
                for part in runs(batch, "text"):
                    texts = part.column("text").fill_null("").to_pylist()
                    ids, lengths = encoder.encode(texts)
                    raw, last = memoryview(ids.astype("<u4").tobytes()), b"" if end is None else end.to_bytes(4, "little")
                    docs_, starts, sizes, pieces, crcs, wholes = [], [], [], [], [], []
                    at = 0
                    for doc, length in zip(part.column("doc_id").to_pylist(), (4 * lengths).tolist()):
                        own = bytes(raw[at : at + length]) + last
                        at += length
                        start, tokens = 0, len(own) // 4
                        for size in binary_lengths(tokens, limit):
                            piece = own[4 * start : 4 * (start + size)]
                            docs_.append(doc)
                            starts.append(start)
                            sizes.append(size)
                            crcs.append(zlib.crc32(piece))
                            wholes.append(tokens)
                            pieces.append(piece if with_ids else None)
                            start += size
                    yield pa.record_batch(
                        [pa.array(docs_, pa.int64()), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()),
                         pa.array(pieces, pa.binary()), pa.array(crcs, pa.int64()), pa.array(wholes, pa.int64())],
                        ["doc_id", "start", "length", "ids", "ids_crc32", "doc_tokens"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(
        work, "doc_id bigint, start bigint, length bigint, ids binary, ids_crc32 bigint, doc_tokens bigint")


def numbered(pieces: DataFrame, work: Workspace, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Add ``sequence_id`` (from 0, without gaps, equal lengths together) and ``offset`` (always 0).

    Rows are dealt to groups by a hash of their content, as many as the counted rows need; groups are counted, and
    a row's number is that of its group's first plus its place in the group. Only the counts, at most one for each
    group and length, are put in one order; equal rows are the same whichever number they get.
    """
    columns = ["doc_id", "start", "ids_crc32", "doc_tokens"]
    pieces = work.keep(pieces)
    groups = max(int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-pieces.count() // group_rows))
    pieces = pieces.withColumn("part", F.pmod(F.xxhash64(*columns), F.lit(groups)).cast("int"))
    counts = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    first = F.expr("sum(n) over (order by length desc, part rows between unbounded preceding and current row) - n")
    # Written, so that Spark knows its bytes and sends it around only if they are few.
    counts = work.keep(counts.withColumn("first", first).drop("n"))
    place = F.expr(f"row_number() over (partition by length, part order by {', '.join(columns)}) - 1")
    return pieces.withColumn("place", place).join(counts, ["length", "part"]).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        (F.col("first") + F.col("place")).cast("bigint").alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))


def packed(docs: DataFrame, work: Workspace, tokenizer: str, limit: int = LIMIT, end: int | None = END,
           chunks_kept: int | None = None) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``: one row per piece.

    Every row of ``docs`` is a document, rows that repeat another too. A null or empty text is the end
    token alone (no piece at all if ``end`` is None); a null doc_id stays null. A long text gives many
    pieces. Other columns are not read; an empty table gives an empty one.
    """
    return numbered(piece_table(docs, tokenizer, limit, end, False, chunks_kept).drop("ids"), work)
