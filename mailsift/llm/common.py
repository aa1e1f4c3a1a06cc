"""Helpers of the corpus operators: tables in the shared folder and byte-level work on Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailsift.workspace import materialise, run_dir

# Texts of one Arrow batch are worked on in runs of at most this many bytes, so memory in a task is
# bounded by this and by the longest single text.
BYTES_AT_ONCE = 1 << 19

# Rows whose crc32(doc_id as text) leaves no remainder by this number are never learnt from.
HOLD_OUT = 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str = "doc_id"):
    """True for the fifth of documents that models may not learn from; a null id counts as held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % HOLD_OUT == 0, F.lit(True))


def seeded_share(seed: int, *columns: str):
    """A number from 0 up to 1 that depends on the columns and the seed alone."""
    return F.pmod(F.xxhash64(F.lit(seed), *columns), F.lit(1 << 30)) / float(1 << 30)


class Workspace:
    """Numbered tables of one run in the shared folder; what is written there ends the lineage."""

    def __init__(self, spark: SparkSession, purpose: str):
        self._folder, self._number = run_dir(spark, purpose), 0

    def keep(self, df: DataFrame) -> DataFrame:
        self._number += 1
        return materialise(df, f"{self._folder}/{self._number:03d}")


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts in a row and the n + 1 offsets of the texts; nulls become empty texts."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    at = at.astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return (whole[at[0] : at[-1]], at - at[0]) if len(at) else (whole[:0], np.zeros(1, np.int64))


def runs(batch: pa.RecordBatch, text: str, most: int = BYTES_AT_ONCE) -> Iterator[pa.RecordBatch]:
    """The batch in consecutive slices whose texts take at most ``most`` bytes, one row at least."""
    if not batch.num_rows:
        return
    _, at = utf8(batch.column(batch.schema.get_field_index(text)))
    start = 0
    while start < batch.num_rows:
        end = max(start + 1, int(np.searchsorted(at, at[start] + most, side="right")) - 1)
        yield batch.slice(start, end - start)
        start = end


def passing(judge: Callable[[pa.Array], np.ndarray]):
    """A function of a text column that is true where ``judge`` says so of the texts of one run.

    Only the texts travel to Python and one bit a row comes back; the other columns stay in the JVM.
    """

    def told(texts: pa.Array) -> pa.Array:
        parts = [judge(part.column("text")) for part in runs(pa.record_batch([texts], ["text"]), "text")]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0, bool))

    return F.arrow_udf(told, "boolean")


def grouped(
    batches: Iterator[pa.RecordBatch], keys: list[str], work: Callable[[pa.Table], Iterator[pa.RecordBatch]]
) -> Iterator[pa.RecordBatch]:
    """Apply ``work`` to each run of rows with equal keys in a stream that is sorted by them."""
    waiting: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        change = np.zeros(batch.num_rows - 1, bool)
        for key in keys:
            values = np.asarray(rows.column(key).combine_chunks())
            change |= values[1:] != values[:-1]
        cuts = [0, *(np.flatnonzero(change) + 1), batch.num_rows]
        if waiting and any(waiting[-1].column(k)[-1].as_py() != rows.column(k)[0].as_py() for k in keys):
            yield from work(pa.concat_tables(waiting))
            waiting = []
        for a, b in zip(cuts[:-1], cuts[1:]):
            if waiting and a:
                yield from work(pa.concat_tables(waiting))
                waiting = []
            waiting.append(rows.slice(a, b - a))
    if waiting:
        yield from work(pa.concat_tables(waiting))


_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit numbers evenly (a fixed one-to-one mapping)."""
    x = x + _M1
    x ^= x >> np.uint64(30)
    x *= _M2
    x ^= x >> np.uint64(27)
    x *= _M3
    x ^= x >> np.uint64(31)
    return x


BYTE_CODE = mixed(np.arange(1, 257, dtype=np.uint64))
_POWER = np.uint64(0xD1342543DE82EF95)


def powers(n: int) -> np.ndarray:
    out = np.full(max(n, 1), _POWER, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class Words:
    """Words of several texts laid end to end: start and end bytes, the text each is in, and their hashes.

    ``is_word`` tells for each of the 256 byte values whether it belongs to a word; ``code`` is the
    number that stands for a byte in hashes (equal for bytes that are to count as equal).
    """

    def __init__(self, data: np.ndarray, at: np.ndarray, is_word: np.ndarray, code: np.ndarray = BYTE_CODE):
        inside = is_word[data]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        # texts touch each other without a separator
        borders = at[1:-1][(at[1:-1] > 0) & (at[1:-1] < len(data))]
        first[borders] = inside[borders]
        last[borders - 1] = inside[borders - 1]
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        self.text = np.searchsorted(at, self.start, side="right") - 1
        self.count = np.bincount(self.text, minlength=len(at) - 1)[: len(at) - 1]
        self._data, self._code = data, code

    def sums(self) -> np.ndarray:
        """Running sums of the bytes' hash parts, one more than there are bytes of words.

        ``offset`` is where each word's bytes begin among the bytes of all words.
        """
        size = self.end - self.start
        self.offset = np.concatenate([[0], np.cumsum(size)])
        if not len(size):
            return np.zeros(1, np.uint64)
        within = np.arange(self.offset[-1]) - np.repeat(self.offset[:-1], size)
        where = within + np.repeat(self.start, size)
        parts = self._code[self._data[where]] * powers(int(size.max()))[within]
        return np.concatenate([np.zeros(1, np.uint64), np.cumsum(parts, dtype=np.uint64)])

    def hashes(self) -> np.ndarray:
        sums = self.sums()
        return mixed(sums[self.offset[1:]] - sums[self.offset[:-1]])


def byte_set(*ranges: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, bool)
    for low, high in ranges:
        out[low : high + 1] = True
    return out


# Words are what stands between ASCII white space.
NOT_SPACE = ~byte_set((0x20, 0x20), (0x09, 0x0D))

# Bytes of A-Z count as those of a-z.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
