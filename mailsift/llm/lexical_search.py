"""Ranked lexical search, term at a time over short lists and document at a time over long ones.

Documents are read once into compact rows: their number of terms, and code and frequency of the terms that
some query may hold. Which may is told by a bit table of fixed size, so what is sent to the tasks does not
grow with the queries. Statistics (documents, terms, document frequencies) are counted by Spark from these rows.

Then blocks of documents are inverted in memory and searched. For each query the shortest lists of a
block are summed into accumulators, term at a time. The summed accumulators are from there on one iterator
with a bound, its largest sum, beside the long lists with theirs. Document at a time, only iterators
whose bounds can still reach the k-th best score together propose documents; the others are probed, the
strongest first, for documents that can still get there, and ranges of documents whose bounds
cannot reach it are skipped. What can only equal the k-th best is scored too, so ties are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailsift.llm.common import BYTE_CODE, LOWER, Words, Workspace, byte_set, runs, utf8

TOP = 10
# Letters and digits of ASCII, and all bytes of longer characters.
IS_TERM = byte_set((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
CODE = BYTE_CODE[LOWER]
# Bits of the table of query terms.
FILTER_BITS = 1 << 22
# Postings of a block, and term entries of the queries that one pass searches.
BLOCK_POSTINGS = 1 << 20
QUERY_TERMS = 1 << 20
# Short lists hold together at most this part of a block's documents, or as many as SHORT if that is more.
SHORT_PART, SHORT = 8, 256
# Documents of a range that can be skipped whole.
RANGE = 512


def term_codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, code and frequency of the distinct terms of each text in order, and the number of terms of each."""
    words = Words(*utf8(texts), IS_TERM, CODE)
    code = words.hashes()
    order = np.lexsort((code, words.text))
    text, code = words.text[order], code[order]
    new = np.ones(len(code), bool)
    new[1:] = (text[1:] != text[:-1]) | (code[1:] != code[:-1])
    at = np.flatnonzero(new)
    tf = np.diff(np.append(at, len(code)))
    return text[at], code[at].view(np.int64), tf, words.count


def _lists(keys: pa.Array, text, code, tf, count, names: list[str]) -> pa.RecordBatch:
    offsets = pa.array(np.searchsorted(text, np.arange(len(keys) + 1)).astype(np.int32))
    return pa.record_batch(
        [keys, pa.array(count.astype(np.int64)), pa.ListArray.from_arrays(offsets, pa.array(code)),
         pa.ListArray.from_arrays(offsets, pa.array(tf.astype(np.int32)))], names)


def coded(rows: DataFrame, key: str, known: np.ndarray | None = None) -> DataFrame:
    """``key, n, codes, tfs`` of ``key, text``; terms outside the bit table ``known`` are left out of the lists."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in runs(batch, "text"):
                text, code, tf, count = term_codes(part.column("text"))
                if known is not None:
                    bit = code.view(np.uint64) % np.uint64(8 * len(known))
                    keep = known[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8) & 1 == 1
                    text, code, tf = text[keep], code[keep], tf[keep]
                yield _lists(part.column(key), text, code, tf, count, [key, "n", "codes", "tfs"])

    return rows.mapInArrow(work, f"{key} bigint, n bigint, codes array<bigint>, tfs array<int>")


def bit_table(asked: DataFrame, bits: int = FILTER_BITS) -> np.ndarray:
    """The codes of all queries as a table of ``bits`` bits; at most ``bits / 32`` words reach the driver."""
    # The remainder of the code as an unsigned number.
    bit = F.pmod(F.col("code"), F.lit(bits))
    words = asked.select((bit / 32).cast("int").alias("word"), F.expr(f"shiftleft(1L, cast(pmod(code, {bits}) % 32 as int))").alias("b"))
    found = words.groupBy("word").agg(F.bit_or("b").alias("b")).toArrow()
    table = np.zeros(bits // 32, "<u4")
    table[np.asarray(found.column("word").combine_chunks())] = np.asarray(found.column("b").combine_chunks()).astype("<u4")
    return table.view(np.uint8)


class Block:
    """The inverted lists of some documents: documents ascending by position, with what a term of weight 1 gives."""

    def __init__(self, ids: np.ndarray, m: np.ndarray, doc: np.ndarray, code: np.ndarray, tf: np.ndarray):
        self.ids = ids
        order = np.argsort(code, kind="stable")
        self._doc, code = doc[order], code[order]
        tf = tf[order].astype(np.int64)
        self._part = 1_000_000_000 * tf // (1000 * tf + 8 * m[self._doc])
        new = np.ones(len(code), bool)
        new[1:] = code[1:] != code[:-1]
        self._codes, self._at = code[new], np.append(np.flatnonzero(new), len(code))
        self._most = np.maximum.reduceat(self._part, self._at[:-1]) if len(code) else np.zeros(0, np.int64)

    def lists(self, codes: np.ndarray, weights: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, int, int]]:
        """(documents, parts, weight, bound) for the terms that occur here and weigh something."""
        if not len(self._codes):
            return []
        at = np.minimum(np.searchsorted(self._codes, codes), len(self._codes) - 1)
        out = []
        for i in np.flatnonzero((self._codes[at] == codes) & (weights > 0)).tolist():
            a, b, w = self._at[at[i]], self._at[at[i] + 1], int(weights[i])
            out.append((self._doc[a:b], self._part[a:b], w, w * int(self._most[at[i]])))
        return out

    def search(self, codes: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions and scores of the k best documents, and of all that equal the k-th."""
        lists = sorted(self.lists(codes, weights), key=lambda x: len(x[0]))
        room, short = max(len(self.ids) // SHORT_PART, SHORT), 0
        while short < len(lists) and room >= len(lists[short][0]):
            room -= len(lists[short][0])
            short += 1
        iterators = [(d, w * p, b) for d, p, w, b in lists[short:]]
        if short:
            # Term at a time.
            docs = np.concatenate([x[0] for x in lists[:short]])
            parts = np.concatenate([x[2] * x[1] for x in lists[:short]])
            order = np.argsort(docs, kind="stable")
            docs, parts = docs[order], parts[order]
            first = np.flatnonzero(np.append(True, docs[1:] != docs[:-1]))
            sums = np.add.reduceat(parts, first)
            iterators.append((docs[first], sums, int(sums.max())))
        return document_at_a_time(iterators, k)


def document_at_a_time(iterators: list[tuple[np.ndarray, np.ndarray, int]], k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best and their ties of iterators (documents ascending, scores, bound), by bounds and skips."""
    best_docs, best = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not iterators:
        return best_docs, best
    # Weak bounds first: a prefix whose bounds together stay below the k-th best proposes nothing.
    iterators = sorted(iterators, key=lambda x: x[2])
    sums = np.cumsum([x[2] for x in iterators])
    last = 1 + max(int(x[0][-1]) for x in iterators)
    cuts = [np.searchsorted(x[0], np.arange(0, last + RANGE, RANGE)) for x in iterators]
    # The largest score of each iterator in each range of documents.
    tops = np.zeros((len(iterators), len(cuts[0]) - 1), np.int64)
    for row, (docs, scores, _), cut in zip(tops, iterators, cuts):
        held = np.flatnonzero(cut[1:] > cut[:-1])
        row[held] = np.maximum.reduceat(scores, cut[held])
    upto = np.cumsum(tops, axis=0)
    least, essential = 1, 0
    # Ranges that may hold the most come first, so the k-th best rises early.
    for r in np.argsort(-upto[-1], kind="stable").tolist():
        if upto[-1, r] < least:
            break
        while essential < len(iterators) and sums[essential] < least:
            essential += 1
        proposed = [x[0][c[r] : c[r + 1]] for x, c in zip(iterators[essential:], cuts[essential:])]
        docs = np.unique(np.concatenate(proposed)) if proposed else np.zeros(0, np.int64)
        if not len(docs):
            continue
        base = r * RANGE
        row = np.zeros(RANGE, np.int64)
        for (d, s, _), c in zip(iterators[essential:], cuts[essential:]):
            row[d[c[r] : c[r + 1]] - base] += s[c[r] : c[r + 1]]
        score = row[docs - base]
        for n in range(essential - 1, -1, -1):
            keep = score + upto[n, r] >= least
            docs, score = docs[keep], score[keep]
            if not len(docs):
                break
            d, s, _ = iterators[n]
            a, b = cuts[n][r], cuts[n][r + 1]
            if b > a:
                at = a + np.minimum(np.searchsorted(d[a:b], docs), b - a - 1)
                score = score + np.where(d[at] == docs, s[at], 0)
        keep = score >= least
        if keep.any():
            best_docs, best = np.concatenate([best_docs, docs[keep]]), np.concatenate([best, score[keep]])
            if len(best) >= k:
                least = max(least, int(np.partition(best, len(best) - k)[len(best) - k]))
                keep = best >= least
                best_docs, best = best_docs[keep], best[keep]
    return best_docs, best


def _searched(docs: DataFrame, queries: list[tuple[int, np.ndarray, np.ndarray]], documents: int, terms: int, k: int) -> DataFrame:
    def found(ids, lengths, codes, tfs, sizes):
        ids, n = np.concatenate(ids), np.concatenate(lengths)
        m = 25 + (75 * n * documents) // max(terms, 1)
        block = Block(ids, m, np.repeat(np.arange(len(ids)), np.concatenate(sizes)), np.concatenate(codes), np.concatenate(tfs))
        out = tuple([np.zeros(0, np.int64)] for _ in range(3))
        for number, asked, weights in queries:
            at, score = block.search(asked, weights, k)
            first = np.lexsort((block.ids[at], -score))[:k]
            out[0].append(np.full(len(first), number, np.int64))
            out[1].append(block.ids[at][first])
            out[2].append(score[first])
        return pa.record_batch([pa.array(np.concatenate(x)) for x in out], ["item", "doc_id", "score"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, postings = ([], [], [], [], []), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column("codes")
            sizes = np.asarray(lists.value_lengths())
            for x, y in zip(held, (batch.column("doc_id"), batch.column("n"), lists.flatten(), batch.column("tfs").flatten(), sizes)):
                x.append(np.asarray(y))
            postings += int(sizes.sum())
            if postings >= BLOCK_POSTINGS:
                yield found(*held)
                held, postings = ([], [], [], [], []), 0
        if held[0]:
            yield found(*held)

    return docs.mapInArrow(work, "item bigint, doc_id bigint, score bigint")


def search(docs: DataFrame, items: DataFrame, work: Workspace, k: int = TOP, id_column: str = "doc_id") -> DataFrame:
    """``item_id, rank, doc_id, score``: the k highest-scoring rows of ``docs`` for each item, from rank 1.

    Terms are runs of ASCII letters and digits and of characters beyond ASCII, A-Z in lower case; the score is
    the sum over an item's terms, repeats included, of ``w * ((1000000000 * tf) div (1000 * tf + 8 * m))``. Only scores
    above 0 are returned, equal ones by doc_id. A null or empty text has no terms and is no document. Every row
    of ``docs`` is a document, so a repeated row can stand twice; rows with a null doc_id can be found, behind all
    others of their score. Items without terms give no row; of rows that share an item_id the least text is
    asked; a null item_id is an item. Other columns are not read; empty tables give an empty one. Terms
    are told apart by codes of 64 bits, and only a document's terms that fall on an item's bit are kept.
    """
    # Null ids stand behind all others.
    last = (1 << 63) - 1
    items = items.select(F.col("item_id").cast("bigint").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    items = items.groupBy("item_id").agg(F.min("text").alias("text"))
    # Numbers that stand for the items, as ids may be null.
    items = work.keep(items.withColumn("item", F.coalesce(F.col("item_id"), F.lit(last))))
    asked = work.keep(coded(items.select("item", "text"), "item").select(
        "item", F.explode(F.arrays_zip("codes", "tfs")).alias("x")).select("item", F.col("x.codes").alias("code"), F.col("x.tfs").alias("times")))
    rows = docs.select(F.coalesce(F.col(id_column).cast("bigint"), F.lit(last)).alias("doc_id"), F.col("text").cast("string").alias("text"))
    kept = work.keep(coded(rows, "doc_id", bit_table(asked)).filter("n > 0"))
    totals = kept.agg(F.count("*").alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    frequency = kept.select(F.explode("codes").alias("code")).groupBy("code").agg(F.count("*").alias("df"))
    weight = F.floor(1000 * F.log((2 * F.lit(totals.documents) + 2).cast("double") / (2 * F.col("df") + 1).cast("double")))
    weighed = work.keep(
        asked.join(frequency, "code").select("item", "code", (F.col("times") * weight).cast("bigint").alias("weight")))
    passes = max(1, -(-weighed.count() // QUERY_TERMS))
    out = None
    for number in range(passes):
        mine = weighed.filter(F.pmod(F.xxhash64("item"), F.lit(passes)) == number).orderBy("item", "code").toArrow()
        item = np.asarray(mine.column("item").combine_chunks())
        codes, weights = np.asarray(mine.column("code").combine_chunks()), np.asarray(mine.column("weight").combine_chunks())
        at = np.append(np.flatnonzero(np.append(True, item[1:] != item[:-1])), len(item)) if len(item) else np.zeros(1, np.int64)
        queries = [(int(item[a]), codes[a:b], weights[a:b]) for a, b in zip(at[:-1], at[1:])]
        found = _searched(kept, queries, totals.documents, totals.terms, k)
        out = found if out is None else out.unionByName(found)
    rank = F.expr("row_number() over (partition by item order by score desc, doc_id)")
    best = out.withColumn("rank", rank).filter(F.col("rank") <= k)
    return best.select(
        F.nullif(F.col("item"), F.lit(last)).alias("item_id"), "rank", F.nullif(F.col("doc_id"), F.lit(last)).alias("doc_id"), "score")
