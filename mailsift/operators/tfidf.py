"""TF-IDF over 1-2-grams: vocabulary fit, weights, long form."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import PipelineModel
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mailsift.functions.fixed_values import MAX_VOCABULARY
from mailsift.functions.terms import pair_term, with_pairs, with_terms, with_tokens
from mailsift.workspace import given_back, local_table, sized


# Tokens that a task counts at once, at least those of one text; and tokens that are looked up in every task, at most.
TOKENS_AT_ONCE, LOOKED_UP = 1 << 20, 1 << 17


def _runs(lists: pa.Array) -> Iterator[tuple[pa.Array, np.ndarray, int]]:
    """Tokens of consecutive texts, the place of the text of each, and how many texts."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    upto, start = np.cumsum(sizes, dtype=np.int64), 0
    while start < len(lists):
        done = int(upto[start - 1]) if start else 0
        end = max(start + 1, int(np.searchsorted(upto, done + TOKENS_AT_ONCE, side="right")))
        yield lists.slice(start, end - start).flatten(), np.repeat(np.arange(end - start), sizes[start:end]), end - start
        start = end


def _tallied(code: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct codes in order, how often each occurs, and in how many rows."""
    both = np.sort(code.astype(np.int64) * rows + row)
    found = both // rows
    start = np.flatnonzero(np.append(True, found[1:] != found[:-1])) if len(both) else np.zeros(0, np.int64)
    new = np.append(True, both[1:] != both[:-1])[: len(both)].astype(np.int64)
    return found[start], np.diff(np.append(start, len(both))), np.add.reduceat(new, start) if len(start) else start


def _counts(term: pa.Array, tf: np.ndarray, df: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([term.cast(pa.string()), pa.array(tf, pa.int64()), pa.array(df, pa.int64())], ["term", "tf", "df"])


def _added_up(parts: DataFrame) -> DataFrame:
    return parts.groupBy("term").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"))


def token_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """(term, tf, df) of the tokens; tasks count their texts, so what is shuffled are terms and not their occurrences."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tokens, row, rows in _runs(batch.column("_tokens")):
                coded = tokens.dictionary_encode()
                code, tf, found = _tallied(coded.indices.to_numpy(), row, rows)
                yield _counts(coded.dictionary.take(pa.array(code)), tf, found)

    return _added_up(with_tokens(df.select(text), text).select("_tokens").mapInArrow(lambda batches: given_back(counted(batches)), "term string, tf bigint, df bigint"))


def _pair_counts(df: DataFrame, text: str, among: list[str] | None) -> DataFrame:
    """(term, tf, df) of bigrams, of those made of the given tokens if any are given."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given = None if among is None else pa.array(among, pa.string())
        for batch in batches:
            for tokens, row, rows in _runs(batch.column("_tokens")):
                coded = tokens.dictionary_encode()
                names = coded.dictionary.cast(pa.string())
                code = coded.indices.to_numpy()
                if given is not None:
                    place = pc.fill_null(pc.index_in(names, given), -1).to_numpy()
                    code, names = place[code], given
                code, size = code.astype(np.int64), max(len(names), 1)
                held = np.flatnonzero((row[1:] == row[:-1]) & (code[1:] >= 0) & (code[:-1] >= 0))
                first, second = code[held], code[held + 1]
                if given is None:
                    # Pairs of all tokens are numbered anew: products of two numbers and a row might not fit.
                    kinds, pair = np.unique(first * size + second, return_inverse=True)
                    at, tf, found = _tallied(pair, row[held], rows)
                    at = kinds[at]
                else:
                    at, tf, found = _tallied(first * size + second, row[held], rows)
                words = [names.take(pa.array(part)) for part in (at // size, at % size)]
                yield _counts(pc.binary_join_element_wise(*words, " "), tf, found)

    return _added_up(with_tokens(df.select(text), text).select("_tokens").mapInArrow(lambda batches: given_back(counted(batches)), "term string, tf bigint, df bigint"))


def bigram_counts(df: DataFrame, text: str = "text", tokens: DataFrame | None = None) -> DataFrame:
    """Frequencies of bigrams, on request only of those made of the given tokens.

    A pair that is dropped is dropped in all texts, so what is left is counted in full.
    """
    if tokens is None:
        return _pair_counts(df, text, None)
    few = [r.term for r in tokens.select("term").limit(LOOKED_UP + 1).collect()]
    if len(few) <= LOOKED_UP:
        return _pair_counts(df, text, few)
    # More tokens than a task should hold: the pairs are joined with them.
    # Outer generators here and below: for inner ones Spark adds a filter on the array's size and
    # computes the array a second time for it.
    # A text's pairs are numbered by a place of their own, so its first of a kind can be told after the filter.
    paired = with_pairs(with_tokens(df.select(text), text)).select(F.array_sort("pairs").alias("_pairs"))
    marked = F.transform("_pairs", lambda p, i: F.struct(
        p.first.alias("first"), p.second.alias("second"),
        ((i == 0) | (p != F.get(F.col("_pairs"), i - 1))).cast("int").alias("new")))
    pairs = paired.select(F.inline_outer(marked)).filter(F.col("second").isNotNull())
    pairs = pairs.join(tokens.select(F.col("term").alias("first")), "first", "left_semi")
    pairs = pairs.join(tokens.select(F.col("term").alias("second")), "second", "left_semi")
    return pairs.groupBy("first", "second").agg(F.count("*").alias("tf"), F.sum("new").alias("df")).select(
        pair_term(F.col("first"), F.col("second")).alias("term"), "tf", "df")


def frequent_terms(df: DataFrame, text: str, max_terms: int) -> DataFrame:
    """(term, tf, df) of the ``max_terms`` most frequent tokens and bigrams, ties by term. Exact.

    A bigram is never more frequent than its tokens. So once the tokens are counted, only bigrams
    of two tokens that reach the frequency of the ``max_terms``-th token can still get in, and the
    mass of rare bigrams is dropped where the text is read instead of being shuffled. That frequency
    is read off a histogram of the frequencies.
    """
    tokens = sized(token_counts(df, text), "tokens")
    down = Window.orderBy(F.desc("tf")).rowsBetween(Window.unboundedPreceding, 0)
    reached = tokens.groupBy("tf").agg(F.count("*").alias("n")).withColumn("upto", F.sum("n").over(down))
    floor = reached.filter(F.col("upto") >= max_terms).agg(F.coalesce(F.max("tf"), F.lit(0)).alias("floor")).first().floor
    frequent = sized(tokens.filter(F.col("tf") >= floor), "frequent-tokens")
    counts = frequent.unionByName(bigram_counts(df, text, frequent))
    return counts.orderBy(F.desc("tf"), "term").limit(max_terms)


def idf(documents: Column | int, frequency: Column) -> Column:
    """Smoothed: ln((1 + n) / (1 + df)) + 1."""
    documents = documents if isinstance(documents, Column) else F.lit(documents)
    return F.log((F.lit(1) + documents) / (F.lit(1) + frequency)) + 1


def vocabulary(df: DataFrame, text: str = "text", max_terms: int = MAX_VOCABULARY) -> DataFrame:
    """The most frequent terms, numbered alphabetically, with tf, df and idf.

    Holds at most ``max_terms`` rows, which also pass through the driver.
    """
    kept = sorted(frequent_terms(df, text, max_terms).collect(), key=lambda r: r.term)
    rows = [(r.term, i, r.tf, r.df) for i, r in enumerate(kept)]
    numbered = local_table(df.sparkSession, rows, "term string, feature_idx int, tf bigint, df bigint")
    return numbered.withColumn("idf", idf(df.count(), F.col("df")))


@dataclass
class Tfidf:
    """A fitted vocabulary. Weighting needs no shuffle: terms are looked up in a broadcast table."""

    terms: list[str]
    pipeline: PipelineModel

    @classmethod
    def fit(cls, df: DataFrame, text: str = "text", max_terms: int = MAX_VOCABULARY) -> "Tfidf":
        return cls.from_vocabulary(vocabulary(df, text, max_terms))

    @classmethod
    def from_vocabulary(cls, table: DataFrame) -> "Tfidf":
        """The table has at most ``max_terms`` rows by construction and is kept on the driver."""
        rows = sorted(table.select("term", "feature_idx", "idf").collect(), key=lambda r: r.feature_idx)
        terms = [r.term for r in rows]
        counts = CountVectorizerModel.from_vocabulary(terms, inputCol="terms", outputCol="term_counts")
        weights = ElementwiseProduct(
            scalingVec=Vectors.dense([r.idf for r in rows]), inputCol="term_counts", outputCol="term_weights"
        )
        unit = Normalizer(p=2.0, inputCol="term_weights", outputCol="tfidf")
        return cls(terms, PipelineModel([counts, weights, unit]))

    def transform(self, df: DataFrame, text: str = "text") -> DataFrame:
        """Append the sparse vector column ``tfidf``; unknown terms are dropped."""
        weighted = self.pipeline.transform(with_terms(df, text))
        return weighted.drop("terms", "term_counts", "term_weights")

    def save(self, path: str) -> None:
        self.pipeline.write().overwrite().save(path)

    @classmethod
    def load(cls, path: str) -> "Tfidf":
        pipeline = PipelineModel.load(path)
        return cls(list(pipeline.stages[0].vocabulary), pipeline)


def long_form(df: DataFrame, vector: str, keys: list[str]) -> DataFrame:
    """(keys, feature_idx, value) of the non-zero entries of a vector column, without a shuffle."""
    v = F.unwrap_udt(F.col(vector))
    unwrapped = df.select(*keys, v.alias("v"))
    positions = F.coalesce(F.col("v.indices"), F.sequence(F.lit(0), F.size("v.values") - 1))
    entries = F.arrays_zip(positions.alias("feature_idx"), F.col("v.values").alias("value"))
    return unwrapped.select(*keys, F.inline_outer(entries)).toDF(*keys, "feature_idx", "value").filter("value <> 0")
