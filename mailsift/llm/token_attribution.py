"""Token counts by section: a document is encoded once, its tokens are allotted to sections by offset.

Tokens and sections are intervals of characters. Both are in order, so the sections that a token meets
are found by binary search for its first and last character. A token that crosses a boundary is
allotted by an explicit rule:

* ``start``: to the section that holds its first character;
* ``most``: to the section that holds most of its characters, the earlier of equals;
* ``share``: to each section by the share of its characters that lie there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailsift.llm.chunk_encoder import worker_encoder
from mailsift.llm.common import runs

RULES = ("start", "most", "share")
# A sentence ends with its mark and the white space after it, a line with its line feed.
SENTENCES = r"[^\n.!?]*(?:[.!?]+[ \t]*|$|(?=\n))\n*|\n+"


def section_starts(text: str, pattern: regex.Pattern) -> list[int]:
    """First characters of the sections: they follow each other and cover the text."""
    starts = [m.start() for m in pattern.finditer(text) if m.end() > m.start()]
    return starts if starts and starts[0] == 0 else [0, *starts] if text else []


def allot(spans: np.ndarray, starts: np.ndarray, end: int, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section by the rule, and tokens of each that cross one of its boundaries.

    ``spans`` are character intervals in order, ``starts`` the sections' first characters; the last
    section ends at ``end``. A token without characters belongs where it stands.
    """
    n = len(starts)
    first = np.clip(np.searchsorted(starts, spans[:, 0], side="right") - 1, 0, n - 1)
    last = np.clip(np.searchsorted(starts, np.maximum(spans[:, 1] - 1, spans[:, 0]), side="right") - 1, 0, n - 1)
    whole = first == last
    crossing = np.flatnonzero(~whole)
    counts = np.bincount(first[whole], minlength=n).astype(np.float64)
    crossed = np.zeros(n, np.int64)
    ends = np.append(starts[1:], end)
    for t in crossing.tolist():
        held = np.arange(first[t], last[t] + 1)
        chars = np.minimum(ends[held], spans[t, 1]) - np.maximum(starts[held], spans[t, 0])
        crossed[held] += 1
        if rule == "start":
            counts[held[0]] += 1
        elif rule == "most":
            counts[held[int(np.argmax(chars))]] += 1
        else:
            counts[held] += chars / chars.sum()
    return counts, crossed


def token_counts(
    docs: DataFrame, ranks: str, pattern: str, rule: str = "most", sections: str = SENTENCES
) -> DataFrame:
    """``doc_id, section, start, end, tokens, crossing, doc_tokens``: a row for each section of a text.

    ``ranks`` and ``pattern`` are a tokenizer's rank file and its splitting pattern.

    ``section`` counts from 0; ``start`` and ``end`` are characters (end excluded) and leave no gap;
    ``tokens`` (double, whole numbers unless the rule is ``share``) add up to ``doc_tokens``; ``crossing``
    counts the tokens that reach over a boundary of the section. A null or empty text is one section
    from 0 to 0 without tokens. Every row of ``docs`` is taken by itself, so rows that repeat give their
    sections again, and a null doc_id stays null. Other columns are not read.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    names = ["doc_id", "section", "start", "end", "tokens", "crossing", "doc_tokens"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with worker_encoder(ranks, "byte", pattern) as encoder:
            cut = regex.compile(sections)
            for batch in batches:
                for part in runs(batch, "text"):
                    texts = part.column("text").fill_null("").to_pylist()
                    _, lengths, spans = encoder.encode(texts)
                    starts = [section_starts(t, cut) or [0] for t in texts]
                    sizes = np.array([len(s) for s in starts], np.int64)
                    wide = np.array([len(t) for t in texts], np.int64)
                    # The texts of the slice are laid end to end, each a character apart from the next.
                    base = np.cumsum(wide + 1) - (wide + 1)
                    where = np.concatenate([np.array(s, np.int64) + b for s, b in zip(starts, base.tolist())])
                    spans = spans + np.repeat(base, lengths)[:, None]
                    counts, crossed = allot(spans, where, int(base[-1] + wide[-1]), rule)
                    begin = where - np.repeat(base, sizes)
                    last = np.cumsum(sizes) - 1
                    end = np.append(begin[1:], 0)
                    end[last] = wide
                    doc = part.column("doc_id").take(pa.array(np.repeat(np.arange(len(texts)), sizes)))
                    number = np.arange(len(begin)) - np.repeat(last + 1 - sizes, sizes)
                    yield pa.record_batch(
                        [doc, pa.array(number), pa.array(begin), pa.array(end), pa.array(counts), pa.array(crossed),
                         pa.array(np.repeat(lengths, sizes))], names)

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(
        work, "doc_id bigint, section bigint, start bigint, `end` bigint, tokens double, crossing bigint, "
              "doc_tokens bigint")
