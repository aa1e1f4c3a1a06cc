"""Regex building blocks shared by the column functions.

Word boundaries, digits and white space are spelled out as Unicode classes, so results do not
depend on the JVM's notion of ``\\b``, ``\\w``, ``\\d`` and ``\\s``.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Bytes of texts that a Python function holds as Python strings at once, where one text is not longer.
BYTES_AT_ONCE = 1 << 20

SPACE = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
# \w and the POSIX classes used as guards are ASCII-only and cost one table lookup.
WORD_CHAR = r"\w\p{L}\p{N}"
AT_WORD_START = rf"(?<!\w)(?<![{WORD_CHAR}])"
AT_WORD_END = rf"(?![{WORD_CHAR}])"


def unicode_classes(pattern: str) -> str:
    """Spell the shorthand classes of a fixed pattern as Unicode classes."""
    worded = re.sub(r"(?<!\[)\\w", lambda _: f"[{WORD_CHAR}]", pattern.replace(r"[\w-]", rf"[{WORD_CHAR}-]"))
    return worded.replace(r"\d", r"\p{Nd}").replace(r"\s", f"[{SPACE}]")


def any_of(patterns: list[str]) -> str:
    return "(?:" + "|".join(unicode_classes(p) for p in patterns) + ")"


def first_letter_guard(patterns: list[str]) -> str:
    """Look-ahead on the possible first characters in both cases; rejects most positions cheaply.

    Besides the ASCII letters, two characters fold to "s" and "k".
    """
    firsts = sorted({re.sub(r"\A[\^\\(]+", "", p)[0].lower() for p in patterns})
    both = sorted({*firsts, *(c.upper() for c in firsts)})
    folded = ("ſ" if "s" in firsts else "") + ("K" if "k" in firsts else "")
    return f"(?=[{''.join(map(re.escape, both))}{folded}])"


def whole_phrases(phrases: list[str]) -> str:
    """One alternation of whole phrases, any case."""
    return rf"(?<!\w){first_letter_guard(phrases)}{AT_WORD_START}(?iu:{any_of(phrases)}){AT_WORD_END}"


def phrase_starts(phrases: list[str]) -> str:
    """Phrases that begin at a word start and may go on after their end, any case."""
    return rf"(?<!\w){first_letter_guard(phrases)}{AT_WORD_START}(?iu:{any_of(phrases)})"


def anywhere(patterns: list[str], flags: str) -> str:
    return f"{first_letter_guard(patterns)}(?{flags}:{any_of(patterns)})"


def matches(text: Column, pattern: str) -> Column:
    return F.rlike(text, F.lit(pattern))


def replace_all(text: Column, pattern: str, by: str) -> Column:
    return F.regexp_replace(text, F.lit(pattern), F.lit(by))


def trim_space(text: Column) -> Column:
    """Trim every Unicode white space at both ends, not only blanks."""
    return replace_all(text, rf"\A[{SPACE}]++|(?!\p{{Graph}})[{SPACE}]++\z", "")


def by_runs(work: Callable[[str], str], most: int = BYTES_AT_ONCE) -> Callable[[pa.Array], pa.Array]:
    """The function for all texts of an Arrow batch, NULL for NULL.

    A batch may hold thousands of long texts, which take several times their bytes as Python strings, so
    only runs of ``most`` bytes are unpacked together.
    """

    def mapped(texts: pa.Array) -> pa.Array:
        upto = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        parts, start = [pa.array([], pa.string())], 0
        while start < len(texts):
            done = int(upto[start - 1]) if start else 0
            end = max(start + 1, int(np.searchsorted(upto, done + most, side="right")))
            run = texts.slice(start, end - start).to_pylist()
            parts.append(pa.array([None if t is None else work(t) for t in run], pa.string()))
            start = end
        return pa.concat_arrays(parts)

    return mapped


def with_computed(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Append (or replace) a costly column that later filters use.

    A filter above a projection gets a copy of the projected expression and would compute it
    again, once per mention. A generator over a one-element array is not looked through, so the
    value is computed once per row.
    """
    return df.withColumn(name, F.explode(F.array(value)))
