"""Text of JSON trees: nested lists of strings with "…" placeholders."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from mailsift.functions.patterns import matches, replace_all

# Possessive: a string with thousands of escapes is matched without recursion.
_STRING_LITERAL = r'(?s)"[^"\\]*+(?:\\.[^"\\]*+)*+"'
_ELIDED = "…"


def _leaf_strings(node) -> list[str]:
    if isinstance(node, str):
        return [node] if node and node != _ELIDED else []
    if isinstance(node, list):
        return [leaf for child in node for leaf in _leaf_strings(child)]
    return []


def _flatten(raw: str | None) -> str | None:
    if raw is None:
        return None
    try:
        return "\n".join(_leaf_strings(json.loads(raw)))
    except (ValueError, RecursionError):
        return raw


@F.pandas_udf(StringType())
def _flattened(raw: pd.Series) -> pd.Series:
    return raw.map(_flatten)


def json_tree_text(raw: Column) -> Column:
    """String leaves joined by line feeds; text that is no JSON stays as it is.

    Trees of lists and scalars are read on the JVM. Only trees holding objects, whose strings
    do not count, go through Python.
    """
    is_json = F.try_parse_json(raw).isNotNull()
    has_object = F.contains(replace_all(raw, _STRING_LITERAL, ""), F.lit("{"))
    literals = F.array_join(F.regexp_extract_all(raw, F.lit(_STRING_LITERAL), F.lit(0)), ",")
    leaves = F.from_json(F.concat(F.lit("["), literals, F.lit("]")), "array<string>")
    joined = F.array_join(F.filter(leaves, lambda s: (s != "") & (s != _ELIDED)), "\n")
    from_objects = _flattened(F.when(looks_like_json(raw) & has_object, raw))
    return F.when(looks_like_json(raw) & has_object, from_objects).when(is_json, joined).otherwise(raw)


def looks_like_json(raw: Column) -> Column:
    return matches(raw, r"\A[ \t\r\n]*+[\[{]")
