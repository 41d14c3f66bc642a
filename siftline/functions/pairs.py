"""Likeness of pairs of strings, for pairs that were blocked before; Python over Arrow batches."""

from __future__ import annotations

from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftline.functions.text import jaccard, norm_tokens


@F.arrow_udf(T.DoubleType())
def sequence_ratio(a: pa.Array, b: pa.Array) -> pa.Array:
    """Twice the matched characters over both lengths; null if either is null."""
    return pa.array([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.float64())


@F.arrow_udf(T.StringType())
def longest_common_substring(a: pa.Array, b: pa.Array) -> pa.Array:
    """The longest string in both, the first of the first one on ties."""
    out = []
    for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True):
        if x is None or y is None:
            out.append(None)
            continue
        m = SequenceMatcher(None, x, y, autojunk=False).find_longest_match(0, len(x), 0, len(y))
        out.append(x[m.a : m.a + m.size])
    return pa.array(out, pa.string())


def title_similarity(a: Column, b: Column) -> Column:
    """Mean of the sequence ratio and the Jaccard of the titles' words."""
    return (sequence_ratio(a, b) + jaccard(norm_tokens(a), norm_tokens(b))) / 2
