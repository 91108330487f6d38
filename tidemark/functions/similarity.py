"""String similarity kernels and their lossless pruning bounds."""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F


def matcher_ratio(a: str, b: str) -> float:
    """Share of matching blocks; not symmetric, so the order (query, candidate) matters."""
    return 1.0 if a == b else SequenceMatcher(None, a, b).ratio()


def lcs_length(a: str, b: str) -> int:
    """Longest common subsequence, with the columns of the table packed into one integer."""
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        hit = row & where.get(ch, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def indel_ratio(a: str, b: str) -> float:
    """2*LCS/(len+len) to two decimals; 0 when either side is empty."""
    if not a or not b:
        return 0.0
    return round(100 * 2 * lcs_length(a, b) / (len(a) + len(b))) / 100.0


KERNELS = {"matcher": matcher_ratio, "indel": indel_ratio}


def kernel_udf(kernel: str):
    fn = KERNELS[kernel]

    @F.pandas_udf("double")
    def score(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else fn(x, y) for x, y in zip(a, b)], dtype="float64")

    return score


def length_bound(a: Column, b: Column) -> Column:
    """No ratio of these two strings can exceed this."""
    la, lb = F.length(a), F.length(b)
    return F.coalesce(F.try_divide(2.0 * F.least(la, lb), la + lb), F.lit(1.0))


def indel_bound(a: Column, b: Column) -> Column:
    """Upper bound of the indel ratio from the built-in edit distance, with room for its rounding."""
    return F.coalesce(1.0 - F.try_divide(F.levenshtein(a, b), F.length(a) + F.length(b)), F.lit(1.0)) + 0.005


def score_pairs(pairs: DataFrame, a: str, b: str, kernel: str = "matcher", out: str = "score") -> DataFrame:
    """Add the ratio of two text columns, computed once per distinct lower-case pair."""
    keyed = pairs.withColumns({"_a": F.lower(a), "_b": F.lower(b)})
    scored = keyed.select("_a", "_b").distinct().withColumn(out, kernel_udf(kernel)("_a", "_b"))
    return keyed.join(scored, (keyed["_a"].eqNullSafe(scored["_a"])) & (keyed["_b"].eqNullSafe(scored["_b"])), "left").drop("_a", "_b")


def multiset_bounds(left: list[str], right: list[str]) -> np.ndarray:
    """Matrix of 2*|common characters|/(len+len): an upper bound of both kernels."""
    alphabet = {ch: i for i, ch in enumerate(sorted(set("".join(left)) | set("".join(right))))}

    def counts(words):
        m = np.zeros((len(words), max(1, len(alphabet))), dtype=np.int32)
        for i, w in enumerate(words):
            for ch in w:
                m[i, alphabet[ch]] += 1
        return m

    a, b = counts(left), counts(right)
    common = np.zeros((len(left), len(right)), dtype=np.float64)
    for j in range(a.shape[1]):
        rows, cols = np.flatnonzero(a[:, j]), np.flatnonzero(b[:, j])
        if len(rows) and len(cols):
            common[np.ix_(rows, cols)] += np.minimum(a[rows, j][:, None], b[cols, j][None, :])
    total = a.sum(1)[:, None] + b.sum(1)[None, :]
    return np.divide(2.0 * common, total, out=np.ones_like(common), where=total > 0)
