"""Token-set similarity for the strings that are neither equal nor a subset of each other.

Those two cases are decided by plain Column expressions (see ``compare``), so only the
remaining pairs cross into Python, in Arrow batches.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F, types as T

from fieldledger.functions.text import WS_RUN

_SPLIT = re.compile(WS_RUN)


def lcs_length(a: str, b: str) -> int:
    """Longest common subsequence, one machine-word-parallel step per character of ``b``."""
    if len(a) > len(b):
        a, b = b, a
    masks: dict[str, int] = {}
    for i, ch in enumerate(a):
        masks[ch] = masks.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        hit = row & masks.get(ch, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def token_set_similarity(p: str, t: str) -> float:
    """Similarity in 0..1 of two normalised strings seen as sets of words."""
    left = set(filter(None, _SPLIT.split(p)))
    right = set(filter(None, _SPLIT.split(t)))
    if not left or not right:
        return 0.0
    shared = " ".join(left & right)
    only_l, only_r = " ".join(sorted(left - right)), " ".join(sorted(right - left))
    if shared and not (only_l and only_r):
        return 1.0
    joint = len(shared) + 1 if shared else 0
    la, lb = joint + len(only_l), joint + len(only_r)
    distance = len(only_l) + len(only_r) - 2 * lcs_length(only_l, only_r)
    best = 1.0 - distance / (la + lb)
    if shared:
        best = max(
            best,
            1.0 - (la - len(shared)) / (len(shared) + la),
            1.0 - (lb - len(shared)) / (len(shared) + lb),
        )
    return best


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def pair_similarities(pairs: pd.Series) -> pd.Series:
    """Similarity of every (p, t) pair in each row's array."""
    return pairs.map(lambda row: [token_set_similarity(x["p"], x["t"]) for x in row])
