"""Exact distributions of rank statistics by counting; each function works on one row for each test."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

MOST = 50  # tests with more values are left to the approximations


@lru_cache(maxsize=256)
def rank_sum_counts(m: int, n: int) -> np.ndarray:
    """In how many ways U = 0 .. m n arises from m and n values without ties.

    The largest value belongs to the first sample, and then lies above all n, or to the second: ``c(m, n, u) = c(m - 1, n, u - n) + c(m, n - 1, u)``.
    Counts are Python integers, which don't overflow.
    """
    above = [np.ones(1, object)] * (n + 1)  # c(0, j)
    for i in range(1, m + 1):
        row = [np.ones(1, object)]  # c(i, 0)
        for j in range(1, n + 1):
            c = np.zeros(i * j + 1, object)
            c[j:] += above[j]
            c[: i * (j - 1) + 1] += row[j - 1]
            row.append(c)
        above = row
    return above[n]


@lru_cache(maxsize=256)
def signed_rank_counts(n: int) -> np.ndarray:
    """In how many of the 2^n choices of signs the positive ranks sum to 0 .. n (n + 1) / 2: each rank is in the sum or not."""
    c = np.ones(1, object)
    for i in range(1, n + 1):
        wider = np.zeros(len(c) + i, object)
        wider[: len(c)] += c
        wider[i:] += c
        c = wider
    return c


def upper_tail(counts: np.ndarray, at: float) -> float:
    """P(S >= at)."""
    low = max(0, int(np.ceil(at - 1e-9)))
    return float(counts[low:].sum() / counts.sum()) if low < len(counts) else 0.0


@F.pandas_udf(DoubleType())
def rank_sum_tail(u: pd.Series, n_a: pd.Series, n_b: pd.Series) -> pd.Series:
    """K1.  P(U >= u) without ties; null for samples of MOST values and more."""
    fits = lambda x, m, n: not pd.isna(x) and m < MOST and n < MOST
    return pd.Series([upper_tail(rank_sum_counts(int(m), int(n)), x) if fits(x, m, n) else None for x, m, n in zip(u, n_a, n_b, strict=True)], dtype="float64")


@F.pandas_udf(DoubleType())
def signed_rank_tail(w: pd.Series, n: pd.Series) -> pd.Series:
    """K2.  P(W >= w) without ties; null for MOST differences and more."""
    return pd.Series([upper_tail(signed_rank_counts(int(k)), x) if not pd.isna(x) and k < MOST else None for x, k in zip(w, n, strict=True)], dtype="float64")


def lattice_share(d: float, m: int, n: int, ends: np.ndarray) -> float:
    """The share of lattice paths from (0, 0) to (m, n) that reach a difference ``|i / m - j / n|`` of at least d at a place where a run of
    ties ends.

    Row by row: ``p(i, j)`` is the share of paths to (i, j) that stay below d, by the last step's direction.
    """
    at_end = np.zeros(m + n + 1, bool)
    at_end[ends] = True
    far = d - 1e-9 * max(d, 1.0)
    i, j = np.arange(m + 1)[:, None], np.arange(n + 1)[None, :]
    out = at_end[i + j] & (np.abs(i / m - j / n) >= far)
    share = np.zeros((m + 1, n + 1))
    share[0, 0] = 1.0
    for total in range(1, m + n + 1):  # along diagonals; a path's next step goes to either side by what is left of each sample
        x = np.arange(max(0, total - n), min(m, total) + 1)
        y = total - x
        left = np.where(x > 0, share[x - 1, y] * (m - x + 1), 0.0)
        below = np.where(y > 0, share[x, y - 1] * (n - y + 1), 0.0)
        share[x, y] = np.where(out[x, y], 0.0, (left + below) / (m + n - total + 1))
    return float(min(1.0, max(0.0, 1 - share[m, n])))


@F.pandas_udf(DoubleType())
def ks_tail(d: pd.Series, n_a: pd.Series, n_b: pd.Series, ends: pd.Series) -> pd.Series:
    """K5.  P(D >= d) given the tied runs' ends; null where no ends are given."""
    rows = zip(d, n_a, n_b, ends, strict=True)
    return pd.Series([lattice_share(x, int(m), int(n), np.asarray(e, np.int64)) if e is not None and len(e) and m and n else None for x, m, n, e in rows], dtype="float64")
