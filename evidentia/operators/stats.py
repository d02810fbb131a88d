"""Tests as queries (K*).  Ranks and counts are windows and aggregates; only tail probabilities are a small pandas UDF,
applied to one row for each test."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from evidentia.operators import exact
from evidentia.operators.aggregate import running_sums
from evidentia.operators.windows import p_adjust


@F.pandas_udf(DoubleType())
def normal_two_sided(z: pd.Series) -> pd.Series:
    """P(|Z| >= |z|)."""
    return z.map(lambda x: math.erfc(abs(x) / math.sqrt(2)), na_action="ignore").astype("float64")


@F.pandas_udf(DoubleType())
def chi2_tail_df1(x: pd.Series) -> pd.Series:
    """P(chi-square with one degree of freedom >= x)."""
    return x.map(lambda v: math.erfc(math.sqrt(max(0.0, v) / 2)), na_action="ignore").astype("float64")


def average_ranks(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Adds ``rank`` (mean over ties) and ``ties``: from counts by value, so what is ordered are distinct values."""
    n = df.groupBy(*by, value).agg(F.count("*").alias("ties"))
    if by:
        n = n.withColumn("_run", F.sum("ties").over(W.partitionBy(*by).orderBy(value).rowsBetween(W.unboundedPreceding, 0)))
    else:
        n = running_sums(n, [value], {"_run": "ties"})
    return df.join(n.withColumn("rank", F.col("_run") - (F.col("ties") - 1) / 2).drop("_run"), [*by, value])


def rank_sum(df: DataFrame, value: str, group: str, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    """K1.  U of the first group, z with the tie correction (no continuity correction), and whether any values tie; see ``with_p``.

    One test over all rows, or one for each ``by`` (those are taken to be small: a task ranks the distinct values of one).
    """
    two = df.filter(F.col(group).isin(a, b) & F.col(value).isNotNull()).select(*by, group, value)
    r = average_ranks(two, value, by)
    s = r.groupBy(*by).agg(
        F.sum(F.when(F.col(group) == a, F.col("rank"))).alias("_r"),
        F.count_if(F.col(group) == a).alias("n_a"),
        F.count_if(F.col(group) == b).alias("n_b"),
        F.sum(F.pow(F.col("ties").cast("double"), F.lit(2.0)) - 1).alias("_t"),  # sum over rows = sum of t^3 - t over ties
    )
    u = F.col("_r") - F.col("n_a") * (F.col("n_a") + 1) / 2
    return _with_z(s.select(*by, F.lit(a).alias("a"), F.lit(b).alias("b"), "n_a", "n_b", F.coalesce(u, F.lit(0.0)).alias("u"), "_t"))


def _with_z(s: DataFrame) -> DataFrame:
    """Adds ``z``, ``sigma`` and ``tied`` to ``u n_a n_b`` and the sum of t^3 - t over ties."""
    n = F.col("n_a") + F.col("n_b")
    var = F.col("n_a") * F.col("n_b") / 12 * ((n + 1) - F.try_divide(F.col("_t"), n * (n - 1)))
    s = s.withColumns({"sigma": F.sqrt(var), "tied": F.col("_t") > 0})
    return s.withColumn("z", F.try_divide(F.col("u") - F.col("n_a") * F.col("n_b") / 2, F.col("sigma"))).drop("_t")


def signed_rank(df: DataFrame, a: str, b: str) -> DataFrame:
    """K2.  Sum of positive ranks of the differences, zeros and nulls left out, its z, and whether there were zeros or ties; see ``with_p``."""
    every = df.select((F.col(a) - F.col(b)).alias("d")).filter("d is not null").withColumn("_m", F.abs("d"))
    zeros = every.agg((F.count_if(F.col("d") == 0) > 0).alias("_zeros"))
    d = average_ranks(every.filter("d <> 0"), "_m")
    s = d.agg(F.sum(F.when(F.col("d") > 0, F.col("rank")).otherwise(0)).alias("w"), F.count("*").alias("n"), F.sum(F.pow(F.col("ties").cast("double"), F.lit(2.0)) - 1).alias("_t"))
    n = F.col("n").cast("double")  # its cube is beyond a long from two million differences on
    s = s.join(F.broadcast(zeros))  # one row
    s = s.select("n", "w", F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("_t") / 48).alias("sigma"), ((F.col("_t") > 0) | F.col("_zeros")).alias("tied"))
    return s.withColumn("z", F.try_divide(F.col("w") - n * (n + 1) / 4, F.col("sigma")))


def kruskal(df: DataFrame, value: str, group: str) -> DataFrame:
    """K3.  H with the tie correction, and degrees of freedom."""
    r = average_ranks(df.filter(F.col(value).isNotNull()).select(group, value), value)
    g = r.groupBy(group).agg(F.sum("rank").alias("_r"), F.count("*").alias("_n"), F.sum(F.pow(F.col("ties").cast("double"), F.lit(2.0)) - 1).alias("_t"))
    s = g.agg(F.sum(F.pow("_r", F.lit(2.0)) / F.col("_n")).alias("_q"), F.sum("_n").alias("n"), F.sum("_t").alias("_t"), (F.count("*") - 1).alias("df"))
    n = F.col("n")
    h = (F.lit(12) / (n * (n + 1)) * F.col("_q") - 3 * (n + 1)) / (1 - F.col("_t") / (F.pow(n, F.lit(3.0)) - n))
    return s.select("n", "df", h.alias("h"))


def upper_gamma(a: float, x: float) -> float:
    """Q(a, x), the regularised upper incomplete gamma function: a series below a + 1, a continued fraction above."""
    if x <= 0:
        return 1.0
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while term > total * 1e-15:
            n += 1
            term *= x / n
            total += term
        return 1 - total * scale
    b, c = x + 1 - a, 1e300
    d = 1 / b
    out = d
    for i in range(1, 10_000):
        b += 2
        d = 1 / (b - i * (i - a) * d)
        c = b - i * (i - a) / c
        out *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return out * scale


def incomplete_beta(a: float, b: float, x: float) -> float:
    """I_x(a, b), the regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1))
    out = d
    for m in range(1, 10_000):
        for e in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 / (1 + e * d), 1 + e / c
            out *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return out * math.exp(a * math.log(x) + b * math.log(1 - x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)) / a


@F.pandas_udf(DoubleType())
def chi2_tail(x: pd.Series, df: pd.Series) -> pd.Series:
    """P(chi-square with df degrees of freedom >= x)."""
    return pd.Series([None if pd.isna(v) or not k else upper_gamma(k / 2, v / 2) for v, k in zip(x, df, strict=True)], dtype="float64")


@F.pandas_udf(DoubleType())
def t_two_sided(t: pd.Series, df: pd.Series) -> pd.Series:
    """P(|T| >= |t|) with df degrees of freedom."""
    return pd.Series([None if pd.isna(v) or k <= 0 else incomplete_beta(k / 2, 0.5, k / (k + v * v)) for v, k in zip(t, df, strict=True)], dtype="float64")


@F.pandas_udf(DoubleType())
def normal_upper(z: pd.Series) -> pd.Series:
    """P(Z >= z)."""
    return z.map(lambda x: math.erfc(x / math.sqrt(2)) / 2, na_action="ignore").astype("float64")


def with_p(df: DataFrame, exact_below: int = 50) -> DataFrame:
    """K1, K2.  Adds ``p``, ``p_greater`` and ``p_less`` to the result of ``rank_sum`` or ``signed_rank``.

    Exact from the distribution of the statistic where each sample has fewer than ``exact_below`` values and none tie (or are 0, for
    differences); else by the normal approximation with a continuity correction of one half.
    """
    if "u" in df.columns:
        stat, mean, small = F.col("u"), F.col("n_a") * F.col("n_b") / 2, (F.col("n_a") < exact_below) & (F.col("n_b") < exact_below)
        tails = {"_ge": exact.rank_sum_tail("u", "n_a", "n_b"), "_le": exact.rank_sum_tail(F.col("n_a") * F.col("n_b") - F.col("u"), "n_a", "n_b")}
    else:
        stat, mean, small = F.col("w"), F.col("n") * (F.col("n") + 1) / 4, F.col("n") < exact_below
        tails = {"_ge": exact.signed_rank_tail("w", "n"), "_le": exact.signed_rank_tail(F.col("n") * (F.col("n") + 1) / 2 - F.col("w"), "n")}
    off = stat - mean
    z = {"_z": (off - F.signum(off) * 0.5) / F.col("sigma"), "_zg": (off - 0.5) / F.col("sigma"), "_zl": (off + 0.5) / F.col("sigma")}
    fits = small & ~F.col("tied")
    # the tails are symmetric, so P(S <= s) is the upper tail at the mirrored value
    made = df.withColumns(tails).withColumns({n: F.when(F.col("sigma") > 0, c) for n, c in z.items()})
    made = made.withColumns({"_p": normal_two_sided("_z"), "_pg": normal_upper("_zg"), "_pl": normal_upper(-F.col("_zl"))})
    made = made.withColumns(
        {
            "p": F.when(fits, F.least(F.lit(1.0), 2 * F.least("_ge", "_le"))).otherwise(F.least(F.lit(1.0), "_p")),
            "p_greater": F.when(fits, F.col("_ge")).otherwise(F.col("_pg")),
            "p_less": F.when(fits, F.col("_le")).otherwise(F.col("_pl")),
        }
    )
    return made.drop(*tails, *z, "_p", "_pg", "_pl")


def cor_test(df: DataFrame, x: str, y: str) -> DataFrame:
    """K4.  Pearson's r, n, t and its two-sided p."""
    s = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).agg(F.corr(x, y).alias("r"), F.count("*").alias("n"))
    s = s.withColumn("t", F.col("r") * F.sqrt((F.col("n") - 2) / (1 - F.col("r") * F.col("r"))))
    return s.withColumn("p", t_two_sided("t", F.col("n") - 2))


def ks2(df: DataFrame, value: str, group: str, a: str, b: str, exact_below: int = 10_000) -> DataFrame:
    """K5.  The largest difference of two groups' distribution functions and its p: exact where ``n_a * n_b < exact_below``, ties included,
    else asymptotic (Kolmogorov's series)."""
    at = df.filter(F.col(group).isin(a, b) & F.col(value).isNotNull()).groupBy(value).agg(F.count_if(F.col(group) == a).alias("_a"), F.count_if(F.col(group) == b).alias("_b"))
    n = at.agg(F.sum("_a").alias("_na"), F.sum("_b").alias("_nb"))
    run = running_sums(at, [value], {"_ra": "_a", "_rb": "_b"}).join(F.broadcast(n))  # one row
    small = F.col("_na") * F.col("_nb") < exact_below
    d = run.groupBy("_na", "_nb").agg(
        F.max(F.abs(F.try_divide("_ra", "_na") - F.try_divide("_rb", "_nb"))).alias("d"),
        F.sort_array(F.collect_list(F.when(small, F.col("_ra") + F.col("_rb")))).alias("_ends"),  # where a run of ties ends; none kept of larger tests
    )
    effective = F.col("_na") * F.col("_nb") / (F.col("_na") + F.col("_nb")) * F.col("d") * F.col("d")
    series = F.aggregate(F.sequence(F.lit(1), F.lit(100)), F.lit(0.0), lambda s, k: s + F.when(k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * k * k * effective))
    limit = F.when(effective < 0.01, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), series)))
    made = d.withColumn("_exact", exact.ks_tail("d", "_na", "_nb", "_ends"))
    return made.select(F.lit(a).alias("a"), F.lit(b).alias("b"), "d", F.coalesce("_exact", limit).alias("p"))


def chi_square_table(ct: DataFrame, a: str, b: str, n: str = "n") -> DataFrame:
    """K6.  The test of a whole r x c contingency table: statistic, degrees of freedom and p."""
    s = ct.agg(F.sum(F.pow(F.col(n) - F.col("expected"), F.lit(2.0)) / F.col("expected")).alias("chi2"), F.count_distinct(a).alias("_r"), F.count_distinct(b).alias("_c"))
    s = s.select("chi2", ((F.col("_r") - 1) * (F.col("_c") - 1)).alias("df"))
    return s.withColumn("p", chi2_tail("chi2", "df"))


def one_vs_rest(ct: DataFrame, n: str = "n") -> DataFrame:
    """D18.  The 2 x 2 cells of each pair of levels of a contingency table: ``c11 c12 c21 c22``."""
    return ct.withColumns(
        {"c11": F.col(n), "c12": F.col("n_a") - F.col(n), "c21": F.col("n_b") - F.col(n), "c22": F.col("total") - F.col("n_a") - F.col("n_b") + F.col(n)}
    )


def chi_square(yates: bool = True) -> Column:
    """K6.  Of the cells ``c11 c12 c21 c22``."""
    a, b, c, d = (F.col(x).cast("double") for x in ("c11", "c12", "c21", "c22"))
    n = a + b + c + d
    off = F.abs(a * d - b * c)
    off = F.greatest(F.lit(0.0), off - n / 2) if yates else off
    return F.try_divide(n * off * off, (a + b) * (c + d) * (a + c) * (b + d))


def odds_ratio() -> dict[str, Column]:
    """K7.  The odds ratio of the cells and its 95 % interval; null where a cell is 0."""
    a, b, c, d = (F.nullif(F.col(x).cast("double"), F.lit(0.0)) for x in ("c11", "c12", "c21", "c22"))
    log = F.log(a * d / (b * c))
    off = 1.96 * F.sqrt(1 / a + 1 / b + 1 / c + 1 / d)
    return {"odds_ratio": a * d / (b * c), "ci_low": F.exp(log - off), "ci_high": F.exp(log + off)}


def all_pairs(df: DataFrame, value: str, group: str, groups: Sequence[str]) -> DataFrame:
    """K8.  The rank-sum test of every two groups, from one pass over the distinct values.

    A value has a vector of group counts, and running sums of these tell how many of each group lie below.  A pair's U sums, over the
    first group's values, the second's below and half of those that tie; its tie correction needs the same counts.
    """
    names = list(groups)
    n = {g: f"_n{i}" for i, g in enumerate(names)}
    run = {g: f"_r{i}" for i, g in enumerate(names)}
    at = df.filter(F.col(group).isin(names) & F.col(value).isNotNull()).groupBy(value).agg(*[F.count_if(F.col(group) == g).alias(n[g]) for g in names])
    at = running_sums(at, [value], {run[g]: n[g] for g in names})
    real = lambda c: F.col(c).cast("double")
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    made = []
    for i, (a, b) in enumerate(pairs):
        t = real(n[a]) + real(n[b])
        made += [F.sum(real(n[a]) * (real(run[b]) - real(n[b]) / 2)).alias(f"_u{i}"), F.sum(F.pow(t, F.lit(3.0)) - t).alias(f"_t{i}")]
    one = at.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in n.values()], *made)
    rows = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(n[a]).alias("n_a"), F.col(n[b]).alias("n_b"), F.col(f"_u{i}").alias("u"), F.col(f"_t{i}").alias("_t")) for i, (a, b) in enumerate(pairs)]
    return _with_z(one.select(F.inline(F.array(*rows))))


def conclude(df: DataFrame, alpha: float = 0.05) -> DataFrame:
    """K8, E7.  What pairs of groups come to, in words.

    Takes ``with_p`` of ``all_pairs``.  The two-sided tests and those of "greater" of all pairs are one family for Holm's adjustment
    (``p_adjusted``, ``p_greater_adjusted``).  Only where the two-sided test is significant does the one-sided one speak: significant, the
    first group is greater, else the second.
    """
    both = F.array(F.struct(F.lit("two sided").alias("_test"), F.col("p").alias("_p")), F.struct(F.lit("greater").alias("_test"), F.col("p_greater").alias("_p")))
    long = df.select("a", "b", F.inline(both))
    adjusted = p_adjust(long, "_p", [], ["a", "b", "_test"], "_holm")
    pick = lambda t: F.max(F.when(F.col("_test") == t, F.col("_holm")))
    wide = adjusted.groupBy("a", "b").agg(pick("two sided").alias("p_adjusted"), pick("greater").alias("p_greater_adjusted"))
    greater = lambda x, y: F.concat(F.col(x), F.lit(" is greater than "), F.col(y))
    text = F.when(F.col("p_adjusted") < alpha, F.when(F.col("p_greater_adjusted") < alpha, greater("a", "b")).otherwise(greater("b", "a")))
    return df.join(wide, ["a", "b"]).withColumn("conclusion", F.coalesce(text, F.concat(F.col("a"), F.lit(" and "), F.col("b"), F.lit(" don't differ"))))
