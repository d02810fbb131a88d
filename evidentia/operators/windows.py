"""Ranking, sliding windows over ranks and interval algebra (E*)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evidentia.operators.aggregate import dealt_by_range, quantiles, running_sums, scan
from evidentia.scratch import settled


def window_size(n: int, window: int = 251, least: int = 29) -> int:
    """E1.  The window for n rows: as given if n is over five times it, else a fifth (``least`` at least); made odd."""
    w = window if window < n // 5 else max(window // 5, least)
    return w + (w % 2 == 0)


def combined_pep(df: DataFrame, key: str, source: str, pep: str, is_decoy: str, order: Sequence[Column | str], window: int = 251) -> DataFrame:
    """E1.  Error probabilities of keys that several sources report.

    The last row of each (source, key) counts; a key belongs to exactly one combination of sources.  Its Bayes PEP is
    prod(p) / (prod(p) + prod(1 - p)); sources that disagree make it a decoy.  Within a combination keys stand by Bayes
    PEP (12 digits) and key, and the combined PEP is min(2 decoys, n) / n over a centred window, cut at the ends.
    """
    last = df.withColumn("_r", F.row_number().over(W.partitionBy(source, key).orderBy(*order))).filter("_r = 1")
    p = F.col(pep)
    keys = last.groupBy(key).agg(
        F.array_join(F.array_sort(F.collect_set(source)), "&").alias("combination"),
        F.product(p).alias("_p"),
        F.product(1 - p).alias("_q"),
        F.max(F.col(is_decoy).cast("int")).alias("decoy"),
    )
    keys = keys.select(key, "combination", "decoy", F.round(F.try_divide(F.col("_p"), F.col("_p") + F.col("_q")), 12).alias("bayes_pep"))
    # running sums over range partitions, and for each row those at the two ends of its window: no task holds a whole combination
    made = running_sums(keys.withColumn("_one", F.lit(1)), ["combination", "bayes_pep", key], {"_r": "_one", "_s": "decoy"}).drop("_one")
    made = settled(made)
    ends = made.groupBy("combination").agg(F.min("_r").alias("_low"), F.max("_r").alias("_high"))
    half = F.when(F.floor((F.col("_high") - F.col("_low") + 1) / 5) > window, window // 2).otherwise(window_size(0, window) // 2)
    rows = made.join(ends, "combination").withColumns({"_from": F.greatest(F.col("_r") - half, "_low"), "_to": F.least(F.col("_r") + half, "_high")})
    first, last_ = made.select(F.col("_r").alias("_from"), (F.col("_s") - F.col("decoy")).alias("_before")), made.select(F.col("_r").alias("_to"), F.col("_s").alias("_upto"))
    n = F.col("_to") - F.col("_from") + 1
    share = F.least(2 * (F.col("_upto") - F.col("_before")), n) / n
    return rows.join(first, "_from").join(last_, "_to").select(*keys.columns, share.alias("combined_pep"))


def dedup(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """E3.  The first row of each key by an explicit order."""
    return df.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("_r = 1").drop("_r")


def quantile_class(df: DataFrame, col: str, name: str = "class") -> DataFrame:
    """E5.  first up to the lower quartile, third from the upper one, second between."""
    q = quantiles(df, col, {"_q1": 0.25, "_q3": 0.75})
    label = F.when(F.col(col) <= F.col("_q1"), "first").when(F.col(col) >= F.col("_q3"), "third").otherwise("second")
    return df.join(F.broadcast(q)).withColumn(name, label).drop("_q1", "_q3")


def top_k(df: DataFrame, order: Sequence[Column | str], k: int) -> DataFrame:
    """E6.  The first k rows."""
    return df.orderBy(*order).limit(k)


def p_adjust(df: DataFrame, p: str, by: Sequence[str] = (), order: Sequence[str] = (), name: str = "p_holm", method: str = "holm") -> DataFrame:
    """E7.  Adjusted p-values within families, or over all rows; ``order`` breaks ties (needed by Holm's ranks only for repeatable plans).

    ``holm``: the running maximum of (n - rank + 1) p from the smallest p on.  ``bh``: the running minimum of n p / rank from the
    largest on (Benjamini and Hochberg).  Null p-values don't count and stay null.  Ranks and running values are scans over range
    partitions, so a family of any size spreads over tasks.
    """
    if method not in ("holm", "bh"):
        raise ValueError(f"no such method: {method}")
    tested = df.filter(F.col(p).isNotNull())
    n = tested.groupBy(*by).agg(F.count("*").alias("_n"))
    if by:
        n = n.select(*[F.col(c).alias(f"_family_{c}") for c in by], "_n")
        tested = tested.join(n, [F.col(c).eqNullSafe(F.col(f"_family_{c}")) for c in by]).drop(*[f"_family_{c}" for c in by])
    else:
        tested = tested.join(F.broadcast(n))  # one row
    if method == "holm":
        step, fold, ordered = F.col("_n") - F.col("_rank") + 1, "max", [F.col(p), *[F.col(c) for c in order]]
    else:
        step, fold, ordered = F.try_divide(F.col("_n").cast("double"), F.col("_n") - F.col("_rank") + 1), "min", [F.desc(p), *[F.desc(c) for c in order]]
    layers = {"_rank": ("sum", F.lit(1).cast("long"))}, {"_adjusted": (fold, step * F.col(p))}
    made = scan(dealt_by_range(tested, [*by, *ordered]), by, ordered, *layers)
    made = made.withColumn(name, F.least(F.lit(1.0), "_adjusted")).select(*df.columns, name)
    return made.unionByName(df.filter(F.col(p).isNull()).withColumn(name, F.lit(None).cast("double")))


def _islands(df: DataFrame, part: Sequence[str], start: str, end: str, touching: bool) -> DataFrame:
    """A number for each run of overlapping intervals of a part: scans over range partitions, so that a part of any size spreads over tasks."""
    reach = F.col("_reach")
    opens = F.when(reach.isNull() | ((F.col(start) > reach) if touching else (F.col(start) >= reach)), 1).otherwise(0)
    layers = {"_reach": ("max", F.col(end))}, {"island": ("sum", opens)}
    return scan(dealt_by_range(df, [*part, start, end]), part, [start, end], *layers, before=["_reach"]).drop("_part", "_reach")


def interval_coverage(df: DataFrame, part: Sequence[str], start: str, end: str, total: Column | None = None, inclusive: bool = False) -> DataFrame:
    """E8.  Length of the union of a part's intervals, half open or inclusive, over ``total`` where given."""
    runs = _islands(df, part, start, end, inclusive).groupBy(*part, "island").agg(F.min(start).alias("_a"), F.max(end).alias("_b"))
    covered = runs.groupBy(*part).agg(F.sum(F.col("_b") - F.col("_a") + (1 if inclusive else 0)).alias("covered"), F.count("*").alias("n_runs"))
    return covered if total is None else covered.withColumn("coverage", F.col("covered") / total)


def resolve_overlaps(df: DataFrame, part: Sequence[str], start: str, end: str, curated: Column, lists: Sequence[str]) -> DataFrame:
    """E9.  Overlapping runs; where one has a curated row, only curated rows count; what is left is collapsed.

    Runs keep what curated rows come to beside what all rows come to, and the first counts where there is any: one aggregation.
    """
    runs = _islands(df, part, start, end, True).withColumn("_c", F.coalesce(curated, F.lit(False)))
    own = lambda agg, c: (agg(F.when(F.col("_c"), F.col(c))), agg(c))
    kept = {start: own(F.min, start), end: own(F.max, end), "n": (F.count_if("_c"), F.count("*")), **{c: own(F.collect_set, c) for c in lists}}
    made = runs.groupBy(*part, "island").agg(F.max("_c").alias("_any"), *[x.alias(f"_{i}_{c}") for c, both in kept.items() for i, x in enumerate(both)])
    pick = lambda c: F.when(F.col("_any"), F.col(f"_0_{c}")).otherwise(F.col(f"_1_{c}"))
    return made.select(*part, "island", *[pick(c).alias(c) for c in (start, end, "n")], *[F.array_join(F.array_sort(pick(c)), ";").alias(c) for c in lists])


def merge_contained(df: DataFrame, part: Sequence[str], start: str, end: str, lists: Sequence[str]) -> DataFrame:
    """E11.  Intervals that lie inside an earlier one are folded into it, their payloads joined."""
    order = [F.col(start), F.desc(end)]
    outer = F.when(F.col("_reach").isNull() | (F.col(end) > F.col("_reach")), 1).otherwise(0)
    marked = scan(dealt_by_range(df, [*part, *order]), part, order, {"_reach": ("max", F.col(end))}, {"host": ("sum", outer)}, before=["_reach"])
    return marked.groupBy(*part, "host").agg(
        F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n"), *[F.array_join(F.array_sort(F.collect_set(c)), ";").alias(c) for c in lists]
    )


def min_max(df: DataFrame, col: str, by: Sequence[str] = ()) -> DataFrame:
    """E10.  (x - min) / (max - min) within groups, or over all rows by two scalars."""
    scaled = F.try_divide(F.col(col) - F.col("_lo"), F.col("_hi") - F.col("_lo"))
    ends = df.groupBy(*by).agg(F.min(col).alias("_lo"), F.max(col).alias("_hi"))
    out = df.join(ends, list(by)) if by else df.join(F.broadcast(ends))
    return out.withColumn(f"{col}_scaled", scaled).drop("_lo", "_hi")
