"""Aggregations, reshaping and set operations (D*, F*)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evidentia.functions.scalars import list_median, monoisotopic_mass
from evidentia.scratch import settled


def collapse(df: DataFrame, keys: Sequence[str], cols: Sequence[str], sep: str = ";") -> DataFrame:
    """D1.  Every column's sorted distinct values, joined."""
    return df.groupBy(*keys).agg(*[F.array_join(F.array_sort(F.collect_set(F.col(c).cast("string"))), sep).alias(c) for c in cols])


def explode_and_tag(df: DataFrame, id_col: str, group: str, source: str, sep: str = ",") -> DataFrame:
    """D2.  A row for each delimited id; the group's id gets the source's name behind it."""
    return df.withColumn(id_col, F.explode(F.split(id_col, sep))).withColumn(group, F.concat(F.col(group).cast("string"), F.col(source)))


def explode_list(df: DataFrame, col: str, sep: str = ";", keep_null: bool = False) -> DataFrame:
    """D30.  One row for each element of a delimited cell."""
    return df.withColumn(col, (F.explode_outer if keep_null else F.explode)(F.split(col, sep)))


def numbered(df: DataFrame, order: Sequence[Column | str], name: str) -> DataFrame:
    """0, 1 .. in the given order, which should leave no ties.

    Rows are sorted by range and written once with their place in their partition; partitions' sizes, summed up, give
    the offsets.  No task holds all rows, and what is numbered doesn't change when it is read again.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_pos", F.monotonically_increasing_id())
    ranged = settled(ranged.withColumn("_part", F.shiftright("_pos", 33)).withColumn("_pos", F.col("_pos").bitwiseAND(F.lit((1 << 33) - 1))))
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_size"))
    before = F.coalesce(F.sum("_size").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("_part", before.alias("_before"))  # a row for each partition
    return ranged.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_before") + F.col("_pos")).select(*df.columns, name)


def running_sums(df: DataFrame, order: Sequence[Column | str], sums: Mapping[str, str]) -> DataFrame:
    """Adds running sums (``{name: column}``) in an order that leaves no ties, over range partitions and the sums before each."""
    ranged = settled(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)  # a row for each partition
    whole = ranged.groupBy("_part").agg(*[F.sum(c).alias(f"_all_{n}") for n, c in sums.items()])
    offsets = whole.select("_part", *[F.coalesce(F.sum(f"_all_{n}").over(before), F.lit(0)).alias(f"_before_{n}") for n in sums])
    run = W.partitionBy("_part").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    made = ranged.withColumns({f"_run_{n}": F.sum(c).over(run) for n, c in sums.items()}).join(F.broadcast(offsets), "_part")
    return made.select(*df.columns, *[(F.col(f"_before_{n}") + F.col(f"_run_{n}")).alias(n) for n in sums])


def dealt_by_range(df: DataFrame, order: Sequence[Column | str]) -> DataFrame:
    """The rows written in range partitions of an order; ``_part`` is the partition's number.  Rows equal in it share a partition."""
    return settled(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))


#: What a running aggregate joins two stretches by: the aggregate itself, as all three are associative.
FOLDS = {"sum": F.sum, "max": F.max, "min": F.min}


def _joined(fold: str, a: Column, b: Column) -> Column:
    both = a + b if fold == "sum" else F.greatest(a, b) if fold == "max" else F.least(a, b)
    return F.coalesce(both, a, b)


def scan(dealt: DataFrame, part: Sequence[str], order: Sequence[Column | str], *layers: Mapping[str, tuple[str, Column]], before: Sequence[str] = ()) -> DataFrame:
    """Adds running aggregates ``{name: (fold, column)}`` within parts, up to each row or, for those named in ``before``, up to the row
    before it.  A layer's columns may use the results of the layers before.

    ``dealt`` comes from ``dealt_by_range`` over part and order, so a part lies in neighbouring partitions.  Each stretch (a part's rows in
    one partition) is folded by itself; what the earlier stretches of its part come to is carried into it.  Only parts that go on from one
    partition into the next have something to carry, so these tables have two rows a partition at most.  No task holds a whole part.
    """
    key = F.struct(F.lit(1), *[F.col(p) for p in part])
    ends = dealt.groupBy("_part").agg(F.min(key).alias("_low"), F.max(key).alias("_high"))
    ends = ends.select("_part", *[F.col(f"_low.{p}").alias(f"_l_{p}") for p in part], *[F.col(f"_high.{p}").alias(f"_h_{p}") for p in part])
    lasts = ends.select(*[F.col(f"_h_{p}").alias(f"_key_{p}") for p in part], F.col("_part").alias("_from")).groupBy(*[f"_key_{p}" for p in part]).agg(F.min("_from").alias("_from"), F.max("_from").alias("_to"))
    firsts = ends.select(*[F.col(f"_l_{p}").alias(f"_first_{p}") for p in part], F.col("_part").alias("_next"))
    meets = [F.col(f"_key_{p}").eqNullSafe(F.col(f"_first_{p}")) for p in part]
    on = lasts.join(firsts, [*meets, F.col("_next") > F.col("_from")], "left_semi").select(*[f"_key_{p}" for p in part], F.lit(1).alias("_goes_on"))
    on = settled(on)
    same = [F.col(p).eqNullSafe(F.col(f"_key_{p}")) for p in part]
    # the rows of parts that go on: layers are made for these first, to know what is carried
    going = dealt.join(F.broadcast(on), same or F.lit(True), "left_semi")
    whole = dealt
    for i, layer in enumerate(layers):
        rows = {n: W.partitionBy("_part", *part).orderBy(*order).rowsBetween(W.unboundedPreceding, -1 if n in before else 0) for n in layer}
        own = going.groupBy(*part, "_part").agg(*[FOLDS[f](c).alias(f"_all_{n}") for n, (f, c) in layer.items()])
        earlier = W.partitionBy(*part).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
        carried = own.select(*[F.col(p).alias(f"_key_{p}") for p in part], F.col("_part").alias("_at"), *[FOLDS[f](f"_all_{n}").over(earlier).alias(f"_carry_{n}") for n, (f, _) in layer.items()])
        last = i == len(layers) - 1
        carried = carried if last else settled(carried)  # met twice

        def folded(df: DataFrame) -> DataFrame:
            run = df.withColumns({f"_run_{n}": FOLDS[f](c).over(rows[n]) for n, (f, c) in layer.items()})  # noqa: B023
            run = run.join(F.broadcast(carried), [*same, F.col("_part") == F.col("_at")], "left")  # noqa: B023
            return run.select(*[f"`{c}`" for c in df.columns], *[_joined(f, F.col(f"_carry_{n}"), F.col(f"_run_{n}")).alias(n) for n, (f, _) in layer.items()])  # noqa: B023

        whole, going = folded(whole), going if last else folded(going)
    return whole


def quantiles(df: DataFrame, col: str, shares: Mapping[str, float]) -> DataFrame:
    """One row with interpolated quantiles of a column's values; null if there are none.  What is ordered are distinct values, by range."""
    at = running_sums(df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count("*").alias("_n")), [col], {"_run": "_n"})
    n = df.filter(F.col(col).isNotNull()).count()

    def value(k: int) -> Column:
        return F.max(F.when((F.col("_run") - F.col("_n") <= k) & (F.col("_run") > k), F.col(col)))

    wanted = []
    for name, share in shares.items():
        place = max(n - 1, 0) * share
        low = int(place)
        wanted.append((value(low) + (place - low) * (value(min(low + 1, max(n - 1, 0))) - value(low))).alias(name))
    return at.agg(*wanted)


def assign_ids(df: DataFrame, prefix: str, order: Sequence[Column | str], name: str, part: Sequence[str] = ()) -> DataFrame:
    """E4.  ``<prefix>0`` .. in the given order, over all rows or within parts."""
    if part:
        made = df.withColumn(name, F.row_number().over(W.partitionBy(*part).orderBy(*order)) - 1)
    else:
        made = numbered(df, order, name)
    return made.withColumn(name, F.concat(F.lit(prefix), F.col(name).cast("string")))


def aggregate_unmatched(df: DataFrame, key: str, source: str, means: Sequence[str]) -> DataFrame:
    """D3.  By key: means and the sorted list of sources; keys that are null are left out."""
    made = df.filter(F.col(key).isNotNull()).groupBy(key)
    return made.agg(*[F.avg(c).alias(c) for c in means], F.array_join(F.array_sort(F.collect_set(source)), ";").alias(source))


def distinct_median(df: DataFrame, keys: Sequence[str], value: str, lists: Sequence[str] = ()) -> DataFrame:
    """D4, D5.  The median of a group's distinct values, and sorted distinct lists."""
    return df.groupBy(*keys).agg(list_median(F.collect_set(value)).alias(value), *[F.array_sort(F.collect_set(c)).alias(c) for c in lists])


def ion_matrix(df: DataFrame, ion: str, file: str, source: str, value: str, files: Sequence[str]) -> DataFrame:
    """D4.  By ion, a column for each file: the median over sources of each source's median of distinct values; 0 if none."""
    each = distinct_median(df, [ion, file, source], value)
    return each.groupBy(ion).pivot(file, list(files)).agg(F.median(value)).fillna(0.0, list(files))


def median_by_member(df: DataFrame, list_col: str, values: Sequence[str], prefix: str, exclude: str = "rev_") -> DataFrame:
    """D6.  Lists taken apart, empty and decoy members dropped, each member's medians."""
    each = explode_list(df, list_col).filter((F.col(list_col) != "") & (F.col(list_col) != "NA") & ~F.col(list_col).contains(exclude))
    return each.groupBy(list_col).agg(*[F.median(c).alias(f"{prefix}{c}") for c in values])


def top_n_mean(df: DataFrame, key: str, values: Sequence[str], n: int = 3) -> DataFrame:
    """D7.  Means of the n best rows of a key by the value columns, ties kept; nulls don't count."""
    ranked = df.withColumn("_r", F.rank().over(W.partitionBy(key).orderBy(*[F.desc_nulls_last(c) for c in values])))
    return ranked.filter(F.col("_r") <= n).groupBy(key).agg(*[F.avg(c).alias(c) for c in values], F.count("*").alias("n_rows"))


def normalise_medians(df: DataFrame, sample: str, intensity: str) -> DataFrame:
    """D9.  Positive intensities, scaled so that every sample's median log intensity is the mean of these medians."""
    cells = df.filter(F.col(intensity) > 0)
    medians = settled(cells.groupBy(sample).agg(F.median(F.log2(intensity)).alias("_m")))
    shift = medians.join(F.broadcast(medians.agg(F.avg("_m").alias("_mean")))).select(sample, F.pow(F.lit(2.0), F.col("_mean") - F.col("_m")).alias("_by"))
    return cells.join(shift, sample).withColumn(intensity, F.col(intensity) * F.col("_by")).select(*df.columns)


def sample_ratios(cells: DataFrame, protein: str, ion: str, sample: str, log: str, least: int = 1) -> DataFrame:
    """D9.  ``(protein, a, b, ratio, n_ions)``: the median log ratio of every two samples (a < b) that share ``least`` of a protein's ions.

    Cells meet by protein and ion, so what meets are one ion's samples; medians are aggregates by protein and pair of samples.
    """
    left = cells.select(protein, ion, F.col(sample).alias("a"), F.col(log).alias("_la"))
    right = cells.select(protein, ion, F.col(sample).alias("b"), F.col(log).alias("_lb"))
    met = left.join(right, [protein, ion]).filter("a < b").groupBy(protein, "a", "b")
    return met.agg(F.median(F.col("_la") - F.col("_lb")).alias("ratio"), F.count("*").alias("n_ions")).filter(F.col("n_ions") >= least)


def laplacian_profiles(pairs: list[tuple[int, int, float]], n: int) -> tuple[np.ndarray, np.ndarray]:
    """For n samples and ratios ``(i, j, x_i - x_j)``: each sample's component (its smallest sample) and the level that fits the ratios
    best by least squares, with mean 0 in each component."""
    component, level = np.arange(n), np.zeros(n)
    for i, j, _ in pairs:
        low, high = sorted((component[i], component[j]))
        component[component == high] = low
    for c in np.unique(component):
        own = np.flatnonzero(component == c)
        if len(own) < 2:
            continue
        at = {int(s): k for k, s in enumerate(own)}
        laplacian, right = np.full((len(own), len(own)), 1.0), np.zeros(len(own))  # the ones fix the mean at 0
        for i, j, r in pairs:
            if i in at:
                x, y = at[i], at[j]
                laplacian[x, x] += 1
                laplacian[y, y] += 1
                laplacian[x, y] -= 1
                laplacian[y, x] -= 1
                right[x] += r
                right[y] -= r
        level[own] = np.linalg.solve(laplacian, right)
    return component, level


def maxlfq(df: DataFrame, protein: str, ion: str, sample: str, intensity: str, scale: str = "sum", least: int = 1) -> DataFrame:
    """D9.  ``(protein, sample, component, lfq)``: protein profiles from the medians of ion ratios between samples (MaxLFQ).

    Ratios are the more reliable quantity; a profile is the one that fits its protein's ratios best.  Samples that no chain of shared ions
    connects can't be compared: each connected component (named by its smallest sample) is solved by itself and scaled to what its own
    samples hold, so that its levels sum up to their summed intensities (``scale="sum"``, as published) or its mean log level is that of its
    ions (``"log mean"``; a sample alone gets the median of its logs).  Samples in which a protein has no positive intensity have no row.
    For normalisation between samples see ``normalise_medians``.  A task gets a protein's ratios and sums, as many as samples by samples at most.
    """
    if scale not in ("sum", "log mean"):
        raise ValueError(f"no such scale: {scale}")
    cells = df.filter(F.col(intensity) > 0).groupBy(protein, ion, sample).agg(F.sum(intensity).cast("double").alias("_v")).withColumn("_log", F.log2("_v"))
    cells = settled(cells)
    held = cells.groupBy(protein, sample).agg(F.sum("_v").alias("_sum"), F.sum("_log").alias("_logs"), F.count("*").alias("_n"), F.median("_log").alias("_median"))
    own = held.groupBy(protein).agg(F.array_sort(F.collect_list(F.struct(sample, "_sum", "_logs", "_n", "_median"))).alias("_own"))
    ratios = sample_ratios(cells, protein, ion, sample, "_log", least)
    pairs = ratios.groupBy(protein).agg(F.collect_list(F.struct("a", "b", "ratio")).alias("_pairs"))
    rows = own.join(pairs, protein, "left").withColumn("_pairs", F.coalesce("_pairs", F.array()))
    names = F.col(f"_own.{sample}")
    place = lambda side: F.transform("_pairs", lambda x: (F.array_position(names, x[side]) - 1).cast("int"))

    @F.pandas_udf("array<double>")
    def solved(i: pd.Series, j: pd.Series, r: pd.Series, sums: pd.Series, logs: pd.Series, n: pd.Series, medians: pd.Series) -> pd.Series:
        return pd.Series([_profile(*x, scale) for x in zip(i, j, r, sums, logs, n, medians, strict=True)])

    made = rows.withColumn("_made", solved(place("a"), place("b"), F.col("_pairs.ratio"), *[F.col(f"_own.{c}") for c in ("_sum", "_logs", "_n", "_median")]))
    each = made.select(protein, names.alias("_names"), "_made", F.posexplode(names).alias("_at", sample))
    of = lambda offset: F.element_at("_made", F.col("_at") + offset + 1)
    return each.select(protein, sample, F.element_at("_names", (of(0) + 1).cast("int")).alias("component"), of(F.size("_names")).alias("lfq"))


def _profile(i: np.ndarray, j: np.ndarray, r: np.ndarray, sums: np.ndarray, logs: np.ndarray, n: np.ndarray, medians: np.ndarray, scale: str) -> np.ndarray:
    """A protein's components and then its levels, sample by sample."""
    component, level = laplacian_profiles(list(zip(i.tolist(), j.tolist(), r.tolist(), strict=True)), len(sums))
    lfq = np.zeros(len(sums))
    for c in np.unique(component):
        part = component == c
        if scale == "sum":
            raw = 2.0 ** level[part]
            lfq[part] = raw / raw.sum() * sums[part].sum()
        elif part.sum() == 1:
            lfq[part] = 2.0 ** medians[part]
        else:
            lfq[part] = 2.0 ** (level[part] + logs[part].sum() / n[part].sum())
    return np.concatenate([component, lfq])


def group_by_set(df: DataFrame, id_col: str, list_col: str, name: str = "group_id") -> DataFrame:
    """D10.  Rows with equal sets share a group, named by its smallest id."""
    made = df.withColumn("_set", F.array_sort(F.array_distinct(list_col)))
    names = made.groupBy("_set").agg(F.min(id_col).alias(name), F.count("*").alias("n_members"))
    return made.join(names, "_set").drop("_set")


def group_profile(df: DataFrame, key: str, distinct: Sequence[str] = (), numbers: Sequence[str] = ()) -> DataFrame:
    """D11.  Size, numbers of distinct values, mean and median."""
    wanted = [F.count("*").alias("size"), *[F.count_distinct(c).alias(f"n_{c}") for c in distinct]]
    for c in numbers:
        wanted += [F.avg(c).alias(f"mean_{c}"), F.median(c).alias(f"median_{c}")]
    return df.groupBy(key).agg(*wanted)


def split_and_count(df: DataFrame, tokens: Column, name: str = "token", per_row: bool = False) -> DataFrame:
    """D12.  How often each element of an array occurs; once a row at most with ``per_row``."""
    return df.select(F.explode(F.array_distinct(tokens) if per_row else tokens).alias(name)).groupBy(name).agg(F.count("*").alias("n"))


def percent_present(df: DataFrame) -> DataFrame:
    """D13.  Percentage of rows with a value, a row for each column."""
    one = df.agg(*[(F.count(c) / F.count("*") * 100).alias(c) for c in df.columns])
    return one.unpivot([], list(df.columns), "column", "percent")


def count_patterns(df: DataFrame, id_col: str, text: str, patterns: Mapping[str, str]) -> DataFrame:
    """D14.  How often each named pattern occurs in a row's text, a column each."""
    return df.select(id_col, *[F.regexp_count(text, F.lit(p)).cast("long").alias(n) for n, p in patterns.items()])


def count_mods(df: DataFrame, id_col: str, list_col: str, pattern: str, name: str = "modification", n: str = "n") -> DataFrame:
    """D14.  ``(id, modification, n)``: modifications as a pattern of one group finds them, and in how many distinct elements of the
    row's list each occurs."""
    each = df.select(id_col, F.explode(F.array_distinct(list_col)).alias("_p"))
    found = each.select(id_col, F.explode(F.array_distinct(F.regexp_extract_all("_p", F.lit(pattern), F.lit(1)))).alias(name))
    return found.groupBy(id_col, name).agg(F.count("*").alias(n))


def mods_cell(counts: DataFrame, id_col: str, name: str = "modification", n: str = "n") -> DataFrame:
    """D14.  One cell ``name n|name n`` a row, by name."""
    cell = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(name, n))), lambda x: F.concat_ws(" ", x[name], x[n].cast("string"))), "|")
    return counts.groupBy(id_col).agg(cell.alias("mods"))


def mod_matrix(df: DataFrame, id_col: str, cell: str, names: Sequence[str]) -> DataFrame:
    """D14.  Cells read back: a column for each name, 0 where it is absent, and each one's share of the row's total."""
    each = df.select(id_col, F.explode(F.split(cell, r"\|")).alias("_c"))
    each = each.select(id_col, F.regexp_extract("_c", r"^(.*) \d+$", 1).alias("_m"), F.regexp_extract("_c", r" (\d+)$", 1).cast("long").alias("_n"))
    wide = each.groupBy(id_col).pivot("_m", list(names)).agg(F.sum("_n")).fillna(0)
    total = sum((F.col(f"`{x}`") for x in names), F.lit(0))
    return wide.select("*", *[F.try_divide(F.col(f"`{x}`").cast("double"), total).alias(f"{x}_share") for x in names])


def count_pivot(df: DataFrame, key: str, item: str, items: Sequence[str], value: Column | None = None) -> DataFrame:
    """D15, F5.  Counts (or sums) by item in columns, 0 where there is none."""
    return df.groupBy(key).pivot(item, list(items)).agg(F.count(F.lit(1)) if value is None else F.sum(value)).fillna(0)


def incidence(df: DataFrame, key: str, item: str, items: Sequence[str]) -> DataFrame:
    """D25.  0/1 columns: does the key have the item."""
    return df.groupBy(key).pivot(item, list(items)).agg(F.max(F.lit(1))).fillna(0)


def aggregate_mismatches(df: DataFrame, key: str, index: str, conservative: str) -> DataFrame:
    """D17.  Number of mismatches, half the rows whose place repeats, and sums of (non-)conservative ones with their ratio."""
    counted = df.groupBy(key, index).agg(F.count("*").alias("_n"), F.sum(conservative).alias("_c"))
    made = counted.groupBy(key).agg(
        F.sum("_n").alias("n_mismatches"),
        (F.sum(F.when(F.col("_n") > 1, F.col("_n")).otherwise(0)) / 2).alias("n_disagreements"),
        F.sum("_c").alias("conservative"),
        (F.sum("_n") - F.sum("_c")).alias("non_conservative"),
    )
    return made.withColumn("ratio", F.try_divide("conservative", "non_conservative"))


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    """D18.  Counts of each pair of levels with totals and the expected count; pairs that never occur count 0."""
    n = df.groupBy(a, b).agg(F.count("*").alias("n"))
    rows, cols = n.groupBy(a).agg(F.sum("n").alias("n_a")), n.groupBy(b).agg(F.sum("n").alias("n_b"))
    total = rows.agg(F.sum("n_a").alias("total"))
    grid = rows.crossJoin(cols).join(F.broadcast(total))  # levels by levels: what the table is; total is one row
    made = grid.join(n, [a, b], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return made.withColumn("expected", F.col("n_a") * F.col("n_b") / F.col("total"))


def dominant_label(df: DataFrame, item: str, label: str) -> DataFrame:
    """D19.  Each item's label of highest count relative to the label's total; ties to the smaller label."""
    n = df.groupBy(item, label).agg(F.count("*").alias("n"))
    share = n.join(df.groupBy(label).agg(F.count("*").alias("total")), label).withColumn("share", F.col("n") / F.col("total"))
    ranked = share.withColumn("_r", F.row_number().over(W.partitionBy(item).orderBy(F.desc("share"), label)))
    return ranked.filter("_r = 1").select(item, label, "share")


def groups_min_size(df: DataFrame, key: str, least: int) -> DataFrame:
    """D20.  Rows of groups of at least so many."""
    return df.join(df.groupBy(key).agg(F.count("*").alias("_n")).filter(F.col("_n") >= least).select(key), key, "left_semi")


def overlap_partition(df: DataFrame, keys: Sequence[str], source: str) -> DataFrame:
    """D21.  How many keys have exactly which sources."""
    sets = df.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_set(source)), "&").alias("sources"))
    return sets.groupBy("sources").agg(F.count("*").alias("n_keys"))


def common_keys(df: DataFrame, key: str, source: str, n_sources: int) -> DataFrame:
    """F3.  Keys that all sources have."""
    return df.select(key, source).distinct().groupBy(key).agg(F.count("*").alias("_n")).filter(F.col("_n") == n_sources).select(key)


def unique_to_each(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """F4.  Keys of one side only, and which."""
    one = lambda x, y, side: x.select(key).distinct().join(y.select(key).distinct(), key, "left_anti").withColumn("side", F.lit(side))
    return one(a, b, "a").unionByName(one(b, a, "b"))


def composition(df: DataFrame, group: str, label: str, value: str, truth: Mapping[str, float] | None = None) -> DataFrame:
    """D22.  Groups get their smallest label; labels' shares by number of groups and by value, mixed groups counted."""
    one = df.groupBy(group).agg(F.min(label).alias(label), (F.count_distinct(label) > 1).cast("int").alias("mixed"), F.sum(value).alias("_v"))
    made = one.groupBy(label).agg(F.count("*").alias("n_groups"), F.sum("mixed").alias("n_mixed"), F.sum("_v").alias("_v"))
    all_ = W.partitionBy(F.lit(1))  # as many rows as labels
    made = made.withColumn("count_share", F.col("n_groups") / F.sum("n_groups").over(all_)).withColumn("value_share", F.col("_v") / F.sum("_v").over(all_)).drop("_v")
    if truth is None:
        return made
    known = F.create_map(*[F.lit(x) for pair in truth.items() for x in pair])
    return made.withColumn("truth", F.element_at(known, F.col(label))).withColumn("off", F.col("value_share") - F.col("truth"))


def summarise(df: DataFrame, cols: Sequence[str], by: str) -> DataFrame:
    """D23.  Mean and standard deviation of each column and group, in long form."""
    long = df.select(by, *[F.col(c).cast("double").alias(c) for c in cols]).unpivot([by], list(cols), "metric", "value")
    return long.groupBy(by, "metric").agg(F.avg("value").alias("mean"), F.stddev("value").alias("sd"))


def percent_change(summary: DataFrame, by: str, a: object, b: object) -> DataFrame:
    """D23.  ``(b - a) / a`` of each metric's mean between two groups of a summary; null where a is 0."""
    mean = lambda x: F.max(F.when(F.col(by) == x, F.col("mean")))
    both = summary.groupBy("metric").agg(mean(a).alias("mean_a"), mean(b).alias("mean_b"))
    return both.withColumn("change", F.try_divide(F.col("mean_b") - F.col("mean_a"), F.col("mean_a")))


def to_wide(df: DataFrame, keys: Sequence[str], name: str, value: str, names: Sequence[str]) -> DataFrame:
    """D28.  A column for each name; null where a key has none."""
    return df.groupBy(*keys).pivot(name, list(names)).agg(F.first(value))


def transpose(df: DataFrame, name: str, rows: Sequence[str], by: str = "column") -> DataFrame:
    """D28.  Columns become rows and the named rows columns."""
    cols = [c for c in df.columns if c != name]
    long = df.select(name, *[F.col(c).cast("string").alias(c) for c in cols]).unpivot([name], cols, by, "_v")
    return to_wide(long, [by], name, "_v", rows)


def empai(proteins: DataFrame, id_col: str, seq: str, peptides: DataFrame, peptide: str, mass_range: tuple[float, float] = (600.0, 3500.0)) -> DataFrame:
    """D24.  10 ** (observed / observable) - 1; observable: tryptic peptides in the mass range, observed: distinct peptides.
    Proteins without an observable or an observed peptide have none."""
    pieces = proteins.select(id_col, F.explode(F.array_distinct(F.split(seq, "(?<=[KR])(?!P)"))).alias("_p")).filter(F.col("_p") != "")
    able = pieces.filter(monoisotopic_mass(F.col("_p")).between(*mass_range)).groupBy(id_col).agg(F.count("*").alias("observable"))
    seen = peptides.select(id_col, peptide).distinct().groupBy(id_col).agg(F.count("*").alias("observed"))
    return able.join(seen, id_col).withColumn("empai", F.pow(F.lit(10.0), F.col("observed") / F.col("observable")) - 1)


def mode_per_key(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """D27.  The most frequent value; ties to the smallest."""
    n = df.groupBy(*keys, value).agg(F.count("*").alias("n"))
    best = W.partitionBy(*keys).orderBy(F.desc("n"), value)
    return n.withColumn("_r", F.row_number().over(best)).filter("_r = 1").drop("_r")


def rank_share(df: DataFrame, ranks: Sequence[str]) -> DataFrame:
    """D29.  Count and percentage of each value of each rank column."""
    long = df.unpivot([], list(ranks), "rank", "name").groupBy("rank", "name").agg(F.count("*").alias("n"))
    return long.withColumn("percent", F.col("n") * 100 / F.sum("n").over(W.partitionBy("rank")))


def group_consistency(df: DataFrame, group: str, evidence: str) -> DataFrame:
    """D31.  Size and number of distinct evidence of each group."""
    return df.groupBy(group).agg(F.count("*").alias("size"), F.count_distinct(evidence).alias("n_evidence"))


def count_and_max(df: DataFrame, key: str, list_col: str, scores: DataFrame, item: str, score: str) -> DataFrame:
    """D26.  Number of distinct listed items and the highest score among them."""
    each = df.select(key, F.explode(F.array_distinct(list_col)).alias(item)).join(scores, item, "left")
    return each.groupBy(key).agg(F.count("*").alias("n_items"), F.max(score).alias("max_score"))


def union_fill(*frames: DataFrame) -> DataFrame:
    """F1.  All rows, missing columns null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def union_distinct(*frames: DataFrame) -> DataFrame:
    """F2."""
    return union_fill(*frames).distinct()


