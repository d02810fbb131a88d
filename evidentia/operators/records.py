"""Records of several sources brought to one shape: filters, projections, attachments and reports."""

from __future__ import annotations

import functools
import operator
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evidentia.functions.scalars import charge_one_hots, flanked, insert_masses, tryptic_flags

# Thresholds of accepted hits, and the mass between isotopes.
THRESHOLDS = {"q_value": ("<=", 0.05), "pep": ("<=", 1.0), "pident": (">=", 80.0), "evalue": ("<=", 1e-5), "coverage": (">=", 0.8)}
NEUTRON = 1.0033548378
OPERATIONS = {
    "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "=": lambda a, b: a == b, "<>": lambda a, b: a != b,
}


def filter_hits(df: DataFrame, rules: Mapping[str, tuple[str, float]] | None = None) -> DataFrame:
    """B13.  Rows that meet all thresholds ``{column: (operation, value)}``; by default those of THRESHOLDS whose column is there."""
    rules = {c: r for c, r in THRESHOLDS.items() if c in df.columns} if rules is None else rules
    return df.filter(reduce(lambda a, b: a & b, [OPERATIONS[op](F.col(c), F.lit(v)) for c, (op, v) in rules.items()], F.lit(True)))


def project_hits(df: DataFrame, source: str, seq: str, proteins: str, scores: Mapping[str, str], best: Column, decoy: Column | None = None) -> DataFrame:
    """B28.  One source's hits in the common shape ``(source, seq, proteins, scores ...)``.

    Decoys go, ``a|b`` sequences become rows, each sequence keeps its best row (smallest ``best``, then proteins), notes in
    parentheses leave the protein list, whose separators become ``;``.
    """
    rows = df if decoy is None else df.filter(~decoy)
    clean = F.regexp_replace(F.regexp_replace(F.col(proteins), r"\s*\([^)]*\)", ""), r"[,|]", ";")
    rows = rows.select(F.explode(F.split(seq, r"\|")).alias("seq"), clean.alias("proteins"), *[F.col(a).alias(b) for a, b in scores.items()], best.alias("_b"))
    first = W.partitionBy("seq").orderBy("_b", "proteins", *scores.values())
    return rows.withColumn("_r", F.row_number().over(first)).filter("_r = 1").select(F.lit(source).alias("source"), "seq", "proteins", *scores.values())


def psm_features(df: DataFrame) -> DataFrame:
    """B17.  Features for rescoring from a search engine's rows ``(name, scan, decoy, exp_mz, calc_mz, charge, isotope, raw_score, denovo_score, evalue, explained,
    n_term, c_term, ms2_current, mean_error, stdev_error, seq, pre, post, mods, proteins)``; rows without errors' deviation are left out."""
    c = F.col
    ratio = F.coalesce(F.try_divide(c("raw_score"), c("denovo_score")), F.lit(0.0))
    peptide = flanked(insert_masses(c("seq"), c("mods")), c("pre"), c("post"))
    off = (c("exp_mz") - c("isotope") * NEUTRON / c("charge") - c("calc_mz")) / c("exp_mz")
    log = lambda x: F.log(c(x) + 0.0001)
    made = df.filter(c("stdev_error").isNotNull()).select(
        F.concat_ws("_", F.regexp_extract("name", r"(.*)\.", 1), F.concat(F.lit("SII"), c("scan").cast("string"))).alias("spec_id"),
        F.when(c("decoy"), -1).otherwise(1).alias("label"),
        F.round("exp_mz", 3).alias("exp_mass"), F.round("calc_mz", 3).alias("calc_mass"), "raw_score", "denovo_score", ratio.alias("score_ratio"),
        (c("denovo_score") - c("raw_score")).alias("energy"), (-F.log("evalue")).alias("ln_evalue"), "isotope", log("explained").alias("ln_explained"),
        log("n_term").alias("ln_n_term"), log("c_term").alias("ln_c_term"), F.log("ms2_current").alias("ln_ms2_current"), F.length("seq").alias("pep_len"),
        off.alias("d_m"), F.abs(off).alias("abs_d_m"), (-c("mean_error")).alias("mean_error"), (c("mean_error") * c("mean_error")).alias("sq_mean_error"), "stdev_error",
        *[x.alias(n) for n, x in charge_one_hots(c("charge")).items()], peptide.alias("peptide"), F.array_join("proteins", "\t").alias("proteins"),
    )
    return made.withColumns(tryptic_flags(F.col("peptide")))


def to_pin(df: DataFrame, file: str, scan: str, reverse: str, features: Sequence[str], peptide: Column, proteins: Column) -> DataFrame:
    """B19.  A vendor's table for rescoring: ``file.scan``, -1 for reversed hits, features as they are; rows with a null are left out."""
    label = F.when(F.coalesce(F.col(reverse) == "+", F.lit(False)), -1).otherwise(1)
    made = df.select(F.concat_ws(".", file, F.col(scan).cast("string")).alias("spec_id"), label.alias("label"), F.col(scan).alias("scan_nr"), *features, peptide.alias("peptide"), proteins.alias("proteins"))
    return made.dropna()


def attach_ortholog(unmatched: DataFrame, key: str, annotations: DataFrame, seeds: DataFrame, query: str, ortholog: str, seqs: DataFrame, seq: str, lists: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """C14.  Unmatched rows with the annotation of their seed ortholog and its sequence (null where unknown), and the rest.

    Annotations and seeds share the query, which is the unmatched rows' key; list cells get ``;`` and lose ``ko:``.
    """
    clean = {c: F.replace(F.replace(F.col(c), F.lit(","), F.lit(";")), F.lit("ko:"), F.lit("")) for c in lists}
    known = annotations.join(seeds.select(query, ortholog), query).withColumns(clean).withColumnRenamed(query, key)
    found = unmatched.join(known, key).join(seqs.select(ortholog, seq), ortholog, "left")
    return found, unmatched.join(known.select(key), key, "left_anti")


def map_scans(psms: DataFrame, scans: DataFrame, scan: str, protein: str, unmatched: DataFrame, proteins: DataFrame, peptide: str, members: str) -> DataFrame:
    """C15.  PSMs with their scan's columns; a missing protein is filled from the unmatched peptides, then from the proteins whose
    list of peptides has it (the smallest, where there are several).  Each PSM comes out once."""
    own = unmatched.groupBy(peptide).agg(F.min(protein).alias("_u"))
    listed = proteins.select(F.col(protein).alias("_p"), F.explode(members).alias(peptide)).groupBy(peptide).agg(F.min("_p").alias("_p"))
    joined = psms.join(scans, scan).join(own, peptide, "left").join(listed, peptide, "left")
    return joined.withColumn(protein, F.coalesce(protein, "_u", "_p")).drop("_u", "_p")


def search_report(df: DataFrame, by: Sequence[str], group: str, members: str, item: str, score: str, most: float, kinds: Mapping[str, Column]) -> DataFrame:
    """D16.  One row for each source and pass: groups, groups of several members, distinct items, items below a threshold and their share,
    and items of each kind."""
    flag = lambda c: F.max(F.coalesce(c, F.lit(False)).cast("int"))
    # a row for each group, and for each item, of a source; then their numbers: rows aren't copied for each column that is counted
    groups = df.groupBy(*by, group).agg(flag(F.size(members) > 1).alias("_m"), *[F.count_if(c).alias(f"n_{k}") for k, c in kinds.items()])
    groups = groups.groupBy(*by).agg(F.count(group).alias("n_groups"), F.count_if((F.col("_m") == 1) & F.col(group).isNotNull()).alias("n_multi"), *[F.sum(f"n_{k}").alias(f"n_{k}") for k in kinds])
    items = df.groupBy(*by, item).agg(flag(F.col(score) <= most).alias("_b"))
    items = items.groupBy(*by).agg(F.count(item).alias("n_items"), F.count_if((F.col("_b") == 1) & F.col(item).isNotNull()).alias("n_below"))
    same = lambda c: F.col(f"g.{c}").eqNullSafe(F.col(f"i.{c}"))
    both = groups.alias("g").join(items.alias("i"), functools.reduce(operator.and_, [same(c) for c in by], F.lit(True)))  # a row for each source
    report = both.select(*[F.col(f"g.{c}") for c in by], "n_groups", "n_multi", "n_items", "n_below", *[f"n_{k}" for k in kinds])
    return report.withColumn("share_below", F.col("n_below") / F.col("n_items"))


def matched_scans(scans: DataFrame, scan: str, level: str, hits: DataFrame, source: str, sources: Sequence[str]) -> DataFrame:
    """D16.  By level: scans, those that any source matches, those that each does, and the matched share."""
    of = hits.select(scan, source).distinct().groupBy(scan).pivot(source, list(sources)).agg(F.count(F.lit(1)))
    at = scans.join(of.withColumn("_m", F.lit(1)), scan, "left").groupBy(level)
    made = at.agg(F.count("*").alias("n_scans"), F.count("_m").alias("n_matched"), *[F.count(F.col(f"`{s}`")).alias(s) for s in sources])
    return made.withColumn("share", F.col("n_matched") / F.col("n_scans"))
