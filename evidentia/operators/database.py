"""Target/decoy tables and sampling (H*)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evidentia.functions.scalars import monoisotopic_mass, resolve_ambiguous
from evidentia.operators.aggregate import assign_ids
from evidentia.operators.windows import dedup
from evidentia.scratch import settled


def build_database(parts: Sequence[DataFrame], id_col: str, seq: str, min_len: int = 10) -> DataFrame:
    """H1.  Targets (one row for each id, long enough, ambiguous residues resolved) and their reversed decoys."""
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    targets = dedup(every, [id_col], [F.xxhash64(seq)]).filter(F.length(seq) >= min_len).withColumn(seq, resolve_ambiguous(F.col(seq), F.col(id_col)))
    targets = targets.withColumn(id_col, F.col(id_col).cast("string")).withColumn("decoy", F.lit(False))
    decoys = targets.withColumns({id_col: F.concat(F.lit("rev_"), F.col(id_col)), seq: F.reverse(seq), "decoy": F.lit(True)})
    return targets.unionByName(decoys).withColumn("length", F.length(seq))


def database_entries(database: DataFrame, id_col: str, seq: str, header: Column | str, prefix: str = "P") -> DataFrame:
    """H1.  A target/decoy table with what a search needs: ``entry`` (P0, P1 .. over targets and decoys by sequence length, descending, and
    id), ``mass``, and ``header`` (decoys: that of their target with ``rev_`` before it)."""
    headed = database.withColumn("header", F.concat(F.when(F.col("decoy"), "rev_").otherwise(""), header if isinstance(header, Column) else F.col(header)))
    made = assign_ids(headed, prefix, [F.desc("length"), F.col(id_col)], "entry")
    return made.withColumn("mass", monoisotopic_mass(F.col(seq)))  # after the numbers are written: made only where it is asked for


def database_views(entries: DataFrame, seq: str) -> dict[str, DataFrame]:
    """H1.  The table's views: targets alone, decoys alone, the FASTA records of all, and entries by their ids."""
    fasta = entries.select("entry", F.concat(F.lit(">"), F.col("entry"), F.lit(" "), F.col("header"), F.lit("\n"), F.col(seq)).alias("record"))
    return {"targets": entries.filter("not decoy"), "decoys": entries.filter("decoy"), "fasta": fasta, "mapping": entries.select("entry", "header", "length", "mass")}


def balance_decoys(identified: DataFrame, id_col: str, database: DataFrame, seq: str, seed: int = 1) -> DataFrame:
    """H2.  Identified rows of the database, with as many decoys as targets: missing ones are reversed targets, drawn
    with replacement by hashed numbers.

    A draw names a hash bucket and a place in it, so draws and targets meet in an equi-join.
    """
    own = settled(database.join(identified.select(id_col).distinct(), id_col, "left_semi"))
    n = {r["decoy"]: r["n"] for r in own.groupBy("decoy").agg(F.count("*").alias("n")).collect()}
    missing = n.get(False, 0) - n.get(True, 0)
    if missing <= 0 or not n.get(False):
        return own
    buckets = max(1, n[False] // 1000)
    places = own.filter("not decoy").select(id_col, F.pmod(F.xxhash64(id_col), F.lit(buckets)).alias("_b"))  # ids alone are sorted, not their sequences
    places = settled(places.withColumn("_k", F.row_number().over(W.partitionBy("_b").orderBy(id_col)) - 1))
    sizes = places.groupBy("_b").agg(F.count("*").alias("_n"))
    draws = own.sparkSession.range(missing).select("id", F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(buckets)).alias("_b"))
    draws = draws.join(sizes, "_b").withColumn("_k", F.pmod(F.xxhash64(F.lit(seed + 1), "id"), F.col("_n"))).select(F.col("id").alias("_draw"), "_b", "_k")
    drawn = places.join(draws, ["_b", "_k"]).select(id_col, "_draw")
    added = own.filter("not decoy").join(drawn, id_col).withColumns(
        {id_col: F.concat(F.lit("rev_"), F.col(id_col), F.lit("_added"), F.col("_draw").cast("string")), seq: F.reverse(seq), "decoy": F.lit(True)}
    )
    return own.unionByName(added.select(*own.columns))


def cap_per_stratum(df: DataFrame, stratum: str, n: int, key: str, seed: int = 1) -> DataFrame:
    """H3.  At most n rows of each stratum, in hashed order; smaller strata whole."""
    r = F.row_number().over(W.partitionBy(stratum).orderBy(F.xxhash64(key, F.lit(seed)), key))
    return df.withColumn("_r", r).filter(F.col("_r") <= n).drop("_r")
