"""Coverage of sequences and positional comparison of aligned text (G*)."""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidentia.operators.windows import interval_coverage

# Classes of residues (NP non-polar, PN polar neutral, PA polar acidic, PB polar basic).
RESIDUE_CLASS = {
    "A": "NP", "C": "PN", "D": "PA", "E": "PA", "F": "NP", "G": "NP", "H": "PB", "I": "NP", "K": "PB", "L": "NP", "M": "NP", "N": "PN", "O": "PB", "P": "NP", "Q": "PN",
    "R": "PB", "S": "PN", "T": "PN", "U": "PA", "V": "NP", "W": "NP", "Y": "PN",
}


def positions(text: Column, part: Column) -> Column:
    """The 1-based starts of all occurrences of ``part``, overlapping ones included."""
    starts = F.sequence(F.lit(1), F.length(text) - F.length(part) + 1)
    return F.when(
        (F.length(part) > 0) & (F.length(text) >= F.length(part)), F.filter(starts, lambda i: F.substring(text, i, F.length(part)) == part)
    ).otherwise(F.array().cast("array<int>"))


def exact_coverage(seqs: DataFrame, id_col: str, seq: str, parts: DataFrame, part: str, compat: bool = False, strip: str | None = None) -> DataFrame:
    """G1.  Share of a sequence that exact occurrences of its parts cover; with ``compat``, 0 if any part is absent.

    What the pattern ``strip`` matches (``[^A-Z]+`` for all but residues) is taken out of sequences first and doesn't count; a sequence of which
    nothing is left has no coverage (null)."""
    if strip is not None:
        seqs = seqs.withColumn(seq, F.nullif(F.regexp_replace(seq, strip, ""), F.lit("")))
    at = seqs.join(parts, id_col).select(id_col, seq, part, positions(F.col(seq), F.col(part)).alias("_at"))
    each = at.select(id_col, F.length(part).alias("_n"), F.explode("_at").alias("start")).withColumn("end", F.col("start") + F.col("_n") - 1)
    covered = interval_coverage(each, [id_col], "start", "end", inclusive=True)
    absent = at.groupBy(id_col).agg(F.max((F.size("_at") == 0).cast("int")).alias("_absent"))
    out = seqs.select(id_col, F.length(seq).alias("_len")).join(absent, id_col, "left").join(covered, id_col, "left")
    share = F.coalesce("covered", F.lit(0)) / F.col("_len")
    return out.select(id_col, (F.when(F.col("_absent") == 1, 0.0).otherwise(share) if compat else share).alias("coverage"))


def tokens(aligned: Column) -> Column:
    """One element for each position: a letter, a gap, or a bracket of alternatives."""
    return F.regexp_extract_all(aligned, F.lit(r"(\[[A-Z]+\]|.)"), F.lit(1))


def merge_alignments(df: DataFrame, part: Sequence[str], aligned: str, order: str | None = None) -> DataFrame:
    """G2.  Position by position the letters that occur: a gap if none, the letter if one, else all in a bracket, in the order of the
    rows that brought them (``order``), or sorted where no order is given."""
    came = F.lit(0) if order is None else F.col(order)
    each = df.select(*part, came.alias("_o"), F.posexplode(tokens(F.col(aligned))).alias("pos", "_t"))
    each = each.select(*part, "pos", "_o", F.posexplode(F.split(F.regexp_replace("_t", r"[\[\]]", ""), "")).alias("_i", "_l"))
    if order is None:
        each = each.withColumn("_i", F.lit(0))
    first = each.groupBy(*part, "pos", "_l").agg(F.min(F.struct("_o", "_i")).alias("_f"))
    letter = F.when(~F.col("_l").isin("", "-"), F.struct("_f", "_l"))
    at = first.groupBy(*part, "pos").agg(F.transform(F.array_sort(F.collect_list(letter)), lambda x: x["_l"]).alias("_a"))
    written = F.when(F.size("_a") == 0, "-").when(F.size("_a") == 1, F.get("_a", F.lit(0))).otherwise(F.concat(F.lit("["), F.array_join("_a", ""), F.lit("]")))
    joined = at.withColumn("_w", written).groupBy(*part).agg(F.sort_array(F.collect_list(F.struct("pos", "_w"))).alias("_all"))
    return joined.select(*part, F.array_join(F.transform("_all", lambda x: x["_w"]), "").alias("consensus"))


GAP = ord("-")
_TOKEN = re.compile("\\[[A-Z]+\\]|[^\n\r\u0085\u2028\u2029]")  # as in ``tokens``
_UNEVEN = re.compile("[\\[\\]\n\r\u0085\u2028\u2029]")  # what makes tokens other than code points
_MOST_ROWS = 1 << 17  # rows handed on at once


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), "<u4")


def _placed(seq: str, aligned: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places, the sequence's letters there and those aligned with them, once for each alternative, as code points."""
    s = _codes(seq)
    if not _UNEVEN.search(aligned):
        t = _codes(aligned)[: len(s)]
        return np.arange(len(t)), s[: len(t)], t
    parts = [p.strip("[]") for p in _TOKEN.findall(aligned)[: len(s)]]
    at = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    return at, s[at], _codes("".join(parts))


def _mismatched(names: Sequence[str], classes: Mapping[str, str]):
    """Rows of these columns from rows of id, sequence and aligned text; what is said of a change is made once for a batch."""

    def made(ids: pa.Array, found: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        row, index, pair = (np.concatenate(c) for c in zip(*found, strict=True))
        changes, which = np.unique(pair, return_inverse=True)
        letters = [(chr(c >> 32), chr(c & 0xFFFFFFFF)) for c in changes.tolist()]
        kinds = [(classes.get(a), classes.get(b)) for a, b in letters]
        known = [None not in k for k in kinds]
        told = [
            pa.array([f"{a}->{b}" for a, b in letters], pa.string()),
            pa.array([f"{a}->{b}" if k else None for (a, b), k in zip(kinds, known, strict=True)], pa.string()),
            pa.array([int(a == b) if k else None for (a, b), k in zip(kinds, known, strict=True)], pa.int32()),
        ]
        for i in range(0, len(row), _MOST_ROWS):
            part = slice(i, i + _MOST_ROWS)
            change, kind, conservative = (x.take(pa.array(which[part])) for x in told)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(row[part])), change, kind, pa.array(index[part].astype(np.int32)), conservative], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, seqs, aligned = batch.columns
            found, held = [], 0
            for r, (x, y) in enumerate(zip(seqs, aligned, strict=True)):
                if not (x.is_valid and y.is_valid):
                    continue
                at, s, t = _placed(x.as_py(), y.as_py())
                differ = np.nonzero((t != s) & (t != GAP))[0]
                if len(differ):
                    found.append((np.full(len(differ), r), at[differ], s[differ].astype(np.int64) << 32 | t[differ]))
                    held += len(differ)
                if held >= _MOST_ROWS:
                    yield from made(ids, found)
                    found, held = [], 0
            if found:
                yield from made(ids, found)

    return run


def mismatches(df: DataFrame, id_col: str, seq: str, aligned: str, classes: Mapping[str, str] = RESIDUE_CLASS) -> DataFrame:
    """G3, G6.  A row for each alternative that differs from the sequence: change, class change, index (0-based).

    Texts are compared whole in the tasks that hold them, and only places that differ become rows."""
    rows = df.select(id_col, seq, aligned)
    texts = [T.StructField("change", T.StringType()), T.StructField("type", T.StringType())]
    schema = T.StructType([rows.schema[0], *texts, T.StructField("index", T.IntegerType()), T.StructField("conservative", T.IntegerType())])
    return rows.mapInArrow(_mismatched(schema.names, dict(classes)), schema)


def _n_differing(seq: str, aligned: str) -> int:
    """Number of places whose token is neither a gap nor the sequence's letter."""
    if _UNEVEN.search(aligned):
        return sum(t not in ("-", s) for s, t in zip(seq, _TOKEN.findall(aligned), strict=False))
    _, s, t = _placed(seq, aligned)
    return int(np.count_nonzero((t != s) & (t != GAP)))


def alignment_metrics(df: DataFrame, id_col: str, seq: str, aligned: str) -> DataFrame:
    """G3.  Positions that differ (a bracket always does), and the share of positions that aren't gaps."""

    @F.pandas_udf("int")
    def differing(seqs: pd.Series, alignments: pd.Series) -> pd.Series:
        return pd.Series([None if s is None or t is None else _n_differing(s, t) for s, t in zip(seqs, alignments, strict=True)], dtype="Int32")

    gaps = F.length(aligned) - F.length(F.replace(F.col(aligned), F.lit("-"), F.lit("")))  # no bracket holds one
    return df.select(id_col, differing(seq, aligned).alias("n_mismatches"), (F.lit(1) - gaps / F.length(seq)).alias("coverage"))


def coverage_by_source(df: DataFrame, part: str, source: str, sources: Sequence[str], start: str, end: str) -> DataFrame:
    """G4.  Covered length by source in columns, 0 where a source has nothing, and the total."""
    each = interval_coverage(df, [part, source], start, end).groupBy(part).pivot(source, list(sources)).agg(F.sum("covered")).fillna(0)
    return each.join(interval_coverage(df, [part], start, end).select(part, F.col("covered").alias("total")), part)


def coverage_contribution(df: DataFrame, part: str, source: str, kind: str, sources: Sequence[str], kinds: Sequence[str], start: str, end: str) -> DataFrame:
    """G4.  Covered length and number of rows by source, by kind of alignment and of rows without a source, in columns; 0 where
    there is nothing; and the number of all rows."""
    named = F.coalesce(F.nullif(F.col(source), F.lit("unknown")), F.lit("unidentified"))
    both = df.withColumn("_of", F.explode(F.array(F.concat(F.lit("source_"), named), F.concat(F.lit("kind_"), F.col(kind)))))
    columns = [*[f"source_{s}" for s in sources], "source_unidentified", *[f"kind_{k}" for k in kinds]]
    covered = interval_coverage(both, [part, "_of"], start, end).select(part, "_of", F.col("covered").cast("long").alias("covered"))
    counted = both.groupBy(part, "_of").agg(F.count("*").alias("n"))
    wide = counted.join(covered, [part, "_of"], "left").groupBy(part).pivot("_of", columns).agg(F.sum("covered").alias("covered"), F.sum("n").alias("n")).fillna(0)
    return wide.join(df.groupBy(part).agg(F.count("*").alias("n_all")), part)


def coverage_without(df: DataFrame, part: str, source: str, sources: Sequence[str], start: str, end: str) -> DataFrame:
    """G5.  Covered length without each source's rows; 0 where nothing is left."""
    out = df.withColumn("left_out", F.explode(F.array(*[F.lit(s) for s in sources])))  # as many copies as sources
    rest = interval_coverage(out.filter(F.col(source) != F.col("left_out")), [part, "left_out"], start, end)
    return out.select(part, "left_out").distinct().join(rest.select(part, "left_out", "covered"), [part, "left_out"], "left").fillna(0, ["covered"])


def majority_consensus(df: DataFrame, part: Sequence[str], aligned: str) -> DataFrame:
    """G7.  The most frequent letter of each position (the smallest of equals), X where there is none."""
    each = df.select(*part, F.posexplode(F.split(aligned, "")).alias("pos", "_t"))
    n = each.groupBy(*part, "pos", "_t").agg(F.sum((F.col("_t") != "-").cast("int")).alias("_n"))
    best = n.withColumn("_r", F.row_number().over(W.partitionBy(*part, "pos").orderBy(F.desc("_n"), "_t"))).filter("_r = 1")
    letter = F.when(F.col("_n") > 0, F.col("_t")).otherwise("X")
    joined = best.withColumn("_w", letter).groupBy(*part).agg(F.sort_array(F.collect_list(F.struct("pos", "_w"))).alias("_all"))
    return joined.select(*part, F.array_join(F.transform("_all", lambda x: x["_w"]), "").alias("consensus"))


def merge_coverage(base: DataFrame, parts: Sequence[DataFrame], key: str) -> DataFrame:
    """G9.  Distinct parts joined back; rows without coverage stay."""
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return base.join(every.distinct(), key, "left")
