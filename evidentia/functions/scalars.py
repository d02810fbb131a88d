"""Column expressions (B*): cleaning, ids, list cells, nulls, buckets.  All of them run inside the JVM."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Monoisotopic residue masses and water (Da).
RESIDUE_MASS = {
    "A": 71.037114, "C": 103.009185, "D": 115.026943, "E": 129.042593, "F": 147.068414, "G": 57.021464, "H": 137.058912, "I": 113.084064,
    "K": 128.094963, "L": 113.084064, "M": 131.040485, "N": 114.042927, "P": 97.052764, "Q": 128.058578, "R": 156.101111, "S": 87.032028,
    "T": 101.047679, "V": 99.068414, "W": 186.079313, "Y": 163.063329,
}
WATER = 18.010565


def clean_sequence(col: Column, mode: str = "residues") -> Column:
    """B1.  residues: upper-case letters only, where anything else occurs; no_x: also without X; strip_mods: without
    ``[..]`` blocks; brackets_only: residues, but only where a bracket occurs."""
    letters = F.regexp_replace(F.upper(col), "[^A-Z]", "")
    if mode == "residues":
        return F.when(col.rlike(r"[\]a-z0-9.\-]"), letters).otherwise(col)
    if mode == "no_x":
        return F.regexp_replace(letters, "X", "")
    if mode == "strip_mods":
        return F.regexp_replace(col, r"\[[^\]]*\]", "")
    if mode == "brackets_only":
        return F.when(col.contains("]"), letters).otherwise(col)
    raise ValueError(f"no mode {mode}")


def strip_termini(col: Column, n: int = 2) -> Column:
    """B2.  Without n characters at either end; null where there are fewer than 2n."""
    return F.when(F.length(col) >= 2 * n, F.substring(col, n + 1, F.length(col) - 2 * n))


def scan_id(source: Column, col: Column, patterns: Mapping[str, str]) -> Column:
    """B3.  ``file.scan`` by each source's pattern of two groups; others are left as they are."""
    out = col
    for name, pattern in patterns.items():
        out = F.when(source == name, F.concat_ws(".", F.regexp_extract(col, pattern, 1), F.regexp_extract(col, pattern, 2))).otherwise(out)
    return out


def first_match(col: Column, rules: Sequence[tuple[str, str]], default: str = "other") -> Column:
    """B4, B20.  The label of the first pattern that matches."""
    out = None
    for label, pattern in rules:
        out = F.when(col.rlike(pattern), label) if out is None else out.when(col.rlike(pattern), label)
    return F.lit(default) if out is None else out.otherwise(default)


def id_from_header(col: Column) -> Column:
    """B5.  The text between the first and last bar; else, if there is a dot, the first word; else NONE."""
    return F.when(col.rlike(r"\|.*\|"), F.regexp_extract(col, r"^[^|]*\|(.*)\|", 1)).when(col.contains("."), F.regexp_extract(col, r"^(\S*)", 1)).otherwise("NONE")


def organism(known: Column, header: Column) -> Column:
    """B6.  Where unknown: ``OS=Genus species``, else what stands in brackets with a capital."""
    found = F.coalesce(F.nullif(F.regexp_extract(header, r"OS=([A-Z][a-z]+ [a-z]+)", 1), F.lit("")), F.nullif(F.regexp_extract(header, r"\[([A-Z][^\]]*)\]", 1), F.lit("")))
    return F.coalesce(known, found)


def name_from_header(col: Column) -> Column:
    """B7.  The description: after the id, before ``OS=`` or a bracket, lower-cased."""
    return F.lower(F.trim(F.regexp_extract(col, r"^\S+\s+(.*?)(?:\s+OS=.*|\s*\[.*)?$", 1)))


def clean_taxon(col: Column) -> Column:
    """B8.  Without ranks, strains and ``uncultured``."""
    out = F.regexp_replace(col, r"(?i)\buncultured\s+", "")
    for cut in (r"\s+(subsp|sp)\b.*$", r"\s+bv\..*$", r"\s*\(strain.*$", r"\s+complex\b.*$", r"\s+serotype\b.*$"):
        out = F.regexp_replace(out, cut, "")
    return F.trim(out)


def list_union(*cols: Column) -> Column:
    """B9.  The sorted union of array cells; null only if all are."""
    both = F.array_sort(F.array_distinct(F.array_compact(F.concat(*[F.coalesce(c, F.array().cast("array<string>")) for c in cols]))))
    return F.when(F.coalesce(*cols).isNotNull(), both)


def list_clean(col: Column, only: str | None = None, drop: Sequence[str] = ("-", ""), suffix: str | None = None) -> Column:
    """B9.  The distinct elements of a delimited cell (``;`` or ``,``): without placeholders, without a suffix pattern, only those
    that start with ``only``."""
    out = F.transform(F.split(col, "[;,]"), lambda x: F.trim(x))
    if suffix:
        out = F.transform(out, lambda x: F.regexp_replace(x, suffix, ""))
    out = F.filter(out, lambda x: ~x.isin(*drop))
    if only:
        out = F.filter(out, lambda x: x.startswith(only))
    return F.array_sort(F.array_distinct(out))


def second_smallest(col: Column) -> Column:
    """B10.  The second of the sorted values, or the only one."""
    values = F.array_sort(F.array_compact(F.transform(col, lambda x: x.try_cast("double"))))
    return F.when(F.size(values) > 1, F.get(values, F.lit(1))).otherwise(F.get(values, F.lit(0)))


def normalize_nulls(df: DataFrame, columns: Sequence[str], tokens: Sequence[str] = ("", "-", "NaN", "NA")) -> DataFrame:
    """B11.  The tokens, and NaN in numeric columns, become null."""
    kinds = dict(df.dtypes)
    nan = lambda c: F.when(~F.isnan(c), F.col(c))
    return df.withColumns({c: nan(c) if kinds[c] in ("double", "float") else F.when(~F.col(c).isin(*tokens), F.col(c)) for c in columns})


def drop_all_null_columns(df: DataFrame) -> DataFrame:
    """B11.  Without columns that have no value; one aggregation over all of them."""
    n = df.agg(*[F.count(c).alias(c) for c in df.columns]).first()
    return df.select(*[c for c in df.columns if n[c]])


def explode_terms(df: DataFrame, terms: str, evidence: str, default: str = "IEA") -> DataFrame:
    """B12.  A row for each term with its evidence code (before the colon); what is missing gets the default."""
    out = df.select("*", F.posexplode(terms).alias("_at", "term"))
    code = F.regexp_extract(F.get(F.col(evidence), F.col("_at")), "^([^:]*)", 1)
    return out.withColumn("code", F.coalesce(F.nullif(code, F.lit("")), F.lit(default))).drop("_at").distinct()


def list_counts(col: Column) -> dict[str, Column]:
    """B14.  Elements, distinct cleaned elements, and the length of the longest."""
    clean = F.transform(col, lambda x: clean_sequence(x))
    return {"n": F.size(col), "n_distinct": F.size(F.array_distinct(clean)), "longest": F.array_max(F.transform(clean, F.length))}


def monoisotopic_mass(seq: Column) -> Column:
    """B15.  Residue masses plus water; null if a residue is unknown."""
    masses = F.create_map(*[F.lit(x) for pair in RESIDUE_MASS.items() for x in pair])
    return F.aggregate(F.transform(F.split(seq, ""), lambda x: F.element_at(masses, x)), F.lit(WATER), lambda a, x: a + x)


def resolve_ambiguous(seq: Column, key: Column) -> Column:
    """B16.  Without X and U; B, Z and J become one of their two residues, drawn by the key's hash once a sequence."""
    pick = lambda n: F.pmod(F.xxhash64(key, F.lit(n)), F.lit(2)) == 0
    out = F.translate(seq, "XU", "")
    for n, (letter, a, b) in enumerate((("B", "N", "D"), ("Z", "Q", "E"), ("J", "L", "I"))):
        out = F.when(pick(n), F.translate(out, letter, a)).otherwise(F.translate(out, letter, b))
    return out


def rewrite(col: Column, pairs: Mapping[str, str]) -> Column:
    """B18, B26.  Literal substitutions, in order."""
    for old, new in pairs.items():
        col = F.replace(col, F.lit(old), F.lit(new))
    return col


def insert_masses(seq: Column, mods: Column) -> Column:
    """B18.  ``[mass]`` behind the residues that an array of ``(location, mass)`` names (1-based)."""
    own = lambda i: F.filter(mods, lambda m: m["location"] == i + 1)
    return F.array_join(F.transform(F.split(seq, ""), lambda x, i: F.concat(x, F.array_join(F.transform(own(i), lambda m: F.concat(F.lit("["), m["mass"].cast("string"), F.lit("]"))), ""))), "")


def flanked(seq: Column, pre: Column | str = "-", post: Column | str = "-") -> Column:
    """B18.  ``pre.SEQ.post``."""
    side = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.concat(side(pre), F.lit("."), seq, F.lit("."), side(post))


def kmer_hashes(chars: str, k: int | Column) -> Column:
    """Hashes of all runs of k elements of an array column, in order; of the whole array where it is shorter.

    Characters are taken from an array (``split(text, "")``): a substring would be looked for from the text's start each time.
    """
    starts = F.sequence(F.lit(1), F.greatest(F.size(chars) - k + 1, F.lit(1)))
    return F.transform(starts, lambda i: F.xxhash64(F.slice(chars, i, k)))


def piece_hashes(pieces: str, k: int) -> Column:
    """What ``kmer_hashes`` gives, of an array column of pieces of one length (k at least; the last may be shorter) that make up a text: hashes of all its
    substrings of k characters.  A substring is looked for within a piece and what follows it, not from the text's start."""
    rest = F.zip_with(pieces, F.slice(pieces, 2, F.greatest(F.size(pieces), F.lit(1))), lambda c, n: F.concat(c, F.coalesce(F.substring(n, 1, k - 1), F.lit(""))))
    at = lambda c: F.transform(F.sequence(F.lit(1), F.length(c) - k + 1), lambda i: F.xxhash64(F.substring(c, i, F.lit(k))))
    made = F.flatten(F.transform(rest, lambda c: F.when(F.length(c) >= k, at(c)).otherwise(F.array().cast("array<bigint>"))))
    short = F.coalesce(F.size(pieces), F.lit(0)) < 2
    return F.when(short & (F.coalesce(F.length(F.get(pieces, F.lit(0))), F.lit(0)) < k), F.array(F.xxhash64(F.get(pieces, F.lit(0))))).otherwise(made)


def first_substitution(col: Column, pairs: Sequence[tuple[str, str]]) -> Column:
    """B26.  Only the first pattern that matches is replaced."""
    out = None
    for pattern, new in pairs:
        hit = F.regexp_replace(col, pattern, new)
        out = F.when(col.rlike(pattern), hit) if out is None else out.when(col.rlike(pattern), hit)
    return col if out is None else out.otherwise(col)


def map_list(col: Column, names: Mapping[str, str], sep: str = r"\|") -> Column:
    """B21.  Each element of a delimited cell looked up; unknown ones stay."""
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.array_join(F.transform(F.split(col, sep), lambda x: F.coalesce(F.element_at(table, x), x)), "|")


def null_if_contained(a: Column, b: Column) -> Column:
    """B22."""
    return F.when(~F.coalesce(F.contains(b, a), F.lit(False)), a)


def row_mean(*cols: Column) -> Column:
    """B23, D8.  The mean of the values that are there; infinities count as missing."""
    there = F.filter(F.array(*[c.cast("double") for c in cols]), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.when(F.size(there) > 0, F.aggregate(there, F.lit(0.0), lambda a, x: a + x) / F.size(there))


def list_median(values: Column) -> Column:
    """B23.  The median of an array's values, nulls left out."""
    s = F.array_sort(F.array_compact(values))
    n = F.size(s)
    middle = lambda i: F.get(s, i.cast("int"))
    return (middle(F.floor((n - 1) / 2)) + middle(F.floor(n / 2))) / 2


def row_median(*cols: Column) -> Column:
    return list_median(F.array(*[c.cast("double") for c in cols]))


def log2_or_null(col: Column) -> Column:
    """B24.  Null at 0 and below."""
    return F.when(col > 0, F.log2(col))


def neg_log_capped(p: Column, cap: float) -> Column:
    """B24.  -ln p, at most ``cap``."""
    return F.when(p > 0, F.least(-F.log(p), F.lit(cap))).otherwise(F.when(p == 0, F.lit(cap)))


def assign_ranges(df: DataFrame, col: str, ranges: Sequence[tuple[float, float]], half_open: bool = False) -> DataFrame:
    """B25.  A row for each range that holds the value; inclusive at both ends unless half open."""
    c = F.col(col)
    hits = [F.when((c >= a) & ((c < b) if half_open else (c <= b)), F.struct(F.lit(a).alias("low"), F.lit(b).alias("high"))) for a, b in ranges]
    return df.withColumn("_r", F.explode(F.array_compact(F.array(*hits)))).select(*df.columns, "_r.low", "_r.high")


def layout(df: DataFrame, first: Sequence[str], renames: Mapping[str, str]) -> DataFrame:
    """B27.  Renames the columns that are there and moves some to the front."""
    df = df.withColumnsRenamed({a: b for a, b in renames.items() if a in df.columns})
    return df.select(*[c for c in first if c in df.columns], *[c for c in df.columns if c not in first])


def charge_one_hots(charge: Column, charges: Sequence[int] = (1, 2, 3, 4, 5)) -> dict[str, Column]:
    """B17.  A 0/1 column for each charge."""
    return {f"charge{k}": (charge == k).cast("int") for k in charges}


def tryptic_flags(flanked: Column) -> dict[str, Column]:
    """B17.  Of ``K.PEPTIDE.R``: does a cut after K or R, but not before P, explain either end; K and R in all."""
    return {
        "enz_n": flanked.rlike(r"^([KR]\.[^P]|-)").cast("int"),
        "enz_c": flanked.rlike(r"[KR](\[[^\]]*\])?\.[^P]$|-$").cast("int"),
        "n_kr": F.length(F.regexp_replace(F.upper(flanked), "[^KR]", "")),
    }


def aligned_span(col: Column) -> dict[str, Column]:
    """G8.  First and last letter's place (1-based) and the text between them."""
    text = F.regexp_extract(col, r"([A-Za-z].*[A-Za-z]|[A-Za-z])", 1)
    start = F.regexp_instr(col, F.lit("[A-Za-z]"))
    return {"span_start": start, "span_end": F.when(start > 0, start + F.length(text) - 1).otherwise(0), "span_text": text}
