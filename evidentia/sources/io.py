"""Scans and sinks (A*).  All of them read and write through Spark, so paths may be in any store it knows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.operators.aggregate import assign_ids, dealt_by_range, scan


def read_table(spark: SparkSession, path: str, schema: str, sep: str = "\t", null: str = "NA") -> DataFrame:
    """A1."""
    return spark.read.csv(path, schema=schema, sep=sep, header=True, nullValue=null)


def write_table(df: DataFrame, path: str, sep: str = "\t", null: str = "NA") -> None:
    """A1."""
    df.write.csv(path, sep=sep, header=True, nullValue=null)


def read_many(spark: SparkSession, paths: str | Sequence[str], schema: str, source: str, sep: str = "\t") -> DataFrame:
    """A2.  Files of one schema; the source's name comes from the file's path by a pattern of one group."""
    df = spark.read.csv(paths, schema=schema, sep=sep, header=True, nullValue="NA")
    return df.withColumn("source", F.regexp_extract(F.col("_metadata.file_path"), source, 1))


def combine_taxa(spark: SparkSession, paths: str | Sequence[str], schema: str, id_col: str, keep: Column | None = None, pattern: str = r"([^/]+)\.tsv$", sep: str = "\t") -> DataFrame:
    """H4.  Tables of many taxa stacked: the taxon from the file's name, also behind each id; rows by a condition."""
    every = read_many(spark, paths, schema, pattern, sep).withColumnRenamed("source", "taxon")
    kept = every if keep is None else every.filter(keep)
    return kept.withColumn(id_col, F.concat_ws("-", F.col(id_col).cast("string"), "taxon"))


def read_ragged(spark: SparkSession, path: str, fixed: Sequence[str], tail: str, sep: str = "\t") -> DataFrame:
    """A3.  The first fields by name, all that follow as one list; the header line is left out."""
    parts = spark.read.text(path).select(F.split("value", sep).alias("f")).filter(F.get("f", F.lit(0)) != fixed[0])
    n = len(fixed)
    rest = F.when(F.size("f") > n, F.slice("f", n + 1, F.greatest(F.size("f") - n, F.lit(1)))).otherwise(F.array().cast("array<string>"))
    return parts.select(*[F.get("f", F.lit(i)).alias(c) for i, c in enumerate(fixed)], rest.alias(tail))


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """A4.  ``(id, description, seq)``.  A record starts with ``>`` at the start of a line."""
    records = spark.read.text(path, lineSep="\n>").select(F.regexp_replace("value", "^>", "").alias("value")).filter(F.trim("value") != "")
    lines = F.split(F.regexp_replace("value", "\r", ""), "\n")
    header = F.get(lines, F.lit(0))
    return records.select(
        F.regexp_extract(header, r"^(\S*)", 1).alias("id"),
        F.trim(F.regexp_extract(header, r"^\S*\s*(.*)$", 1)).alias("description"),
        F.array_join(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(1))), "").alias("seq"),
    )


def write_fasta(df: DataFrame, path: str, id_col: str, seq: str, suffix: str = "") -> None:
    """A4.  One record for each id."""
    one = df.groupBy(id_col).agg(F.min(seq).alias("_s"))
    one.select(F.concat(F.lit(">"), F.col(id_col).cast("string"), F.lit(suffix), F.lit("\n"), F.col("_s"))).write.text(path)


def read_external2go(spark: SparkSession, path: str) -> DataFrame:
    """A5.  ``(accession, name, GO)``: lines ``db:accession name > GO:term ; GO:id``; comments left out."""
    lines = spark.read.text(path).filter(~F.col("value").startswith("!"))
    left = F.trim(F.get(F.split("value", ">"), F.lit(0)))
    one = lines.select(
        F.regexp_extract(left, r"^[^:\s]+:(\S+)", 1).alias("accession"),
        F.coalesce(F.nullif(F.regexp_extract(left, r"^\S+\s+(\S+)", 1), F.lit("")), F.lit("NA")).alias("name"),
        F.regexp_extract("value", r"(GO:\d+)\s*$", 1).alias("go"),
    )
    return one.filter("go <> ''").groupBy("accession", "name").agg(F.array_sort(F.collect_set("go")).alias("GO"))


def read_obo(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A6.  ``edges(child, parent, relation)`` and ``terms(id, name, namespace, obsolete)``; stanzas of other kinds are left out."""
    stanza = spark.read.text(path, lineSep="\n[").filter(F.col("value").rlike(r"^\[?Term\]") & F.col("value").rlike(r"(?m)^id: "))
    get = lambda tag: F.regexp_extract("value", rf"(?m)^{tag}: (.*)$", 1)
    terms = stanza.select(get("id").alias("id"), get("name").alias("name"), get("namespace").alias("namespace"), (get("is_obsolete") == "true").alias("obsolete"))
    is_a = stanza.select(get("id").alias("child"), F.explode(F.regexp_extract_all("value", F.lit(r"(?m)^is_a: (\S+)"), F.lit(1))).alias("parent"), F.lit("is_a").alias("relation"))
    pairs = F.regexp_extract_all("value", F.lit(r"(?m)^relationship: (\S+ \S+)"), F.lit(1))
    other = stanza.select(get("id").alias("child"), F.explode(pairs).alias("_p")).select("child", F.split("_p", " ")[1].alias("parent"), F.split("_p", " ")[0].alias("relation"))
    return is_a.unionByName(other), terms


def flatten_xrefs(df: DataFrame, json_col: str, databases: Sequence[str]) -> DataFrame:
    """A7.  A delimited cell for each database (``id_property``; InterPro and KEGG ids alone) and GO evidence codes."""
    schema = "STRUCT<uniProtKBCrossReferences: ARRAY<STRUCT<database: STRING, id: STRING, properties: ARRAY<STRUCT<value: STRING>>>>>"
    made = df.withColumn("_x", F.from_json(json_col, schema)["uniProtKBCrossReferences"])

    def cell(db: str):
        own = F.filter("_x", lambda x: x["database"] == db)
        prop = lambda x: F.get(x["properties"], F.lit(0))["value"]
        text = F.transform(own, lambda x: x["id"] if db in ("InterPro", "KEGG") else F.concat_ws("_", x["id"], prop(x)))
        return F.nullif(F.array_join(text, ";"), F.lit("")).alias(db)

    evidence = F.array_join(F.transform(F.filter("_x", lambda x: x["database"] == "GO"), lambda x: F.get(x["properties"], F.lit(1))["value"]), ";")
    return made.select(*[c for c in df.columns if c != json_col], *[cell(d) for d in databases], F.nullif(evidence, F.lit("")).alias("GO_evidence"))


def read_after_marker(spark: SparkSession, path: str, markers: Sequence[str], columns: Sequence[str], sep: str = "\t") -> DataFrame:
    """A8.  Rows behind the first line of their file whose first field is a marker; comment lines are left out.

    Lines know their file, their block of it and their order there, so what a file's marker line comes before is told without
    reading the file in one piece.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"), F.struct(F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("n")).alias("_at"))
    lines = lines.withColumn("f", F.split("value", sep))
    begins = lines.filter(F.get("f", F.lit(0)).isin(*markers)).groupBy("_file").agg(F.min("_at").alias("_from"))
    rows = lines.join(begins, "_file").filter((F.col("_at") > F.col("_from")) & ~F.col("value").startswith("##") & (F.trim("value") != ""))
    return rows.select(*[F.get("f", F.lit(i)).alias(c) for i, c in enumerate(columns)])


def read_manifest(spark: SparkSession, path: str, kinds: Mapping[str, str]) -> DataFrame:
    """A9.  ``(Prefix, kind, path)`` in long form; a path's kind is the first pattern that it matches."""
    wide = spark.read.csv(path, sep="\t", header=True)
    long = wide.unpivot(["Prefix"], [c for c in wide.columns if c != "Prefix"], "column", "path").filter("path is not null")
    kind = None
    for name, pattern in kinds.items():
        kind = F.when(F.col("path").rlike(pattern), name) if kind is None else kind.when(F.col("path").rlike(pattern), name)
    return long.select("Prefix", kind.alias("kind"), "path")


def read_gff(spark: SparkSession, path: str) -> DataFrame:
    """A10."""
    schema = "seqid string, source string, type string, start int, end int, score string, strand string, phase string, attributes string"
    return spark.read.csv(path, sep="\t", comment="#", schema=schema)


def read_groups(spark: SparkSession, path: str, known: DataFrame | None = None, lines: bool = False) -> DataFrame:
    """A11.  ``(group, member)`` from a JSON object of lists a file, or of one object a line (``lines``), restricted to known members where given.

    A file's object may be of any size, and so may its lists: it is read in pieces between commas.  Running sums of the quotes before a piece
    tell which commas stand within strings; the pieces of such a string are put together again, and a piece belongs to the last group named
    before it.  Members are strings or numbers; groups without members have no row, and of groups named twice all members count.
    """
    pairs = _pairs_of_lines(spark, path) if lines else _pairs_of_objects(spark, path)
    return pairs if known is None else pairs.join(known.select("member"), "member", "left_semi").select("group", "member")


def _pairs_of_lines(spark: SparkSession, path: str) -> DataFrame:
    each = spark.read.text(path).select(F.from_json("value", "map<string,array<string>>").alias("m"))
    return each.select(F.explode("m").alias("group", "members")).select("group", F.explode("members").alias("member"))


def _pairs_of_objects(spark: SparkSession, path: str) -> DataFrame:
    at = F.struct(F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("n"))
    pieces = spark.read.text(path, lineSep=",").select(F.col("_metadata.file_path").alias("_file"), at.alias("_place"), F.col("value").alias("_piece"))
    plain = F.regexp_replace("_piece", r"\\.", "")  # without escaped quotes
    pieces = dealt_by_range(pieces.withColumn("_quotes", F.length(plain) - F.length(F.replace(plain, F.lit('"')))), ["_file", "_place"])
    before = {"_before": ("sum", F.col("_quotes").cast("long"))}
    begins = {"_token": ("sum", (F.coalesce("_before", F.lit(0)) % 2 == 0).cast("long"))}
    cut = scan(pieces, ["_file"], ["_place"], before, begins, before=["_before"])
    tokens = cut.groupBy("_file", "_token").agg(F.array_sort(F.collect_list(F.struct("_place", "_piece"))).alias("_all"))
    text = F.array_join(F.transform("_all", lambda p: p["_piece"]), ",")
    name, one = r'("(?:[^"\\]|\\.)*")\s*:', r'("(?:[^"\\]|\\.)*"|[-+.0-9A-Za-z]+)'
    parts = tokens.select("_file", "_token", F.regexp_extract(text, name, 1).alias("_name"), F.regexp_extract(text, rf"^(?:[\s{{\]]*{name})?[\s\[]*{one}[\s\]}}]*$", 2).alias("_member"))
    read = lambda c: F.from_json(F.concat(F.lit('{"v":'), c, F.lit("}")), "v string")["v"]
    named = parts.select("_file", "_token", F.when(F.col("_name") != "", F.struct("_token", read(F.col("_name")).alias("v"))).alias("_name"), F.when(F.col("_member") != "", read(F.col("_member"))).alias("member"))
    owned = scan(dealt_by_range(named, ["_file", "_token"]), ["_file"], ["_token"], {"_last": ("max", F.col("_name"))})
    return owned.filter(F.col("member").isNotNull() & F.col("_last").isNotNull()).select(F.col("_last.v").alias("group"), "member")


def read_embeddings(spark: SparkSession, path: str, ids: DataFrame, id_col: str) -> DataFrame:
    """A12.  Vectors of the given ids."""
    return spark.read.parquet(path).join(ids.select(id_col), id_col, "left_semi")


def denovo_to_peptides(df: DataFrame, col: str, name: str, least: int = 0) -> DataFrame:
    """A13.  Upper-case residues of each sequence, unknown-token rows left out, ids ``<name><n>-DENOVO``."""
    clean = df.filter(~F.col(col).rlike("<s>|<unk>")).select(F.regexp_replace(col, "[^A-Z]", "").alias("seq")).filter(F.length("seq") >= max(1, least)).distinct()
    return assign_ids(clean, name, ["seq"], "id").withColumn("id", F.concat("id", F.lit("-DENOVO")))
