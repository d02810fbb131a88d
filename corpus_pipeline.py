"""From raw documents to token counts: quality rules, line dedup, near-duplicate removal, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; what it decides takes effect.
All but the last return the columns of ``documents``.  ``run`` writes every stage's result as Parquet in the shared
folder and reads it again, so that a lost executor costs a stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.llm.bpe import encode_documents
from evidentia.llm.common import fenced, staged, table
from evidentia.llm.line_dedup import dedup_lines
from evidentia.llm.mixing import mixed_documents
from evidentia.llm.near_dup import distinct_documents
from evidentia.llm.quality import judged, ledger


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the present policy keeps."""
    kept = fenced(judged(ledger(docs)).select("doc", "kept")).filter("kept")
    return kept.select(*[F.col(f"doc.`{c}`").alias(c) for c in docs.columns])


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without passages that occurred before; ``n_chars`` follows the text."""
    short = dedup_lines(docs)
    n_chars = [F.length("text").cast("long").alias("n_chars") if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns]
    return short.select(*n_chars)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicate texts (five-word shingles, 0.8)."""
    return distinct_documents(docs, k=5, num=80, den=100)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents as often as their sources' targets take them."""
    return mixed_documents(docs)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document of the mix."""
    return encode_documents(docs).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("bpe", bpe)]

#: SQL can't express byte-pair encoding; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
