"""What the operators of this subpackage share: tables, staged results and word rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.scratch import settled

#: Runs of characters other than ASCII white space.
SPACES = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again: lineage ends there and lost executors cost nothing."""
    return settled(df, name)


#: Stands for a null id within Python, where a column with nulls would turn into floating point and lose digits.
NO_ID = -(2**63)


def id_in(col: Column) -> Column:
    return F.coalesce(col.cast("long"), F.lit(NO_ID))


def id_out(col: Column) -> Column:
    return F.when(col != NO_ID, col)


def words(text: Column) -> Column:
    """The array of a text's words; empty for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def fenced(df: DataFrame) -> DataFrame:
    """The same rows behind a generator, so that filters above don't move below and repeat costly columns inside themselves."""
    return df.select(F.inline(F.array(F.struct(*[F.col(f"`{c}`") for c in df.columns]))))


#: Bits of the numbers in a bitmap, which has 2^26 bits = 8 MB whatever is marked in it.
BITS = 26


def bitmap(df: DataFrame, at: Column) -> bytes:
    """A map with the bits at the low BITS bits of ``at`` set, for tasks to leave out what surely isn't in ``df`` before an exact join.

    It is made by aggregation; 2^(BITS - 15) rows of 4 KB at most reach the driver.
    """
    at = (at.bitwiseAND(F.lit((1 << BITS) - 1)) + 1).alias("at")  # buckets of 2^15 begin with the number 1
    made = df.select(at).groupBy(F.call_function("bitmap_bucket_number", F.col("at")).alias("bucket"))
    made = made.agg(F.call_function("bitmap_construct_agg", F.call_function("bitmap_bit_position", F.col("at"))).alias("bits"))
    out = bytearray(1 << (BITS - 3))
    for r in made.collect():
        out[(r["bucket"] - 1) * 4096 : r["bucket"] * 4096] = r["bits"]
    return bytes(out)
