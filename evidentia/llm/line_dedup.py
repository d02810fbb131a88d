"""Line dedup: windows of three consecutive lines that occurred before, anywhere in the corpus, are removed.

Lines are compared without white space at their ends, and blank lines are passed over.  Every window of three lines is
hashed (128 bits); per hash, the first occurrence by (doc_id, text hash, place) stands.  The places of all later
occurrences come back to their document, are merged into covered lines, and those lines go.  So that a long passage goes too
where its neighbours differ, lines of more than LONG words are windows of their own, and so are two shorter ones that
have more together.  A passage that repeats within a text is reduced to what its later windows don't cover: of ``a a a a z``
stay ``a`` and ``z``.  DataFrame functions only:
a frequent passage is combined before the shuffle when firsts are looked for, and its occurrences meet the first one in
a join of two exchanged sides, which adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.llm.common import SPACES, staged

BLANK = " \t\x0b\x0c\r"
WINDOW = 3
LONG = 50


def _solid(text: Column) -> Column:
    """The lines that aren't blank, as (at, line): place among all lines, and text without white space at its ends."""
    lines = F.transform(F.split(text, "\n"), lambda x, i: F.struct(i.alias("at"), F.btrim(x, F.lit(BLANK)).alias("line")))
    return F.filter(lines, lambda x: x["line"] != "")


def _own(doc_id: Column, text: Column) -> list[Column]:
    return [doc_id.alias("doc_id"), F.xxhash64(text).alias("version")]


def windows(docs: DataFrame) -> DataFrame:
    """``(h1, h2, doc_id, version, pos, n)`` for each window of n lines; pos counts the lines that aren't blank."""
    counted = F.transform(_solid(F.col("text").cast("string")), lambda x: F.struct(x["line"].alias("line"), F.size(F.split(x["line"], SPACES)).alias("words")))
    solid = docs.select(*_own(F.col("doc_id"), F.col("text")), counted.alias("solid")).filter(F.size("solid") > 0)
    at = lambda i, j: F.get("solid", i + j)

    def window(i: Column, n: int) -> Column:
        lines = [at(i, j)["line"] for j in range(n)]
        return F.struct(F.xxhash64(*lines).alias("h1"), F.xxhash64(F.lit(n), *lines[-1:], *lines[:-1]).alias("h2"), i.alias("pos"), F.lit(n).alias("n"))

    def all_at(i: Column) -> Column:
        one, two = at(i, 0)["words"], at(i, 1)["words"]
        three = F.when(at(i, WINDOW - 1).isNotNull(), window(i, WINDOW))
        return F.array(three, F.when(one > LONG, window(i, 1)), F.when((one <= LONG) & (two <= LONG) & (one + two > LONG), window(i, 2)))

    found = F.flatten(F.transform(F.sequence(F.lit(0), F.size("solid") - 1), all_at))
    found = solid.select("doc_id", "version", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("w"))
    return found.select("w.h1", "w.h2", "doc_id", "version", "w.pos", "w.n")


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text, ...)`` with each text rid of repeated passages, plus ``n_lines`` and ``n_removed_lines``.

    n_lines counts the lines that aren't blank.  Blank lines stay, and a text that loses nothing is unchanged.  Texts
    null or empty have no window and lose nothing.  Rows equal in doc_id and text are one document and share one result,
    so none of them is a later occurrence of another; rows without doc_id come first in the order of occurrences.  Other columns are passed on,
    save that n_lines and n_removed_lines are replaced if the table already has them.
    """
    found = windows(docs)
    place = F.struct("doc_id", "version", "pos")
    first = staged(found.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count("*").alias("times")).filter("times > 1").drop("times"), "first")
    later = found.join(first, ["h1", "h2"]).filter(place > F.col("first"))
    covered = staged(
        later.groupBy("doc_id", "version").agg(F.collect_set(F.struct("pos", "n")).alias("starts")).select(F.col("doc_id").alias("c_id"), F.col("version").alias("c_version"), "starts"),
        "covered",
    )
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("doc"), *_own(docs["doc_id"], docs["text"]))
    # the texts move to what is removed from them at every size, so that a plan seen on little data is the one that runs on much
    rows = rows.join(covered.hint("merge"), F.col("doc_id").eqNullSafe(F.col("c_id")) & (F.col("version") == F.col("c_version")), "left")
    rows = rows.withColumn("solid", _solid(F.col("doc.text").cast("string"))).withColumn(
        "gone",
        F.array_distinct(F.flatten(F.transform("starts", lambda p: F.sequence(p["pos"], p["pos"] + p["n"] - 1)))),
    )
    lines = rows.withColumn("lines", F.when(F.col("gone").isNotNull(), F.split(F.col("doc.text").cast("string"), "\n"))).withColumn(
        "drop", F.transform("gone", lambda g: F.get("solid", g)["at"])
    )
    left = lines.withColumn("left", F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("drop")))
    text = F.when(F.col("gone").isNull(), F.col("doc.text")).otherwise(F.array_join(F.transform("left", lambda i: F.get("lines", i)), "\n"))
    keep = [F.col(f"doc.`{c}`").alias(c) if c != "text" else text.alias("text") for c in docs.columns if c not in ("n_lines", "n_removed_lines")]
    return left.select(
        *keep,
        F.coalesce(F.size("solid"), F.lit(0)).cast("long").alias("n_lines"),
        F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_removed_lines"),
    )
