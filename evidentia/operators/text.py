"""Words of groups (L*)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evidentia.functions.scalars import first_match
from evidentia.operators.aggregate import quantiles

# Words of term names that are written short.
ABBREVIATIONS = {
    "localization": "loc.", "organization": "org.", "establishment": "est.", "processing": "prcs.", "biological": "biol.", "intracellular": "intr.", "activity": "act.",
    "extracellular": "extr.", "developmental|development": "dev.", "metabolic process": "m.p.", "proliferation": "prol.", "response": "resp.", "migration": "mig.",
    "maintenance": "main.", "signaling": "sign.", "regulation": "reg.", "homeostasis": "hom.", "differentiation": "diff.",
}

# Sub-tables of processes by what their names hold, the types in them by the first pattern that matches, and the type of the rest.
CLOUDS = {
    "regulation": ("regulation", [("positive", "positive"), ("negative", "negative")], "unspecified effect"),
    "process": ("^(?=.*process).*(biosynthetic|metabolic|catabolic)", [("catabolic", "catabolic"), ("anabolic", "biosynthetic")], "unspecified metabolism"),
}


def top_terms(df: DataFrame, key: str, text: Column, n: int, keywords: Sequence[str] = (), stop: Sequence[str] = (), least: int = 3) -> DataFrame:
    """L1.  The n most frequent words of each group; a text with a keyword counts as the first such keyword alone."""
    low = F.lower(text)
    words = F.split(F.regexp_replace(low, r"[^\p{L}\s]", ""), r"\s+")
    for k in reversed(keywords):
        words = F.when(F.contains(low, F.lit(k)), F.array(F.lit(k))).otherwise(words)
    each = df.select(key, F.explode(words).alias("term")).filter(F.length("term") >= least)
    if stop:
        each = each.filter(~F.col("term").isin(*stop))
    count = each.groupBy(key, "term").agg(F.count("*").alias("n"))
    ranked = count.withColumn("rank", F.row_number().over(W.partitionBy(key).orderBy(F.desc("n"), "term")))
    return ranked.filter(F.col("rank") <= n)


def term_cloud(terms: DataFrame, term: str, level: DataFrame, min_level: int, max_level: int, share: float = 0.8, n: int = 50) -> DataFrame:
    """L2.  Terms within a range of levels, at or above a percentile of frequency, the n most frequent."""
    count = terms.groupBy(term).agg(F.count("*").alias("n")).join(level.withColumnRenamed("node", term), term)
    count = count.filter(F.col("level").between(min_level, max_level))
    bar = quantiles(count, "n", {"_bar": share})
    return count.join(F.broadcast(bar)).filter("n >= _bar").drop("_bar").orderBy(F.desc("n"), term).limit(n)


def rolled_up(terms: DataFrame, term: str, generic: DataFrame) -> DataFrame:
    """L2.  Terms replaced by the generic term that ``generic(child, parent)`` names for them (the smallest, where it names several); others stay."""
    one = generic.groupBy(F.col("child").alias(term)).agg(F.min("parent").alias("_up"))
    return terms.join(one, term, "left").withColumn(term, F.coalesce("_up", term)).drop("_up")


def abbreviated(name: Column, words: Mapping[str, str] = ABBREVIATIONS) -> Column:
    """L2.  A name with whole words (patterns) written short, one after the other."""
    for long, short in words.items():
        name = F.regexp_replace(name, rf"\b(?:{long})\b", short)
    return name


def term_clouds(
    terms: DataFrame, term: str, info: DataFrame, level: DataFrame, min_level: int = 3, max_level: int = 7, namespace: str = "biological_process",
    clouds: Mapping[str, tuple[str, Sequence[tuple[str, str]], str]] = CLOUDS, words: Mapping[str, str] = ABBREVIATIONS, share: float = 0.8, n: int = 50,
) -> DataFrame:
    """L2.  ``(cloud, type, token, n, rank)``: the n most frequent names of each cloud, of those above its percentile of frequency.

    Terms of the levels given count, with names and namespaces from ``info(id, name, namespace)``.  A term of the namespace whose name matches a cloud's
    pattern is in that cloud, with the type of the first rule that its name matches; it may be in several.  All others are in ``main``, without
    a type.  Names are lower-cased in the clouds but not in ``main``; equal names count once, with the most frequent term; the names
    kept are abbreviated last.  Ties go to the smaller name.
    """
    count = terms.groupBy(term).agg(F.count("*").alias("n")).join(level.select(F.col("node").alias(term), "level"), term)
    count = count.filter(F.col("level").between(min_level, max_level)).join(info.select(F.col("id").alias(term), "name", "namespace"), term).filter(F.col("name").isNotNull())
    own = F.coalesce(F.col("namespace") == namespace, F.lit(False))
    inside = [F.when(own & F.col("name").rlike(p), F.struct(F.lit(c).alias("cloud"), first_match(F.col("name"), rules, rest).alias("type"))) for c, (p, rules, rest) in clouds.items()]
    at = F.filter(F.array(*inside), lambda x: x.isNotNull()) if inside else F.array()
    main = F.array(F.struct(F.lit("main").alias("cloud"), F.lit(None).cast("string").alias("type")))
    each = count.withColumn("_at", F.explode(F.when(F.size(at) > 0, at).otherwise(main) if inside else main)).select("_at.cloud", "_at.type", "name", "n")
    bars = each.groupBy("cloud").agg(F.percentile("n", share).alias("_bar"))  # partial counts of the frequencies; a row for each cloud
    token = F.when(F.col("cloud") == "main", F.col("name")).otherwise(F.lower("name"))
    kept = each.join(F.broadcast(bars), "cloud").filter("n > _bar").withColumn("token", token)
    kept = kept.groupBy("cloud", "token").agg(F.max(F.struct("n", "type")).alias("_b")).select("cloud", "_b.type", "token", "_b.n")
    ranked = kept.withColumn("rank", F.row_number().over(W.partitionBy("cloud").orderBy(F.desc("n"), "token"))).filter(F.col("rank") <= n)
    return ranked.select("cloud", "type", abbreviated(F.col("token"), words).alias("token"), "n", "rank")
