"""License scans: MinHash bands over overlapping text windows retrieve notices, exact shingle containment confirms them.

A text's words (runs of letters and digits, lowered) give five-word shingles.  A notice of m shingles is cut into
segments at every length of SCALES up to m, one every half length and one at its end; a text is covered
by windows of the same lengths, one every quarter, so that a copy of a segment meets a window that shares seven eighths
of either.  At that, 0.78 similar, 24 bands of two rows meet with a probability of 1 - 2e-10; at 0.5, of 0.999; a piece that is
the same surely meets.  A window that meets a segment proposes the notice, and a text that holds 80 % of its distinct shingles,
wherever in the text, counted exactly, is a match.  As segments go down to two shingles, what is cut into pieces by foreign words is proposed
too, unless no two of its shingles stand side by side.  DataFrame functions only.

Texts that hold no shingle of any notice can't match; they are left out before windows are made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.llm.common import fenced, staged
from evidentia.llm.license_templates import TEMPLATES

SHINGLE = 5
SCALES = (1, 2, 4, 8, 16, 32, 64)
BANDS, ROWS = 24, 2
CONTAINED = 80  # percent


def tokens(text: Column) -> Column:
    """The words of a text, lowered."""
    return F.array_remove(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def _hashed(tokens: str) -> Column:
    """The hashes of the five-word shingles, in order; empty where there are fewer words."""
    each = F.transform(F.sequence(F.lit(0), F.size(tokens) - SHINGLE), lambda i: F.xxhash64(*[F.get(tokens, i + j) for j in range(SHINGLE)]))
    return F.when(F.size(tokens) >= SHINGLE, each).otherwise(F.array().cast("array<long>"))


def _bands(part: str) -> Column:
    """One key for each band of ROWS coordinates; a coordinate is the least of its hashes over the part's shingles."""
    drawn = lambda k: lambda x: F.xxhash64(x, F.lit(k))
    least = [F.array_min(F.transform(part, drawn(k))) for k in range(BANDS * ROWS)]
    return F.array(*[F.xxhash64(F.lit(b), *least[b * ROWS : (b + 1) * ROWS]) for b in range(BANDS)])


def _cut(df: DataFrame, scale: int, step: int) -> DataFrame:
    """Windows of ``scale`` of the shingles ``sh``, one every ``step`` and one at the end."""
    last = F.size("sh") - scale
    starts = F.array_distinct(F.concat(F.sequence(F.lit(0), last, F.lit(step)), F.array(last)))
    cut = df.filter(F.size("sh") >= scale).withColumn("start", F.explode(starts))
    return cut.withColumn("part", F.slice("sh", F.col("start") + 1, scale)).withColumn("scale", F.lit(scale))


def notices(spark: SparkSession, templates: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """``(license, notice, sh)``: a row for each notice; their number is that of the fixed list."""
    rows = [(name, i, text) for name, texts in (templates or TEMPLATES).items() for i, text in enumerate(texts)]
    listed = F.array(*[F.struct(F.lit(a).alias("license"), F.lit(i).alias("notice"), F.lit(t).alias("text")) for a, i, t in rows])
    made = spark.range(1).select(F.inline(listed)).withColumn("tokens", tokens(F.col("text")))
    return fenced(made.select("license", "notice", F.array_distinct(_hashed("tokens")).alias("sh"))).filter("size(sh) > 0")


def scan(docs: DataFrame, templates: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """``(doc_id, license, notice, n_shared, n_notice, containment, at_word)``: a row for each notice a document holds.

    ``n_shared`` counts the notice's distinct shingles that are anywhere in the text, and ``at_word`` is the place among its words
    of the first of them.  Windows retrieve what is alike; texts that hold a notice torn apart are found by counting.  Null, empty and short
    texts match nothing; rows equal in doc_id and text give one row for each notice, not one each.  Rows without doc_id are told
    apart by their texts.  Other columns are ignored.
    """
    known = staged(notices(docs.sparkSession, templates), "notices")
    # the fixed list's shingles, some thousand numbers
    listed = sorted({x for r in known.select("sh").collect() for x in r["sh"]})
    some = F.array(*[F.lit(x) for x in listed]).cast("array<long>")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("version"), tokens(F.col("text")).alias("tokens"))
    texts = fenced(texts.select("doc_id", "version", _hashed("tokens").alias("sh")))
    # which of the listed shingles a text holds is told once; windows are then looked at for these few
    held = staged(texts.filter(F.arrays_overlap("sh", some)).withColumn("mine", F.array_intersect("sh", some)), "held")

    found = None
    for scale in SCALES:
        own = known.filter(F.size("sh") == 1 if scale == 1 else F.size("sh") >= scale)
        segments = fenced(_cut(own, scale, max(1, scale // 2)).select("license", "notice", "scale", "part")).select("license", "notice", "scale", F.explode(_bands("part")).alias("band"))
        windows = fenced(_cut(held, scale, max(1, scale // 4)).select("doc_id", "version", "scale", "start", "part", "mine")).filter(F.arrays_overlap("part", "mine"))
        windows = windows.select("doc_id", "version", "scale", "start", F.explode(_bands("part")).alias("band"))
        met = windows.join(F.broadcast(segments), ["scale", "band"]).select("doc_id", "version", "license", "notice", "scale", "start").distinct()
        found = met if found is None else found.unionByName(met)
    # what windows can't see, as shingles that never stand two in a row: texts' own shares of the listed shingles, counted
    each = known.select("license", "notice", F.size("sh").alias("n"), F.explode("sh").alias("x"))
    rest = held.dropDuplicates(["doc_id", "version"]).select("doc_id", "version", F.explode("mine").alias("x")).join(F.broadcast(each), "x")  # the fixed list
    rest = rest.groupBy("doc_id", "version", "license", "notice", "n").agg(F.count("*").alias("k")).filter(100 * F.col("k") >= CONTAINED * F.col("n"))
    proposed = staged(found.unionByName(rest, allowMissingColumns=True).select("doc_id", "version", "license", "notice").distinct(), "proposed")
    same = F.col("d.doc_id").eqNullSafe(F.col("p.doc_id")) & (F.col("d.version") == F.col("p.version"))
    pairs = held.drop("mine").dropDuplicates(["doc_id", "version"]).alias("d").join(proposed.alias("p"), same).join(F.broadcast(known.withColumnRenamed("sh", "wanted")), ["license", "notice"])
    counted = fenced(pairs.select(F.col("d.doc_id").alias("doc_id"), "license", "notice", "d.sh", F.size("wanted").cast("long").alias("n_notice"), F.array_intersect("d.sh", "wanted").alias("shared")))
    matches = counted.filter(100 * F.size("shared") >= CONTAINED * F.col("n_notice"))
    first = F.array_min(F.transform("shared", lambda x: F.array_position("sh", x))) - 1
    n_shared = F.size("shared").cast("long")
    return matches.select("doc_id", "license", "notice", n_shared.alias("n_shared"), "n_notice", (n_shared / F.col("n_notice")).alias("containment"), first.cast("long").alias("at_word"))
