"""Near-duplicate documents: fast similarity sketches, banding, exact verification, components.

1. Each text becomes its set of k-word shingles (64-bit hashes) and a sketch (``sketching.sketch``); texts with the same
   set form a class.
2. Classes that share a band of ``rows`` sketch coordinates are candidates.  With 56 bands of 7 rows a pair at a
   similarity of exactly 0.8 shares none with a probability of 2e-6, one at 0.85 with 4e-10.
3. Every member of a bucket is verified on full sets against the bucket's first, so a bucket of n gives n - 1 pairs, not
   n * n.  That settles buckets of two, and those whose members turn out connected, which are nearly all.
4. Members of the others get exact candidates: shingles are ordered from rare to frequent, and two sets that are
   similar enough share one of their first ``n - ceil(0.8 n) + 1``.  Boilerplate that many share comes last in that order,
   so texts that are alike in it alone never meet.  The same rule, each against its bucket's first, follows.
5. What even this leaves open (chains of texts, each alike only to some of its bucket) is dealt into blocks of 128 texts,
   and every pair of blocks of such a cluster is compared on full sets in a task of its own, which returns one link
   for each two components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm.common import BITS, NO_ID, bitmap, id_in, id_out, staged
from evidentia.llm.graph import connected_components
from evidentia.llm.sketching import WordHasher, band_keys, overlap, shingle_set, sketch

BLOCK = 128
SLOTS = 1 << 18  # counters of shingles
CLASS = ["h1", "h2", "n_shingles"]


def _prepared(k: int, rows: int, bands: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = WordHasher()
        for batch in batches:
            for at in range(0, len(batch), 256):  # a few documents at a time, so that long ones don't pile up
                part = batch.iloc[at : at + 256]
                sets = [shingle_set(x if isinstance(x, str) else None, k, hasher) for x in part["text"]]
                with np.errstate(over="ignore"):
                    sums = [(int(s.sum(dtype=np.uint64)), int(np.bitwise_xor.reduce(s)) if len(s) else 0) for s in sets]
                keys = band_keys(sketch(sets, rows * bands), rows)
                yield pd.DataFrame(
                    {
                        "doc_id": part["doc_id"].array,
                        "version": part["version"].array,
                        "n_shingles": [len(s) for s in sets],
                        "h1": np.array([a for a, _ in sums], np.uint64).view(np.int64),
                        "h2": np.array([b for _, b in sums], np.uint64).view(np.int64),
                        "bands": [x if len(s) else x[:0] for x, s in zip(keys, sets, strict=True)],
                    }
                )

    return run


def _sets(k: int, marked: Broadcast):
    """Sets of the rows whose ``at`` is marked."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher, bits = WordHasher(), np.frombuffer(marked.value, np.uint8)
        for batch in batches:
            at = batch["at"].to_numpy()
            batch = batch[(bits[at >> 3] >> (at & 7) & 1).astype(bool)]
            for at in range(0, len(batch), 256):
                part = batch.iloc[at : at + 256]
                yield part[["doc_id", "version"]].assign(shingles=[shingle_set(x, k, hasher).tobytes() for x in part["text"]])

    return run


def _linked(num: int, den: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ok = []
            for x, y in zip(batch["x"], batch["y"], strict=True):
                a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = overlap(a, b)
                ok.append(den * both >= num * (len(a) + len(b) - both))
            yield batch.loc[ok, ["a", "b"]]

    return run


def _between_blocks(num: int, den: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        _, i, j = key
        left, right = rows[rows["block"] == i], rows[rows["block"] == j]
        a = [np.frombuffer(x, np.uint64) for x in left["shingles"]]
        b = [np.frombuffer(x, np.uint64) for x in right["shingles"]]
        none = pd.DataFrame({"a": np.empty(0, np.int64), "b": np.empty(0, np.int64)})
        if not a or not b:
            return none
        shared = np.intersect1d(np.unique(np.concatenate(a)), np.unique(np.concatenate(b)), assume_unique=True)
        both = np.zeros((len(a), len(b)), np.float32)
        for at in range(0, len(shared), 8192):
            part = shared[at : at + 8192]
            x, y = (np.stack([np.isin(part, s, assume_unique=True) for s in side]).astype(np.float32) for side in (a, b))
            both += x @ y.T
        size = np.array([len(s) for s in a])[:, None] + np.array([len(s) for s in b])[None, :]
        la, lb = left["label"].to_numpy(), right["label"].to_numpy()
        links = (den * both >= num * (size - both)) & (la[:, None] != lb[None, :])
        u, v = np.nonzero(links)
        if not len(u):
            return none
        return pd.DataFrame({"a": la[u], "b": lb[v]}).drop_duplicates()

    return run


def _tallied(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counts = np.zeros(SLOTS, np.int64)
    for batch in batches:
        for x in batch["shingles"]:
            counts += np.bincount((np.frombuffer(x, np.uint64) % np.uint64(SLOTS)).astype(np.int64), minlength=SLOTS)
    yield pd.DataFrame({"slot": np.flatnonzero(counts), "n": counts[counts > 0]})


def _rarest(counts: np.ndarray, num: int, den: int):
    """The first shingles of each set, from rare to frequent, that a similar set must share one of."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i, x in zip(batch["id"], batch["shingles"], strict=True):
                own = np.frombuffer(x, np.uint64)
                first = own[np.lexsort((own, counts[(own % np.uint64(SLOTS)).astype(np.int64)]))][: len(own) - -(-num * len(own) // den) + 1]
                yield pd.DataFrame({"key": first.view(np.int64), "id": i, "n": len(own)})

    return run


def _members(entries: DataFrame) -> DataFrame:
    """The entries ``(key, id, n)`` of keys that several ids share, with the first id of the key and how many it has."""
    buckets = entries.groupBy("key").agg(F.min(F.struct("id", "n")).alias("low"), F.max("id").alias("high"), F.count("*").alias("size"))
    buckets = staged(buckets.filter("low.id <> high").drop("high"), "buckets")
    return staged(entries.join(buckets, "key").select("key", "id", "n", "low", "size"), "members")


def _against_first(members: DataFrame, num: int, den: int) -> DataFrame:
    near = members.filter(f"id <> low.id and {den} * least(n, low.n) >= {num} * greatest(n, low.n)")
    return staged(near.select(F.col("low.id").alias("a"), F.col("id").alias("b")).distinct(), "pairs")


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    sides = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a").join(
        sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b"
    )
    return staged(sides.mapInPandas(_linked(num, den), "a long, b long").distinct(), "links")


def _open_members(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members of the buckets of three and more that links leave in several components."""
    large = members.filter("size > 2")
    named = large.select("key", "id").join(labels, "id", "left")
    split = named.groupBy("key").agg(F.min(F.coalesce("label", "id")).alias("l"), F.max(F.coalesce("label", "id")).alias("h")).filter("l <> h")
    return staged(large.join(staged(split.select("key"), "split"), "key"), "open")


def _components(classes: DataFrame, texts: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """``(id, label)`` of the classes that link with another; label is the component's smallest id."""
    members = _members(classes.select(F.explode("bands").alias("key"), "id", F.col("n_shingles").alias("n")))
    pairs = _against_first(members, num, den)
    wanted = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).union(members.filter("size > 2").select("id")).distinct()
    wanted = staged(wanted.join(classes.select("id", "first.doc_id", "first.version"), "id"), "wanted")
    # texts stay where they lie: only sets of wanted rows, and of those that share a bit with one, are made and moved
    at = F.xxhash64("doc_id", "version").bitwiseAND(F.lit((1 << BITS) - 1))
    marked = texts.sparkSession.sparkContext.broadcast(bitmap(wanted, at))
    made = texts.withColumn("at", at).mapInPandas(_sets(k, marked), "doc_id long, version long, shingles binary")
    sets = staged(made.join(wanted, ["doc_id", "version"]).dropDuplicates(["doc_id", "version"]).select("id", "shingles"), "sets")
    links = _verified(pairs, sets, num, den)
    labels = connected_components(links)

    members = _open_members(members, labels)
    if members.isEmpty():
        return labels
    own = staged(sets.join(members.select("id").distinct(), "id", "left_semi"), "own")
    counts = np.zeros(SLOTS, np.int64)
    for r in own.mapInPandas(_tallied, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect():  # SLOTS rows at most
        counts[r["slot"]] = r["n"]
    members = _members(staged(own.mapInPandas(_rarest(counts, num, den), "key long, id long, n long"), "rarest"))
    # a pair within one component would tell nothing new
    pairs = _against_first(members, num, den)
    of = lambda end: labels.select(F.col("id").alias(end), F.col("label").alias(f"of_{end}"))
    pairs = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left").filter("coalesce(of_a, a) <> coalesce(of_b, b)").select("a", "b")
    links = staged(links.union(_verified(staged(pairs, "apart"), own, num, den)), "links")
    labels = connected_components(links)

    members = _open_members(members, labels)
    if members.isEmpty():
        return labels
    loose = members.select(F.col("low.id").alias("a"), F.col("id").alias("b")).distinct()
    clusters = staged(connected_components(loose).withColumnRenamed("label", "cluster").join(labels, "id", "left"), "clusters")
    sizes = staged(clusters.groupBy("cluster").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), "sizes")
    dealt = clusters.join(sizes, "cluster").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    dealt = staged(dealt.select("id", F.coalesce("label", "id").alias("label"), "cluster", "block", "blocks"), "dealt")
    spread = dealt.join(own, "id").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    spread = spread.select("cluster", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "label", "shingles")
    more = spread.groupBy("cluster", "i", "j").applyInPandas(_between_blocks(num, den), "a long, b long").distinct()
    return connected_components(staged(links.union(more), "links"))


def _prepare(docs: DataFrame, k: int, rows: int, bands: int) -> tuple[DataFrame, DataFrame]:
    """The texts ``(doc_id, text, version)``, and for each row its set's size, digest and bands."""
    text = F.col("text").cast("string")
    texts = docs.select(id_in(F.col("doc_id")).alias("doc_id"), text.alias("text"), F.coalesce(F.xxhash64(text), F.lit(0)).alias("version"))
    schema = "doc_id long, version long, n_shingles long, h1 long, h2 long, bands array<long>"
    return texts, staged(texts.mapInPandas(_prepared(k, rows, bands), schema), "prepared")


def _classes(prepared: DataFrame) -> DataFrame:
    """One row for each distinct set that isn't empty: a number, its first row by doc_id (null last) and text hash, copies and bands."""
    first = F.min(F.struct((F.col("doc_id") == NO_ID).alias("unnamed"), "doc_id", "version")).alias("first")
    made = prepared.filter("n_shingles > 0").groupBy(*CLASS).agg(first, F.count("*").alias("copies"), F.first("bands").alias("bands"))
    return staged(made.withColumn("id", F.monotonically_increasing_id()), "classes")


def near_duplicates(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, rows: int = 7, bands: int = 56) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` for every row of ``docs(doc_id, text)``.

    Documents link where ``den * |A & B| >= num * |A | B|`` over their sets of distinct k-word shingles; component_id
    is the smallest doc_id reachable, and ``kept`` marks the document that bears it.  Texts null, empty or of white
    space have no shingles and link with nothing.  Rows that share a doc_id stand for one document: it has the links of
    each of its texts, and all its rows share one component.  A row without doc_id links with nothing, has a null
    component and is kept.  Other columns are ignored; an empty table gives an empty result.
    """
    texts, prepared = _prepare(docs, k, rows, bands)
    named = prepared.filter(F.col("doc_id") != NO_ID)
    classes = _classes(named)
    labelled = classes.join(_components(classes, texts, k, num, den), "id", "left")
    labelled = labelled.select(*CLASS, F.coalesce("label", "id").alias("label"), F.col("first.doc_id").alias("low"), ((F.col("copies") > 1) | F.col("label").isNotNull()).alias("joined"))

    # documents with several texts join the components of their texts
    sets = F.struct(*CLASS)
    several = staged(named.groupBy("doc_id").agg(F.min(sets).alias("l"), F.max(sets).alias("h")).filter("l <> h").select("doc_id"), "several")
    shared = not several.isEmpty()
    if shared:
        labelled = staged(labelled.drop("joined"), "labelled")
        held = named.join(several, "doc_id", "left_semi").join(labelled, CLASS).select("doc_id", "label").distinct()
        held = staged(held.join(held.groupBy("doc_id").agg(F.min("label").alias("least")), "doc_id"), "held")
        moved = connected_components(held.select(F.col("least").alias("a"), F.col("label").alias("b"))).select(F.col("id").alias("label"), F.col("label").alias("to"))
        labelled = labelled.join(moved, "label", "left").select(*CLASS, F.coalesce("to", "label").alias("label"), "low", F.lit(True).alias("joined"))
    labelled = staged(labelled.filter("joined"), "labelled")
    known = labelled.join(labelled.groupBy("label").agg(F.min("low").alias("component")), "label").select(*CLASS, "component")
    found = prepared.drop("bands").join(staged(known, "known"), CLASS, "left").withColumn("component", F.coalesce("component", "doc_id"))
    if shared:  # also for those of its rows that have no words
        found = staged(found, "found")
        least = found.join(several, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("component").alias("least"))
        found = found.join(least, "doc_id", "left").withColumn("component", F.coalesce("least", "component"))
    doc_id, component = id_out(F.col("doc_id")), id_out(F.col("component"))
    return found.select(doc_id.alias("doc_id"), "n_shingles", component.alias("component_id"), (F.col("doc_id") == F.coalesce("component", "doc_id")).alias("kept"))


def distinct_documents(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, rows: int = 7, bands: int = 56) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of the rows whose texts are reachable by links, one stays.

    It is the first by doc_id (null last) and text hash.  Here every row is a document of its own, whatever its doc_id, so
    a text that differs from all others stays.  Rows without words stay.  Columns are those of ``docs``.
    """
    texts, prepared = _prepare(docs, k, rows, bands)
    classes = _classes(prepared)
    labelled = classes.join(_components(classes, texts, k, num, den), "id", "left").filter("copies > 1 or label is not null")
    labelled = staged(labelled.select(*CLASS, F.coalesce("label", "id").alias("label"), "first"), "labelled")
    known = staged(labelled.join(labelled.groupBy("label").agg(F.min("first").alias("one")), "label").select(*CLASS, "one"), "known")
    found = prepared.drop("bands").join(known, CLASS, "left")
    stays = F.col("one").isNull() | ((F.col("one.doc_id") == F.col("doc_id")) & (F.col("one.version") == F.col("version")))
    stay = staged(found.filter(stays).select(F.col("doc_id").alias("s_id"), F.col("version").alias("s_version"), (F.col("n_shingles") == 0).alias("empty")).distinct(), "stay")
    rows_ = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("doc"))
    rows_ = rows_.select("doc", id_in(F.col("doc.doc_id")).alias("s_id"), F.coalesce(F.xxhash64(F.col("doc.text").cast("string")), F.lit(0)).alias("s_version"))
    kept = rows_.join(stay.hint("merge"), ["s_id", "s_version"])
    numbered = kept.selectExpr("doc", "empty", "row_number() over (partition by s_id, s_version order by empty) as nth")
    return numbered.filter("nth = 1 or empty").select(*[F.col(f"doc.`{c}`").alias(c) for c in docs.columns])
