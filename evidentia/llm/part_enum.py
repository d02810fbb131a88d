"""Exact similarity join of word-shingle sets by PartEnum signatures.

Sets x and y with a Jaccard similarity of at least ``num / den`` differ in at most ``(den - num) / (den + num) * (|x| + |y|)`` elements.  Sizes
are cut into bands; all sets that may meet in a band, those of its sizes and those just below that still reach into it, have sizes up to
``r``, so they differ in at most ``k = floor(2 r (den - num) / (den + num))`` elements.  The domain of elements is dealt at random into
``n1`` parts, so few that at least one part holds no more than ``k2`` of the differing elements, and each part into ``n2`` cells: then two
similar sets agree in all elements of at least ``n2 - k2`` cells of that part.  A signature is made for each part and each choice of ``n2 - k2``
of its cells, from the elements that fall there; similar sets share at least one, whatever the draw, so nothing is missed.

1. Texts with the same set form a class; a class has one row from there on.
2. Classes that share a signature are candidates.  Each is verified on full sets against the first of its bucket.
3. Members of buckets that this leaves in several components get signatures of a second, finer scheme with larger projections.
4. What is still open is dealt into blocks, and every pair of blocks of a bucket cluster is compared on full sets in a task of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm.common import BITS, NO_ID, bitmap, id_in, id_out, staged
from evidentia.llm.graph import connected_components
from evidentia.llm.near_dup import BLOCK, CLASS, _between_blocks, _open_members, _sets, _verified
from evidentia.llm.sketching import WordHasher, mix64, shingle_set

STEP = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Scheme:
    """How signatures are made: ``k2`` differing elements are borne in a part of ``n2`` cells; bands grow by ``growth``."""

    num: int
    den: int
    k2: int = 1
    n2: int = 3
    growth: float = 1.5
    seed: int = 1


@cache
def choices(n2: int, k2: int) -> np.ndarray:
    """One row of 0 and 1 for each choice of all but k2 of a part's cells."""
    rows = list(combinations(range(n2), n2 - k2))
    out = np.zeros((len(rows), n2), np.uint64)
    for i, r in enumerate(rows):
        out[i, list(r)] = 1
    return out


def bands_of(size: int, s: Scheme) -> list[tuple[int, int]]:
    """``(band, r)`` for each band in which a set of this size may meet a similar one; r is the largest size there."""
    low, band = 1, 0
    while True:
        high = max(low, int(low * s.growth))
        if low <= size <= high:
            out = [(band, high)]
            # the next band's smallest sets may be similar to this one
            if s.den * size >= s.num * (high + 1):
                out.append((band + 1, max(high + 1, int((high + 1) * s.growth))))
            return out
        low, band = high + 1, band + 1


def signatures(own: np.ndarray, s: Scheme) -> np.ndarray:
    """The signatures of a set of 64-bit elements as sorted distinct signed numbers.  Sets too small to differ at all have none, as
    similar ones are equal."""
    out = []
    with np.errstate(over="ignore"):
        for band, r in bands_of(len(own), s):
            k = (s.den - s.num) * 2 * r // (s.den + s.num)
            if not k:
                continue
            n1 = k // (s.k2 + 1) + 1
            h = mix64(own + mix64(np.uint64([s.seed * 1_000_003 + band + 1]))[0])
            cell = ((h >> np.uint64(32)) % np.uint64(n1)).astype(np.int64) * s.n2 + (h & np.uint64(0xFFFFFFFF)).astype(np.int64) % s.n2
            sums = np.zeros(n1 * s.n2, np.uint64)
            np.add.at(sums, cell, mix64(h * STEP))  # a commutative digest of each cell's elements
            sums = sums.reshape(n1, s.n2) @ choices(s.n2, s.k2).T
            place = np.arange(sums.size, dtype=np.uint64).reshape(sums.shape) + np.uint64(band + 1) * np.uint64(1 << 40)
            out.append(mix64(sums ^ mix64(place * STEP + np.uint64(s.seed))).ravel())
    return np.unique(np.concatenate(out)).view(np.int64) if out else np.empty(0, np.int64)


def _prepared(k: int, scheme: Scheme):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = WordHasher()
        for batch in batches:
            for at in range(0, len(batch), 256):  # a few documents at a time, so that long ones don't pile up
                part = batch.iloc[at : at + 256]
                sets = [shingle_set(x if isinstance(x, str) else None, k, hasher) for x in part["text"]]
                with np.errstate(over="ignore"):
                    sums = [(int(s.sum(dtype=np.uint64)), int(np.bitwise_xor.reduce(s)) if len(s) else 0) for s in sets]
                yield pd.DataFrame(
                    {
                        "doc_id": part["doc_id"].array,
                        "version": part["version"].array,
                        "n_shingles": [len(s) for s in sets],
                        "h1": np.array([a for a, _ in sums], np.uint64).view(np.int64),
                        "h2": np.array([b for _, b in sums], np.uint64).view(np.int64),
                        "keys": [signatures(s, scheme) if len(s) else np.empty(0, np.int64) for s in sets],
                    }
                )

    return run


def _signed(scheme: Scheme):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i, x in zip(batch["id"], batch["shingles"], strict=True):
                yield pd.DataFrame({"key": signatures(np.frombuffer(x, np.uint64), scheme), "id": i})

    return run


def _members(entries: DataFrame) -> DataFrame:
    """The entries ``(key, id)`` of keys that several ids share, with the first id of the key and how many it has."""
    buckets = entries.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count("*").alias("size"))
    buckets = staged(buckets.filter("low <> high").drop("high"), "buckets")
    return staged(entries.join(buckets, "key").select("key", "id", "low", "size"), "members")


def _against_first(members: DataFrame, sizes: DataFrame, s: Scheme) -> DataFrame:
    """Pairs of each member and the first of its bucket, where their sets' sizes ``(id, n)`` allow a link."""
    pairs = members.filter("id <> low").select(F.col("low").alias("a"), F.col("id").alias("b")).distinct()
    for end in ("a", "b"):
        pairs = pairs.join(sizes.select(F.col("id").alias(end), F.col("n").alias(f"n_{end}")), end)
    return staged(pairs.filter(f"{s.den} * least(n_a, n_b) >= {s.num} * greatest(n_a, n_b)").select("a", "b"), "pairs")


def _links(classes: DataFrame, texts: DataFrame, k: int, first: Scheme, second: Scheme) -> DataFrame:
    """``(id, label)`` of the classes that link with another; label is the component's smallest id."""
    num, den = first.num, first.den
    sizes = classes.select("id", F.col("n_shingles").alias("n"))
    members = _members(classes.select(F.explode("keys").alias("key"), "id"))
    pairs = _against_first(members, sizes, first)
    wanted = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).union(members.filter("size > 2").select("id")).distinct()
    wanted = staged(wanted.join(classes.select("id", "first.doc_id", "first.version"), "id"), "wanted")
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
    members = _members(staged(own.mapInPandas(_signed(second), "key long, id long"), "signed"))
    of = lambda end: labels.select(F.col("id").alias(end), F.col("label").alias(f"of_{end}"))
    pairs = _against_first(members, sizes, second)
    pairs = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left").filter("coalesce(of_a, a) <> coalesce(of_b, b)").select("a", "b")
    links = staged(links.union(_verified(staged(pairs, "apart"), own, num, den)), "links")
    labels = connected_components(links)

    members = _open_members(members, labels)
    if members.isEmpty():
        return labels
    loose = members.select(F.col("low").alias("a"), F.col("id").alias("b")).distinct()
    clusters = staged(connected_components(loose).withColumnRenamed("label", "cluster").join(labels, "id", "left"), "clusters")
    blocks = staged(clusters.groupBy("cluster").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), "blocks")
    dealt = clusters.join(blocks, "cluster").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    dealt = staged(dealt.select("id", F.coalesce("label", "id").alias("label"), "cluster", "block", "blocks"), "dealt")
    spread = dealt.join(own, "id").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    spread = spread.select("cluster", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "label", "shingles")
    more = spread.groupBy("cluster", "i", "j").applyInPandas(_between_blocks(num, den), "a long, b long").distinct()
    return connected_components(staged(links.union(more), "links"))


def similar_documents(docs: DataFrame, k: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` for every row of ``docs(doc_id, text)``.

    Documents link where ``den * |A & B| >= num * |A | B|`` over their sets of distinct k-word shingles (words with A-Z lowered; with fewer
    than k words the whole sequence is the one shingle); component_id is the smallest doc_id reachable, itself included.  Texts null, empty
    or of white space have no shingles and link with nothing.  Rows that share a doc_id stand for one document: it has the links of each of
    its texts, and all its rows share one component.  A row without doc_id links with nothing and has a null component.  Texts of any length
    are read whole.  Other columns are ignored; an empty table gives an empty result.
    """
    first, second = Scheme(num, den), Scheme(num, den, k2=2, n2=6, seed=2)
    text = F.col("text").cast("string")
    texts = docs.select(id_in(F.col("doc_id")).alias("doc_id"), text.alias("text"), F.coalesce(F.xxhash64(text), F.lit(0)).alias("version"))
    schema = "doc_id long, version long, n_shingles long, h1 long, h2 long, keys array<long>"
    prepared = staged(texts.mapInPandas(_prepared(k, first), schema), "prepared")
    named = prepared.filter(F.col("doc_id") != NO_ID)
    made = named.filter("n_shingles > 0").groupBy(*CLASS).agg(F.min(F.struct("doc_id", "version")).alias("first"), F.count("*").alias("copies"), F.first("keys").alias("keys"))
    classes = staged(made.withColumn("id", F.monotonically_increasing_id()), "classes")
    labels = _links(classes, texts, k, first, second)
    joined = ((F.col("copies") > 1) | F.col("label").isNotNull()).alias("joined")  # a class that stands alone needs no component
    labelled = classes.join(labels, "id", "left").select(*CLASS, F.coalesce("label", "id").alias("label"), F.col("first.doc_id").alias("low"), joined)

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
    known = staged(labelled.join(labelled.groupBy("label").agg(F.min("low").alias("component")), "label").select(*CLASS, "component"), "known")
    found = prepared.drop("keys").join(known, CLASS, "left").withColumn("component", F.when(F.col("doc_id") != NO_ID, F.coalesce("component", "doc_id")))
    if shared:  # also for those of its rows that have no words
        found = staged(found, "found")
        least = found.join(several, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("component").alias("least"))
        found = found.join(least, "doc_id", "left").withColumn("component", F.coalesce("least", "component"))
    return found.select(id_out(F.col("doc_id")).alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))
