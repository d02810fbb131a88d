"""Ranked lexical search in the manner of LEMP: norm buckets, Cauchy-Schwarz, coordinate bounds, exact integer scores.

A document is a vector of impacts, one for each term of the queries that it holds, and a query a vector of its terms' weights; the score is
their inner product, all in integers.

1. Documents become sparse vectors of term counts where they lie.  One pass over these gives the counts that weights and impacts need.
2. Vectors are dealt by length (norm) into range partitions; the longest come first.
3. A task cuts its vectors into buckets by length.  A query whose k-th score so far exceeds its own length times the bucket's passes the whole
   bucket by (Cauchy-Schwarz).
4. Within a bucket, a query's heaviest coordinates are taken exactly and the rest is bounded by the product of the lengths that remain; only
   vectors whose bound reaches the k-th score survive.
5. Survivors are scored in 64-bit integers.

The longest vectors are searched first; the scores found there are thresholds for all the rest, which tasks raise further as they go on.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidentia.llm.common import id_in, id_out, staged

# ASCII letters and digits and all bytes beyond ASCII belong to terms; A-Z are lowered.
_SOLID = b"0123456789abcdefghijklmnopqrstuvwxyz"
TERMS = bytes(c + 32 if 65 <= c <= 90 else c if c in _SOLID or c >= 128 else 32 for c in range(256))
CHUNK = 1 << 22  # bytes of a text that are cut into terms at once
BUCKET = 512
ITEMS = 2_000  # queries that are searched together; more make further blocks
HEAD = 16  # one in so many vectors, the longest, gives the first thresholds
SLACK = 1 + 1e-9  # bounds are floating point, scores exact


def terms(text: str | None) -> Iterator[bytes]:
    """A text's terms in UTF-8, in order."""
    raw = (text or "").encode("utf-8", "surrogatepass").translate(TERMS)
    at = 0
    while at < len(raw):
        end = raw.find(b" ", at + CHUNK)
        end = len(raw) if end < 0 else end
        yield from raw[at:end].split()
        at = end


def _counted(at: dict[bytes, int]):
    """For each text with a term: how many it has, and which of the vocabulary how often."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for low in range(0, len(batch), 512):
                part, out = batch.iloc[low : low + 512], []
                for doc_id, text in zip(part["doc_id"].array, part["text"], strict=True):
                    held, n = Counter(), 0
                    for word, c in Counter(terms(text if isinstance(text, str) else None)).items():
                        n += c
                        if (i := at.get(word)) is not None:
                            held[i] = c
                    if n:
                        ids = sorted(held)
                        out.append((doc_id, n, ids, [held[i] for i in ids]))
                yield pd.DataFrame(out, columns=["doc_id", "n", "ids", "tfs"])

    return run


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column and where each row's begin."""
    offsets = column.offsets.to_numpy()
    return column.values.to_numpy()[offsets[0] : offsets[-1]], offsets - offsets[0]


def _document_counts(n_terms: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(n_terms, np.int64)
        for batch in batches:
            df += np.bincount(_flat(batch.column("ids"))[0], minlength=n_terms)
        ids = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(df[ids], pa.int64())], names=["id", "df"])

    return run


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impacts(tf: np.ndarray, n: np.ndarray, n_docs: int, n_all: int) -> np.ndarray:
    """Of counts ``tf`` in documents of ``n`` terms."""
    m = 100 - 50 + (50 * n * n_docs) // n_all
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


class Queries:
    """The queries of a block as sparse vectors, and for each term the queries that hold it."""

    def __init__(self, own: list[list[int]], weights: np.ndarray):
        self.ids = [np.array(t, np.int64) for t in own]
        self.weights = [weights[t] for t in self.ids]
        self.norms = np.array([math.sqrt(float((w.astype(float) ** 2).sum())) for w in self.weights])
        # a query's focus: its heaviest coordinates, until little of its length remains
        flat, rest = [], np.zeros(len(own))
        for q, (t, w) in enumerate(zip(self.ids, self.weights, strict=True)):
            order = np.argsort(-w, kind="stable")
            left = np.sqrt(np.maximum(self.norms[q] ** 2 - np.cumsum(w[order].astype(float) ** 2), 0))
            size = int(np.argmax(left <= self.norms[q] / 4)) + 1 if len(w) else 0
            rest[q] = left[size - 1] if size else 0
            flat += [(int(i), q, float(x)) for i, x in zip(t[order[:size]], w[order[:size]], strict=True)]
        self.rest = rest
        flat.sort()
        self.focus = np.array([q for _, q, _ in flat], np.int64)
        self.focus_weight = np.array([x for _, _, x in flat], float)
        self.starts = np.searchsorted(np.array([i for i, _, _ in flat], np.int64), np.arange(len(weights) + 1))


class Best:
    """The k best of each query so far: scores and ids, highest first, equal scores by id."""

    def __init__(self, thresholds: np.ndarray, k: int):
        self.k, self.thresholds = k, thresholds.copy()
        self.found = [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in thresholds]

    def add(self, q: int, scores: np.ndarray, ids: np.ndarray) -> None:
        s, i = np.concatenate((self.found[q][0], scores)), np.concatenate((self.found[q][1], ids))
        order = np.lexsort((i, -s))[: self.k]
        self.found[q] = s[order], i[order]
        if len(order) == self.k:
            self.thresholds[q] = max(self.thresholds[q], int(s[order[-1]]))


def search_bucket(ids: np.ndarray, owner: np.ndarray, values: np.ndarray, doc_ids: np.ndarray, norms: np.ndarray, q: Queries, best: Best) -> int:
    """One bucket: entries ``(owner, ids, values)`` of the vectors ``doc_ids`` with ``norms``.  Returns how many pairs were scored."""
    alive = q.norms * float(norms.max()) * SLACK >= best.thresholds
    if not alive.any():
        return 0
    shape = (len(doc_ids), len(alive))
    starts, sizes = q.starts[ids], q.starts[ids + 1] - q.starts[ids]
    each = np.repeat(np.arange(len(ids)), sizes)
    at = np.arange(len(each)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + starts[each]
    keep = alive[q.focus[at]]
    each, at = each[keep], at[keep]
    cell, real = owner[each] * shape[1] + q.focus[at], values[each].astype(float)
    exact = np.bincount(cell, q.focus_weight[at] * real, shape[0] * shape[1]).reshape(shape)
    taken = np.bincount(cell, real * real, shape[0] * shape[1]).reshape(shape)
    bound = exact + q.rest * np.sqrt(np.maximum(norms[:, None] ** 2 - taken, 0))
    reach = bound * SLACK >= np.maximum(best.thresholds, 1)
    reach[:, ~alive] = False
    scored = 0
    ends = np.searchsorted(owner, np.arange(len(doc_ids) + 1))
    for low in range(0, len(doc_ids), 64):
        block = reach[low : low + 64]
        wanted = np.flatnonzero(block.any(0))
        if not len(wanted):
            continue
        a, b = ends[low], ends[min(low + 64, len(doc_ids))]
        rows = np.zeros((len(block), len(q.starts) - 1), np.int64)
        rows[owner[a:b] - low, ids[a:b]] = values[a:b]
        for i in wanted:
            own = np.flatnonzero(block[:, i])
            scores = rows[own[:, None], q.ids[i]] @ q.weights[i]
            good = scores >= max(1, best.thresholds[i])
            scored += len(own)
            if good.any():
                best.add(i, scores[good], doc_ids[low + own[good]])
    return scored


def _searched(q: Queries, thresholds: np.ndarray, k: int, n_docs: int, n_all: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(thresholds, k)
        for batch in batches:
            ids, starts = _flat(batch.column("ids"))
            tfs, _ = _flat(batch.column("tfs"))
            doc_ids, n = batch.column("doc_id").to_numpy(), batch.column("n").to_numpy()
            norms = batch.column("norm").to_numpy()
            order = np.argsort(-norms, kind="stable")
            sizes = np.diff(starts)
            for low in range(0, len(order), BUCKET):
                own = order[low : low + BUCKET]
                owner = np.repeat(np.arange(len(own)), sizes[own])
                at = np.arange(len(owner)) - np.repeat(np.cumsum(sizes[own]) - sizes[own], sizes[own]) + np.repeat(starts[own], sizes[own])
                values = impacts(tfs[at].astype(np.int64), np.repeat(n[own], sizes[own]), n_docs, n_all)
                search_bucket(ids[at].astype(np.int64), owner, values, doc_ids[own], norms[own], q, best)
        for i, (s, d) in enumerate(best.found):
            if len(s):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), i), pa.int64()), pa.array(d, pa.int64()), pa.array(s, pa.int64())], names=["q", "doc_id", "score"])

    return run


def _normed(n_docs: int, n_all: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tfs, starts = _flat(batch.column("tfs"))
            owner = np.repeat(np.arange(batch.num_rows), np.diff(starts))
            values = impacts(tfs.astype(np.int64), batch.column("n").to_numpy()[owner], n_docs, n_all)
            norms = np.sqrt(np.bincount(owner, values.astype(float) ** 2, batch.num_rows)) * SLACK
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "n", "ids", "tfs")), pa.array(norms, pa.float64())], names=["doc_id", "n", "ids", "tfs", "norm"])

    return run


def _best_of(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query; what tasks found is cut again by parts before a query's rows meet."""
    parts = Window.partitionBy("q", F.pmod(F.xxhash64("doc_id"), F.lit(64))).orderBy(F.desc("score"), F.asc("doc_id"))
    cut = found.withColumn("nth", F.row_number().over(parts)).filter(F.col("nth") <= k)
    every = Window.partitionBy("q").orderBy(F.desc("score"), F.asc("doc_id"))
    return cut.withColumn("rank", F.row_number().over(every)).filter(F.col("rank") <= k).select("q", "rank", "doc_id", "score")


def _search_block(docs: DataFrame, own: list[list[bytes]], k: int) -> DataFrame:
    """``(q, rank, doc_id, score)``; q is the number of a query in ``own``."""
    spark = docs.sparkSession
    vocabulary = {t: i for i, t in enumerate(sorted({t for q in own for t in q}))}
    texts = docs.select(id_in(F.col("doc_id")).alias("doc_id"), F.col("text").cast("string").alias("text"))
    counted = staged(texts.mapInPandas(_counted(vocabulary), "doc_id long, n long, ids array<int>, tfs array<int>"), "counted")
    totals = counted.agg(F.count("*").alias("n"), F.sum("n").alias("l")).first()
    n_docs, n_all = totals["n"], totals["l"] or 0
    if not n_docs or not vocabulary:
        return spark.createDataFrame([], "q long, rank int, doc_id long, score long")
    df = np.zeros(len(vocabulary), np.int64)
    for r in counted.mapInArrow(_document_counts(len(vocabulary)), "id int, df long").groupBy("id").agg(F.sum("df").alias("df")).collect():
        df[r["id"]] = r["df"]
    weights = np.array([weight(n_docs, int(x)) for x in df], np.int64)
    q = Queries([sorted(vocabulary[t] for t in set(terms_)) for terms_ in own], weights)

    normed = counted.filter(F.size("ids") > 0).mapInArrow(_normed(n_docs, n_all), "doc_id long, n long, ids array<int>, tfs array<int>, norm double")
    dealt = staged(normed.repartitionByRange(F.desc("norm"), F.xxhash64("doc_id")), "vectors")  # ties spread over partitions
    cut = dealt.agg(F.percentile_approx("norm", 1 - 1 / HEAD).alias("cut")).first()["cut"]
    if cut is None:
        return spark.createDataFrame([], "q long, rank int, doc_id long, score long")
    schema = "q long, doc_id long, score long"
    head = staged(dealt.filter(F.col("norm") >= cut).mapInArrow(_searched(q, np.zeros(len(own), np.int64), k, n_docs, n_all), schema), "head")
    head = staged(_best_of(head, k).drop("rank"), "head")
    thresholds = np.zeros(len(own), np.int64)
    for r in head.groupBy("q").agg(F.count("*").alias("n"), F.min("score").alias("least")).collect():  # one row a query of the block
        thresholds[r["q"]] = r["least"] if r["n"] >= k else 0
    reach = float(np.min(np.maximum(thresholds, 1)[q.norms > 0] / q.norms[q.norms > 0] / SLACK, initial=math.inf))  # shorter vectors reach no query
    rest = dealt.filter((F.col("norm") < cut) & (F.col("norm") >= reach))
    found = rest.mapInArrow(_searched(q, thresholds, k, n_docs, n_all), schema)
    return _best_of(head.union(staged(found, "rest")), k)


def search(docs: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the k best documents of ``docs(doc_id, text)`` for each row of ``items(item_id, text)``.

    Terms are runs of ASCII letters and digits and of characters beyond ASCII, with A-Z lowered.  A term's weight falls with the
    documents that hold it, a document's impact rises with the term's count and falls with its length; scores are sums of their products
    over an item's terms, once each.  Only scores above 0 count; equal scores go by doc_id (null first).  Null and empty texts hold no
    terms: such documents are never found, and such items find nothing.  Each row of either table counts by itself, also where ids repeat.
    Other columns are ignored; an empty table on either side gives an empty result.  Texts are read whole.

    Items are searched in blocks of ITEMS, the unit that goes to the driver and to all tasks; all documents are read for each block.
    """
    numbered = staged(items.select(F.col("item_id"), F.col("text").cast("string").alias("text")).withColumn("at", F.monotonically_increasing_id()), "items")
    out, last = None, -1
    while rows := numbered.filter(F.col("at") > last).orderBy("at").limit(ITEMS).collect():
        last = rows[-1]["at"]
        names = docs.sparkSession.createDataFrame([(i, r["item_id"]) for i, r in enumerate(rows)], numbered.select(F.col("at").alias("q"), "item_id").schema)
        found = _search_block(docs, [list(set(terms(r["text"]))) for r in rows], k).join(F.broadcast(names), "q")  # ITEMS rows at most
        found = found.select("item_id", F.col("rank").cast("int").alias("rank"), id_out(F.col("doc_id")).alias("doc_id"), "score")
        out = found if out is None else out.union(found)
    if out is None:
        return numbered.select("item_id", F.lit(1).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")).limit(0)
    return out
