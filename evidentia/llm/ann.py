"""Nearest neighbours by inner product from randomly rotated one-bit codes.

The index: centroids fitted on a bounded sample; every vector goes to the cell of its nearest centroid, and what is
left of it, scaled to length one and rotated at random, is coded by the signs of its coordinates, together with its
length and the inner product of the coded and the true direction.  From these, ``<q, x>`` is estimated without bias,
within an error of ``|q| |r| sqrt((1 - a*a) / (a*a)) * Z / sqrt(D - 1)`` save for a share of cases that falls off as
a normal tail does in Z.

A search first visits the cells nearest to the query, then those others that could still hold a better vector.  What a cell's
residuals can add to ``<q, centre>`` is bounded surely along the AXES directions in which residuals of the sample vary most, by the
cell's largest projections on them; across them the query is taken to be as good as random to the residuals, up to Z_CELL deviations.
That last part is no sure bound: recall is measured, not proven.  In a cell, vectors whose upper bound reaches the k-th best lower
bound are scored exactly.  Cells are dealt out in blocks of BLOCK vectors by BLOCK queries, so no task grows with a cell or a
frequent vector; to which cell a query goes is kept as a pair of numbers, and its vector joins it only on the way to the block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm.common import staged

BLOCK = 2048
MOST_CELLS = 4096
SAMPLE = 20_000  # vectors that the centroids are fitted on, at most
FIRST_CELLS = 6
RESULT = "query_id long, rank int, vec_id long, score double"
Z_CODE, Z_CELL = 3.0, 3.0
AXES = 16


def rotation(dim: int, seed: int) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.RandomState(seed).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def fit_centroids(sample: np.ndarray, cells: int, rounds: int = 8, seed: int = 0) -> np.ndarray:
    """Plain k-means from distinct starting points."""
    points = np.unique(sample, axis=0)
    cells = min(cells, len(points))
    centres = points[np.random.RandomState(seed).permutation(len(points))[:cells]].copy()
    for _ in range(rounds):
        own = nearest(points, centres)
        sums, n = np.zeros_like(centres), np.bincount(own, minlength=cells)
        np.add.at(sums, own, points)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmax(x @ centres.T - 0.5 * (centres * centres).sum(1), axis=1)


def encode(x: np.ndarray, own: np.ndarray, centres: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed signs, residual lengths and alignments (the inner product of the code's direction and the true one)."""
    rest = x - centres[own]
    length = np.sqrt((rest * rest).sum(1))
    turned = np.divide(rest, length[:, None], out=np.zeros_like(rest), where=length[:, None] > 0) @ turn
    aligned = np.abs(turned).sum(1) / np.sqrt(x.shape[1])
    return np.packbits(turned >= 0, axis=1), length, np.where(length > 0, aligned, 1.0)


def estimate(q: np.ndarray, centre: np.ndarray, bits: np.ndarray, length: np.ndarray, aligned: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated inner products (queries x vectors) of a cell and the half-widths of their bounds."""
    dim = len(centre)
    signs = np.unpackbits(bits, axis=1, count=dim).astype(np.float32) * 2 - 1
    along = ((q @ turn).astype(np.float32) @ signs.T) / np.sqrt(dim) / aligned
    norm = np.sqrt((q * q).sum(1))
    off = length * np.sqrt(np.maximum(0, 1 - aligned**2)) / aligned * Z_CODE / np.sqrt(max(1, dim - 1))
    return (q @ centre)[:, None] + length * along, norm[:, None] * (off + 1e-6 * (length + np.sqrt((centre * centre).sum())))


def axes(sample: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The directions (as columns) in which what is left of the sample varies most."""
    rest = sample - centres[nearest(sample, centres)]
    return np.linalg.eigh(rest.T @ rest)[1][:, ::-1][:, : min(AXES, sample.shape[1])]


def _packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Vectors as float64 bytes."""
    for batch in batches:
        yield batch[["vec_id", "row", "dim"]].assign(x=[np.asarray(v, np.float64).tobytes() for v in batch["v"]])


def _stack(x: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(x), np.float64).reshape(len(x), -1)


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -scores))[:k]


def search(vectors: DataFrame, is_query, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", seed: int = 11) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each row for which ``is_query`` (a condition over the id) holds, its k
    nearest other rows by inner product in double precision, ties to the smaller id.

    Rows without id, and vectors null, empty, zero or holding a null or a value that isn't finite take no part.  Vectors are
    compared with those of their own length.  Rows that share an id are different vectors of one name: each is a query of
    its own, and a neighbour of the others.  With fewer than k others, all are returned; an empty table gives an empty result.
    """
    v = F.col("v")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v")).filter(F.col("vec_id").isNotNull() & finite)
    rows = rows.select("vec_id", F.monotonically_increasing_id().alias("row"), F.size("v").cast("long").alias("dim"), "v")
    rows = staged(rows.mapInPandas(_packed, "vec_id long, row long, dim long, x binary"), "valid")
    out = None
    for r in rows.groupBy("dim").count().orderBy("dim").collect():
        own = _search(rows.filter(F.col("dim") == r["dim"]), r["dim"], r["count"], is_query, k, seed)
        out = own if out is None else out.unionByName(own)
    return vectors.sparkSession.createDataFrame([], RESULT) if out is None else out


def _search(rows: DataFrame, dim: int, n: int, is_query, k: int, seed: int) -> DataFrame:
    spark = rows.sparkSession
    # about 0.95 SAMPLE of the rows by hash, so that nothing else reaches the driver
    drawn = rows.filter(F.pmod(F.xxhash64("row", F.lit(seed)), F.lit(max(n, 1))) < int(0.95 * SAMPLE)) if n > SAMPLE else rows
    sample = _stack(drawn.select("x").limit(SAMPLE).toPandas()["x"])
    sample = sample[np.lexsort(sample.T)]
    centres = fit_centroids(sample, max(1, min(MOST_CELLS, round(n**0.5 / 2))), seed=seed)
    turn, along = rotation(dim, seed), axes(sample, centres)

    def code(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            x = _stack(batch["x"])
            own = nearest(x, centres)
            bits, length, aligned = encode(x, own, centres, turn)
            on = (x - centres[own]) @ along
            off = np.sqrt(np.maximum(0, length**2 - (on * on).sum(1)))
            yield pd.DataFrame(
                {"cell": own, "vec_id": batch["vec_id"], "row": batch["row"], "x": batch["x"], "bits": [b.tobytes() for b in bits], "length": length, "aligned": aligned, "on": list(np.abs(on)), "off": off}
            )

    coded = staged(rows.mapInPandas(code, "cell long, vec_id long, row long, x binary, bits binary, length double, aligned double, on array<double>, off double"), "coded")
    widest = [F.max(F.get("on", F.lit(j))).alias(f"on{j}") for j in range(along.shape[1])]
    cells = coded.groupBy("cell").agg(F.count("*").alias("n"), F.max("off").alias("off"), *widest).toPandas()  # MOST_CELLS rows at most
    used, blocks = np.zeros(len(centres), bool), np.zeros(len(centres), np.int64)
    on, off = np.zeros((len(centres), along.shape[1])), np.zeros(len(centres))
    used[cells["cell"]], blocks[cells["cell"]], off[cells["cell"]] = True, -(-cells["n"] // BLOCK), cells["off"]
    on[cells["cell"]] = cells[[f"on{j}" for j in range(along.shape[1])]].to_numpy()
    sizes = spark.createDataFrame([(int(c), int(b)) for c, b in enumerate(blocks) if b], "cell long, blocks long")
    queries = rows.filter(is_query(F.col("vec_id"))).select(F.col("vec_id").alias("query_id"), F.col("row").alias("query"), "x")

    def probe(first: bool):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for at in range(0, len(batch), BLOCK):
                    part = batch.iloc[at : at + BLOCK]
                    q, least = _stack(part["x"]), part["least"].fillna(-np.inf).to_numpy(float)
                    near = q @ centres.T
                    near[:, ~used] = -np.inf
                    went = np.zeros(near.shape, bool)
                    np.put_along_axis(went, np.argsort(-near, axis=1, kind="stable")[:, :FIRST_CELLS], True, axis=1)
                    went &= used
                    if not first:
                        q_on = q @ along
                        q_off = np.sqrt(np.maximum(0, (q * q).sum(1) - (q_on * q_on).sum(1)))
                        could = near + np.abs(q_on) @ on.T + Z_CELL / np.sqrt(max(1, dim - along.shape[1])) * q_off[:, None] * off
                        went = ~went & used & (could >= least[:, None])
                    i, c = np.nonzero(went)
                    yield pd.DataFrame({"cell": c, "query": part["query"].to_numpy()[i], "least": least[i]})

        return run

    def within(key: tuple, data: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(data) and len(asked):
            data = data.sort_values(["vec_id", "row"])
            x, ids, own_rows = _stack(data["x"]), data["vec_id"].to_numpy(), data["row"].to_numpy()
            bits = np.frombuffer(b"".join(data["bits"]), np.uint8).reshape(len(x), -1)
            q, names = _stack(asked["q"]), asked["query"].to_numpy()
            guess, off = estimate(q, centres[key[0]], bits, data["length"].to_numpy(), data["aligned"].to_numpy(), turn)
            low, high = guess - off, guess + off
            least = asked["least"].to_numpy(float)
            for j in range(len(q)):
                others = own_rows != names[j]
                sure = low[j][others]
                bar = least[j] if len(sure) < k else max(least[j], np.partition(sure, len(sure) - k)[len(sure) - k])
                at = np.flatnonzero(others & (high[j] >= bar))
                score = (x[at] * q[j]).sum(1)
                at, score = at[score >= least[j]], score[score >= least[j]]
                best = _best(ids[at], score, k)
                if len(best):
                    out.append((names[j], ids[at][best].tolist(), own_rows[at][best].tolist(), score[best].tolist()))
        return pd.DataFrame(out, columns=["query", "ids", "rows", "scores"])

    def visit(asked: DataFrame) -> DataFrame:
        asked = staged(asked, "asked")
        shape = staged(asked.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).alias("q_blocks")).join(sizes, "cell"), "shape")
        left = coded.drop("on", "off").join(F.broadcast(shape), "cell").withColumn("block", F.pmod(F.xxhash64("row"), F.col("blocks")))
        left = left.withColumn("q_block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("q_blocks") - 1))).drop("blocks", "q_blocks")
        right = asked.join(F.broadcast(shape), "cell").withColumn("q_block", F.pmod(F.xxhash64("query"), F.col("q_blocks")))
        right = right.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).drop("blocks", "q_blocks")
        right = right.join(queries.select("query", F.col("x").alias("q")), "query")
        keys = ["cell", "block", "q_block"]
        met = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(within, "query long, ids array<long>, rows array<long>, scores array<double>")
        met = met.select("query", F.explode(F.arrays_zip("ids", "rows", "scores")).alias("m"))
        return met.select("query", F.col("m.ids").alias("vec_id"), F.col("m.rows").alias("row"), F.col("m.scores").alias("score"))

    def ranked(found: DataFrame) -> DataFrame:
        return found.selectExpr("*", "row_number() over (partition by query order by score desc, vec_id, row) as rank").filter(f"rank <= {k}")

    pairs = "cell long, query long, least double"
    none = F.lit(None).cast("double").alias("least")
    first = staged(ranked(visit(queries.select("query", "x", none).mapInPandas(probe(True), pairs))).drop("rank"), "first")
    bars = first.groupBy("query").agg(F.min("score").alias("least"), F.count("*").alias("n")).select("query", F.when(F.col("n") >= k, F.col("least")).alias("least"))
    second = visit(queries.select("query", "x").join(bars, "query", "left").mapInPandas(probe(False), pairs))
    best = ranked(first.unionByName(staged(second, "second")))
    return best.join(queries.select("query", "query_id"), "query").select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
