"""Mixing overlapping sources to target weights by a min-cost flow.

Documents are aggregated by membership pattern (the set of sources they belong to).  Words flow from patterns to the
quotas of the sources in the pattern; a pattern offers its words once for each repetition, and a further repetition
costs more than the one before, so the flow repeats documents only where it must.  What flows through a pattern becomes
a number of whole repetitions plus a rest, and the rest picks documents in a seeded order.

Only patterns and sources, never documents, reach the driver, and their number is checked against ``MOST_PATTERNS``.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.llm.common import id_in, staged, words

MOST_PATTERNS = 100_000
LEAST_BUCKET = 1_000
MOST_BITS = 1 << 30  # of the sums that the search for the best subset holds at once


def capped_shares(sizes: Mapping[str | None, int], weights: Sequence[float] = (5, 2, 1), total: float = 1.5, cap: float = 2.0) -> dict[str | None, float]:
    """Target words of each source: ``total`` times all sizes, shared by weights, none above ``cap`` times its size.

    Sources stand by code point, null last, and take the weights in turn; what a cap cuts off is shared anew by weight
    among the others until none is above its cap.
    """
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, out = total * sum(sizes.values()), set(order), {}
    while open_:
        each = left / sum(weight[s] for s in open_)
        above = [s for s in order if s in open_ and each * weight[s] > cap * sizes[s]]
        if not above:
            return out | {s: each * weight[s] for s in open_}
        for s in above:
            out[s] = cap * sizes[s]
            left -= out[s]
            open_.discard(s)
    return out


def route(capacity: Mapping[str, int], members: Mapping[str, Sequence[str | None]], quota: Mapping[str | None, int], costs: Sequence[float]) -> dict[tuple[str, str | None], int]:
    """The min-cost flow: words of pattern p that serve source s, as ``{(p, s): words}``.

    Pattern p offers ``capacity[p]`` words at ``costs[0]`` each, as many again at ``costs[1]``, and so on; costs don't fall, so they
    are convex in what a pattern sends.  Only these first edges cost anything.  What sets of words can be sent on from
    the patterns form a polymatroid, so it is best to take the offers from cheap to dear, each as far as it goes; augmenting
    paths (breadth first) reroute what others sent where that lets more through, and never send a pattern less than before.
    """
    if any(a > b for a, b in zip(costs, costs[1:], strict=False)):
        raise ValueError("costs of repetitions must not fall")
    flow: dict[tuple[str, str | None], int] = {}
    wants, gets = dict(quota), {s: [] for p in capacity for s in members[p]}  # patterns that serve a source
    for _, p in sorted((cost, p) for p in capacity for cost in costs):
        left = capacity[p]
        while left > 0:
            back: dict[tuple[str, object], tuple[str, object] | None] = {("p", p): None}
            queue, end = deque([("p", p)]), None
            while queue and end is None:
                kind, x = queue.popleft()
                if kind == "p":
                    for s in members[x]:
                        if ("s", s) not in back:
                            back["s", s] = (kind, x)
                            if wants.get(s, 0) > 0:
                                end = ("s", s)
                                break
                            queue.append(("s", s))
                else:  # a pattern that serves x could serve another source instead
                    for q in gets[x]:
                        if ("p", q) not in back and flow[q, x] > 0:
                            back["p", q] = (kind, x)
                            queue.append(("p", q))
            if end is None:
                break
            path = [end]
            while back[path[-1]] is not None:
                path.append(back[path[-1]])
            path = [x for _, x in reversed(path)]  # pattern, source, pattern, source ...
            gains, loses = list(zip(path[::2], path[1::2], strict=True)), list(zip(path[2::2], path[1::2], strict=False))
            move = min([left, wants[end[1]], *(flow[q, s] for q, s in loses)])
            for q, s in gains:
                if (q, s) not in flow:
                    gets[s].append(q)
                flow[q, s] = flow.get((q, s), 0) + move
            for q, s in loses:
                flow[q, s] -= move
            wants[end[1]] -= move
            left -= move
    return flow


def best_subset(sizes: list[int], room: int) -> list[bool]:
    """Which of a few sizes to take so that their sum is the largest that fits; sums are the bits of an integer."""
    reach = [1]
    for w in sizes:
        reach.append((reach[-1] | reach[-1] << w) & ((1 << (room + 1)) - 1))
    at, taken = reach[-1].bit_length() - 1, [False] * len(sizes)
    for i in range(len(sizes) - 1, -1, -1):
        if not reach[i] >> at & 1:
            taken[i] = True
            at -= sizes[i]
    return taken


def _fill(rows: pd.DataFrame) -> pd.DataFrame:
    """Of a bucket's documents, in their seeded order, those that still fit; then the best subset of as many as MOST_BITS lets in.

    The search may give back what the order took, so it never fills less.  Where not all get in, the smallest do.
    """
    rows = rows.sort_values(["h", "id"])
    sizes, room = (rows["size"] * rows["n"]).tolist(), int(rows["room"].iloc[0])
    more, left = [], room
    for w in sizes:
        more.append(w <= left)
        left -= w * more[-1]
    fit = sorted((i for i, w in enumerate(sizes) if 0 < w <= room), key=sizes.__getitem__)
    if left and not all(more[i] for i in fit):
        pool: list[int] = []
        for i in fit:
            given = left + sizes[i] * more[i]
            if (len(pool) + 1) * (given + 1) > MOST_BITS:
                break
            pool.append(i)
            left = given
        pool.sort()
        for i, taken in zip(pool, best_subset([sizes[i] for i in pool], left), strict=True):
            more[i] = taken
    taken = np.array(more, np.int64)
    return pd.DataFrame({"pattern": rows["pattern"].array, "id": rows["id"].array, "h": rows["h"].array, "more": taken, "filled": taken * np.array(sizes, np.int64)})


def _bucket(seed: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), "h"), F.col("buckets"))


def mix(
    docs: DataFrame,
    sources: Column | None = None,
    targets: Callable[[dict[str | None, int]], dict[str | None, float]] = capped_shares,
    costs: Sequence[float] = (0, 1),
    seed: int = 7,
) -> DataFrame:
    """``doc`` (the whole row), ``size`` (its words), ``pattern``, ``source_size``, ``target`` and ``taken`` words.

    ``sources`` is an array of the sources a row belongs to (default: its ``source``); source_size and target are those
    of the first.  ``targets`` gets the words of each source and returns the words the mix should take for it.  Whole
    documents are taken, ``taken`` is 0, 1 ... ``len(costs)`` times ``size`` (``costs``: of a word's first use, its second ...), and equal inputs give equal results.  Texts
    null or empty have size 0 and are never taken.  A null source is a source like any other.  Rows equal in doc_id,
    text and sources share one result.  An empty table gives an empty result.
    """
    spark = docs.sparkSession
    whole = F.struct(*[docs[f"`{c}`"] for c in docs.columns])
    names = F.sort_array(F.array_distinct(F.array(docs["source"].cast("string")) if sources is None else sources))
    base = docs.select(
        whole.alias("doc"), F.to_json(names).alias("pattern"), id_in(docs["doc_id"]).alias("id"), F.size(words(docs["text"].cast("string"))).cast("long").alias("size")
    ).withColumn("h", F.xxhash64(F.lit(seed), "id", "doc.text", "pattern"))
    slim = staged(base.drop("doc"), "sizes")
    found = slim.groupBy("pattern").agg(F.sum("size").alias("words"), F.count("*").alias("n")).limit(MOST_PATTERNS + 1).collect()
    if len(found) > MOST_PATTERNS:
        raise ValueError(f"more than {MOST_PATTERNS} membership patterns")
    members = {r["pattern"]: json.loads(r["pattern"]) for r in found}
    capacity = {r["pattern"]: r["words"] for r in found}
    sizes: dict[str | None, int] = {}
    for p, own in members.items():
        for s in own:
            sizes[s] = sizes.get(s, 0) + capacity[p]
    wanted = targets(sizes)
    sent = dict.fromkeys(capacity, 0)
    for (p, _), n in route(capacity, members, {s: round(x) for s, x in wanted.items()}, costs).items():
        sent[p] += n
    plan, buckets, open_ = {}, {}, []
    for r in found:
        p = r["pattern"]
        times, rest = divmod(sent[p], capacity[p]) if capacity[p] else (0, 0)
        first = members[p][0] if members[p] else None
        buckets[p] = max(1, round(r["n"] / max(LEAST_BUCKET, r["n"] ** 0.5)))
        plan[p] = (times, sizes.get(first, 0), float(wanted.get(first, 0.0)))
        if rest:
            open_.append((p, buckets[p], -1, rest))

    # where the rest ends: sums by bucket of what isn't larger than it, and in the bucket that holds the end, document
    # by document; what that bucket can't fill goes on to those after it
    steps: dict[str, list[tuple[int, int, int]]] = {p: [] for p in plan}
    more = None
    while open_:
        now = spark.createDataFrame(open_, "pattern string, buckets long, past long, rest long")
        fits = slim.join(F.broadcast(now), "pattern").withColumn("bucket", _bucket(seed)).filter("bucket > past and size > 0 and size <= rest")
        sums = fits.groupBy("pattern", "bucket").agg(F.sum("size").alias("words"), F.first("rest").alias("rest"))
        sums = sums.selectExpr("*", "sum(words) over (partition by pattern order by bucket rows unbounded preceding) - words as before")
        ends = {r["pattern"]: (r["end"], r["room"]) for r in sums.filter("before <= rest and rest < before + words").selectExpr("pattern", "bucket as end", "rest - before as room").collect()}
        for p, n, past, rest in open_:
            steps[p].append((past, ends[p][0] if p in ends else n, rest))
        if not ends:
            break
        edge = spark.createDataFrame([(p, end, room) for p, (end, room) in ends.items()], "pattern string, end long, room long")
        last = fits.join(F.broadcast(edge), "pattern").filter("bucket = end").groupBy("pattern", "room", "id", "h", "size").agg(F.count("*").alias("n"))
        made = staged(last.groupBy("pattern").applyInPandas(_fill, "pattern string, id long, h long, more long, filled long"), "more")
        filled = {r["pattern"]: r["filled"] for r in made.groupBy("pattern").agg(F.sum("filled").alias("filled")).collect()}
        more = made if more is None else more.unionByName(made)
        open_ = [(p, buckets[p], end, room - filled[p]) for p, (end, room) in ends.items() if filled[p] < room and end + 1 < buckets[p]]

    rows = [(p, *plan[p], buckets[p], steps[p]) for p in plan]
    settled = spark.createDataFrame(rows, "pattern string, times long, source_size long, target double, buckets long, steps array<struct<past:long,end:long,rest:long>>")
    dealt = base.join(F.broadcast(settled), "pattern").withColumn("bucket", _bucket(seed))
    columns = ["doc", "size", "pattern", "source_size", "target"]
    whole_buckets = F.exists("steps", lambda x: (F.col("bucket") > x["past"]) & (F.col("bucket") < x["end"]) & (F.col("size") <= x["rest"]))
    if more is None:
        return dealt.select(*columns, (F.col("size") * (F.col("times") + whole_buckets.cast("long"))).alias("taken"))
    at_end = F.exists("steps", lambda x: F.col("bucket") == x["end"])
    out = dealt.filter(~at_end).select(*columns, (F.col("size") * (F.col("times") + whole_buckets.cast("long"))).alias("taken"))
    more = more.select(F.col("id").alias("m_id"), F.col("h").alias("m_h"), "more")
    edge = dealt.filter(at_end).join(more, F.col("h").eqNullSafe(F.col("m_h")) & F.col("id").eqNullSafe(F.col("m_id")), "left")
    return out.unionByName(edge.select(*columns, (F.col("size") * (F.col("times") + F.coalesce("more", F.lit(0)))).alias("taken")))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as it is taken."""
    taken = mix(docs, **options).filter("taken > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), (F.col("taken") / F.col("size")).cast("int"))))
    return taken.select(*[F.col(f"doc.`{c}`").alias(c) for c in docs.columns])
