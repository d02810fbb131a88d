"""Groups and ontologies as iterative joins (I*).

Loops write their state to the cluster's checkpoint folder each round (``settled``), so the plan stays short and a lost
executor costs a round.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.operators.aggregate import numbered
from evidentia.scratch import discard, settled


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``(id, label)`` for the ends of edges between different ids: the smallest id reachable.

    Each round points every node at its smallest neighbour (or itself, where that is smaller), follows the pointers once more and contracts
    the edges to what is pointed at.  A node that stays is pointed at by another at least, so no more than half of a round's nodes are left
    and the rounds end after log2 of their number.  A round's tables go when the next one's are written.
    """
    pairs = settled(edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).filter("a <> b").distinct())
    labels = None
    while True:
        ends = pairs.select("a", "b").union(pairs.select("b", "a"))
        point = settled(ends.groupBy(F.col("a").alias("id")).agg(F.least(F.col("a"), F.min("b")).alias("to")))
        jump = point.join(point.select(F.col("id").alias("to"), F.col("to").alias("then")), "to").select("id", F.col("then").alias("to"))
        if labels is None:
            new = settled(jump.withColumnRenamed("to", "label"))
        else:
            new = settled(labels.join(jump.withColumnRenamed("id", "label"), "label", "left").select("id", F.coalesce("to", "label").alias("label")))
        x, y = jump.select(F.col("id").alias("a"), F.col("to").alias("x")), jump.select(F.col("id").alias("b"), F.col("to").alias("y"))
        left = settled(pairs.join(x, "a").join(y, "b").filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        discard(pairs, labels, point)
        pairs, labels = left, new
        if pairs.isEmpty():
            discard(pairs)
            return labels


def unify_groups(df: DataFrame, id_col: str, groups: str, none: str = "U") -> DataFrame:
    """I1.  Rows that share a group token, directly or through others, share a group, named by the smallest token;
    rows whose only token is ``none`` stay apart."""
    tokens = df.select(id_col, F.explode(F.array_remove(groups, none)).alias("_t"))
    heads = tokens.groupBy(id_col).agg(F.min("_t").alias("_h"))
    labels = components(tokens.join(heads, id_col).filter("_t <> _h"), "_h", "_t")
    own = heads.join(labels.withColumnRenamed("id", "_h"), "_h", "left").select(id_col, F.coalesce("label", "_h").alias("group"))
    return df.join(own, id_col, "left").withColumn("group", F.coalesce("group", F.lit(none)))


#: A hierarchy of more ranks than this, or of few edges, is closed by doubling paths: that takes fewer rounds.
MOST_RANKS = 64
FEW_EDGES = 1 << 18


def _ranked(edges: DataFrame) -> tuple[DataFrame, dict[int, int]] | None:
    """Edges ``(node, parent, ..)`` with the child's rank ``_r``, the edges on its longest way up, and each rank's least rank of a parent; None if
    edges form a cycle or there are more than MOST_RANKS."""
    kids, found, n = settled(edges.select("node").distinct()), [], None
    while True:
        more = kids.count()
        if not more:
            break
        if more == n or len(found) == MOST_RANKS:
            discard(kids, *found)
            return None
        found.append(kids)
        kids, n = settled(edges.join(kids.select(F.col("node").alias("parent")), "parent", "left_semi").select("node").distinct()), more
    every = edges.sparkSession.createDataFrame([], kids.schema).withColumn("_r", F.lit(0))
    for r, t in enumerate(found, 1):
        every = every.unionByName(t.withColumn("_r", F.lit(r)))
    ranks = settled(every.groupBy("node").agg(F.max("_r").alias("_r")))
    made = settled(edges.join(ranks, "node").join(ranks.select(F.col("node").alias("parent"), F.col("_r").alias("_up")), "parent", "left").fillna(0, ["_up"]))
    discard(kids, ranks, *found)
    return made, {r["_r"]: r["low"] for r in made.groupBy("_r").agg(F.min("_up").alias("low")).collect()}  # a row for each rank


def _descended(edges: DataFrame, own: Column, value: Column, best) -> DataFrame | None:
    """``(node, ancestors, values)``: two lists for each node, itself (with ``own``) included.  A node's lists are made once, when those of all its parents
    are: ``best`` of ``value``, which is made of the parent's ``_v`` and the edge's columns.  What moves are lists, one for each edge; their elements
    are taken apart and joined where they lie.  None where ``_ranked`` is, and for few edges."""
    ranked = _ranked(edges) if edges.count() > FEW_EDGES else None
    if ranked is None:
        return None
    step, low = ranked
    more = [c for c in edges.columns if c not in ("node", "parent")]
    tops = edges.select(F.col("parent").alias("node")).distinct().join(edges.select("node"), "node", "left_anti")
    done = [settled(tops.select("node", F.array("node").alias("ancestors"), F.array(own).alias("values")))]
    for r in range(1, len(low) + 1):
        above = done[low[r]]
        for t in done[low[r] + 1 :]:
            above = above.unionByName(t)
        lists = step.filter(F.col("_r") == r).select("node", "parent", *more).join(above.withColumnRenamed("node", "parent"), "parent")
        each = lists.select("node", *more, "ancestors", "values").repartition("node")
        each = each.select("node", *more, F.explode(F.arrays_zip("ancestors", "values")).alias("_x")).select("node", *more, F.col("_x.ancestors").alias("_a"), F.col("_x.values").alias("_v"))
        each = each.groupBy("node", "_a").agg(best(value).alias("_v"))
        made = each.groupBy("node").agg(F.collect_list("_a").alias("ancestors"), F.collect_list("_v").alias("values"))
        done.append(settled(made.select("node", F.array_append("ancestors", F.col("node")).alias("ancestors"), F.array_append("values", own).alias("values"))))
    discard(step)
    every = done[0]
    for t in done[1:]:
        every = every.unionByName(t)
    return every


def closure(edges: DataFrame, child: str, parent: str) -> DataFrame:
    """I2, I3.  ``(node, ancestor, depth)`` for all ancestors by the shortest path.

    Along the ranks of a hierarchy, each node's ancestors are made once, of its parents' lists.  Where edges form a cycle, or ranks are many, paths
    double instead: what is farther than a round's length is reached over a node at exactly that length, so only such pairs are joined with what is known.
    """
    edges = settled(edges.select(F.col(child).alias("node"), F.col(parent).alias("parent")).filter("node <> parent").distinct())
    lists = _descended(edges, F.lit(0), F.col("_v") + 1, F.min)
    if lists is not None:
        each = lists.select("node", F.explode(F.arrays_zip("ancestors", "values")).alias("_x")).select("node", F.col("_x.ancestors").alias("ancestor"), F.col("_x.values").alias("depth"))
        return each.filter("depth > 0")
    pair, length = ["node", "ancestor"], 1
    known = settled(edges.select("node", F.col("parent").alias("ancestor"), F.lit(1).alias("depth")))
    while True:
        onward = known.select(F.col("node").alias("ancestor"), F.col("ancestor").alias("far"), F.col("depth").alias("more"))
        longer = known.filter(F.col("depth") == length).join(onward, "ancestor").select("node", F.col("far").alias("ancestor"), (F.col("depth") + F.col("more")).alias("depth"))
        found = settled(longer.groupBy(*pair).agg(F.min("depth").alias("depth")).join(known.select(*pair), pair, "left_anti"))
        if found.isEmpty():
            discard(found)
            return known
        grown = settled(known.unionByName(found))
        discard(known, found)
        known, length = grown, 2 * length


def reach(edges: DataFrame, child: str, parent: str, wanted: DataFrame, levels: int = 4) -> DataFrame:
    """I4, I7, I8.  ``(node, ancestor)`` for the ancestors in ``wanted(node)`` alone, without the closure.

    Each wanted node is a bit; what a node stands under is the union of its parents' bits and of those of them that are wanted.  Bits are
    pushed down from the wanted nodes, ``levels`` levels between two written tables, and only where they are news; a node's bits are rows of
    64, so that few ancestors cost little and many are no limit.
    """
    step = settled(edges.select(F.col(parent).alias("node"), F.col(child).alias("_child")).filter("node <> _child").distinct())
    chosen = numbered(wanted.select("node").distinct(), ["node"], "_bit")
    chosen = settled(chosen.select("node", F.floor(F.col("_bit") / 64).alias("_word"), F.expr("shiftleft(1L, cast(_bit % 64 as int))").alias("_bits")))
    known, fresh = None, chosen
    while True:
        at, found = fresh, None
        for _ in range(levels):
            at = at.join(step, "node").groupBy(F.col("_child").alias("node"), "_word").agg(F.bit_or("_bits").alias("_bits"))
            found = at if found is None else found.unionByName(at)
        found = found.groupBy("node", "_word").agg(F.bit_or("_bits").alias("_bits"))
        if known is not None:
            had = known.withColumnRenamed("_bits", "_had")
            found = found.join(had, ["node", "_word"], "left").withColumn("_bits", F.expr("_bits & ~coalesce(_had, 0L)")).filter("_bits <> 0").drop("_had")
        found = settled(found)
        if found.isEmpty():
            break
        grown = found if known is None else settled(known.unionByName(found).groupBy("node", "_word").agg(F.bit_or("_bits").alias("_bits")))
        if known is not None:
            discard(known)
        if fresh is not chosen and fresh is not known:
            discard(fresh)
        known, fresh = grown, found
    if known is None:
        return chosen.select("node", F.col("node").alias("ancestor")).limit(0)
    each = known.join(chosen.select(F.col("node").alias("ancestor"), "_word", F.col("_bits").alias("_one")), "_word")
    return each.filter(F.expr("_bits & _one") != 0).select("node", "ancestor")


def n_descendants(closed: DataFrame) -> DataFrame:
    """I2.  How many nodes each node stands above."""
    return closed.groupBy(F.col("ancestor").alias("node")).agg(F.count("*").alias("n_children"))


def _edges_above(edges: DataFrame, start: DataFrame, most: int | None = None, steps: int = 4) -> DataFrame | None:
    """``(_c, node, parent)``: for each label ``_c`` of ``start(_c, node)`` the edges above its nodes, once for all of them, ``steps`` levels between two
    written tables; None where they go up more than ``most`` levels."""
    fresh, known, made, depth = settled(start.select("_c", "node").distinct()), None, None, 0
    while True:
        at, rows = fresh, None
        for _ in range(steps):
            step = at.join(edges, "node").select("_c", "node", "parent")
            rows = step if rows is None else rows.unionByName(step)
            at = step.select("_c", F.col("parent").alias("node")).distinct()
        found = settled(rows.distinct())
        made = found if made is None else made.unionByName(found)
        had = found.select("_c", "node").distinct()
        known = had if known is None else known.unionByName(had)
        # those whose edges aren't there yet; nodes without any bring nothing more
        fresh = settled(found.select("_c", F.col("parent").alias("node")).distinct().join(known, ["_c", "node"], "left_anti").join(edges.select("node"), "node", "left_semi"))
        depth += steps
        if fresh.isEmpty():
            return made
        if most is not None and depth >= most:
            return None


#: Words of bits by edges that a task takes at once, and the edges above a chunk up to which a task gets them all.
BITS_AT_ONCE, MOST_ABOVE = 1 << 22, 1 << 22


def _counted(rows: pd.DataFrame) -> pd.DataFrame:
    """How many of a chunk's nodes (``own``) each node of ``(node, parent, own)`` stands above: a bit for each, carried up until nothing is news."""
    of, names = pd.factorize(pd.concat([rows["node"], rows["parent"]], ignore_index=True))
    u, v = of[: len(rows)], of[len(rows) :]
    order = np.argsort(v, kind="stable")
    u, v, own = u[order], v[order], np.unique(u[rows["own"].to_numpy(bool)])
    count, step = np.zeros(len(names), np.int64), 64 * max(1, min(64, BITS_AT_ONCE // len(u)))
    for s in range(0, len(own), step):
        part = own[s : s + step]
        mine = np.zeros((len(names), -(-len(part) // 64)), np.uint64)
        bit = np.arange(len(part))
        mine[part, bit // 64] = np.uint64(1) << (bit % 64).astype(np.uint64)
        below, news = np.zeros_like(mine), np.zeros(len(names), bool)
        news[part] = True
        while news.any():
            e = np.flatnonzero(news[u])
            if not len(e):
                break
            first = np.flatnonzero(np.r_[True, v[e][1:] != v[e][:-1]])
            to = v[e][first]
            grown = below[to] | np.bitwise_or.reduceat(below[u[e]] | mine[u[e]], first, axis=0)
            news = np.zeros(len(names), bool)
            news[to] = (grown != below[to]).any(1)
            below[to] = grown
        count += np.bitwise_count(below).sum(1, dtype=np.int64)
    return pd.DataFrame({"node": names[count > 0], "_n": count[count > 0]})


def descendant_counts(edges: DataFrame, child: str, parent: str, chunk: int = 4096) -> DataFrame:
    """I2.  ``n_descendants`` of the closure without its pairs: ``(node, n_children)``.

    Nodes are dealt into chunks, those with the same parents side by side.  A chunk takes the edges above it, each once for all of its nodes, and
    a task counts with a bit for each node how many of them stand below each ancestor; a node's counts are then summed up.  Chunks share
    their ancestors, so a fraction of the closure's rows moves, and never more.  Where edges go up more than MOST_RANKS levels (or in circles
    that long), or a chunk has more than MOST_ABOVE edges above it, the closure is made.
    """
    edges = settled(edges.select(F.col(child).alias("node"), F.col(parent).alias("parent")).filter("node <> parent").distinct())
    ends = edges.groupBy("node").agg(F.min("parent").alias("_low"), F.max("parent").alias("_high"))
    dealt = numbered(ends, ["_low", "_high", "node"], "_i").select("node", F.floor(F.col("_i") / chunk).cast("int").alias("_c"))
    dealt = settled(dealt)
    above = _edges_above(edges, dealt, MOST_RANKS)
    if above is None or (above.groupBy("_c").count().agg(F.max("count")).first()[0] or 0) > MOST_ABOVE:
        return n_descendants(closure(edges, "node", "parent"))
    mine = dealt.withColumn("own", F.lit(True))
    rows = above.join(mine, ["_c", "node"], "left").select("_c", "node", "parent", F.coalesce("own", F.lit(False)).alias("own"))
    each = rows.groupBy("_c").applyInPandas(_counted, f"node {dict(edges.dtypes)['parent']}, _n long")
    return each.groupBy("node").agg(F.sum("_n").alias("n_children"))


def levels(closed: DataFrame, roots: DataFrame) -> DataFrame:
    """I3.  The least depth below any root; roots have 0."""
    below = closed.join(roots.select(F.col("node").alias("ancestor")), "ancestor").groupBy("node").agg(F.min("depth").alias("level"))
    return below.unionByName(roots.select("node", F.lit(0).alias("level"))).groupBy("node").agg(F.min("level").alias("level"))


def levels_below(edges: DataFrame, child: str, parent: str, roots: DataFrame, steps: int = 4) -> DataFrame:
    """I3.  ``levels`` without the closure: depths are pushed down from the roots, ``steps`` levels between two written tables, each node's once."""
    step = settled(edges.select(F.col(parent).alias("node"), F.col(child).alias("_child")).filter("node <> _child").distinct())
    known = fresh = settled(roots.select("node", F.lit(0).alias("level")).distinct())
    depth = 0
    while True:
        at, found = fresh.select("node"), None
        for k in range(depth + 1, depth + steps + 1):
            at = at.join(step, "node").select(F.col("_child").alias("node")).distinct()
            made = at.withColumn("level", F.lit(k))
            found = made if found is None else found.unionByName(made)
        found = settled(found.groupBy("node").agg(F.min("level").alias("level")).join(known.select("node"), "node", "left_anti"))
        if found.isEmpty():
            discard(step, found)
            return known
        depth += steps
        grown = settled(known.unionByName(found))
        discard(known)
        fresh, known = found.filter(F.col("level") == depth), grown


def map_to_slim(closed: DataFrame, slim: DataFrame, direct: bool = False) -> DataFrame:
    """I4.  ``closed`` is the closure, or what ``reach`` gives for the slim.  ``(node, slim)``: ancestors (or the node itself) in the slim; ``direct``: none that is above another of them."""
    own = slim.select("node", F.col("node").alias("slim"))
    hits = closed.select("node", F.col("ancestor").alias("slim")).join(slim.select(F.col("node").alias("slim")), "slim").select("node", "slim").unionByName(own)
    if not direct:
        return hits
    above = closed.select(F.col("node").alias("lower"), F.col("ancestor").alias("slim"))
    beaten = hits.select("node", F.col("slim").alias("lower")).join(above, "lower").select("node", "slim").distinct()
    return hits.join(beaten, ["node", "slim"], "left_anti")


def semantic_sets(edges: DataFrame, child: str, parent: str, weight: Column | float = 0.8) -> DataFrame:
    """I5.  ``semantic_values`` as two lists for each node, ``(node, ancestors, values)``."""
    w = weight if isinstance(weight, Column) else F.lit(float(weight))
    step = settled(edges.select(F.col(child).alias("node"), F.col(parent).alias("parent"), w.alias("w")).groupBy("node", "parent").agg(F.max("w").alias("w")))
    lists = _descended(step, F.lit(1.0), F.col("_v") * F.col("w"), F.max)
    return _packed(_values_by_paths(step.withColumnsRenamed({"node": "ancestor", "parent": "up"}))) if lists is None else lists


def semantic_values(edges: DataFrame, child: str, parent: str, weight: Column | float = 0.8) -> DataFrame:
    """I5.  ``(node, ancestor, s)``: the best product of weights over paths, 1 for the node itself (Wang's S-values)."""
    each = semantic_sets(edges, child, parent, weight).select("node", F.explode(F.arrays_zip("ancestors", "values")).alias("_x"))
    return each.select("node", F.col("_x.ancestors").alias("ancestor"), F.col("_x.values").alias("s"))


def _packed(values: DataFrame) -> DataFrame:
    return values.groupBy("node").agg(F.collect_list("ancestor").alias("ancestors"), F.collect_list("s").alias("values"))


def _values_by_paths(step: DataFrame) -> DataFrame:
    """S-values over edges ``(ancestor, up, w)`` of any depth: weights are below 1, so values settle at every depth."""
    nodes = step.select(F.col("ancestor").alias("node")).union(step.select("up")).distinct()
    known = settled(nodes.select("node", F.col("node").alias("ancestor"), F.lit(1.0).alias("s")))
    frontier = known
    while True:
        reached = frontier.join(step, "ancestor").select("node", F.col("up").alias("ancestor"), (F.col("s") * F.col("w")).alias("s"))
        reached = reached.groupBy("node", "ancestor").agg(F.max("s").alias("s"))
        better = reached.join(known.withColumnRenamed("s", "had"), ["node", "ancestor"], "left").filter("had is null or s > had").drop("had")
        found = settled(better)
        if frontier is not known:
            discard(frontier)
        if found.isEmpty():
            return known
        grown = settled(known.unionByName(found).groupBy("node", "ancestor").agg(F.max("s").alias("s")))
        discard(known)
        frontier, known = found, grown


def wang_similarity(values: DataFrame, pairs: DataFrame, a: str, b: str) -> DataFrame:
    """I6.  Term similarity: the S-values of common ancestors over both terms' totals; ``values`` are those of ``semantic_sets`` or of ``semantic_values``.

    A pair gets both terms' lists; their elements are taken apart and meet where the pair lies."""
    lists = values if "ancestors" in values.columns else _packed(values)
    known = pairs.select(a, b).distinct()
    both = None
    for c in (a, b):
        side = known.join(lists.withColumnRenamed("node", c), c).select(a, b, "ancestors", "values")
        both = side if both is None else both.unionByName(side)
    each = both.repartition(a, b).select(a, b, F.explode(F.arrays_zip("ancestors", "values")).alias("_x")).select(a, b, F.col("_x.ancestors").alias("_a"), F.col("_x.values").alias("_s"))
    # an ancestor of both terms comes twice; each term itself shows that its list is there
    met = each.groupBy(a, b, "_a").agg(F.sum("_s").alias("_s"), F.count("*").alias("_n"))
    top = met.groupBy(a, b).agg(F.sum(F.when(F.col("_n") > 1, F.col("_s"))).alias("_top"), F.sum("_s").alias("_v"), F.max(F.col("_a") == F.col(a)).alias("_ina"), F.max(F.col("_a") == F.col(b)).alias("_inb"))
    top = top.filter("_ina and _inb").select(a, b, (F.coalesce("_top", F.lit(0.0)) / F.col("_v")).alias("similarity"))
    return pairs.join(top, [a, b]).select(a, b, "similarity")


#: Pairs of a chunk that are compared at once, with all that stands above them.
PAIRS_AT_ONCE = 128


def _similar(rows: pd.DataFrame) -> pd.DataFrame:
    """The similarity of a chunk's pairs ``(node, parent, pair)`` from the edges above them ``(node, parent, w)``: a column of S-values for each term, carried up
    until nothing is news."""
    of, names = pd.factorize(pd.concat([rows["node"], rows["parent"]], ignore_index=True))
    pair = rows["pair"].to_numpy(bool)
    u, v, w = of[: len(rows)][~pair], of[len(rows) :][~pair], rows["w"].to_numpy(float)[~pair]
    order = np.argsort(v, kind="stable")
    u, v, w = u[order], v[order], w[order]
    a, b = of[: len(rows)][pair], of[len(rows) :][pair]
    order = np.lexsort((b, names[a]))
    a, b = a[order], b[order]
    out = np.empty(len(a))
    for s in range(0, len(a), PAIRS_AT_ONCE):
        own, at = np.unique(np.concatenate([a[s : s + PAIRS_AT_ONCE], b[s : s + PAIRS_AT_ONCE]]), return_inverse=True)
        held = np.zeros(len(names), bool)
        held[own] = True
        fresh = held.copy()
        while fresh.any():
            up = np.zeros(len(names), bool)
            up[v[fresh[u]]] = True
            fresh = up & ~held
            held |= fresh
        place = np.cumsum(held) - 1
        edge = np.flatnonzero(held[u])
        x, y, k = place[u[edge]], place[v[edge]], w[edge]
        values = np.full((int(held.sum()), len(own)), np.nan)
        values[place[own], np.arange(len(own))] = 1.0
        news = np.zeros(len(values), bool)
        news[place[own]] = True
        while (e := np.flatnonzero(news[x])).size:
            first = np.flatnonzero(np.r_[True, y[e][1:] != y[e][:-1]])
            to = y[e][first]
            had = values[to]
            grown = np.fmax(had, np.fmax.reduceat(values[x[e]] * k[e, None], first, axis=0))
            news = np.zeros(len(values), bool)
            news[to] = ((grown > had) | (np.isnan(had) & ~np.isnan(grown))).any(1)
            values[to] = grown
        p, q = at[: len(at) // 2], at[len(at) // 2 :]
        total = np.nansum(values, 0)
        top = np.nansum(values[:, p] + values[:, q], 0)  # of ancestors that both have
        out[s : s + PAIRS_AT_ONCE] = top / (total[p] + total[q])
    return pd.DataFrame({"node": names[a], "parent": names[b], "similarity": out})


def similarity_above(edges: DataFrame, child: str, parent: str, pairs: DataFrame, a: str, b: str, weight: Column | float = 0.8, chunk: int = 4096) -> DataFrame:
    """I6.  ``wang_similarity`` of the pairs over ``semantic_sets``, without making these.

    Pairs are dealt into chunks in their order; a chunk takes the edges above its terms, each once for all of them, and a task carries S-values up
    along these.  Neighbours share most of their ancestors, so a fraction of the lists moves.  Where edges go up more than MOST_RANKS levels, or a
    chunk has more than MOST_ABOVE edges above it, the lists are made.
    """
    w = weight if isinstance(weight, Column) else F.lit(float(weight))
    step = settled(edges.select(F.col(child).alias("node"), F.col(parent).alias("parent"), w.alias("w")).groupBy("node", "parent").agg(F.max("w").alias("w")))
    nodes = step.select("node").union(step.select("parent")).distinct()
    known = pairs.select(F.col(a).alias("_a"), F.col(b).alias("_b")).distinct()
    known = known.join(nodes.withColumnRenamed("node", "_a"), "_a", "left_semi").join(nodes.withColumnRenamed("node", "_b"), "_b", "left_semi")
    dealt = settled(numbered(known, ["_a", "_b"], "_i").select("_a", "_b", F.floor(F.col("_i") / chunk).cast("int").alias("_c")))
    start = dealt.select("_c", F.col("_a").alias("node")).union(dealt.select("_c", "_b"))
    above = _edges_above(step.filter("node <> parent").select("node", "parent"), start, MOST_RANKS)
    if above is None or (above.groupBy("_c").count().agg(F.max("count")).first()[0] or 0) > MOST_ABOVE:
        return wang_similarity(semantic_sets(edges, child, parent, weight), pairs, a, b)
    kind = dict(step.dtypes)["node"]
    rows = above.join(step, ["node", "parent"]).select("_c", "node", "parent", "w", F.lit(False).alias("pair"))
    rows = rows.unionByName(dealt.select("_c", F.col("_a").alias("node"), F.col("_b").alias("parent"), F.lit(None).cast("double").alias("w"), F.lit(True).alias("pair")))
    made = rows.groupBy("_c").applyInPandas(_similar, f"node {kind}, parent {kind}, similarity double").withColumnsRenamed({"node": a, "parent": b})
    return pairs.join(made, [a, b]).select(a, b, "similarity")


#: Products of entities by their best matches that are summed at once, terms of a block of entities, and its entities.
PRODUCTS_AT_ONCE, MOST_TERMS, MOST_ENTITIES = 1 << 21, 1 << 22, 4096


def _mean_matches(key: tuple[Any, ...], frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Mean best matches between two blocks of entities, or within one, of rows ``(_x, _y, _m, _turned)``: a term's entities of one block, and those of the
    other with their best match with it; ``_turned``, where the first are the second block's."""
    alone, parts = key[0] == key[1], []
    for f in frames:
        for turned in (False, True):
            own = f[f["_turned"] == turned]
            if len(own):
                sizes = [own[c].map(len).to_numpy() for c in ("_x", "_y")]
                x, y, m = (np.concatenate(own[c].tolist()) for c in ("_x", "_y", "_m"))
                parts.append((turned, *sizes, x, y, m))
    side = lambda turn: pd.unique(np.concatenate([p[4 if p[0] == turn else 3] for p in parts]))
    low, high = side(True), side(False)
    low, high = (np.sort(pd.unique(np.concatenate([low, high]))),) * 2 if alone else (np.sort(low), np.sort(high))
    total, n = np.zeros(len(low) * len(high)), np.zeros(len(low) * len(high), np.int64)
    for turned, many, few, x, y, m in parts:
        x, y = (np.searchsorted(high, x), np.searchsorted(low, y) * len(high)) if turned else (np.searchsorted(low, x) * len(high), np.searchsorted(high, y))
        each = np.repeat(few, many)  # matches that an entry of x meets
        start = np.repeat(np.cumsum(few) - few, many)
        done = np.cumsum(each)
        s = 0
        while s < len(x):
            e = max(s + 1, int(np.searchsorted(done, (done[s - 1] if s else 0) + PRODUCTS_AT_ONCE, "right")))
            k = each[s:e]
            at = np.arange(k.sum()) + np.repeat(start[s:e] - (np.cumsum(k) - k), k)
            cell = np.repeat(x[s:e], k) + y[at]
            np.add.at(total, cell, m[at])
            np.add.at(n, cell, 1)
            s = e
    total, n = total.reshape(len(low), len(high)), n.reshape(len(low), len(high))
    if alone:
        total, n = np.triu(total + total.T, 1), np.triu(n + n.T, 1)
    step = max(1, (1 << 20) // len(high))
    for s in range(0, len(low), step):
        i, j = np.nonzero(n[s : s + step])
        if len(i):
            yield pd.DataFrame({"e1": low[s + i], "e2": high[j], "similarity": total[s + i, j] / n[s + i, j]})


def best_match_average(terms: DataFrame, similarity: DataFrame, entity: str, term: str, a: str, b: str, most: int = MOST_ENTITIES) -> DataFrame:
    """I6.  Entity similarity over given term pairs: the mean of every term's best match, both ways.

    A term's entities, and those that match it with their best matches, are lists; entities are dealt into blocks by their order, and a pair of blocks gets
    the lists of the terms that both have.  A task sums up its products, so only lists are shuffled, not a row for each term and pair of entities."""
    terms = terms.select(F.col(entity).alias("_e"), F.col(term).alias("_t")).filter("_e is not null")
    names = numbered(terms.select("_e").distinct(), ["_e"], "_i")
    n = names.count()
    size = max(64, min(most, MOST_TERMS * n // max(1, terms.count()), -(-n // 12)))
    blocks = settled(names.select("_e", F.floor(F.col("_i") / size).cast("int").alias("_block")))
    lists = terms.join(blocks, "_e").repartition("_t").groupBy("_t", "_block").agg(F.collect_set("_e").alias("_x"))
    both = similarity.select(F.col(a).alias("_t"), F.col(b).alias("_u"), "similarity").union(similarity.select(b, a, "similarity"))
    near = both.join(lists.withColumnsRenamed({"_t": "_u", "_block": "_of"}), "_u").select("_t", "_of", "similarity", "_x").repartition("_t")
    best = near.select("_t", "_of", "similarity", F.explode("_x").alias("_y")).groupBy("_t", "_of", "_y").agg(F.max("similarity").alias("_m"))
    best = best.groupBy("_t", "_of").agg(F.collect_list("_y").alias("_y"), F.collect_list("_m").alias("_m"))
    met = lists.join(best, "_t").select(F.least("_block", "_of").alias("_i"), F.greatest("_block", "_of").alias("_j"), "_x", "_y", "_m", (F.col("_block") > F.col("_of")).alias("_turned"))
    kind = dict(terms.dtypes)["_e"]
    made = met.groupBy("_i", "_j").applyInPandas(_mean_matches, f"e1 {kind}, e2 {kind}, similarity double")
    return made.select(F.least("e1", "e2").alias("e1"), F.greatest("e1", "e2").alias("e2"), "similarity")


def select_parents(closed: DataFrame, level: DataFrame, n: int, min_level: int = 2) -> DataFrame:
    """I7.  Up to n representative terms: those with at most 1/n of all terms below them and deep enough, greedily by the
    number below them, passing over what stands under a chosen one.  Each of the n rounds takes the best that is left by
    one aggregate; only it reaches the driver.
    """
    total = level.count()
    left = n_descendants(closed).join(level, "node").filter((F.col("n_children") <= total / n) & (F.col("level") >= min_level))
    left, chosen = settled(left.select("node", "n_children")), []
    for _ in range(n):
        best = left.agg(F.min_by("node", F.struct(-F.col("n_children"), F.col("node"))).alias("node")).first()["node"]
        if best is None:
            break
        chosen.append(best)
        under = closed.filter(F.col("ancestor") == best).select("node")
        left = settled(left.filter(F.col("node") != best).join(under, "node", "left_anti"))
    return closed.sparkSession.createDataFrame([(c,) for c in chosen], level.select("node").schema)


def representative_parents(edges: DataFrame, child: str, parent: str, level: DataFrame, n: int, min_level: int = 2, at_once: int = 256) -> DataFrame:
    """I7.  ``select_parents`` without the closure.

    What stands above a node has more below it (or is in a circle with it), so the first ``at_once`` nodes by number below are taken greedily as soon as
    it is known which of them stand under which.  Only where that isn't enough, what stands under the chosen ones goes, and the next follow.
    """
    edges = settled(edges.select(F.col(child).alias("node"), F.col(parent).alias("parent")).filter("node <> parent").distinct())
    total, chosen = level.count(), []
    left = descendant_counts(edges, "node", "parent").join(level, "node").filter((F.col("n_children") <= total / n) & (F.col("level") >= min_level))
    left = settled(left.select("node", "n_children"))
    while len(chosen) < n:
        top = settled(left.orderBy(F.desc("n_children"), "node").limit(at_once))
        rows = [r["node"] for r in top.orderBy(F.desc("n_children"), "node").collect()]  # at_once rows
        walked = _edges_above(edges, top.select(F.col("node").alias("_c"), "node")).select("_c", F.col("parent").alias("node")).distinct()
        under: dict = {}
        for r in walked.join(top.select("node"), "node", "left_semi").collect():  # pairs of these rows
            under.setdefault(r["_c"], set()).add(r["node"])
        new: list = []
        for x in rows:
            if len(chosen) + len(new) < n and not under.get(x, set()).intersection(new):
                new.append(x)
        chosen += new
        if len(rows) < at_once or len(chosen) == n:
            break
        found = edges.sparkSession.createDataFrame([(c,) for c in new], level.select("node").schema)
        gone = reach(edges, "node", "parent", found).select("node").unionByName(top.select("node"))
        left = settled(left.join(gone, "node", "left_anti"))
    return edges.sparkSession.createDataFrame([(c,) for c in chosen], level.select("node").schema)


def assign_category(items: DataFrame, item: str, term: str, mapping: DataFrame, parent: str, priority: list | None = None) -> DataFrame:
    """I8.  The parent that most of an item's terms map to; a priority parent wins outright, ties go to the smaller;
    ``other`` if no term maps, ``unknown`` if there is no term."""
    terms = items.select(item, F.explode(term).alias("_t"))
    n = terms.join(mapping.select(F.col("node").alias("_t"), parent), "_t").groupBy(item, parent).agg(F.count("*").alias("_n"))
    first = F.col(parent).isin(priority or []).cast("int")
    best = n.groupBy(item).agg(F.min_by(parent, F.struct(-first, -F.col("_n"), F.col(parent))).alias(parent))
    out = items.join(best.select(item, F.col(parent).cast("string").alias("category")), item, "left")
    return out.withColumn("category", F.coalesce("category", F.when(F.coalesce(F.size(term), F.lit(0)) > 0, "other").otherwise("unknown")))


def category_counts(assigned: DataFrame, ontology: str, category: str = "category", missing: str = "unknown") -> DataFrame:
    """I8.  One row for each category with its number of items by ontology (columns), and ``n_missing``: items of that ontology without a
    term, repeated in each row's total ``n``."""
    names = sorted(r[0] for r in assigned.select(ontology).distinct().collect())  # one for each ontology
    counts = assigned.groupBy(category).pivot(ontology, names).agg(F.count(F.lit(1))).fillna(0, names)
    gone = assigned.agg(F.count_if(F.col(category) == missing).alias("n_missing"))
    total = sum((F.col(f"`{n}`") for n in names), F.lit(0).cast("long"))
    return counts.withColumn("n", total).join(F.broadcast(gone))  # one row


def has_any(terms: Column, wanted: Column) -> Column:
    """I9."""
    return F.arrays_overlap(terms, wanted)


def has_all(terms: Column, wanted: Column) -> Column:
    """I9."""
    return F.size(F.array_except(wanted, terms)) == 0


def term_info(df: DataFrame, term: str, terms: DataFrame) -> DataFrame:
    """I10.  Name and namespace of a term; null where it is unknown or obsolete."""
    known = terms.filter(~F.coalesce("obsolete", F.lit(False))).select(F.col("id").alias(term), "name", "namespace")
    return df.join(known, term, "left")


def pathway_completeness(nodes: DataFrame, pathway: str, name: str, found: DataFrame) -> DataFrame:
    """I11.  Share of a pathway's nodes that are found."""
    hit = nodes.join(found.select(name).distinct().withColumn("_f", F.lit(1)), name, "left")
    return hit.groupBy(pathway).agg(F.count("*").alias("n_nodes"), F.count("_f").alias("n_found"), (F.count("_f") / F.count("*")).alias("completeness"))


def overlap_coefficient(groups: DataFrame, group: str, sets: DataFrame, set_name: str, member: str, least: float = 50.0) -> DataFrame:
    """I12.  |A & B| / min(|A|, |B|) in percent, pairs over the threshold."""
    a, b = groups.select(group, member).distinct(), sets.select(set_name, member).distinct()
    both = a.join(b, member).groupBy(group, set_name).agg(F.count("*").alias("_n"))
    sized = both.join(a.groupBy(group).agg(F.count("*").alias("_na")), group).join(b.groupBy(set_name).agg(F.count("*").alias("_nb")), set_name)
    return sized.select(group, set_name, (F.col("_n") * 100 / F.least("_na", "_nb")).alias("overlap")).filter(F.col("overlap") > least)


def generic_terms(closed: DataFrame, names: DataFrame, level: DataFrame, min_level: int = 3, min_variants: int = 5) -> DataFrame:
    """I13.  Terms with many descendants that share at least one word with their name."""
    words = names.select("node", F.array_distinct(F.split(F.lower("name"), r"\W+")).alias("w"))
    pairs = closed.join(words, "node").join(words.select(F.col("node").alias("ancestor"), F.col("w").alias("wa")), "ancestor")
    n = pairs.filter(F.size(F.array_intersect("w", "wa")) > 0).groupBy(F.col("ancestor").alias("node")).agg(F.count("*").alias("n_variants"))
    return n.join(level, "node").filter((F.col("level") > min_level) & (F.col("n_variants") > min_variants))
