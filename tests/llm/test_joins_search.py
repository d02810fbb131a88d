"""Fill-in-middle, the n-gram join and ranked search: against plain versions and on edge cases."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from evidentia.llm import fim, part_enum, ranked_search
from evidentia.llm.part_enum import Scheme, bands_of, signatures, similar_documents
from evidentia.llm.sketching import WordHasher, shingle_set


def plain_fim(doc_id, text, unit, seed=7, fim_percent=100, spm_percent=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text) if unit == "line" else list(text)
    n, h = len(units), fim.draws(doc_id, seed)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= fim_percent:
        return n, "plain", None, None, text
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if h[3] % 100 < spm_percent:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("unit", ["line", "code point"])
def test_fill_in_middle_plain(spark, unit):
    rng = random.Random(1)
    texts = ["".join(rng.choices("ab\n\né日\U0001f389<P>S ", k=rng.randrange(60))) for _ in range(600)] + ["\n", "a", "\n\n", "", None, "x" * 300_000 + "\n" + "é\n" * 70_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    made = fim.fill_in_middle(df, unit, fim_percent=90, spm_percent=30)
    got = {r["doc_id"]: r for r in made.withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()}
    for i, text in enumerate(texts):
        r = got[i]
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == plain_fim(i, text, unit, 7, 90, 30)
        assert r["back"] == (text or "")
    assert {r["form"] for r in got.values()} == {"plain", "psm", "spm"}


def test_fill_in_middle_edges(edges, nothing):
    got = fim.fill_in_middle(edges).collect()
    assert len(got) == edges.count() and {r["n"] for r in got if r["doc_id"] in (3, 4)} == {0}
    assert all(r["output"] == plain_fim(r["doc_id"], e["text"], "line")[4] for r, e in zip(got, edges.collect(), strict=True))
    assert fim.fill_in_middle(nothing).count() == 0
    with pytest.raises(ValueError):
        fim.fill_in_middle(edges, "word")


def test_marks_rank_and_select():
    raw = np.frombuffer(("a\n\n" + "é" * 9 + "\n" + "x" * 20 + "\n").encode() * 50, np.uint8)
    marks = fim.Marks(fim.feeds(fim._words(raw)))
    at = np.flatnonzero(raw == 10)
    assert (marks.select(np.arange(1, len(at) + 1)) == at).all()
    assert (marks.rank(np.arange(len(raw) + 1)) == np.concatenate(([0], np.cumsum(raw == 10)))).all()


def test_fill_in_middle_pieces(monkeypatch):
    """Results don't depend on how a batch is cut."""
    texts = pa.array(["one\ntwo\n" * i for i in range(40)]).cast(pa.large_binary())
    whole = fim._transformed(list(range(40)), texts, "line", 7, 100, 50)
    monkeypatch.setattr(fim, "PIECE", 100)
    parts = [fim._transformed(list(range(a, b)), texts[a:b], "line", 7, 100, 50) for a, b in fim._slices(texts)]
    assert len(parts) > 20 and pa.Table.from_batches(parts).to_pylist() == whole.to_pylist()


@pytest.mark.parametrize("scheme", [Scheme(90, 100), Scheme(90, 100, k2=2, n2=6, seed=2), Scheme(80, 100)])
def test_similar_sets_share_a_signature(scheme):
    rng = np.random.default_rng(3)
    for size in [*range(1, 60), 100, 333, 1000, 5000]:
        for _ in range(12):
            a = rng.integers(0, 2**63, size, dtype=np.uint64)
            # as far apart as the threshold lets them be: some elements replaced, or more added
            swap = (scheme.den - scheme.num) * size // (scheme.den + scheme.num)
            add = (scheme.den - scheme.num) * size // scheme.num
            b = np.concatenate((a[swap:], rng.integers(0, 2**63, swap, dtype=np.uint64)))
            c = np.concatenate((a, rng.integers(0, 2**63, add, dtype=np.uint64)))
            for x in (b, c):
                u, v = np.unique(a), np.unique(x)
                if (u == v).all() if len(u) == len(v) else False:
                    continue
                assert set(signatures(u, scheme)) & set(signatures(v, scheme)), size


def test_bands_overlap_where_similar_sets_may_meet():
    s = Scheme(90, 100)
    for n in range(1, 3000):
        for m in range(n, n * 10 // 9 + 1):
            a, b = dict(bands_of(n, s)), dict(bands_of(m, s))
            assert any(a.get(k) == r and max(n, m) <= r for k, r in b.items()), (n, m)


def test_similar_documents_brute(docs):
    want = brute.components({r["doc_id"]: r["text"] for r in docs.collect()}, 3, 90)
    got = similar_documents(docs).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert {r["doc_id"]: r["n_shingles"] for r in got} == {r["doc_id"]: len(brute.shingles(r["text"], 3)) for r in docs.collect()}


def test_similar_documents_hard_group(spark):
    """Chains, near misses and one passage that many hold: links that hang on no bucket's first."""
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(10**6)}"
    rows, i = [], 0
    for n in (12, 30, 80, 300):
        own = [word() for _ in range(n)]
        for _ in range(60):  # each differs a little more from the one before
            at = rng.randrange(n)
            own = [*own[:at], word(), *own[at + 1 :]] if rng.random() < 0.7 else [*own, word()]
            rows.append((i := i + 1, " ".join(own)))
    head = " ".join(word() for _ in range(90))
    rows += [((i := i + 1), head + " " + " ".join(word() for _ in range(n))) for n in (0, 1, 2, 5, 8, 12, 20, 30) for _ in range(20)]
    rows += [((i := i + 1), "a b c"), ((i := i + 1), "A b C"), ((i := i + 1), "a b"), ((i := i + 1), "a  B")]
    rng.shuffle(rows)
    got = {r["doc_id"]: r["component_id"] for r in similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute.components(dict(rows), 3, 90) and len(set(got.values())) < len(got)


def test_similar_documents_last_step(spark, monkeypatch):
    """Blocks, with signatures so coarse that nearly all texts share a bucket."""
    monkeypatch.setattr(part_enum, "BLOCK", 8)
    monkeypatch.setattr(part_enum, "signatures", lambda own, s: np.array([len(own) // 40], np.int64))
    rng = random.Random(6)
    own, rows = [f"w{j}" for j in range(60)], []
    for i in range(60):
        at = rng.randrange(60)
        own = [*own[:at], f"x{i}", *own[at + 1 :]]
        rows.append((i, " ".join(own)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    texts = df.selectExpr("doc_id", "text", "xxhash64(text) as version")
    sets = {i: shingle_set(t, 3, WordHasher()) for i, t in rows}
    classes = spark.createDataFrame(
        [(i, len(s), (i, df.sparkSession.sql(f"select xxhash64('{dict(rows)[i]}')").first()[0]), [1]) for i, s in sets.items()],
        "id long, n_shingles long, first struct<doc_id: long, version: long>, keys array<long>",
    )
    monkeypatch.setattr(part_enum, "_signed", lambda s: lambda batches: (b[["id"]].assign(key=1)[["key", "id"]] for b in batches))
    got = {r["id"]: r["label"] for r in part_enum._links(classes, texts, 3, Scheme(90, 100), Scheme(90, 100)).collect()}
    want = brute.components(dict(rows), 3, 90)
    assert {i: got.get(i, i) for i in sets} == want


def test_similar_documents_edges(edges, nothing, spark):
    got = similar_documents(edges).collect()
    assert len(got) == edges.count()
    assert {r["component_id"] for r in got if r["doc_id"] in (1, 2)} == {1} and {r["component_id"] for r in got if r["doc_id"] in (6, 7)} == {6}
    assert all(r["n_shingles"] == 0 and r["component_id"] == r["doc_id"] for r in got if r["doc_id"] in (3, 4, 5))
    assert all(r["component_id"] is None for r in got if r["doc_id"] is None)
    assert similar_documents(nothing).count() == 0
    df = spark.createDataFrame([(5, "a b c d"), (7, "a b c d"), (7, "e f g"), (9, "E f g"), (9, None)], "doc_id long, text string")
    assert {r["component_id"] for r in similar_documents(df).collect()} == {5}


def plain_search(docs, items, k):
    own = [(i, Counter(re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")))) for i, t in docs]
    own = [(i, c, sum(c.values())) for i, c in own if c]
    n_docs, n_all, df = len(own), sum(n for _, _, n in own), Counter(t for _, c, _ in own for t in c)
    out = []
    for item, text in items:
        scores = []
        q = set(re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")))
        for i, c, n in own:
            m = 50 + 50 * n * n_docs // n_all
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in q if c[t])
            if s > 0:
                scores.append((-s, i))
        out += [(item, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k])]
    return sorted(out)


def searched(docs, items, k=50):
    return sorted((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in ranked_search.search(docs, items, k).collect())


def test_ranked_search_plain(docs, spark, sf_dir):
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    want = plain_search([(r["doc_id"], r["text"]) for r in docs.collect()], [(r["item_id"], r["text"]) for r in items.collect()], 7)
    assert searched(docs, items, 7) == want


def test_ranked_search_ties_and_blocks(spark, monkeypatch):
    """Many equal scores, small buckets, one item a block, k larger and smaller than what is found."""
    monkeypatch.setattr(ranked_search, "ITEMS", 1)
    monkeypatch.setattr(ranked_search, "BUCKET", 3)
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choices(["alpha", "Beta", "gamma-delta", "été", "x9"], k=rng.randrange(1, 6)))) for i in range(300)] + [(i, "same words here") for i in range(300, 400)]
    items = [(1, "alpha beta"), (2, "same"), (3, "ÉTÉ été X9."), (4, "nowhere"), (5, None), (6, "")]
    docs, queries = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for k in (1, 10, 1000):
        assert searched(docs, queries, k) == plain_search(rows, items, k)


def test_ranked_search_edges(edges, nothing, spark):
    items = spark.createDataFrame([(1, "The fox word5", "x"), (1, "lazy", "x"), (None, "token one", "x"), (2, None, "x")], "item_id long, text string, score string")
    got = ranked_search.search(edges, items).collect()
    assert {r["item_id"] for r in got} == {1, None} and all(r["score"] > 0 for r in got)
    assert {r["doc_id"] for r in got if r["item_id"] is None} == {None, 8}
    assert ranked_search.search(nothing, items).count() == 0
    assert ranked_search.search(edges, items.limit(0)).count() == 0
    assert ranked_search.search(edges, spark.createDataFrame([(1, "!?")], "item_id long, text string")).count() == 0


def test_bounds_never_lose_a_vector():
    rng = np.random.default_rng(2)
    own = [sorted(rng.choice(50, rng.integers(1, 12), replace=False).tolist()) for _ in range(20)]
    weights = rng.integers(0, 9000, 50)
    q = ranked_search.Queries(own, weights)
    n, ids, owner, values = 200, [], [], []
    for d in range(n):
        t = np.sort(rng.choice(50, rng.integers(1, 20), replace=False))
        ids.append(t), owner.append(np.full(len(t), d)), values.append(rng.integers(1, 10**6, len(t)))
    ids, owner, values = map(np.concatenate, (ids, owner, values))
    norms = np.sqrt(np.bincount(owner, values.astype(float) ** 2))
    dense = np.zeros((n, 50), np.int64)
    dense[owner, ids] = values
    best, scored = ranked_search.Best(np.zeros(20, np.int64), 5), 0
    order = np.argsort(-norms)
    for low in range(0, n, 25):
        part = order[low : low + 25]
        at = np.concatenate([np.flatnonzero(owner == d) for d in part])
        scored += ranked_search.search_bucket(ids[at], np.repeat(np.arange(len(part)), [np.sum(owner == d) for d in part]), values[at], part, norms[part], q, best)
    for i, t in enumerate(own):
        scores = dense[:, t] @ weights[t]
        want = np.lexsort((np.arange(n), -scores))[:5]
        want = want[scores[want] > 0]
        assert best.found[i][1].tolist() == want.tolist()
    assert scored < n * 20  # some were left out
