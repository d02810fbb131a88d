"""Small cases with hand-computed results, and invariants."""

from __future__ import annotations

import hashlib
import itertools
import math

import numpy as np
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evidentia.functions import scalars as S
from evidentia.functions.winnowing import minimisers
from evidentia.operators import aggregate as A
from evidentia.operators import database as H
from evidentia.operators import enrichment as N
from evidentia.operators import exact
from evidentia.operators import graph as I
from evidentia.operators import joins as J
from evidentia.operators import records as X
from evidentia.operators import sequence as G
from evidentia.operators import stats as K
from evidentia.operators import vectors as V
from evidentia.operators import windows as E


def test_at_least_two_sources(spark):
    rows = [("comet", "P1"), ("comet", "P2"), ("comet", "rev_P3"), ("msgf", "P2"), ("msgf", "rev_P3"), ("tide", "P4")]
    df = spark.createDataFrame(rows, "source string, id string")
    assert {r["id"] for r in J.at_least_k_sources(df, "id", "source", 2, exclude="rev_").collect()} == {"P2"}


def test_overlap_merge(spark):
    left = spark.createDataFrame([("P1", [0.01]), ("P2", [0.02])], "id string, q array<double>")
    right = spark.createDataFrame([("P2", [0.03]), ("P9", [0.04])], "id string, q array<double>")
    got = {r["id"]: (r["q"], r["origin"]) for r in J.merge_overlap(left, right, "id", ["q"]).collect()}
    assert got == {"P1": ([0.01], "left"), "P2": ([0.02, 0.03], "both"), "P9": ([0.04], "right")}


def test_second_smallest(spark):
    df = spark.createDataFrame([(["0.3", "0.001", "0.02"],), (["0.3"],), ([],), (["x"],)], "v array<string>")
    assert [r[0] for r in df.select(S.second_smallest(F.col("v"))).collect()] == [0.02, 0.3, None, None]


@pytest.mark.parametrize(("ps", "want"), [((0.01, 0.2), 0.00251889), ((0.5, 0.5), 0.5), ((0.01, 0.02, 0.1), 2.290426e-05)])
def test_bayes_pep(spark, ps, want):
    rows = [(f"s{i}", "k", p, False) for i, p in enumerate(ps)]
    df = spark.createDataFrame(rows, "source string, key string, pep double, decoy boolean")
    assert E.combined_pep(df, "key", "source", "pep", "decoy", ["pep"]).first()["bayes_pep"] == pytest.approx(want, rel=1e-5)


def test_window_size_and_combined_pep(spark):
    assert [E.window_size(n) for n in (1260, 1259, 10)] == [251, 51, 51]
    df = spark.createDataFrame([("a", f"k{i}", 0.1 + i / 100, i < 3) for i in range(10)], "source string, key string, pep double, decoy boolean")
    assert {r["combined_pep"] for r in E.combined_pep(df, "key", "source", "pep", "decoy", ["pep"]).collect()} == {0.6}


def test_interval_coverage(spark):
    df = spark.createDataFrame([("p", 1, 5), ("p", 4, 9), ("p", 11, 14)], "id string, a int, b int")
    assert E.interval_coverage(df, ["id"], "a", "b", F.lit(20)).first()["coverage"] == 0.55


def test_holm(spark):
    df = spark.createDataFrame([("f", 1, 0.01), ("f", 2, 0.03), ("f", 3, 0.04)], "f string, i int, p double")
    assert [r["p_holm"] for r in E.p_adjust(df, "p", ["f"], ["i"]).orderBy("i").collect()] == pytest.approx([0.03, 0.06, 0.06])


def test_chi_square_and_odds_ratio(spark):
    df = spark.createDataFrame([(20, 10, 5, 25)], "c11 long, c12 long, c21 long, c22 long").withColumn("chi2", K.chi_square()).withColumns(K.odds_ratio())
    r = df.withColumn("p", K.chi2_tail_df1("chi2")).first()
    assert r["chi2"] == pytest.approx(13.44) and r["p"] == pytest.approx(2.4632e-4, rel=1e-3)
    assert (r["odds_ratio"], r["ci_low"], r["ci_high"]) == pytest.approx((10, 2.94046, 34.00830), rel=1e-5)


def test_connected_groups(spark):
    df = spark.createDataFrame([("a", ["1x", "2y"]), ("b", ["2y"]), ("c", ["3z"]), ("d", ["U"])], "id string, g array<string>")
    got = {r["id"]: r["group"] for r in I.unify_groups(df, "id", "g").collect()}
    assert got["a"] == got["b"] != got["c"] and got["d"] == "U"


def test_digest(spark):
    df = spark.createDataFrame([("AKRPKPWK",)], "s string")
    assert df.select(F.split("s", "(?<=[KR])(?!P)")).first()[0][:2] == ["AK", "RPKPWK"]


MISMATCHES = [
    ("ACDEFGHIK", "ACDEFGHIK", 0, [], 1),
    ("ACDEFGHIK", "AC-EFW-IK", 1, ["G->W@5 NP->NP 1"], 7 / 9),
    ("LMNP", "L[QS]NP", 1, ["M->Q@1 NP->PN 0", "M->S@1 NP->PN 0"], 1),
    ("WYVT", "[WF]Y-[TS]", 2, ["T->S@3 PN->PN 1", "W->F@0 NP->NP 1"], 0.75),
    ("DKIR", "NHMK", 4, ["D->N@0 PA->PN 0", "I->M@2 NP->NP 1", "K->H@1 PB->PB 1", "R->K@3 PB->PB 1"], 1),
    ("QQQQ", "----", 0, [], 0),
]


@pytest.mark.parametrize(("seq", "aligned", "n", "changes", "coverage"), MISMATCHES)
def test_mismatches(spark, seq, aligned, n, changes, coverage):
    df = spark.createDataFrame([("x", seq, aligned)], "id string, seq string, al string")
    got = G.mismatches(df, "id", "seq", "al").collect()
    assert sorted(f"{r['change']}@{r['index']} {r['type']} {r['conservative']}" for r in got) == changes
    m = G.alignment_metrics(df, "id", "seq", "al").first()
    assert m["n_mismatches"] == n and m["coverage"] == pytest.approx(coverage)


# (lines, consensus in the order of the lines, consensus with sorted alternatives)
CONSENSUS = [
    (["KL--", "--MN"], "KLMN", "KLMN"),
    (["KQMN", "KLMN"], "K[QL]MN", "K[LQ]MN"),
    (["K[TA]M", "KSM", "KAM"], "K[TAS]M", "K[AST]M"),
    (["WV-", "YV-", "-I-"], "[WY][VI]-", "[WY][IV]-"),
    (["---", "---"], "---", "---"),
]


@pytest.mark.parametrize(("lines", "want", "plain"), CONSENSUS)
def test_consensus(spark, lines, want, plain):
    df = spark.createDataFrame([("p", i, x) for i, x in enumerate(lines)], "p string, i int, a string")
    assert G.merge_alignments(df, ["p"], "a", order="i").first()["consensus"] == want
    assert G.merge_alignments(df, ["p"], "a").first()["consensus"] == plain


def test_sequential_ids_are_dense(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("x"))
    got = [r["n"] for r in A.assign_ids(df, "P", ["x"], "n").orderBy("x").collect()]
    assert got == [f"P{i}" for i in range(1000)]


def test_target_decoy_invariants(spark):
    df = spark.createDataFrame([("a", "MKTAYIAKQRBX"), ("a", "MKTAYIAKQRBX"), ("b", "SHORT")], "id string, seq string")
    both = H.build_database([df], "id", "seq")
    rows = {r["id"]: r for r in both.collect()}
    assert set(rows) == {"a", "rev_a"} and rows["rev_a"]["seq"] == rows["a"]["seq"][::-1] and "B" not in rows["a"]["seq"]


def test_pairs_and_pool(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 0.0])], "id long, v array<double>")
    got = {(r["a"], r["b"]): r["distance"] for r in V.pairwise(df, "id", "v", block=1).collect()}
    assert got == pytest.approx({(1, 2): 1.0, (1, 3): 0.0, (2, 3): 1.0})


def test_maxlfq_recovers_profile(spark):
    rows = [("p", f"i{k}", s, level * scale) for s, level in (("a", 1.0), ("b", 2.0), ("c", 4.0)) for k, scale in enumerate((10.0, 100.0, 7.0)) if not (s == "c" and k == 0)]
    got = {r["s"]: r["lfq"] for r in A.maxlfq(spark.createDataFrame(rows, "p string, i string, s string, v double"), "p", "i", "s", "v").collect()}
    assert got["b"] / got["a"] == pytest.approx(2.0) and got["c"] / got["b"] == pytest.approx(2.0)


def test_same_under_other_partitions(spark, sf_dir):
    from evidentia import plans

    made = []
    for n in ("1", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        made.append(sorted(plans.queries()["combined_pep"](spark, sf_dir).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert made[0] == made[1]


def test_flatten_xrefs(spark):
    from evidentia.sources import io

    doc = (
        '{"uniProtKBCrossReferences": [{"database": "GO", "id": "GO:1", "properties": [{"value": "C:x"}, {"value": "IDA:y"}]}, {"database": "InterPro", "id": "IPR1", "properties": [{"value": "d"}]},'
        ' {"database": "Pfam", "id": "PF1", "properties": [{"value": "p"}]}]}'
    )
    df = spark.createDataFrame([("a", doc), ("b", None), ("c", '{"uniProtKBCrossReferences": []}')], "id string, j string")
    got = {r["id"]: tuple(r)[1:] for r in io.flatten_xrefs(df, "j", ["GO", "Pfam", "InterPro"]).collect()}
    assert got == {"a": ("GO:1_C:x", "PF1_p", "IPR1", "IDA:y"), "b": (None,) * 4, "c": (None,) * 4}


def test_preamble_and_manifest(spark, tmp_path):
    from evidentia.sources import io

    (tmp_path / "a.tsv").write_text("## tool 1.0\nmade\tby hand\n##\n#query\tscore\nq1\t5\nq2\t7\n## done\n")
    got = io.read_after_marker(spark, str(tmp_path / "a.tsv"), ["#query", "#qseqid"], ["query", "score"]).collect()
    assert sorted((r["query"], r["score"]) for r in got) == [("q1", "5"), ("q2", "7")]
    (tmp_path / "r.tsv").write_text("id\tscore\tproteins\np1\t3\tA\tB\tC\np2\t4\n")
    got = io.read_ragged(spark, str(tmp_path / "r.tsv"), ["id", "score"], "proteins").collect()
    assert sorted((r["id"], tuple(r["proteins"])) for r in got) == [("p1", ("A", "B", "C")), ("p2", ())]


def test_entity_similarity_and_generic_terms(spark):
    edges = spark.createDataFrame([("b", "a"), ("c", "a"), ("d", "b")], "child string, parent string")
    values = I.semantic_values(edges, "child", "parent", 0.8)
    pairs = spark.createDataFrame([("b", "c"), ("c", "d")], "x string, y string")
    sim = {(r["x"], r["y"]): r["similarity"] for r in I.wang_similarity(values, pairs, "x", "y").collect()}
    assert sim[("b", "c")] == pytest.approx(1.6 / 3.6)
    terms = spark.createDataFrame([("e1", "b"), ("e2", "c")], "e string, t string")
    bma = I.best_match_average(terms, I.wang_similarity(values, pairs, "x", "y"), "e", "t", "x", "y").first()
    assert (bma["e1"], bma["e2"], bma["similarity"]) == ("e1", "e2", pytest.approx(1.6 / 3.6))
    closed = I.closure(edges, "child", "parent")
    assert {(r["node"], r["ancestor"], r["depth"]) for r in closed.collect()} == {("b", "a", 1), ("c", "a", 1), ("d", "b", 1), ("d", "a", 2)}
    names = spark.createDataFrame([("a", "ion binding"), ("b", "metal binding"), ("c", "dna binding"), ("d", "zinc binding")], "node string, name string")
    level = I.levels(closed, spark.createDataFrame([("a",)], "node string"))
    got = I.generic_terms(closed, names, level, min_level=-1, min_variants=2).collect()
    assert [(r["node"], r["n_variants"]) for r in got] == [("a", 3)]


def test_sampled_pairs_and_null(spark):
    df = spark.range(50).withColumnRenamed("id", "k")
    got = V.sampled_pairs(df, "k", 200).collect()
    assert len(got) == 200 and all(r["a"] != r["b"] for r in got)
    stats, null = spark.createDataFrame([(1.0,), (9.5,)], "s double"), spark.range(10).selectExpr("cast(id as double) as v")
    assert {r["s"]: r["p"] for r in V.empirical_p(stats, "s", null, "v").collect()} == {1.0: 0.2, 9.5: 1.0}
    assert {r["s"]: r["p"] for r in V.empirical_p(stats, "s", null, "v", tail="right").collect()} == {1.0: 0.9, 9.5: 0.0}


def test_minimisers_of_a_part_are_the_wholes():
    rng = np.random.default_rng(1)
    for k, w in ((1, 1), (3, 5), (8, 8), (48, 7)):
        for _ in range(60):
            whole = "".join(rng.choice(list("abcé\U0001f389"), 200))
            a, b = sorted(rng.integers(0, 201, 2))
            assert set(minimisers(whole[a:b], k, w)) <= set(minimisers(whole, k, w))
            assert (len(minimisers(whole[a:b], k, w)) > 0) == (b - a >= k + w - 1)
    assert len(minimisers(None, 3, 3)) == 0


def test_drop_contained_brute(spark):
    """Random texts and parts of them, of every length, under one heading that all share; ids that repeat go by their own text."""
    rng = np.random.default_rng(4)
    head = "the same heading stands above every text of this table "
    rows = []
    for i in range(120):
        text = head + "".join(rng.choice(list("abcdef "), rng.integers(0, 90)))
        a, b = sorted(rng.integers(0, len(text) + 1, 2))
        rows += [(i, text), (1000 + i % 40, text[a:b]), (2000 + i, text[-int(rng.integers(1, 30)) :])]
    got = sorted((r["id"], r["s"]) for r in J.drop_contained(spark.createDataFrame(rows, "id long, s string"), "id", "s").collect())
    first = {}
    for i, s in sorted(rows):
        first.setdefault(s, i)
    want = sorted((i, s) for i, s in rows if first[s] == i and not any(s in t and s != t for t in first))
    assert got == want and 0 < len(got) < len(rows)


def test_drop_contained_meets_few(spark, monkeypatch):
    """Texts under a heading, of which many are short or share all minimisers: found in passes, and no text meets more than a few."""
    rng = np.random.default_rng(14)
    head = "one heading stands above the texts of this \U0001f600 table "
    rows = [(i, head + "".join(rng.choice(list("abcé"), int(rng.integers(0, 40))))) for i in range(150)]
    rows += [(1000 + i, head[int(rng.integers(0, 9)) :] + "".join(rng.choice(list("ab"), i % 4))) for i in range(40)]
    rows += [(2000 + n, rows[n][1][-n:]) for n in (1, 2, 3, 4, 7, 8, 15, 16, 17)] + [(3000, ""), (3001, "\U0001f600"), (3002, "zz")]
    sizes, lying_in = [], J._lying_in

    def looked(wanted, texts):
        made = lying_in(wanted, texts)
        sizes.append((wanted.count(), made.count()))
        return made

    monkeypatch.setattr(J, "AT_ONCE", 20)
    monkeypatch.setattr(J, "_lying_in", looked)
    got = sorted(r["s"] for r in J.drop_contained(spark.createDataFrame(rows, "id long, s string"), "id", "s", k=8).collect())
    every = {s for _, s in rows}
    assert got == sorted(s for s in every if not any(s in t and s != t for t in every)) and 0 < len(got) < len(every)
    assert sizes[0][0] > 40 and sizes[0][1] <= 2 * sizes[0][0]


def test_representatives_brute(spark):
    """Groups that share members, near copies, and a heading: against all pairs of k-mer sets within each group."""
    rng = np.random.default_rng(6)
    base = ["".join(rng.choice(list("abcdefgh"), 80)) for _ in range(6)]
    rows = []
    for i in range(48):
        text = base[i % 6]
        at = int(rng.integers(0, 70))
        text = text[:at] + "".join(rng.choice(list("xyz"), int(rng.integers(0, 3)))) + text[at + 1 :] if i >= 6 else text
        rows += [(g, i, "one heading " + text) for g in ("g1", "g2", "g3")[: 1 + i % 3]]
    got = {(r["g"], r["i"]): r["cluster"] for r in V.representatives(spark.createDataFrame(rows, "g string, i long, s string"), "g", "i", "s", k=8).collect()}
    want = {}
    for g in ("g1", "g2", "g3"):
        sets = {i: {s[j : j + 8] for j in range(len(s) - 7)} for h, i, s in rows if h == g}
        label = {i: i for i in sets}
        for _ in sets:
            for i, j in itertools.combinations(sets, 2):
                if len(sets[i] & sets[j]) >= 0.8 * min(len(sets[i]), len(sets[j])):
                    label[i] = label[j] = min(label[i], label[j])
        want |= {(g, i): x for i, x in label.items()}
    assert got == want and len(set(want.values())) < len(want)


def test_representatives_short_and_missing(spark):
    """Texts of few k-mers, whose kept part alone would miss links, and absent ones, which are like nothing."""
    rng = np.random.default_rng(8)
    long = ["".join(rng.choice(list("abcdefghijkl"), 2000)) for _ in range(4)]
    rows = [(i, x) for i, x in enumerate(long)] + [(90, None), (91, None), (92, ""), (93, "")]
    for i in range(10, 70):
        at = int(rng.integers(0, 1900))
        text = long[i % 4][at : at + int(rng.integers(3, 40))]
        rows.append((i, text[:-1] + "z" if i % 3 == 0 else text))
    got = {r["i"]: r["cluster"] for r in V.representatives(spark.createDataFrame([("g", *r) for r in rows], "g string, i long, s string"), "g", "i", "s", k=8).collect()}
    sets = {i: {s[j : j + 8] for j in range(max(1, len(s) - 7))} for i, s in rows if s is not None}
    label = {i: i for i, _ in rows}
    for _ in range(4):
        for i, j in itertools.combinations(sets, 2):
            if len(sets[i] & sets[j]) >= 0.8 * min(len(sets[i]), len(sets[j])):
                label[i] = label[j] = min(label[i], label[j])
    assert got == label and got[90] == 90 and got[91] == 91 and got[93] == 92 and len(set(got.values())) < len(got)


def test_small_joins(spark):
    df = spark.createDataFrame([("a", "g", True), ("b", "g", False), ("c", "h", None), ("d", "i", True), (None, "i", False)], "k string, g string, m boolean")
    assert {r["k"] for r in J.associated(df, "g", F.col("m")).collect()} == {"b", None}
    assert {r["k"] for r in J.keep_in(df, "k", df.filter("m"), df.filter("g = 'i'")).collect()} == {"a"}
    x, y = spark.createDataFrame([("s", 1), ("t", 2)], "source string, n int"), spark.createDataFrame([("s", 3), ("u", 4)], "source string, n int")
    assert [tuple(r) for r in J.pair_sources({"x": x, "y": y}, "source").collect()] == [("s", 1, 3)]
    assert J.pair_sources({"x": x, "y": y}, "source", fill=True).count() == 3


def test_reach_is_the_closure_of_chosen_nodes(spark):
    """More chosen nodes than a word has bits, diamonds, and a graph deeper than a round's levels."""
    edges = spark.createDataFrame([(c, p) for c in range(2, 400) for p in {c // 2, c // 3, c - 1 if c % 17 else c // 2} if p], "child long, parent long")
    chosen = spark.range(1, 200, 2).withColumnRenamed("id", "node")
    got = {(r["node"], r["ancestor"]) for r in I.reach(edges, "child", "parent", chosen).collect()}
    closed = I.closure(edges, "child", "parent").join(chosen.withColumnRenamed("node", "ancestor"), "ancestor")
    assert got == {(r["node"], r["ancestor"]) for r in closed.collect()}
    assert I.reach(edges, "child", "parent", chosen.limit(0)).count() == 0


def test_drop_contained_and_representatives(spark):
    rows = [(1, "abcdefghijklmnop"), (2, "cdefghijkl"), (3, "abcdefghijklmnop"), (4, "zzzzzzzzzzzz"), (5, "short")]
    df = spark.createDataFrame(rows, "id long, s string")
    more = spark.createDataFrame([(6, "cde"), (7, ""), (8, "z"), (9, None), (10, "hort"), (11, "ohrt")], "id long, s string")
    assert sorted(r["id"] for r in J.drop_contained(df.union(more), "id", "s").collect()) == [1, 4, 5, 9, 11]
    assert J.drop_contained(df.limit(0), "id", "s").count() == 0
    got = {r["id"]: (r["representative"], r["n_members"]) for r in V.representatives(df.withColumn("g", F.lit("x")), "g", "id", "s").collect()}
    assert got[2] == got[1] == got[3] == (1, 3) and got[4] == (4, 1)


def test_fasta_and_obo_records(spark, tmp_path):
    from evidentia.sources import io

    (tmp_path / "a.fa").write_text(">P1 mutant A->T variant\nMKT\nAYI\n>P2\nGG\n")
    assert sorted(tuple(r) for r in io.read_fasta(spark, str(tmp_path / "a.fa")).collect()) == [("P1", "mutant A->T variant", "MKTAYI"), ("P2", "", "GG")]
    stanzas = "format-version: 1.2\n\n[Term]\nid: GO:1\nname: one\n\n[Term]\nid: GO:2\nis_a: GO:1 ! one\nrelationship: part_of GO:1\n\n[Typedef]\nid: regulates\nis_a: GO:9\n"
    (tmp_path / "a.obo").write_text(stanzas)
    edges, terms = io.read_obo(spark, str(tmp_path / "a.obo"))
    assert sorted(map(tuple, edges.collect())) == [("GO:2", "GO:1", "is_a"), ("GO:2", "GO:1", "part_of")] and sorted(r["id"] for r in terms.collect()) == ["GO:1", "GO:2"]


def test_profiles_that_share_nothing(spark):
    df = spark.createDataFrame([("a", "x", 2), ("b", "y", 3), ("c", "x", 2), ("c", "y", 2)], "e string, f string, n long")
    got = {(r["a"], r["b"]): (r["bray_curtis"], r["jaccard"]) for r in V.profile_distance(df, "e", "f", "n", block=1).collect()}
    assert got[("a", "b")] == (1.0, 1.0) and got[("a", "c")][0] == pytest.approx(1 - 4 / 6) and got[("b", "c")][0] == pytest.approx(1 - 4 / 7) and len(got) == 3


def test_tail_probabilities(spark):
    assert K.upper_gamma(1.5, 7.814728 / 2) == pytest.approx(0.05, rel=1e-5) and K.upper_gamma(5, 0.5) == pytest.approx(0.9998279, rel=1e-6)
    assert K.incomplete_beta(5, 0.5, 10 / (10 + 2.228139**2)) == pytest.approx(0.05, rel=1e-5)
    df = spark.createDataFrame([(2, 5, 4, 20), (0, 3, 3, 10), (4, 4, 4, 8)], "k long, n long, m long, t long")
    exact = [sum(math.comb(m, i) * math.comb(t - m, n - i) for i in range(k, min(n, m) + 1)) / math.comb(t, n) for k, n, m, t in ((2, 5, 4, 20), (0, 3, 3, 10), (4, 4, 4, 8))]
    assert [r[0] for r in df.select(N.hypergeometric_tail("k", "n", "m", "t")).collect()] == pytest.approx(exact)


def test_gsea_scores(spark):
    """A set on top has the greatest score there is; null scores have no place; a set without a ranked member has no row."""
    ranked = spark.createDataFrame([(i, float(100 - i)) for i in range(37)] + [(99, None)], "e long, v double")
    sets = spark.createDataFrame([("half", i) for i in range(18)] + [("most", i) for i in range(36)] + [("half", 99), ("none", 99)], "s string, e long")
    got = {r["s"]: r for r in N.gsea(ranked, "e", "v", sets, "s", n_perm=15, few=0).collect()}
    assert got["half"]["p"] == pytest.approx(1 / 16) and got["half"]["n_members"] == 18 and got["half"]["es"] == pytest.approx(1.0) and set(got) == {"half", "most"}


def test_null_scores_by_blocks(spark):
    """Random sets of several sizes, that of all entities too, cut into blocks: as walks of each set by itself."""
    rng = np.random.default_rng(5)
    place = [(f"e{i}", i + 1, float(w)) for i, w in enumerate(np.sort(rng.random(60))[::-1])]
    ranked, sizes = spark.createDataFrame(place, "e string, _rank long, _w double"), (1, 7, 23, 60)
    got = N._null(ranked, "e", 60, spark.createDataFrame([(m,) for m in sizes], "n_members long"), 3, 1, block=9).collect()
    want = []
    for rep in (1, 2, 3):
        drawn = sorted(place, key=lambda x: (hashlib.md5(f"1:{rep}:{x[0]}".encode()).hexdigest(), x[0]))
        for m in sizes:
            held = sorted(x[1:] for x in drawn[:m])
            up, whole = np.cumsum([w for _, w in held]), sum(w for _, w in held)
            want.append((m, max(u / whole - ((r - i) / (60 - m) if m < 60 else 0) for i, (u, (r, _)) in enumerate(zip(up, held, strict=True), 1))))
    assert sorted((r[0], round(r[1], 9)) for r in got) == sorted((m, round(float(es), 9)) for m, es in want)


def test_gsea_p_is_uniform_for_random_sets(spark):
    """Random sets of several sizes: the p-values' distribution is that of the null (Kolmogorov's distance)."""
    rng = np.random.default_rng(5)
    n, sets = 300, []
    for i in range(240):
        sets += [(f"s{i}", int(e)) for e in rng.choice(n, [5, 20, 60][i % 3], replace=False)]
    ranked = spark.createDataFrame([(i, float(1000 - i)) for i in range(n)], "e long, v double")
    made = N.gsea(ranked, "e", "v", spark.createDataFrame(sets, "s string, e long"), "s", n_perm=200, few=0).collect()
    p = np.sort([r["p"] for r in made])
    off = np.abs(p - (np.arange(len(p)) + 0.5) / len(p)).max()
    assert len(p) == 240 and off < 1.63 / math.sqrt(240) + 0.01 and abs(p.mean() - 0.5) < 0.06
    assert min(r["p_adjusted"] for r in made) >= min(p)


def test_splitting_p():
    """Against all sets of 3 of 20 places, down to the rarest; means over seeds, as each estimate is random."""
    weights = np.arange(20, 0, -1).astype(float)
    scores = []
    for own in itertools.combinations(range(20), 3):
        w = weights[list(own)]
        scores.append(max(np.cumsum(w) / w.sum() - (np.array(own) - np.arange(3)) / 17))
    scores = np.sort(scores)[::-1]
    for k in (2, 12, 100, 500):
        want = (scores >= scores[k - 1] - 1e-12).mean()
        got = [N.splitting_p(round(float(scores[k - 1]), 9) - 1e-9, 3, 20, weights, np.random.default_rng(i), moves=30) for i in range(30)]
        assert abs(np.log(np.mean(got) / want)) < 0.4, (k, want, np.mean(got))


def test_exact_rank_tests(spark):
    """Against enumeration of all arrangements, up to eight values, and a normal tail with continuity beyond."""
    for m, n in ((1, 1), (2, 3), (4, 4), (3, 5), (1, 7)):
        us = [sum(sum(1 for x in own if x > y) for y in set(range(m + n)) - set(own)) for own in itertools.combinations(range(m + n), m)]
        counts = exact.rank_sum_counts(m, n)
        assert [int(c) for c in counts] == [us.count(u) for u in range(m * n + 1)]
        assert exact.upper_tail(counts, 2) == pytest.approx(sum(u >= 2 for u in us) / len(us))
    for n in range(1, 9):
        ws = [sum(i + 1 for i in range(n) if signs >> i & 1) for signs in range(1 << n)]
        assert [int(c) for c in exact.signed_rank_counts(n)] == [ws.count(w) for w in range(n * (n + 1) // 2 + 1)]
    rows = [("x", v) for v in (1.0, 4.0, 6.0, 8.0)] + [("y", v) for v in (2.0, 3.0, 5.0)]
    r = K.with_p(K.rank_sum(spark.createDataFrame(rows, "g string, v double"), "v", "g", "x", "y")).first()
    us = [sum(sum(1 for a in own if a > b) for b in set(range(7)) - set(own)) for own in itertools.combinations(range(7), 4)]
    assert r["u"] == 8 and r["p_greater"] == pytest.approx(sum(u >= 8 for u in us) / 35) and r["p_less"] == pytest.approx(sum(u <= 8 for u in us) / 35)
    assert r["p"] == pytest.approx(min(1, 2 * min(r["p_greater"], r["p_less"])))
    d = spark.createDataFrame([(float(v), 0.0) for v in (3, -1, 4, 7, -2, 6)], "a double, b double")
    w = K.with_p(K.signed_rank(d, "a", "b")).first()
    ws = [sum(i + 1 for i in range(6) if signs >> i & 1) for signs in range(64)]
    assert w["w"] == 18 and w["p_greater"] == pytest.approx(sum(x >= 18 for x in ws) / 64) and w["p"] == pytest.approx(2 * sum(x >= 18 for x in ws) / 64)
    tied = K.with_p(K.rank_sum(spark.createDataFrame([*rows, ("y", 8.0)], "g string, v double"), "v", "g", "x", "y")).first()
    assert tied["tied"] and tied["p"] == pytest.approx(math.erfc((abs(tied["u"] - 8) - 0.5) / tied["sigma"] / math.sqrt(2)))


def test_exact_ks(spark):
    """Against all arrangements, with and without ties."""
    for values, m in (([1, 2, 3, 4, 5, 6, 7], 3), ([1, 1, 2, 2, 2, 3, 4, 4], 4), ([1, 2, 2, 3, 3, 3], 2)):
        def distance(own):
            other = [i for i in range(len(values)) if i not in own]
            return max(abs(sum(values[i] <= v for i in own) / len(own) - sum(values[i] <= v for i in other) / len(other)) for v in values)

        every = [distance(own) for own in itertools.combinations(range(len(values)), m)]
        for own in itertools.islice(itertools.combinations(range(len(values)), m), 0, None, 5):
            rows = [("x" if i in own else "y", float(v)) for i, v in enumerate(values)]
            r = K.ks2(spark.createDataFrame(rows, "g string, v double"), "v", "g", "x", "y").first()
            assert r["d"] == pytest.approx(distance(own)) and r["p"] == pytest.approx(np.mean([d >= distance(own) - 1e-9 for d in every]))


def test_scan_carries_over_partitions(spark):
    """A part that lies in many partitions, null keys, and a layer that uses the one before, against plain windows."""
    df = spark.range(2000).selectExpr("case when id % 3 = 0 then 'hot' when id % 50 = 1 then null else concat('p', id % 20) end as k", "id * 7919 % 2003 as x", "id * 31 % 101 as v")
    dealt = df.repartitionByRange(9, "k", "x").withColumn("_part", F.spark_partition_id())
    dealt = A.settled(dealt)
    assert dealt.filter("k = 'hot'").select("_part").distinct().count() > 1
    rises = F.when(F.col("v") > F.coalesce("m", F.lit(-1)), 1).otherwise(0)
    got = A.scan(dealt, ["k"], ["x"], {"s": ("sum", F.col("v")), "m": ("max", F.col("v"))}, {"c": ("sum", rises), "lo": ("min", F.col("s"))}, before=["m"]).drop("_part")
    up, low = W.partitionBy("k").orderBy("x").rowsBetween(W.unboundedPreceding, 0), W.partitionBy("k").orderBy("x").rowsBetween(W.unboundedPreceding, -1)
    want = df.withColumns({"s": F.sum("v").over(up), "m": F.max("v").over(low)}).withColumn("c", F.sum(rises).over(up)).withColumn("lo", F.min("s").over(up))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_adjusted_p(spark):
    ps = [0.01, 0.02, 0.02, 0.2, 0.5, None]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(ps)], "i int, p double")
    holm = [r["a"] for r in E.p_adjust(df, "p", [], ["i"], "a").orderBy("i").collect()]
    bh = [r["a"] for r in E.p_adjust(df, "p", [], ["i"], "a", method="bh").orderBy("i").collect()]
    assert holm == pytest.approx([0.05, 0.08, 0.08, 0.4, 0.5, None]) and bh == pytest.approx([5 * 0.02 / 3] * 3 + [0.25, 0.5, None])


def test_maxlfq_components(spark):
    """One and two components, a sample without a value, zero intensities, and what the total comes to."""
    rows = [("one", "i", "a", 100.0), ("one", "i", "b", 900.0), ("two", "i", "a", 5.0), ("two", "j", "b", 50_000.0), ("two", "j", "c", 100_000.0), ("gap", "i", "a", 7.0), ("gap", "i", "b", 0.0)]
    got = {(r["p"], r["s"]): (r["component"], r["lfq"]) for r in A.maxlfq(spark.createDataFrame(rows, "p string, i string, s string, v double"), "p", "i", "s", "v").collect()}
    want = {("one", "a"): ("a", 100), ("one", "b"): ("a", 900), ("two", "a"): ("a", 5), ("two", "b"): ("b", 50_000), ("two", "c"): ("b", 100_000), ("gap", "a"): ("a", 7)}
    assert set(got) == set(want) and all(got[k][0] == c and got[k][1] == pytest.approx(v) for k, (c, v) in want.items())
    logs = {r["s"]: math.log2(r["lfq"]) for r in A.maxlfq(spark.createDataFrame([("p", i, s, 2.0**v) for i, s, v in (("i", "a", 1), ("i", "b", 3), ("j", "a", 2), ("j", "b", 5), ("k", "c", 4))], "p string, i string, s string, v double"), "p", "i", "s", "v", scale="log mean").collect()}
    assert logs == pytest.approx({"a": 2.75 - 1.25, "b": 2.75 + 1.25, "c": 4})


def test_median_normalisation(spark):
    df = spark.createDataFrame([("i", "a", 2.0), ("j", "a", 8.0), ("i", "b", 16.0), ("j", "b", 64.0), ("k", "b", 0.0)], "i string, s string, v double")
    got = {(r["i"], r["s"]): r["v"] for r in A.normalise_medians(df, "s", "v").collect()}
    assert got == pytest.approx({("i", "a"): 2 * 2**1.5, ("j", "a"): 8 * 2**1.5, ("i", "b"): 16 / 2**1.5, ("j", "b"): 64 / 2**1.5})


def brute_linkage(d, cutoff):
    own = {i: [i] for i in range(len(d))}
    while len(own) > 1:
        best = min((round(float(np.mean([d[x][y] for x in own[a] for y in own[b]])), 12), a, b) for a in own for b in own if a < b)
        if best[0] > cutoff:
            break
        own[best[1]] += own.pop(best[2])
    return {x: c for c, members in own.items() for x in members}


@pytest.mark.parametrize("tied", [False, True])
def test_average_linkage_brute(spark, tied):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(8, 6))[np.arange(30) % 8] + rng.normal(size=(30, 6)) * 0.35
    if tied:
        x = np.round(x) + (np.abs(np.round(x)).sum(1, keepdims=True) == 0)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    got = {r["id"]: r["label"] for r in V.average_clusters(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "i long, v array<double>"), "i", "v", 0.1).collect()}
    want = brute_linkage(1 - u @ u.T, 0.1)
    assert {i: got.get(i, i) for i in range(30)} == want and len(set(want.values())) < 30


@pytest.mark.parametrize(("cutoff", "metric"), [(0.05, "cosine"), (0.4, "euclidean")])
def test_near_pairs_brute(spark, cutoff, metric, monkeypatch):
    """The pairs are exactly those of brute force, each once; few of the others are tested."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(20, 8))[rng.integers(0, 20, 400)] + rng.normal(size=(400, 8)) * 0.12
    x[7] = x[8]
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    d = 1 - u @ u.T if metric == "cosine" else ((x[:, None] - x[None]) ** 2).sum(-1)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None), (1001, [])] + ([(1002, [0.0] * 8)] if metric == "cosine" else [])
    df = spark.createDataFrame(rows, "i long, v array<double>")
    got = [(r["a"], r["b"]) for r in V.near_pairs(df, "i", "v", cutoff, metric, block=16).collect()]
    assert set(got) == {(i, j) for i in range(400) for j in range(i + 1, 400) if d[i, j] <= cutoff} and len(got) == len(set(got))
    assert V.near_pairs(df.limit(0), "i", "v", cutoff, metric).count() == 0


def test_groups_that_share_members(spark):
    """A member of two groups counts in each by its own distances."""
    df = spark.createDataFrame([("x", "g1", [1.0, 0.0]), ("y", "g1", [0.0, 1.0]), ("x", "g2", [1.0, 0.0]), ("z", "g2", [1.0, 0.1]), ("x", "g3", [1.0, 0.0])], "i string, g string, v array<double>")
    got = {r["g"]: (r["cohesion"], r["n_pairs"]) for r in V.group_cohesion(df, "i", "v", "g").collect()}
    assert got["g1"] == (pytest.approx(1.0), 1) and got["g2"] == (pytest.approx(1 - 1 / math.sqrt(1.01)), 1) and got["g3"] == (0, 0)


def test_components_of_a_long_path(spark):
    rng = np.random.default_rng(3)
    names = rng.permutation(600)
    edges = [(int(names[i]), int(names[i + 1])) for i in range(599) if i != 300] + [(5, 5)]
    got = {r["id"]: r["label"] for r in I.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert {got[int(x)] for x in names[:301]} == {int(min(names[:301]))} and {got[int(x)] for x in names[301:]} == {int(min(names[301:]))}


def test_silhouette_on_line(spark):
    """Against all pairs: equal values, clusters of one or at one value, a group of one cluster, a large offset; one group isn't made into pairs."""
    rng = np.random.default_rng(2)
    rows = [(i, f"g{i % 7}", f"g{i % 7}{'abc'[int(rng.integers(0, 3))]}", 1e9 + float(rng.integers(0, 40)) / 10) for i in range(300)]
    rows += [(900, "h", "ha", 0.1), (901, "h", "ha", 0.1), (902, "h", "hb", 0.1), (903, "i", "ia", 1.0), (904, "i", "ia", 3.0), (905, "j", "ja", 0.3), (906, "j", "jb", 0.7)]
    df = spark.createDataFrame(rows, "id long, g string, c string, v double")
    pairs = spark.createDataFrame([(x[0], y[0], abs(x[3] - y[3])) for x, y in itertools.combinations(rows, 2) if x[1] == y[1]], "a long, b long, distance double")
    want = {r["id"]: (r["c"], r["silhouette"]) for r in V.silhouette_from(pairs, df.select("id", "c"), "id", "c").collect()}
    got = {r["id"]: (r["c"], r["silhouette"]) for r in V.silhouette_on_line(df, "id", "v", "c", "g").collect()}
    assert got.keys() == want.keys() and all(got[i][0] == want[i][0] and got[i][1] == pytest.approx(want[i][1], abs=1e-6) for i in want)
    assert got[900][1] == got[902][1] == got[903][1] == got[905][1] == 0
    many = spark.range(200_000).select("id", F.lit("g").alias("g"), F.concat(F.lit("c"), (F.col("id") % 2).cast("string")).alias("c"), F.col("id").cast("double").alias("v"))
    assert V.silhouette_on_line(many, "id", "v", "c", "g").filter("abs(silhouette) <= 1").count() == 200_000


def test_descendants_and_parents_without_closure(spark, monkeypatch):
    """Chunks of a few nodes, diamonds, a circle, names; more candidates under the first than are taken at once; the closure is not made."""
    edges = [(c, p) for c in range(2, 500) for p in {c // 2, c // 3, c - 7 if c % 5 == 0 else c // 2} if p > 0]
    edges += [(900, 901), (901, 902), (902, 900), (3, 900)]
    df = spark.createDataFrame(edges, "child long, parent long")
    level = I.levels_below(df, "child", "parent", spark.range(1, 2).withColumnRenamed("id", "node")).unionByName(spark.createDataFrame([(900, 2), (901, 3)], "node long, level int"))
    closed = I.closure(df, "child", "parent").cache()
    want = {tuple(r) for r in I.n_descendants(closed).collect()}
    chosen = [[r[0] for r in I.select_parents(closed, level, n, m).collect()] for n, m in ((4, 2), (9, 1))]
    monkeypatch.setattr(I, "MOST_RANKS", 1000)
    monkeypatch.setattr(I, "BITS_AT_ONCE", 1)
    monkeypatch.setattr(I, "closure", None)
    assert {tuple(r) for r in I.descendant_counts(df, "child", "parent", chunk=150).collect()} == want
    assert [[r[0] for r in I.representative_parents(df, "child", "parent", level, n, m, at_once=k).collect()] for n, m, k in ((4, 2, 3), (9, 1, 256))] == chosen
    names = df.select(*[F.concat(F.lit("n"), F.col(c).cast("string")).alias(c) for c in df.columns])
    assert {(r["node"], r["n_children"]) for r in I.descendant_counts(names, "child", "parent").collect()} == {(f"n{a}", b) for a, b in want}


def test_select_parents(spark):
    edges = spark.createDataFrame([(c, c // 2) for c in range(2, 64)], "child int, parent int")
    closed = I.closure(edges, "child", "parent")
    level = I.levels(closed, spark.createDataFrame([(1,)], "node int"))
    assert sorted(r["node"] for r in I.select_parents(closed, level, 4, min_level=2).collect()) == [4, 5, 6, 7]


def test_fold_hits_with_errors(spark):
    rows = [("q1", "s1", 0.5, [0.1, 0.2, 0.3]), ("q1", "s2", 0.4, [0.1, 0.2, 0.3]), ("q2", "s1", 0.1, [0.05])]
    df = spark.createDataFrame(rows, "q string, s string, e double, pep array<double>")
    got = {r["s"]: (r["queries"], r["pep"]) for r in J.fold_hits(df, "q", "s", F.col("e") < 1, ["e"], [], pep="pep", most_pep=0.3).collect()}
    assert got == {"s1": (["q2"], [0.05])}


def test_records(spark):
    hits = spark.createDataFrame([("a", 0.01, 90.0), ("b", 0.2, 90.0), ("c", 0.01, 70.0)], "id string, q_value double, pident double")
    assert [r["id"] for r in X.filter_hits(hits).collect()] == ["a"]
    raw = spark.createDataFrame([("PEP|TIDE", "P1 (note),P2", 0.1, False), ("PEP", "P3", 0.05, False), ("PEP", "P4", 0.01, True)], "s string, p string, e double, d boolean")
    got = {r["seq"]: (r["proteins"], r["score"]) for r in X.project_hits(raw, "x", "s", "p", {"e": "score"}, F.col("e"), F.col("d")).collect()}
    assert got == {"PEP": ("P3", 0.05), "TIDE": ("P1;P2", 0.1)}
    flags = spark.createDataFrame([("K.AAR.G",), ("-.AAK.P",), ("R.PAA.-",)], "f string")
    assert [tuple(r) for r in flags.select(*S.tryptic_flags(F.col("f")).values()).collect()] == [(1, 1, 2), (1, 0, 1), (0, 1, 1)]


def test_empai(spark):
    """Of AAAAAAAAK, CCCCCCCCR and DK the first two are heavy enough; one of them and a short one were seen."""
    proteins = spark.createDataFrame([("p", "AAAAAAAAKCCCCCCCCRDK"), ("q", "DKDK")], "id string, s string")
    seen = spark.createDataFrame([("p", "AAAAAAAAK"), ("p", "DK"), ("q", "DK")], "id string, pep string")
    got = A.empai(proteins, "id", "s", seen, "pep").collect()
    assert [(r["id"], r["observable"], r["observed"]) for r in got] == [("p", 2, 2)] and got[0]["empai"] == pytest.approx(9)


def test_pca_scores_and_shares(spark):
    r = np.random.RandomState(3)
    x = r.normal(size=(60, 5)) * [4, 2, 1, 0.5, 0.1]
    scores, explained = V.pca(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>"), "v", 2)
    centred = x - x.mean(0)
    _, d, w = np.linalg.svd(centred, full_matrices=False)
    assert [q["share"] for q in explained.orderBy("component").collect()] == pytest.approx(list((d**2 / (d**2).sum())[:2]))
    got = np.array([q["scores"].toArray() for q in scores.orderBy("id").collect()])
    want = x @ w[:2].T  # scores aren't centred; directions are known up to their sign
    assert np.allclose(np.abs(got), np.abs(want), atol=1e-6)


def test_conclude(spark):
    """The one-sided test speaks only where the two-sided one is significant."""
    rows = [("x", "y", 0.001, 0.0005), ("x", "z", 0.001, 0.9995), ("y", "z", 0.9, 0.45)]
    got = {(r["a"], r["b"]): r for r in K.conclude(spark.createDataFrame(rows, "a string, b string, p double, p_greater double")).collect()}
    assert got["x", "y"]["conclusion"] == "x is greater than y" and got["x", "z"]["conclusion"] == "z is greater than x" and got["y", "z"]["conclusion"] == "y and z don't differ"
    assert got["x", "y"]["p_greater_adjusted"] == pytest.approx(0.003) and got["x", "y"]["p_adjusted"] == pytest.approx(0.005)


def test_running_sums_and_quantiles(spark):
    df = spark.range(1000).selectExpr("id * 7919 % 1009 as x", "id % 5 as v").repartition(7)
    got = A.running_sums(df, ["x"], {"s": "v"}).orderBy("x").collect()
    assert [r["s"] for r in got] == list(itertools.accumulate(r["v"] for r in got))
    q = A.quantiles(df, "x", {"a": 0.25, "b": 0.5}).first()
    x = sorted(i * 7919 % 1009 for i in range(1000))
    assert (q["a"], q["b"]) == pytest.approx(tuple(np.quantile(x, [0.25, 0.5])))
    assert A.quantiles(df.limit(0), "x", {"a": 0.25}).first()["a"] is None


def test_sharing_profiles(spark):
    """Equal to all pairs by brute force, with a feature that everyone holds, and for every cutoff; blocks of three split it."""
    rng = np.random.default_rng(3)
    counts = {}
    for e in range(60):
        own = {"hot": int(rng.integers(1, 4))} if e % 10 else {}
        base = 7 * (e // 6)
        own |= {f"f{base + int(i)}": int(rng.integers(1, 9)) for i in rng.choice(7, int(rng.integers(1, 7)), replace=False)}
        counts[e] = own
    counts[61] = dict(counts[60 - 1])
    rows = [(e, f, n) for e, own in counts.items() for f, n in own.items()] + [(None, "hot", 1), (5, None, 2), (70, "hot", None), (71, "lonely", 3)]
    df = spark.createDataFrame(rows, "e long, f string, n long")

    def apart(a, b):
        both = sum(min(n, counts[b].get(f, 0)) for f, n in counts[a].items())
        return 1 - 2 * both / (sum(counts[a].values()) + sum(counts[b].values()))

    every = {(a, b): apart(a, b) for a, b in itertools.combinations(sorted(counts), 2)}
    for cutoff in (None, 0.0, 0.3, 0.6, 0.95):
        got = {(r["a"], r["b"]): (r["bray_curtis"], r["jaccard"]) for r in V.sharing_profiles(df, "e", "f", "n", cutoff, block=3).collect()}
        want = {p: d for p, d in every.items() if (d < 1 if cutoff is None else d <= cutoff + 1e-12)}
        assert set(got) == set(want), cutoff
        assert all(got[p][0] == pytest.approx(d) and got[p][1] == pytest.approx(2 * d / (1 + d)) for p, d in want.items())
    assert V.sharing_profiles(df.limit(0), "e", "f", "n", 0.5).count() == 0


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_silhouettes(spark, metric):
    """From cluster sums and from a table of pairs: the same as from all distances; clusters of one, one cluster alone, ids as text."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(40, 5)) + 1
    labels = [int(i) for i in rng.integers(0, 6, 39)] + [9]
    df = spark.createDataFrame([(f"i{i}", x[i].tolist(), g) for i, g in enumerate(labels)], "id string, v array<double>, g int")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    d = 1 - unit @ unit.T if metric == "cosine" else ((x[:, None] - x[None]) ** 2).sum(2)
    want = {}
    for i, g in enumerate(labels):
        mean = {h: np.mean([d[i, j] for j, k in enumerate(labels) if k == h and j != i]) for h in set(labels) if any(k == h and j != i for j, k in enumerate(labels))}
        a, b = mean.get(g), min(m for h, m in mean.items() if h != g)
        want[f"i{i}"] = 0.0 if a is None else (b - a) / max(a, b)
    made = V.silhouette(df, "id", "v", "g", metric, block=7)
    assert {r["id"]: r["silhouette"] for r in made.collect()} == pytest.approx(want)
    pairs = V.pairwise(df, "id", "v", metric)
    assert {r["id"]: r["silhouette"] for r in V.silhouette_from(pairs, df, "id", "g").collect()} == pytest.approx(want)
    mean = V.mean_silhouette(made, "g").first()
    assert mean["n_clusters"] == len(set(labels)) and mean["silhouette"] == pytest.approx(np.mean(list(want.values())))
    for alone in (F.lit(1), F.col("id")):
        made = V.mean_silhouette(V.silhouette_from(pairs, df.withColumn("g", alone), "id", "g"), "g").first()
        assert made["silhouette"] is None and made["n_clusters"] in (1, 40)


def test_groups_of_one_large_object(spark, tmp_path):
    """Commas, brackets, colons, quotes and lines within strings; empty lists, groups named twice, numbers, nulls, several files, small splits."""
    import json

    from evidentia.sources import io

    odd = {'a, "b": [c]': ["x,y", 'q"', "]", "\\", 'e\\",', "é\n", ""], "none": [], "empty too": [], "num": [1, 2.5, None, "3"], "long": [f"m{i},{i}" for i in range(3000)]}
    (tmp_path / "1.json").write_text(json.dumps(odd, indent=2, ensure_ascii=False))
    (tmp_path / "2.json").write_text('{"twice":["u"],"k":[],"twice":["v","w,"]}\n')
    (tmp_path / "3.json").write_text("{}")
    want = [(g, str(m)) for g, ms in odd.items() for m in ms if m is not None] + [("twice", "u"), ("twice", "v"), ("twice", "w,")]
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        got = [tuple(r) for r in io.read_groups(spark, str(tmp_path)).collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    assert sorted(got) == sorted(want)
    known = spark.createDataFrame([("v",), ("m7,7",), ("absent",)], "member string")
    assert sorted(map(tuple, io.read_groups(spark, str(tmp_path), known).collect())) == [("long", "m7,7"), ("twice", "v")]


def test_subgroups(spark):
    text = "abcdefghijklmnopqrstuvwxyz0123456789"
    rows = [("g", 1, text), ("g", 2, text[:30]), ("g", 3, text[::-1]), ("h", 4, text), ("h", 5, text), ("s", 6, text), ("s", 1, text[:3])]
    df = spark.createDataFrame(rows, "g string, id long, seq string")
    made = V.subgroups(df, "g", "id", "seq", V.representatives(df, "g", "id", "seq"))
    got = {(r["g"], r["id"]): (r["subgroup"], r["representative"]) for r in made.collect()}
    assert got[("g", 1)] == got[("g", 2)] == ("g.0", 1) and got[("g", 3)] == ("g.1", 3)
    assert got[("h", 4)] == ("h", 4) and got[("h", 5)] == ("h", 5) and got[("s", 1)][0] != got[("s", 6)][0]


def test_term_clouds(spark):
    from evidentia.operators import text as L

    names = {1: "positive regulation of Growth", 2: "regulation of catabolic process", 3: "lipid biosynthetic process", 4: "protein folding", 5: "transport", 6: None, 7: "rare thing"}
    info = spark.createDataFrame([(i, n, "biological_process" if i != 4 else "molecular_function") for i, n in names.items()], "id long, name string, namespace string")
    level = spark.createDataFrame([(i, 9 if i == 5 else 4) for i in names], "node long, level int")
    counts = {1: 4, 2: 3, 3: 6, 4: 5, 5: 50, 6: 9, 7: 1, 8: 2}
    terms = spark.createDataFrame([(i,) for i, n in counts.items() for _ in range(n)], "t long")
    terms = L.rolled_up(terms, "t", spark.createDataFrame([(8, 2), (8, 4)], "child long, parent long"))
    got = sorted(tuple(r) for r in L.term_clouds(terms, "t", info, level, share=0.0).select("cloud", "type", "token", "n", "rank").collect())
    assert got == [("main", None, "protein folding", 5, 1), ("process", "anabolic", "lipid biosynthetic process", 6, 1), ("regulation", "unspecified effect", "reg. of catabolic process", 5, 1)]
    got = sorted(tuple(r) for r in L.term_clouds(terms.union(terms.filter("t = 2")), "t", info, level, share=0.0).select("cloud", "type", "token", "n").collect())
    assert ("regulation", "unspecified effect", "reg. of catabolic process", 10) in got and ("process", "catabolic", "reg. of catabolic process", 10) in got


def test_coverage_of_letters_alone(spark):
    seqs = spark.createDataFrame([(1, "AB-C*D\nE"), (2, "ABCDE"), (3, "--"), (4, None)], "id long, s string")
    parts = spark.createDataFrame([(1, "BCD"), (2, "BCD"), (3, "A"), (4, "A")], "id long, p string")
    got = {r["id"]: r["coverage"] for r in G.exact_coverage(seqs, "id", "s", parts, "p", strip="[^A-Z]+").collect()}
    assert got == {1: 0.6, 2: 0.6, 3: None, 4: None}


def test_hashes_of_substrings(spark):
    """All substrings of k characters across pieces, whatever their lengths; a shorter text is one, and so are an empty one and null."""
    texts = ["", "a", "abc", "abcd", "é\n😀d" * 3, "x" * 10, "abcdefgh", "abcdefghij😀klm\n", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string")
    for k in (1, 3, 4):
        pieces = F.when(F.col("t") == "", F.array(F.lit(""))).otherwise(F.regexp_extract_all("t", F.lit("(?s).{1,4}"), F.lit(0)))
        got = {r["i"]: r["h"] for r in df.withColumn("c", pieces).select("i", S.piece_hashes("c", k).alias("h")).collect()}
        runs = [(i, j, None if t is None else t[j : j + k]) for i, t in enumerate(texts) for j in range(max(1, len(t or "") - k + 1))]
        want = spark.createDataFrame(runs, "i long, j long, s string").select("i", "j", F.xxhash64("s").alias("h")).collect()
        assert got == {i: [r["h"] for r in sorted(want, key=lambda r: r["j"]) if r["i"] == i] for i in range(len(texts))}


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_blocks_copy_rows_seldom(spark, metric):
    """a row meets all others in a few copies, and what it meets is complete."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(700, 64))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "i long, v array<double>")
    assert V.pairwise(df, "i", "v", metric).count() == 700 * 699 // 2
    got = V.pairwise(df.limit(90), "i", "v", metric, block=10).select("a", "b").distinct().count()
    assert got == 90 * 89 // 2
    many = spark.range(40000).select(F.lit(0).alias("g"), F.array_repeat(F.lit(0.5), 64).alias("v"))
    assert V._blocks(many, ["g"], "v").first()["_blocks"] == 12  # 157 before


@pytest.mark.parametrize(("cutoff", "metric"), [(0.6, "cosine"), (45.0, "euclidean"), (6.8, "l2")])
def test_near_components(spark, cutoff, metric):
    """components without pairs are those of all near pairs, where nothing clusters too."""
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(size=(300, 16)) * 2, np.repeat(rng.normal(size=(3, 16)), 40, axis=0)])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "i long, v array<double>")
    pairs = V.near_pairs(df, "i", "v", cutoff, metric, block=32)
    want = {(r["id"], r["label"]) for r in V.cluster_at(pairs, cutoff).collect()}
    assert {(r["id"], r["label"]) for r in V.near_components(df, "i", "v", cutoff, metric, block=32).collect()} == want and len(want) > 120


@pytest.mark.parametrize("metric", ["cosine", "euclidean", "l2"])
def test_average_clusters_of_large_components(spark, metric):
    """One task's matrix, sums of vectors and pairs give the same clusters."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(6, 5))[np.arange(80) % 6] + rng.normal(size=(80, 5)) * 0.4
    df = spark.createDataFrame([(i, i % 2, v.tolist()) for i, v in enumerate(x)], "i long, g int, v array<double>")
    cutoff = {"cosine": 0.2, "euclidean": 1.5, "l2": 1.3}[metric]
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    d = {"cosine": 1 - u @ u.T, "euclidean": ((x[:, None] - x[None]) ** 2).sum(-1), "l2": np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))}[metric]
    want = brute_linkage(d, cutoff)
    for most in (6144, 3):
        got = {r["id"]: r["label"] for r in V.average_clusters(df, "i", "v", cutoff, metric, most=most).collect()}
        assert {i: got.get(i, i) for i in range(80)} == want
    small, large = (sorted(V.average_clusters(df, "i", "v", cutoff, metric, within="g", most=most).collect()) for most in (6144, 3))
    assert small == large and len(small) > 40


def test_signed_rank_of_millions(spark):
    """the cube of three million differences is no long."""
    df = spark.range(3_000_000).select(F.when(F.col("id") % 3 == 0, -1.0).otherwise(1.0).alias("a"), F.lit(0.0).alias("b"))
    r = K.signed_rank(df, "a", "b").first()
    n = 3e6
    assert (r["n"], r["w"]) == (3_000_000, 2e6 * (n + 1) / 2) and r["z"] == pytest.approx((r["w"] - n * (n + 1) / 4) / math.sqrt(n * (n + 1) * (2 * n + 1) / 24 - (n**3 - n) / 48))


@pytest.mark.parametrize("kind", ["hierarchy", "cycle", "deep"])
def test_closure_by_ranks_and_by_doubling(spark, kind, monkeypatch):
    """Depths, levels and S-values are those of a search from each node, in a hierarchy and where ranks don't help."""
    monkeypatch.setattr(I, "FEW_EDGES", 0)
    rng = np.random.default_rng(8)
    edges = {(int(c), int(rng.integers(0, c))) for c in range(1, 60) for _ in range(2) if c < 8 or c % 8 == 0} | {(c, c // 3) for c in range(1, 60)}
    if kind == "cycle":
        edges |= {(0, 40), (7, 7)}
    if kind == "deep":
        monkeypatch.setattr(I, "MOST_RANKS", 3)
    up = {c: [p for x, p in edges if x == c and p != c] for c in range(60)}
    want, values = {}, {}
    for v in range(60):
        seen, at, k = {}, [v], 0
        while at:
            at, k = sorted({p for x in at for p in up[x]} - set(seen)), k + 1
            seen |= {p: k for p in at}
        want |= {(v, p): d for p, d in seen.items()}
        values |= {(v, p): 0.8**d for p, d in {**seen, v: 0}.items()}
    df = spark.createDataFrame(sorted(edges), "c long, p long")
    closed = I.closure(df, "c", "p")
    rows = closed.collect()
    assert {(r["node"], r["ancestor"]): r["depth"] for r in rows} == want and len(rows) == len(want)
    roots = spark.createDataFrame([(0,), (3,)], "node long")
    assert sorted(I.levels_below(df, "c", "p", roots, steps=2).collect()) == sorted(I.levels(closed, roots).collect())
    if kind != "cycle":
        assert {(r["node"], r["ancestor"]): r["s"] for r in I.semantic_values(df, "c", "p").collect()} == pytest.approx(values)


def test_best_match_average_of_shared_terms(spark):
    """the best match of a term counts once for each entity, whichever neighbour it comes by."""
    terms = spark.createDataFrame([("x", 1), ("x", 2), ("y", 2), ("y", 3), ("z", 3), ("z", 3)], "e string, t int")
    near = spark.createDataFrame([(1, 2, 0.5), (2, 3, 0.25), (1, 3, 0.75)], "a int, b int, similarity double")
    got = {(r["e1"], r["e2"]): r["similarity"] for r in I.best_match_average(terms, near, "e", "t", "a", "b").collect()}
    assert got == pytest.approx({("x", "y"): (0.75 + 0.25 + 0.5 + 0.75) / 4, ("x", "z"): (0.75 + 0.25 + 0.75) / 3, ("y", "z"): 0.25})


def test_profiles_by_blocks(spark):
    """entities that share few features meet in blocks; tiles, cutoffs and pairs that share nothing are right."""
    rng = np.random.default_rng(9)
    n = rng.integers(0, 9, size=(150, 6)) * (np.arange(6)[None] % 3 == np.arange(150)[:, None] % 3)
    n[:, :3] += np.eye(3, dtype=int)[np.arange(150) % 3]
    df = spark.createDataFrame([(e, f, int(n[e, f])) for e in range(150) for f in range(6) if n[e, f]], "e long, f int, n long")
    d = {(a, b): 1 - 2 * np.minimum(n[a], n[b]).sum() / (n[a].sum() + n[b].sum()) for a in range(150) for b in range(a + 1, 150)}
    read = lambda t: {(r["a"], r["b"]): r["bray_curtis"] for r in t.collect()}
    assert read(V.profile_distance(df, "e", "f", "n", block=20)) == pytest.approx(d)
    assert read(V.sharing_profiles(df, "e", "f", "n", block=20)) == pytest.approx({k: v for k, v in d.items() if v < 1})
    assert read(V.sharing_profiles(df, "e", "f", "n", 0.2)) == pytest.approx({k: v for k, v in d.items() if v <= 0.2 + 1e-12})


def test_tail_of_very_large_groups(spark):
    """Only the terms that add something are made: before, one for each of a thousand million places."""
    df = spark.createDataFrame([(1_000_000_000, 2_000_000_000, 2_000_000_000, 4_000_000_000), (2, 3, 4, 10)], "k long, n long, m long, total long")
    half, third = (r["p"] for r in df.coalesce(1).select(N.hypergeometric_tail("k", "n", "m", "total").alias("p")).collect())
    assert abs(half - 0.5) < 1e-3 and abs(third - 1 / 3) < 1e-9


def test_any_key_without_distinct_pairs(spark):
    """A pair that agrees in several keys, rows that repeat, ids with several keys, absent keys; pairs aren't brought together to tell them apart."""
    a = spark.createDataFrame([(1, "x", "u"), (1, "x", "u"), (2, "x", None), (3, None, "u"), (4, "y", "v")], "i long, p string, q string")
    b = spark.createDataFrame([(7, "x", "u"), (8, "x", "w"), (9, None, None), (10, "z", "v")], "j long, r string, s string")
    made = J.join_any_key(a, b, [("p", "r"), ("q", "s")], ["j", "i"])
    assert sorted(map(tuple, made.collect())) == [(7, 1), (7, 2), (7, 3), (8, 1), (8, 2), (10, 4)]
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan.split("Aggregate")[0] or plan.index("Join") < plan.index("Aggregate")  # no aggregate above a join
    more = spark.createDataFrame([(5, "x", "k"), (5, "m", "u")], "i long, p string, q string")  # one id, two keys
    assert sorted(map(tuple, J.join_any_key(more, b, [("p", "r"), ("q", "s")], ["j", "i"]).collect())) == [(7, 5), (8, 5)]


def test_search_report_counts_without_copies(spark):
    """Absent sources, groups, items and members; the rows aren't copied for each column that is counted."""
    rows = [("a", 1, [1, 2], 7, 0.1), ("a", 1, [1, 2], 8, 0.9), ("a", 2, [1], 7, 0.9), ("a", None, [1, 2], None, 0.1), (None, 3, None, 9, 0.1), (None, 3, [1, 2], 9, None)]
    df = spark.createDataFrame(rows, "s string, g long, m array<int>, i long, v double")
    made = X.search_report(df, ["s"], "g", "m", "i", "v", 0.5, {"low": F.col("v") < 0.5})
    got = {r["s"]: (r["n_groups"], r["n_multi"], r["n_items"], r["n_below"], r["n_low"], r["share_below"]) for r in made.collect()}
    assert got == {"a": (2, 1, 2, 1, 2, 0.5), None: (1, 1, 1, 1, 1, 1.0)}
    assert "Expand" not in made._jdf.queryExecution().optimizedPlan().toString()


def test_masses_are_made_late(spark):
    """Masses aren't written with the numbers; decoys are drawn over ids alone, which may be named as any."""
    both = H.build_database([spark.createDataFrame([(i, "ACDEFGHIKLMN"[i:] + "PQRSTVWY" * 2, "h") for i in range(4)], "id long, s string, h string")], "id", "s")
    made = H.database_entries(both, "id", "s", "h")
    assert "mass" in made.columns and "mass" not in spark.read.parquet(*made.inputFiles()).columns
    kept = H.balance_decoys(both.filter("not decoy or id = 'rev_1'").select("id"), "id", both, "s").collect()
    targets = {r["s"] for r in kept if not r["decoy"]}
    assert sum(r["decoy"] for r in kept) == 4 == len(targets) and all(r["s"][::-1] in targets for r in kept if r["decoy"]) and len({r["id"] for r in kept}) == 8


def test_category_by_one_aggregate(spark):
    """Priority first, then the number of terms, then the smaller parent; items aren't sorted for it."""
    items = spark.createDataFrame([(1, [1, 2, 3]), (2, [1, 2]), (3, [9]), (4, []), (5, [3, 4, 5])], "i long, t array<long>")
    mapping = spark.createDataFrame([(1, 6), (2, 7), (3, 6), (4, 8), (5, 8)], "node long, parent long")
    made = I.assign_category(items, "i", "t", mapping, "parent", priority=[7])
    assert {r["i"]: r["category"] for r in made.collect()} == {1: "7", 2: "7", 3: "other", 4: "unknown", 5: "8"}
    assert {r["i"]: r["category"] for r in I.assign_category(items, "i", "t", mapping, "parent").collect()}[2] == "6"
    assert "Window" not in made._jdf.queryExecution().optimizedPlan().toString()


def test_only_mismatches_become_rows(spark):
    """F32: texts are compared without a row for each place; alternatives, stray brackets, line ends, characters of two units, uneven ends, absent texts."""
    cases = [("ACDEF", "AC-K"), ("AC", "ACKKK"), ("ACD", "[KL]C[D]"), ("A[C]", "A[CK"), ("ACD", "A\nKD"), ("A😀C", "A😁C"), ("AxC", "KyC"), (None, "A"), ("A", None), ("LMN", "")]
    df = spark.createDataFrame([(None if i == 6 else i, *c) for i, c in enumerate(cases)], "i long, s string, a string")
    made = G.mismatches(df, "i", "s", "a")
    want = [(0, "E->K", "PA->PB", 3, 0), (2, "A->K", "NP->PB", 0, 0), (2, "A->L", "NP->NP", 0, 1), (3, "]->K", None, 3, None), (4, "C->K", "PN->PB", 1, 0)]
    want += [(5, "😀->😁", None, 1, None), (None, "A->K", "NP->PB", 0, 0), (None, "x->y", None, 1, None)]
    assert sorted(map(str, map(tuple, made.collect()))) == sorted(map(str, want))
    assert "Generate" not in made._jdf.queryExecution().optimizedPlan().toString()
    metrics = {r["i"]: (r["n_mismatches"], r["coverage"]) for r in G.alignment_metrics(df.filter("i is not null"), "i", "s", "a").collect()}
    assert metrics == {0: (1, 0.8), 1: (0, 1), 2: (2, 1), 3: (1, 1), 4: (1, 1), 5: (1, 1), 7: (None, None), 8: (None, None), 9: (0, 1)}


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_distances_rounded_in_tiles(spark, metric):
    """rounded where they are made, as SQL's round has it: halves go away from zero, nothing becomes a negative zero."""
    values = [0.0, 0.5, 0.0078125, 1.0009765625, -0.0078125, -1e-16, 2 / 3, 1e-7, 5e-7, 123456.7890125]
    want = [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").orderBy("i").select(F.round("v", 6)).collect()]
    assert list(map(str, V._rounded(np.array(values), 6).tolist())) == list(map(str, want))
    x = np.random.default_rng(3).normal(size=(60, 8))
    rows = [(f"i{i}", v.tolist(), "gh"[i % 2]) for i, v in enumerate(x)] + [("i0", [1.0] * 8, "g"), ("i7", x[3].tolist(), "h")]
    df = spark.createDataFrame(rows, "id string, v array<double>, g string")
    for within in (None, "g"):
        plain = V.pairwise(df, "id", "v", metric, 16, within).withColumn("distance", F.round("distance", 4))
        made = V.pairwise(df, "id", "v", metric, 16, within, digits=4)
        assert made.columns == plain.columns and sorted(map(tuple, made.collect())) == sorted(map(tuple, plain.collect()))
        assert "round(" not in made._jdf.queryExecution().optimizedPlan().toString()


def test_similarity_above_without_lists(spark):
    """as over the lists of all ancestors, in several chunks; with weights, a circle, a loop, a term without edges and one that isn't there."""
    rng = np.random.default_rng(5)
    rows = [(i, int(p), float(rng.uniform(0.3, 0.9))) for i in range(2, 80) for p in {max(1, i // 2), int(rng.integers(1, i))}]
    edges = spark.createDataFrame([*rows, (1, 3, 0.5), (7, 7, 0.4)], "c long, p long, w double")
    pairs = spark.createDataFrame([(int(x), int(y)) for x, y in rng.integers(1, 80, (200, 2))] + [(1, 2), (1, 1), (900, 4)], "a long, b long").distinct()
    read = lambda df: {(r["a"], r["b"]): r["similarity"] for r in df.collect()}
    want = read(I.wang_similarity(I.semantic_sets(edges, "c", "p", F.col("w")), pairs, "a", "b"))
    got = read(I.similarity_above(edges, "c", "p", pairs, "a", "b", F.col("w"), chunk=30))
    assert got == pytest.approx(want) and (1, 1) in got and (900, 4) not in got


@pytest.mark.parametrize("most", [64, 4096])
def test_best_matches_meet_by_blocks(spark, most):
    """pairs of entities are summed up where blocks of them meet; before, a row for each term and pair was shuffled by the pair."""
    rng = np.random.default_rng(6)
    terms = [(f"e{int(e)}", int(t)) for e, t in rng.integers(0, (150, 60), (900, 2))] + [(None, 3), ("e1", 5), ("e1", 5)]
    near = [(t, t + int(k), float(rng.integers(1, 9)) / 10) for t in range(60) for k in rng.integers(0, 3, 2)]
    both, holds = [*near, *[(u, t, s) for t, u, s in near]], {}
    for e, t in set(terms):
        holds.setdefault(t, set()).add(e)
    best, means = {}, {}
    for t, u, s in both:
        for e in holds.get(u, set()) - {None}:
            best[t, e] = max(s, best.get((t, e), 0))
    for (t, e), s in best.items():
        for x in holds.get(t, set()) - {None, e}:
            means.setdefault((min(e, x), max(e, x)), []).append(s)
    made = I.best_match_average(spark.createDataFrame(terms, "e string, t long"), spark.createDataFrame(near, "a long, b long, similarity double"), "e", "t", "a", "b", most=most)
    assert "hashpartitioning(e1" not in made._jdf.queryExecution().executedPlan().toString()
    assert {(r["e1"], r["e2"]): r["similarity"] for r in made.collect()} == pytest.approx({k: sum(v) / len(v) for k, v in means.items()})


def test_other_grams_are_marked_first(spark):
    """of the grams outside the index only those that some set looks for become rows; before, all did."""
    from evidentia.functions import winnowing as Wn

    df = spark.createDataFrame([(1, "".join(chr(97 + (i * i + i // 7) % 26) for i in range(3000)))], "i long, s string")
    every = Wn.grams(df.first()["s"], 12)
    other = every[(every & np.uint64(255)) >= Wn.KEPT].view(np.int64)
    wanted = other[:3].tolist()
    marks = Wn.gram_marks(spark.createDataFrame([(int(x),) for x in wanted], "m long"), "m")
    texts = df.select("i", F.col("s").alias("_s"))
    got = Wn.gram_rows(texts, 12, marks).first()["_ks"]
    assert set(wanted) <= set(got) < set(other.tolist()) and len(got) < 10
    assert (every == np.unique(every)).all() and set(Wn.gram_rows(texts, 12).first()["_ks"]) == set(every.view(np.int64).tolist()) - set(other.tolist())


def test_grams_within_keeps_few_texts(spark, monkeypatch):
    """texts that come again aren't taken apart again, and no more of them are held than there is room for."""
    from evidentia.functions import winnowing as Wn

    monkeypatch.setattr(Wn, "GRAMS_HELD", 50)
    texts = ["abcdefghij" * 3, "abcdefghij" * 3 + "klm", "zyxwvu" * 30, "".join(map(chr, range(40, 120))), "ab"]
    rows = [(x, y) for x in texts for y in texts]
    got = [r["w"] for r in spark.createDataFrame(rows, "x string, y string").coalesce(1).select(Wn.grams_within(F.col("x"), F.col("y"), 4, 0.8).alias("w")).collect()]
    sets = {t: {t[i : i + 4] for i in range(max(1, len(t) - 3))} for t in texts}
    assert got == [len(sets[x] & sets[y]) >= 0.8 * min(len(sets[x]), len(sets[y])) for x, y in rows]


def test_grams_leave_by_portions(spark):
    """what is made of a batch of long texts isn't held whole."""
    from evidentia.functions import winnowing as Wn

    texts = spark.createDataFrame([(i, chr(97 + i) * 20 + "".join(chr(97 + (j * j + i) % 23) for j in range(100 * i))) for i in range(8)], "n long, _s string").coalesce(1)
    assert sorted((r["n"], sorted(r["_ks"])) for r in Wn.gram_rows(texts, 6, portion=300).collect()) == sorted((r["n"], sorted(r["_ks"])) for r in Wn.gram_rows(texts, 6).collect())
    assert [list(range(8))[p] for p in Wn.in_portions(["x" * 200] * 8, 300)] == [[i] for i in range(8)]


def test_profiles_rounded_by_tile(spark):
    """distances are made and rounded where pairs are; a cutoff goes by what isn't rounded yet, by blocks and by an index."""
    rng = np.random.default_rng(8)
    df = spark.createDataFrame([(int(e), f"f{int(f)}", int(n)) for e, f, n in zip(rng.integers(0, 90, 600), rng.integers(0, 6, 600), rng.integers(1, 9, 600), strict=True)], "e long, f string, n long")
    read = lambda d: {(r["a"], r["b"]): (r["bray_curtis"], r["jaccard"]) for r in d.collect()}
    exact = read(V.profile_distance(df, "e", "f", "n", block=32))
    for digits in (7, 9):
        got = read(V.profile_distance(df, "e", "f", "n", block=32, digits=digits))
        assert got == {k: tuple(math.floor(x * 10**digits + 0.5) / 10**digits for x in v) for k, v in exact.items()}
        for cutoff in (None, 0.34):
            near = {k for k, v in exact.items() if v[0] < 1 and v[0] <= (cutoff or 1)}
            for dense in (64, 1000):
                assert read(V.sharing_profiles(df, "e", "f", "n", cutoff, dense=dense, digits=digits)) == {k: got[k] for k in near}


def test_enrich_counts_of_shared_entities(spark, monkeypatch):
    """F8: entities of several groups, or of none, count for a term once; ancestors of several terms once.  Entities meet their terms' ancestors' rows in one pass:
    before, they were made and shuffled for the terms' counts and for the groups'."""
    members = spark.createDataFrame([("g1", 1), ("g2", 1), ("g1", 2), ("g2", 3), ("g3", 3), (None, 4), ("g1", 4), (None, 5), ("g4", None)], "g string, e long")
    terms = spark.createDataFrame([(1, "c"), (1, "d"), (2, "c"), (3, "d"), (4, "b"), (5, "c"), (6, "c")], "e long, t string")
    closed = spark.createDataFrame([("c", "b"), ("c", "a"), ("d", "b"), ("d", "a"), ("b", "a")], "node string, ancestor string")
    kept, own = [], N.settled
    monkeypatch.setattr(N, "settled", lambda df, *a: kept.append(df) or own(df, *a))
    made = N.enrich(members, "g", "e", terms, "t", least=1, closed=closed).collect()
    up = {"a": {"a"}, "b": {"b", "a"}, "c": {"c", "b", "a"}, "d": {"d", "b", "a"}}
    bears = {e: set().union(*(up[t] for x, t in [(1, "c"), (1, "d"), (2, "c"), (3, "d"), (4, "b"), (5, "c")] if x == e)) for e in range(1, 6)}
    groups = {"g1": {1, 2, 4}, "g2": {1, 3}, "g3": {3}}
    want = {(g, t): (sum(t in bears[e] for e in es), len(es), sum(t in b for b in bears.values()), 5) for g, es in groups.items() for t in "abcd" if any(t in bears[e] for e in es)}
    assert {(r["g"], r["t"]): (r["n_both"], r["n_group"], r["n_term"], r["n_universe"]) for r in made} == want
    assert sum("explode" in df._jdf.queryExecution().optimizedPlan().toString() for df in kept) == 1


def test_linkage_ends_in_one_task(spark, monkeypatch):
    """once few clusters are left, a task merges them; before, each further round wrote and shuffled all of them."""
    rng = np.random.default_rng(11)
    x = np.concatenate([rng.normal(c, 0.2, (6, 3)) for c in rng.normal(0, 5, (5, 3))])
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "i long, v array<double>, g int")
    rounds, own = [], V._nearest_means
    monkeypatch.setattr(V, "_nearest_means", lambda *a: rounds.append(1) or own(*a))
    cutoff = 8.0
    want = {r["id"]: r["label"] for r in V.average_clusters(df, "i", "v", cutoff, "euclidean", within="g").collect()}
    assert not rounds
    got = {r["id"]: r["label"] for r in V.average_clusters(df, "i", "v", cutoff, "euclidean", within="g", most=29).collect()}
    assert got == want and len(rounds) == 1 and len(set(want.values())) > 1


def test_splitting_p_of_large_sets():
    """half of all places, against the exact tail (Gnedenko and Korolyuk); before, a move was lost if one of its exchanges was, which is nearly always in large sets."""
    m, k = 600, 120
    choose = lambda n, i: math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1)
    want = choose(2 * m, m - k) - choose(2 * m, m)
    got = [math.log(N.splitting_p(k / m - 1e-9, m, 2 * m, np.ones(2 * m), np.random.default_rng(i), moves=40)) for i in range(3)]
    assert abs(np.mean(got) - want) < 2.5 and want < -20
