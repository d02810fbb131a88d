"""Line dedup, quality rules and license scans: against SQL, brute force, and on edge cases."""

from __future__ import annotations

import re

import brute
import pytest
from oracle import rows_of_duckdb, rows_of_spark

from evidentia.llm import licenses, queries
from evidentia.llm.license_templates import TEMPLATES
from evidentia.llm.line_dedup import dedup_lines
from evidentia.llm.quality import POLICIES, ablations, judged, ledger, mask


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_matches_oracle(spark, sf_dir, name):
    assert rows_of_spark(queries.queries()[name](spark, sf_dir)) == rows_of_duckdb(sf_dir, queries.oracle_sql()[name])


@pytest.mark.parametrize("name", ["op1_line_dedup", "op5_license_scan", "op9_quality_rules"])
def test_native_plans_run_no_python(spark, sf_dir, name):
    plan = queries.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_line_dedup_brute(docs):
    want = brute.dedup_lines([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert {r["doc_id"]: r["text"] for r in dedup_lines(docs).collect()} == want


def test_line_dedup_edges(edges, nothing):
    got = dedup_lines(edges).collect()
    assert len(got) == edges.count() and "n_lines" in got[0].asDict() and got[0]["kept"] == "kept"
    first = next(r for r in got if r["doc_id"] == 1)
    assert first["n_removed_lines"] == 0 and all(r["text"] == "" and r["n_removed_lines"] == 4 for r in got if r["doc_id"] == 2)
    assert next(r for r in got if r["doc_id"] == 3)["text"] is None
    assert dedup_lines(nothing).count() == 0


def test_line_dedup_merges_overlaps(spark):
    rows = [(1, "a\nb\nc\nd\ne"), (2, "x\na\nb\nc\nd\ny"), (3, "a\n\nb\nc\nz"), (4, "a\nb")]
    got = {r["doc_id"]: r["text"] for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "a\nb\nc\nd\ne", 2: "x\ny", 3: "\nz", 4: "a\nb"}


def test_line_dedup_long_lines(spark):
    """Passages of over 50 words go between other neighbours too, in one line or two; shorter ones stay."""
    long, half, short = (" ".join(f"{x}{i}" for i in range(n)) for x, n in (("a", 51), ("b", 26), ("c", 25)))
    rows = [(1, f"x\n{long}\ny"), (2, f"p\n{long} \nq"), (3, long), (4, f"{half}\n{half}r"), (5, f"s\n{half}\n\n{half}r\nt"), (6, f"u\n{short}\n{half}"), (7, f"{short}\n{short}"), (8, f"v\n{short}\n{short}\nw")]
    got = {r["doc_id"]: r["text"] for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute.dedup_lines(rows) and got[2] == "p\nq" and got[3] == "" and got[5] == "s\n\nt" and got[6] == rows[5][1] and got[8] == rows[7][1]


def test_line_dedup_within_a_text(spark):
    rows = [(1, "a\na\na\na\nz"), (2, "b\nb\nb")]
    got = {r["doc_id"]: r["text"] for r in dedup_lines(spark.createDataFrame(rows * 2, "doc_id long, text string")).collect()}
    assert got == {1: "a\nz", 2: "b\nb\nb"}


def test_quality_brute_and_edges(edges, nothing, docs):
    for df in (edges, docs):
        for r in ledger(df).collect():
            want = brute.quality(r["doc"]["text"])
            assert {k: r[k] for k in want} == want
    assert ledger(nothing).count() == 0


def test_quality_of_a_very_long_text(spark):
    """No window of 2 million distinct words repeats, whatever their hashes; with three words said again, six do."""
    df = spark.range(1).selectExpr("id as doc_id", "array_join(transform(sequence(1, 2000000), i -> concat('w', i)), ' ') as text")
    rows = ledger(df.union(df.selectExpr("doc_id", "concat(text, ' w7 w8 w9')"))).select("n_words", "n_repeat_words").collect()
    assert sorted(map(tuple, rows)) == [(2_000_000, 0), (2_000_003, 6)]


def test_policies_and_ablations(docs):
    book = judged(ledger(docs)).cache()
    rows = book.collect()
    assert all(r["kept"] == (r["failed_bits"] & mask(POLICIES["v2"]) == 0) for r in rows) and not any(r["kept"] and r["base_failed"] for r in rows)
    for a in ablations(book).collect():
        bit = mask([a["rule"]])
        assert a["n_failed"] == sum(bool(r["failed_bits"] & bit) for r in rows)
        assert a["n_kept_without"] == sum(r["failed_bits"] & ~bit == 0 for r in rows)
    book.unpersist()


def test_quality_agrees_with_labels(spark, sf_dir, docs):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = judged(ledger(docs)).selectExpr("doc.doc_id", "kept", "n_words").join(labels, "doc_id").filter("n_words >= 50").collect()
    assert rows and all(r["kept"] == bool(r["quality"]) for r in rows)


def test_licenses_brute(spark, docs):
    def shingles(text):
        w = [x for x in re.split(r"[\W_]+", (text or "").lower()) if x]
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    notices = {(n, i): shingles(t) for n, texts in TEMPLATES.items() for i, t in enumerate(texts)}
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    for k, (n, i) in enumerate(notices):
        words = TEMPLATES[n][i].split()
        rows.append((10_000 + k, " ".join(["lead"] * (k * 7 % 90) + words + ["tail"] * 40)))
        rows.append((20_000 + k, " ".join(words[: len(words) // 2])))
    rows += [(30_000, None), (30_001, "")]
    want = {(i, n, k): len(own & shingles(t)) for i, t in rows for (n, k), own in notices.items() if own and 100 * len(own & shingles(t)) >= 80 * len(own)}
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["license"], r["notice"]): r["n_shared"] for r in got} == want and len(got) == len(want)


def test_licenses_in_pieces_and_twice(spark):
    """Containment is that of the whole text: a notice in pieces, one met twice, and one far into a very long text are matches."""
    notice = TEMPLATES["Zlib"][0]
    w = notice.split()
    far = " ".join(f"x{i}" for i in range(200_000))
    texts = [" ".join(w[: len(w) // 2] + ["foreign"] * 400 + w[len(w) // 2 :]), f"lead {notice} between {notice}", f"{far} {notice}", " ".join(w[: len(w) // 2])]
    got = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect() if r["license"] == "Zlib"}
    assert set(got) == {0, 1, 2} and got[0]["n_shared"] == got[0]["n_notice"] - 4 and got[1]["containment"] == 1
    assert (got[0]["at_word"], got[1]["at_word"], got[2]["at_word"]) == (0, 1, 200_000)


def test_licenses_edges(edges, nothing):
    assert licenses.scan(edges).count() == 0 and licenses.scan(nothing).count() == 0


def test_license_scan_of_torn_notices(spark):
    """Foreign words between the words of a notice, one after every g: found just where 80 % of its shingles are left."""
    text = next(t for own in TEMPLATES.values() for t in own if len(t.split()) > 60)
    words_, rows, want = re.findall(r"[\w]+", text.lower()), [], {}
    whole = {tuple(words_[i : i + 5]) for i in range(len(words_) - 4)}
    for g in [*range(1, 21), 30, 45, 80]:
        torn = [x for i, w in enumerate(words_) for x in ((w, f"zq{i}") if i % g == g - 1 else (w,))]
        left = {tuple(torn[i : i + 5]) for i in range(len(torn) - 4)} & whole
        rows.append((g, " ".join(torn)))
        want[g] = 100 * len(left) >= 80 * len(whole)
    # every shingle by itself, a foreign word behind each
    rows.append((1000, " ".join(" ".join(words_[i : i + 5]) + f" zq{i}" for i in range(len(words_) - 4))))
    want[1000] = True
    found = {r["doc_id"] for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), {"one": (text,)}).collect()}
    assert found == {g for g, w in want.items() if w} and not all(want.values())
