"""The pipeline, stage by stage, against plain versions."""

from __future__ import annotations

import hashlib

import brute
import numpy as np
import public_tokenizers as P
import tiktoken

import corpus_pipeline
from evidentia.llm.bpe import load_ranks
from evidentia.llm.common import staged
from evidentia.llm.mixing import capped_shares


def test_stages(spark, sf_dir, docs):
    at, columns = {"input": docs}, docs.columns
    for name, stage in corpus_pipeline.STAGES:
        at[name] = staged(stage(spark, list(at.values())[-1], sf_dir), name)
    rows = {name: [r.asDict() for r in df.collect()] for name, df in at.items()}
    assert all(at[n].columns == columns for n, _ in corpus_pipeline.STAGES[:-1])

    def bad(t):
        q, letters = brute.quality(t), [c for c in t or "" if c.isalpha()]
        return q["n_words"] < 50 or 2 * q["n_repeat_words"] > q["n_words"] or 5 * q["n_symbols"] > q["n_words"] or 2 * sum(c.isupper() for c in letters) > len(letters)

    key = lambda rs: sorted((r["doc_id"], r["text"]) for r in rs)
    assert key(rows["quality_rules"]) == key(r for r in rows["input"] if not bad(r["text"]))
    assert key(rows["line_dedup"]) == sorted(brute.dedup_lines(key(rows["quality_rules"])).items())
    assert all(r["n_chars"] == len(r["text"]) for r in rows["line_dedup"])
    label = brute.components(dict(key(rows["line_dedup"])), 5)
    assert key(rows["near_dedup"]) == [x for x in key(rows["line_dedup"]) if label[x[0]] == x[0]]

    sizes: dict = {}
    for r in rows["near_dedup"]:
        sizes[r["source"]] = sizes.get(r["source"], 0) + len(brute.WORD.findall(r["text"]))
    taken: dict = {}
    for r in rows["mixing"]:
        taken[r["source"]] = taken.get(r["source"], 0) + len(brute.WORD.findall(r["text"]))
    longest: dict = {}
    for r in rows["near_dedup"]:
        longest[r["source"]] = max(longest.get(r["source"], 0), len(brute.WORD.findall(r["text"])))
    for s, want in capped_shares(sizes).items():  # whole documents of few: within one of them
        assert abs(taken.get(s, 0) - want) <= longest[s]
    assert {(r["doc_id"], r["text"]) for r in rows["mixing"]} <= {(r["doc_id"], r["text"]) for r in rows["near_dedup"]}

    coder = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=load_ranks(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    digest = lambda t: hashlib.sha256(np.array(coder.encode_ordinary(t), "<u4").tobytes()).hexdigest()
    want = sorted((r["doc_id"], digest(r["text"]), hashlib.sha256(r["text"].encode()).hexdigest()) for r in rows["mixing"])
    assert sorted((r["doc_id"], r["ids_sha256"], r["decoded_sha256"]) for r in rows["bpe"]) == want


def test_run_agrees_with_stages(spark, sf_dir, docs):
    for _, stage in corpus_pipeline.STAGES:
        docs = staged(stage(spark, docs, sf_dir), "stage")
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf_dir).collect())) == sorted(map(tuple, docs.collect()))


def test_edges(spark, sf_dir, edges, nothing):
    from pyspark.sql import functions as F

    for df in (edges.drop("n_chars").withColumn("n_chars", F.lit(1).cast("long")), nothing.withColumn("n_chars", F.lit(1).cast("long"))):
        for _, stage in corpus_pipeline.STAGES:
            made = stage(spark, df, sf_dir)
            made.collect()
