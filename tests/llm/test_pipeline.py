"""The pipeline's stages against what brute force gives on each stage's own input."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from glimmer.llm.quality import KEEP, fit, grades_of, rate
from tests.llm import test_linededup, test_minhash

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(f"{tmp_path}/{k}")
        out = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert out.columns == columns
        seen.append((name, docs, out))
        docs = out
    (_, a, b), (_, _, c), (_, _, d), (_, _, e), (_, _, f) = seen
    model = fit(a, grades_of(spark.read.parquet(f"{SF}/labels.parquet")))
    kept = {r.doc_id for r in rate(a, model).where(F.element_at("tails", -1) >= KEEP).collect()}
    assert {r.doc_id for r in b.collect()} == kept
    want = test_linededup.brute([(r.doc_id, r.copy, r.text) for r in b.select("doc_id", F.xxhash64("text").alias("copy"), "text").collect()])
    got = {r.doc_id: r.text for r in c.collect()}
    assert got == {d: t for (d, _), t in want.items()}
    rows = [(r.doc_id, r.text) for r in c.collect()]
    assert {r.doc_id for r in d.collect()} == {x[0] for x in test_minhash.brute(rows, 5, 80) if x[3]}
    ids = {r.doc_id for r in d.collect()}
    counts = Counter(r.doc_id for r in e.collect())
    assert set(counts) <= ids and sum(counts.values()) > len(ids) / 2
    assert Counter(r.doc_id for r in f.collect()) == counts
    assert f.where("n_tokens is null").count() == 0


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "source", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() > 50


def test_copies_do_not_weigh(spark, tmp_path):
    fields = "doc_id long, source string, text string, n_chars long"
    one = "\n".join(f"line {i} of the only text that this source has" for i in range(3))
    rows = [(i, "copies", one) for i in range(40)] + [(100 + i, "own", f"text number {i} says {i * i} and {i * 7} things of its own") for i in range(40)]
    rows += [(200, "own", None), (201, "own", ""), (202, "own", " \n")]
    docs = spark.createDataFrame([(*r, len(r[2] or "")) for r in rows], fields)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    out = docs
    for _, stage in corpus_pipeline.STAGES[1:3]:
        out = stage(spark, out, str(tmp_path))
    left = corpus_pipeline.filled(out, docs)
    # of equal texts one document is left; those that never had a word stay
    assert sorted(r.doc_id for r in left.collect()) == [0, *range(100, 140), 200, 201, 202]
    mixed = corpus_pipeline.mixing(spark, out, str(tmp_path))
    assert mixed.columns == docs.columns
    assert not {r.doc_id for r in mixed.collect()} & set(range(1, 40))
    counts = Counter(r.source for r in mixed.collect())
    assert counts["copies"] > 10
