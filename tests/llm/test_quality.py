"""Ordinal regression: thresholds, held-out accuracy, odd rows."""

from __future__ import annotations

import numpy as np

from glimmer.llm.quality import KEEP, MARKERS, fit, fit_model, grades_of, rate, select


def test_cumulative_link():
    rng = np.random.default_rng(1)
    n = 3000
    forms = rng.normal(size=(n, MARKERS))
    s = 2 * forms[:, 0] + rng.logistic(size=n)
    grade = (s > -1).astype(int) + (s > 1) + (s > 3)
    m = fit_model(grade, np.zeros(0, dtype=int), np.zeros(0, dtype=np.int32), forms)
    assert m.grades == 4 and (np.diff(m.thresholds) > 0).all()
    assert abs(m.markers[0] - 2) < 0.25 and np.abs(m.thresholds - [-1, 1, 3]).max() < 0.3
    tails = m.tails(np.array([-5.0, 0.0, 5.0]))
    assert (np.diff(tails, axis=0) > 0).all() and (np.diff(tails, axis=1) < 0).all()


def test_held_out(spark):
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    grades = grades_of(spark.read.parquet(f"{sf}/labels.parquet"))
    model = fit(docs, grades.where("doc_id % 4 <> 0"))
    out = rate(docs.join(grades.where("doc_id % 4 = 0"), "doc_id").select("text", "grade"), model).collect()
    by = {g: [r.tails[-1] >= KEEP for r in out if r.grade == g] for g in (0, 1, 2)}
    assert np.mean(by[2]) > 0.98 and np.mean(by[0]) < 0.05 and np.mean(by[1]) < 0.25
    assert all(abs(r.expected_grade - sum(r.tails)) < 1e-9 and r.tails[0] >= r.tails[1] for r in out)


def test_odd_rows(spark):
    text = "plain words stand here in a row "
    docs = [(i, text + f"item {i}") for i in range(30)] + [(i, "bad bad bad $$$ %%% " * 5) for i in range(30, 60)] + [(60, None), (61, ""), (None, text + "item 5"), (62, "x"), (62, "x"), (63, (text + "item 5 ") * 5000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("doc_id", "'s' as tails", "text", "1 as expected_grade", "2 as grade")
    labels = [(i, 1, 0) for i in range(30)] + [(i, 0, 0) for i in range(30, 60)] + [(0, 0, 0), (None, 1, 0), (61, 1, 1), (60, None, None), (62, 1, None), (999, 1, 0)]
    rated = grades_of(spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    model = fit(df, rated)
    kept = select(df, model)
    assert kept.columns == df.columns
    ids = {r.doc_id for r in kept.collect()}
    assert set(range(1, 30)) <= ids and not ids & set(range(30, 62)) and None in ids and 63 in ids
    assert fit(df, rated.limit(0)) is None
    assert {r.doc_id for r in select(df, None).collect()} == {r[0] for r in docs} - {60, 61}
    assert select(df.limit(0), model).count() == 0
