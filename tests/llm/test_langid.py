"""The byte network: gradients, held-out accuracy, odd rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from glimmer.llm.langid import UNKNOWN, WINDOW, Network, Predictor, _softmax, fit, held_out, predict
from glimmer.llm.queries import op3_langid


def loss(net, x, y):
    p = Predictor(net).windows(x)
    return -np.log(p[np.arange(len(y)), y]).mean()


def test_gradients():
    rng = np.random.default_rng(1)
    net = Network.fresh(["a", "b", "c"], 5)
    for i, p in enumerate(net.parameters()):
        p[...] = rng.normal(size=p.shape) * 0.3
    x, y = rng.integers(0, 256, (8, WINDOW), dtype=np.uint8), rng.integers(0, 3, 8)
    for p, g in zip(net.parameters(), net.step(x, y), strict=True):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old = p[at]
        p[at] = old + 2e-3
        up = loss(net, x, y)
        p[at] = old - 2e-3
        down = loss(net, x, y)
        p[at] = old
        assert abs((up - down) / 4e-3 - g[at]) < 0.05 * abs(g[at]) + 2e-3


def test_tables_are_the_network():
    net = Network.fresh(["a", "b"], 7)
    x = np.random.default_rng(2).integers(0, 256, (3, WINDOW), dtype=np.uint8)
    pooled = []
    for w, f, b in zip((2, 3, 4), net.filters, net.biases, strict=True):
        e = net.embedding[x]
        h = np.concatenate([e[:, j : WINDOW - w + 1 + j] for j in range(w)], axis=2) @ f + b
        pooled.append(h.max(axis=1))
    want = _softmax(np.maximum(np.concatenate(pooled, axis=1), 0) @ net.top + net.offset)
    assert np.allclose(Predictor(net).windows(x), want, atol=1e-5)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    truth = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    out = op3_langid(spark, sf).join(truth, "doc_id").groupBy("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("right"), F.min("score").alias("low"), F.max("score").alias("high")).collect()
    assert {r.held_out for r in out} == {True, False}
    assert all(r.right > 0.96 and r.low >= 0 and r.high <= 1 for r in out)


def test_odd_rows(spark):
    learn = [("the cat and the dog went to the house " * 3, "en"), ("le chat et le chien sont dans la maison " * 3, "fr")] * 20 + [("x", None), (None, "en"), ("123", "zz"), ("", "de")]
    net = fit(spark.createDataFrame(learn, "text string, lang string"), per_lang=20)
    assert net.langs == ["en", "fr"]
    rows = [(1, None), (2, ""), (3, "12 .. !"), (3, "12 .. !"), (None, "the house and the dog"), (4, "le chien et la maison " * 20_000), (5, "é")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("text", "'q' as lang_pred", "doc_id", "1 as score")
    out = sorted(((str(r.doc_id), r.lang_pred, r.score) for r in predict(df, net).collect()), key=str)
    assert [(d, x) for d, x, _ in out[:4]] == [("1", UNKNOWN), ("2", UNKNOWN), ("3", UNKNOWN), ("3", UNKNOWN)]
    assert dict((d, x) for d, x, _ in out)["4"] == "fr" and dict((d, x) for d, x, _ in out)["None"] == "en"
    assert predict(df.limit(0), net).count() == 0
    assert fit(spark.createDataFrame([], "text string, lang string")) is None
    assert {r.lang_pred for r in predict(df, None).collect()} == {UNKNOWN}
    assert df.where(held_out()).count() in range(8)


def test_copies_do_not_thin(spark):
    english = [(f"the cat and the dog number {i} went to the house", "en") for i in range(30)]
    french = [(f"le chat et le chien {i} sont dans la maison", "fr") for i in range(20)]
    learn = spark.createDataFrame(english + french[1:], "text string, lang string")
    many = spark.range(100_000).select(F.lit(french[0][0]).alias("text"), F.lit("fr").alias("lang"))
    net, once = (fit(learn.unionByName(x), per_lang=20) for x in (many, many.limit(1)))
    assert net.langs == ["en", "fr"]
    assert all((a == b).all() for a, b in zip(net.parameters(), once.parameters(), strict=True))
