"""Cues, sweeps, whole-number rules and presets at their edges."""

from __future__ import annotations

import math
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from glimmer import codec, palettes
from glimmer.functions import quant
from glimmer.operators import analytics, cues, images, sweep


def test_whole_numbers(spark):
    far = (1 << 63) - 1
    pairs = [(a, b) for a in (0, 1, -1, 7, -7, 10**15 + 1, -far, far) for b in (1, -1, 3, -3, 0, far)]
    d = spark.createDataFrame(pairs, "a long, b long").select("a", "b", quant.floor_div(F.col("a"), F.col("b")).alias("low"), quant.ceil_div(F.col("a"), F.col("b")).alias("high"))
    for r in d.collect():
        assert (r.low, r.high) == ((r.a // r.b, -(-r.a // r.b)) if r.b else (None, None))
    near = [k * k + e for k in (1, 2, 3, 94906265, 94906267, 3037000498, 3037000499) for e in (-1, 0, 1)]
    for r in spark.createDataFrame([(n,) for n in [*near, 0, -5, far, None]], "n long").select("n", quant.isqrt(F.col("n")).alias("root")).collect():
        assert r.root == (None if r.n is None else math.isqrt(max(r.n, 0)))


def test_texts_of_times(spark):
    values = [4.795, 0.125, 0.25, 0.35, 2.675, 10.05, 99.95, 100.5, 101.5, 999.95, 1234.5, 1e9 + 0.5]

    def exact(x, digits, even):
        scaled = Fraction(x) * 10**digits
        n, rest = divmod(scaled, 1)
        n += rest > Fraction(1, 2) or (rest == Fraction(1, 2) and (not even or n % 2 == 1))
        return f"{int(n) / 10**digits:.{digits}f}"

    d = spark.createDataFrame([(v,) for v in values], "v double").select("v", analytics.milliseconds_text(F.col("v")).alias("ms"), analytics.duration_text(F.col("v")).alias("us"))
    for r in d.collect():
        assert r.ms == exact(r.v, 0 if r.v >= 100 else 1 if r.v >= 10 else 2, False) + " ms"
        assert r.us == (exact(r.v, 1, True) + " us" if r.v < 1000 else exact(r.v / 1000, 2, True) + " ms")
    odd = spark.createDataFrame([(0.0,), (None,), (float("nan"),), (float("inf"),)], "v double").select(analytics.milliseconds_text(F.col("v")))
    assert {r[0] for r in odd.collect()} == {"—"}


def test_milliseconds_are_those_of_their_sql(spark, tmp_path):
    """25 and 250 times 1.37 end in exact halves."""
    import duckdb

    from glimmer.plans import load_all
    from glimmer.registry import ORACLES, QUERIES

    load_all()
    rows = [(i, "a", i, v) for i, v in enumerate([25.0, 250.0, 25.5, 0.0, None, 75.0, 1234.5, 3.125])]
    spark.createDataFrame(rows, "event_id long, event_type string, user_id long, value double").write.parquet(f"{tmp_path}/events.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = sorted(db.execute(ORACLES["milliseconds"]).fetchall())
    assert sorted(map(tuple, QUERIES["milliseconds"](spark, str(tmp_path)).collect())) == want
    assert (0, "34.2 ms") in want and (1, "342 ms") in want


def test_presets_and_palettes():
    assert codec.preset("small_circle") == codec.of("circle", 12)
    with pytest.warns(DeprecationWarning):
        assert codec.preset("placeholder_circle") == codec.preset("small_circle")
    with pytest.raises(KeyError):
        codec.preset("none")
    assert {n: len(palettes.get(n)) // 6 for n in (*palettes.THEMED, *palettes.ALSO)} == {
        "mono": 2, "gb-pocket": 4, "gb-dmg": 4, "gba-warm": 4, "cga": 4, "resurrect-64": 64, "pc98": 16, "oil-6": 6, "lospec500": 42, "endesga-32": 32,
    }


def test_cues(spark):
    flat = spark.createDataFrame([(1, y, x, 0.5, 0.5, 0.5) for y in range(3) for x in range(5)] + [(2, 0, 0, 0.1, 0.2, 0.3)], "k int, y int, x int, r double, g double, b double")
    for cue in cues.CUES:
        got = cues.weighted(flat, ["k"], cue, 3.0).collect()
        assert len(got) == 16 and all(1 <= r.weight <= 4 for r in got)
        assert cue == "center" or all(abs(r.weight - 1) < 1e-6 for r in got)
        ground = {r.k: r for r in cues.background(cues.weighted(flat, ["k"], cue, 3.0), ["k"]).collect()}
        assert math.isclose(ground[1].r, 0.5) and math.isclose(ground[2].b, 0.3)
    assert cues.weighted(flat.limit(0), ["k"], "edge", 1.0).count() == 0
    with pytest.raises(ValueError):
        cues.weighted(flat, ["k"], "else", 1.0)


def test_worst_place(spark):
    errors = spark.createDataFrame([(1, 0, 0, 5.0), (1, 0, 1, 5.0), (1, 1, 0, None), (2, 0, 0, 1.0), (3, 2, 2, 7.0)], "k int, gy int, gx int, e double")
    used = spark.createDataFrame([(1, 0, 0), (2, 0, 0), (2, 0, 0)], "k int, gy int, gx int")
    assert sorted(map(tuple, cues.worst_place(errors, used, ["k"]).collect())) == [(1, 0, 1, 5.0), (3, 2, 2, 7.0)]


def test_sweep(spark):
    pixels = [((7 * i) % 256, (11 * i) % 256, (5 * i) % 256) for i in range(64)]
    r, g, b = (list(c) for c in zip(*pixels, strict=True))
    df = spark.createDataFrame([(1, 8, 8, r, g, b), (2, 8, 8, None, g, b), (3, 16, 4, r, g, b)], "k int, w int, h int, r array<int>, g array<int>, b array<int>")
    codecs = {"cells": codec.of("pixel", 16), "circles": codec.of("circle", 4)}
    assert list(sweep.methods(("rect",), (4, 8))) == ["dct", "rect-4", "rect-8"]
    got = {(x.k, x.method): x for x in sweep.rate_distortion(df, ["k"], codecs, 8).collect()}
    assert len(got) == 6
    for name, c in codecs.items():
        back = images.decode(images.encode(df.where("k = 1"), c).select("k", "hash"), c, base=8).collect()[0]
        mse = sum((p - q) ** 2 for a, z in ((r, back.r), (g, back.g), (b, back.b)) for p, q in zip(a, z, strict=True)) / 192
        assert math.isclose(got[1, name].psnr, 20 * math.log10(255 / math.sqrt(mse)))
        assert got[1, name].bytes == len(back.hash) // 2 and got[1, name].error is None
        assert got[2, name].psnr is None and got[2, name].error
        assert got[3, name].psnr is None
