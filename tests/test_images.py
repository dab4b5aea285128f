"""Pictures by any codec: against the row-wise operators, with errors, opacity, JSON and SQL functions."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from glimmer import codec as C
from glimmer import palettes, sql
from glimmer.operators import dct, images, shapes
from glimmer.operators.fit import SearchOptions

FEW = SearchOptions(n_random=6, hill_climb_steps=2, n_attempts=1)
CODECS = [C.of(k, 4) for k in ("circle", "triangle", "square", "rect", "rotrect")] + [C.of("pixel", 6), C.of("dct"), C.of("pixel", 12).with_color(24), C.of("circle", 3).with_palette(palettes.get("gb_dmg")), replace(C.of("rect", 2), alpha_bits=2, color_bits=24)]


def pictures(spark, n=3, w=14, h=9, extra=()):
    rng = np.random.default_rng(w * h)
    rows = []
    for i in range(n):
        small = rng.integers(0, 256, (3, 3, 3))
        img = np.kron(small, np.ones((-(-h // 3), -(-w // 3), 1)))[:h, :w].astype(int)
        rows.append((i, w, h, *(img[..., k].reshape(-1).tolist() for k in range(3))))
    return spark.createDataFrame([*rows, *extra], "vec_id int, w int, h int, r array<int>, g array<int>, b array<int>")


def grid(df):
    return {r.vec_id: (r.w, r.h, list(zip(r.r, r.g, r.b, strict=True))) for r in df.collect()}


@pytest.mark.parametrize("codec", CODECS, ids=lambda c: f"{c.shape}{c.n_shapes}-{c.color_field}")
def test_arrays_are_the_rows(spark, codec):
    d = images.encode(pictures(spark), codec, options=FEW).select("vec_id", "hash").cache()
    got = grid(images.decode(d, codec, base=20))
    rows = (dct.decode(d, base=20) if codec.shape == "dct" else shapes.decode(d, codec, base=20)).collect()
    want: dict = {}
    for r in sorted(rows, key=lambda r: (r.vec_id, r.y, r.x)):
        want.setdefault(r.vec_id, (r.w, r.h, []))[2].append((r.r, r.g, r.b))
    assert set(got) == set(want) == {0, 1, 2}
    for i in got:
        assert got[i][:2] == want[i][:2]
        differ = np.abs(np.array(got[i][2]) - np.array(want[i][2])).max(axis=1)
        assert (differ > 0).mean() < (0.01 if codec.shape == "dct" else 1e-9) and differ.max() <= 1 or codec.shape == "rotrect" and (differ > 0).mean() < 0.02


def test_cells_are_the_aggregation(spark):
    d = pictures(spark, w=11, h=7)
    px = d.select("vec_id", F.posexplode(F.arrays_zip("r", "g", "b")).alias("i", "p")).select("vec_id", F.floor(F.col("i") / 11).cast("int").alias("y"), (F.col("i") % 11).alias("x"), "p.*")
    for codec in (C.of("pixel", 16), C.of("pixel", 5).with_color(24), C.of("pixel", 12).with_palette(palettes.get("pico8")), C.of("pixel", 12).with_grid_aspect(0.3)):
        assert {r.vec_id: r.hash for r in images.cells(d, codec).collect()} == {r.vec_id: r.hash for r in shapes.encode_cells(px, codec).collect()}


def test_a_column_of_codecs(spark):
    bad = [(7, 2, 2, [1], [1], [1]), (8, None, 2, [1], [1], [1]), (9, 1, 1, None, [1], [1]), (10, 1, 1, [300], [1], [1]), (11, 0, 0, [], [], [])]
    names = F.col("vec_id") % 4
    d = pictures(spark, n=7, extra=bad).withColumn("codec", F.when(names == 0, C.of("circle", 2).column()).when(names == 1, C.of("pixel", 4).column()).when(names == 2, C.of("dct").column()))
    d = d.withColumn("hash", F.lit("mine")).withColumn("a.b", F.lit(1))
    out = {r.vec_id: r for r in images.encode(d, "codec", options=FEW).collect()}
    assert set(out) == set(range(12)) - set() and len(out) == 12
    for i, r in out.items():
        if i % 4 == 3:
            assert r.hash is None and "codec" in r.error
        elif i >= 7:
            assert r.hash is None and r.error == "the arrays do not fit the size"
        else:
            assert r.error is None and len(r.hash) == {0: 24, 1: 18}.get(i % 4, len(r.hash))
    wrong = d.withColumn("codec", F.col("codec").withField("shape", F.lit("hexagon")))
    assert {r.error for r in images.encode(wrong, "codec").collect()} == {"the codec is null or not valid"}
    assert images.encode(d.limit(0), "codec").count() == 0
    many = spark.range(300).select(C.of("circle").column().withField("n_shapes", F.col("id").cast("int") + 1).alias("codec"), F.lit("00").alias("hash"))
    with pytest.raises(ValueError):
        images.decode(many, "codec")


def test_on_white(spark):
    d = pictures(spark, n=1).withColumn("a", F.transform("r", lambda v: F.lit(0)))
    white = pictures(spark, n=1).withColumns({c: F.transform(c, lambda v: F.lit(255)) for c in "rgb"})
    for codec in (C.of("pixel", 6), C.of("square", 2)):
        seen = images.encode(d, codec, options=FEW, a="a").collect()[0]
        assert seen.hash == images.encode(white, codec, options=FEW).collect()[0].hash
        assert seen.r == d.collect()[0].r  # the picture itself stays
    half = spark.range(1).select(images.over_white(F.lit(10), F.lit(128)).alias("v")).first().v
    assert half == int(128 / 255 * 10 + (1 - 128 / 255) * 255)
    assert images.encode(d, C.of("dct"), a="a").collect()[0].hash != images.encode(white, C.of("dct")).collect()[0].hash


def test_errors_and_svg(spark):
    codec = C.of("circle", 2)
    good = images.encode(pictures(spark, n=1), codec, options=FEW).first().hash
    d = spark.createDataFrame([(1, good), (2, good[:8]), (3, "xyz"), (4, None), (5, ""), (6, good.upper() + "00")], "vec_id int, hash string")
    seen = {r.vec_id: r for r in images.decode(d, codec, base=8).collect()}
    assert [seen[i].error for i in (1, 6)] == [None, None] and all(seen[i].error and seen[i].r is None for i in (2, 3, 4, 5))
    assert seen[1].r == seen[6].r
    two = C.of("pixel", 2).with_palette("000000ffffff808080")
    assert images.decode(spark.createDataFrame([("7f0f",)], "hash string"), two).first().error == "a colour is beyond the palette"
    svg = {r.vec_id: r for r in images.to_svg(d, codec, corner_radius=3.0).collect()}
    assert svg[1].svg.count("<circle") == 2 and "rx=" not in svg[1].svg and svg[2].svg is None and svg[2].error
    assert images.to_svg(d, C.of("dct")).where("svg is null and error = 'frequency hashes have no SVG'").count() == 6
    assert [r.e for r in spark.createDataFrame([("dct",), ("rect",)], "shape string").select(images.target_edge(F.struct("shape")).alias("e")).collect()] == [100, 48]


@pytest.mark.parametrize("codec", [*CODECS, replace(C.of("circle"), alpha_bits=1, alpha_levels=(0.25, 1.0)), C.of("pixel", 9).with_grid_aspect(1.5)], ids=str)
def test_json(spark, codec):
    text = sql.codec_to_json(codec)
    assert sql.codec_from_json(text) == codec
    column = spark.range(1).select(sql.codec_column_to_json(codec.column()).alias("t")).first().t
    assert sql.codec_from_json(column) == codec
    for bad in ("[]", '{"shape":"hexagon"}', '{"sides":3}', "{"):
        with pytest.raises(ValueError):
            sql.codec_from_json(bad)


def test_sql_functions(spark):
    sql.register(spark)
    codec = C.of("rect", 2)
    text = sql.codec_to_json(codec)
    pictures(spark, n=2).createOrReplaceTempView("pics")
    out = spark.sql(f"SELECT vec_id, ph_encode(w, h, r, g, b, '{text}') AS hash, ph_encode(w, h + 1, r, g, b, '{text}') AS none, ph_encode(w, h, r, g, b, 'no codec') AS no FROM pics").cache()
    plain = {r.vec_id: r.hash for r in images.encode(pictures(spark, n=2), codec).collect()}
    assert {r.vec_id: r.hash for r in out.collect()} == plain and all(r.none is None and r.no is None for r in out.collect())
    out.createOrReplaceTempView("hashes")
    drawn = spark.sql(f"SELECT vec_id, ph_decode(hash, '{text}', 12) AS p FROM hashes").select("vec_id", "p.*")
    assert grid(drawn) == grid(images.decode(out.select("vec_id", "hash"), codec, base=12))
    symbols = spark.sql(f"SELECT vec_id, s.* FROM hashes, LATERAL ph_symbols(hash, '{text}') s").where("field in ('x', 'y', 'w', 'h')").collect()
    want = shapes.symbols(out.select("vec_id", "hash"), codec).where("field in ('x', 'y', 'w', 'h')").collect()
    assert sorted((r.vec_id, r.field, r.pos, r.sym) for r in symbols) == sorted((r.vec_id, r.field, r.pos, r.sym) for r in want)
    rows = spark.sql(f"SELECT vec_id, s.* FROM hashes, LATERAL ph_shapes(hash, '{text}', 48) s WHERE field = 'x'").collect()
    assert sorted((r.vec_id, r.idx, int(r.value)) for r in rows) == sorted((r.vec_id, r.idx, r.cx) for r in shapes.shape_rows(out.select("vec_id", "hash"), codec, base=48).collect())
