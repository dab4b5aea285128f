"""Render styles in the array kernel against the column form, table functions on bad rows, and duplicates in a stream."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from glimmer import codec as C
from glimmer import palettes, sql
from glimmer.operators import effects, images, render, shapes
from glimmer.operators.effects import RenderStyle
from glimmer.streaming import distinct_pictures

HASHES = {"circle": "7fc89ceb2fea0fff5ae478faaee8ff43881100560b22e0ae54442f18a58854abf20ff980fe1ffa3d7f39047c1aa368088cff902f09", "rect": "7fc89c1cea23d3f7f557f43b26d58d94526479d10ba6b726d2fd30624680def17de807a45415a9553e5d23e7d39e6304d4796f88fa5ffa15d15f07", "pixel": "9e0821086108a108e10823086308a308e32825286528a528e52827286728a728e7"}


def picture(row):
    return np.stack([row.r, row.g, row.b], axis=-1).reshape(row.h, row.w, 3)


@pytest.mark.parametrize("kind", ["circle", "rect"])
def test_samples_are_the_column_forms(spark, kind):
    codec = C.of(kind, 12)
    d = spark.createDataFrame([(HASHES[kind],)], "hash string")
    got = picture(images.decode(d, codec, base=20, style=RenderStyle(samples=3)).first())
    want = np.zeros_like(got)
    for r in shapes.decode(d, codec, base=20, aa=3).collect():
        want[r.y, r.x] = r.r, r.g, r.b
    # single precision light may round to the byte beside
    assert np.abs(got - want).max() <= 1 and (got == want).mean() > 0.99
    hard = picture(images.decode(d, codec, base=20).first())
    assert (hard != got).any()


def test_smooth_cells_are_the_column_forms(spark):
    codec = C.of("pixel", 16)
    d = spark.createDataFrame([(HASHES["pixel"],)], "hash string")
    for base in (7, 33):
        got = picture(images.decode(d, codec, base=base, style=RenderStyle(smooth=True)).first())
        want = np.zeros_like(got)
        for r in shapes.decode(d, codec, base=base, smooth=True).collect():
            want[r.y, r.x] = r.r, r.g, r.b
        assert (got == want).all()


def test_blur_and_palettes_are_the_column_forms(spark):
    rng = np.random.default_rng(1)
    img = rng.integers(0, 256, (9, 11, 3))
    px = spark.createDataFrame([(1, 11, 9, y, x, *map(int, img[y, x])) for y in range(9) for x in range(11)], "id int, w int, h int, y int, x int, r int, g int, b int")
    for dither in (False, True):
        want = np.zeros_like(img)
        for r in render.blurred(px, 1.3, ["id"], dither).collect():
            want[r.y, r.x] = r.r, r.g, r.b
        assert (effects.blurred(img[None], 1.3, dither)[0] == want).all()
        for r in render.posterised(px, palettes.get("pico8"), dither, 2).collect():
            want[r.y, r.x] = r.r, r.g, r.b
        assert (effects.posterised(img[None], RenderStyle(palette=palettes.get("pico8"), dither=dither, pitch=2))[0] == want).all()
    # planes in rows: odd ones become null, the others' columns stay
    rows = [(1, 11, 9, *(img[..., k].reshape(-1).tolist() for k in range(3)), "x"), (2, 11, 8, *(img[..., k].reshape(-1).tolist() for k in range(3)), "y"), (3, None, 9, None, None, None, None)]
    df = spark.createDataFrame(rows, "id int, w int, h int, r array<int>, g array<int>, b array<int>, note string")
    out = {r.id: r for r in effects.finish(df, RenderStyle(blur=0.7)).collect()}
    assert (picture(out[1]) == effects.blurred(img[None], 0.7)[0]).all() and out[1].note == "x"
    assert out[2].r is None and out[3].b is None and out[2].note == "y"
    plan = effects.finish(df, RenderStyle(blur=2.0))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_palettes_at_render_time():
    ramp = np.repeat(np.arange(256)[None, :, None], 64, axis=0).repeat(3, axis=2)[None]
    two = RenderStyle(palette="000000ffffff")
    hard, soft = effects.posterised(ramp, two), effects.posterised(ramp, RenderStyle(palette="000000ffffff", dither=True))
    assert set(np.unique(hard)) == set(np.unique(soft)) == {0, 255}
    # hard edges stand at the middle; dithering mixes around it, more and more of the lighter colour
    assert (hard[0, :, :127] == 0).all() and (hard[0, :, 129:] == 255).all()
    share = [soft[0, :, at : at + 32].mean() for at in range(0, 256, 32)]
    assert share == sorted(share) and 0 < share[3] < share[4] < 255
    # a dot's size follows the long edge: 256 / 128 pixels
    assert (soft[0, 0::2] == soft[0, 1::2]).all()
    fine = effects.posterised(ramp, RenderStyle(palette="000000ffffff", dither=True, pitch=1))
    assert (fine[0, 0::2] != fine[0, 1::2]).any()
    one = effects.posterised(ramp, RenderStyle(palette="102030", dither=True))
    assert (one == (16, 32, 48)).all()
    assert effects.spacing(np.array([[0, 0, 0], [0, 0, 10], [0, 30, 0]])) == pytest.approx((10 + 10 + 30) / 3)


def test_frequencies_in_a_palette(spark):
    d = spark.createDataFrame([("6765139e37938787517778797776926e390964",), ("zz",)], "hash string")
    style = RenderStyle(palette=palettes.get("c64"), dither=True)
    colors = {tuple(int(palettes.get("c64")[6 * i + j : 6 * i + j + 2], 16) for j in (0, 2, 4)) for i in range(16)}
    drawn, bad = images.decode(d, C.of("dct"), base=24, style=style).orderBy(F.col("w").isNull()).collect()
    assert bad.w is None and bad.error
    assert {tuple(p) for p in picture(drawn).reshape(-1, 3).tolist()} <= colors
    plain = picture(images.decode(d.limit(1), C.of("dct"), base=24).first())
    dithered = picture(images.decode(d.limit(1), C.of("dct"), base=24, style=RenderStyle(dither=True)).first())
    assert 0 < np.abs(plain - dithered).max() <= 1


def test_precedence_of_blurs_and_warnings(spark):
    assert RenderStyle(blur=2).effective_blur(5) == 2 and RenderStyle().effective_blur(5) == 5 and RenderStyle().effective_blur(-1) == 0
    d = spark.createDataFrame([(HASHES["circle"],)], "hash string")
    codec = C.of("circle", 12)
    text = [images.to_svg(d, codec, blur=3.0, style=s).first().svg for s in (RenderStyle(blur=2.0), RenderStyle())]
    assert text[0] == images.to_svg(d, codec, blur=2.0).first().svg != text[1]
    with pytest.warns(UserWarning, match="corner radius"):
        images.to_svg(d, codec, corner_radius=2.0)
    for bad in ({"samples": 0}, {"pitch": -1}, {"blur": -1.0}, {"palette": "12345"}):
        with pytest.raises(ValueError):
            RenderStyle(**bad)


def test_table_functions_leave_bad_rows_out(spark):
    sql.register(spark)
    good = sql.codec_to_json(C.of("circle", 12))
    rows = [(1, HASHES["circle"], good), (2, HASHES["circle"], "{}x"), (3, "zz", good), (4, "7f00", good), (5, None, good), (6, HASHES["circle"], None), (7, HASHES["circle"], sql.codec_to_json(C.of("dct")))]
    spark.createDataFrame(rows, "id int, hash string, codec string").createOrReplaceTempView("mixed_hashes")
    shapes_ = spark.sql("SELECT id, s.* FROM mixed_hashes, LATERAL ph_shapes(hash, codec, 48) s").collect()
    symbols = spark.sql("SELECT id, s.* FROM mixed_hashes, LATERAL ph_symbols(hash, codec) s").collect()
    assert {r.id for r in shapes_} == {1} == {r.id for r in symbols} and len(shapes_) == 48


def test_duplicates_in_a_stream(spark, tmp_path):
    def rows(*of):
        return spark.createDataFrame([(t, i, 2, 1, [i, 2], [3, 4], [5, 6] if i else None) for t, i in of], "at string, id int, w int, h int, r array<int>, g array<int>, b array<int>").select(F.to_timestamp("at").alias("ts"), "id", "w", "h", "r", "g", "b")

    first = rows(("2024-01-01 10:00:00", 1), ("2024-01-01 10:01:00", 2), ("2024-01-01 10:02:00", 1), ("2024-01-01 10:02:00", 0))
    first.write.parquet(f"{tmp_path}/in")

    def run():
        stream = spark.readStream.schema(first.schema).parquet(f"{tmp_path}/in")
        q = distinct_pictures(stream, late="10 minutes").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        q.awaitTermination(120)
        return sorted(r.id for r in spark.read.parquet(f"{tmp_path}/out").collect())

    assert run() == [1, 2]
    # the same pictures in another file, after a restart: no second row; a new one comes through
    rows(("2024-01-01 10:03:00", 1), ("2024-01-01 10:05:00", 3), ("2024-01-01 10:01:00", 2)).write.mode("append").parquet(f"{tmp_path}/in")
    assert run() == [1, 2, 3]
    rows(("2024-01-01 12:00:00", 4)).write.mode("append").parquet(f"{tmp_path}/in")
    assert run() == [1, 2, 3, 4]
    # behind the watermark: dropped; what state has forgotten comes again
    rows(("2024-01-01 10:06:00", 5), ("2024-01-01 12:01:00", 1)).write.mode("append").parquet(f"{tmp_path}/in")
    assert run() == [1, 1, 2, 3, 4]
