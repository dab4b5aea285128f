"""Shape hashes: published bytes, pictures and SVG texts, pixel hashes, styles."""

from __future__ import annotations

from dataclasses import replace
from xml.dom import minidom

import numpy as np
import pytest
from pyspark.sql import functions as F

from glimmer import palettes
from glimmer.codec import Codec, of
from glimmer.operators import shapes

PAL8 = palettes.from_rgb([(i * 32, 255 - i * 32, i * 17) for i in range(8)])
# Published hashes, and 64-bit FNV-1a digests of their pictures at 32 and SVG texts at 64.
GOLDEN = {
    "circle_solid": (of("circle"), "7f26cb10a2c93220449365408826cb80104d9601219a2c03423459068468b20c08d1641910a2c93220449365408826cb80104d9601", "4df2641f33c5afc5", "46648868d1e0675f"),
    "circle_gradient": (of("circle"), "7fc89ceb2fea0fff5ae478faaee8ff43881100560b22e0ae54442f18a58854abf20ff980fe1ffa3d7f39047c1aa368088cff902f09", "c0b2435044159e5b", "4604da83bf258379"),
    "circle24": (of("circle", 24), "91c89cff2d1a3ddb5ff4032db30838d43fd1dfb7492260f37c453d109d884c2bf90ffd7344221ac1be3c64fe9591a810fde510f0dbbfa1df539244c054f98778c0670db950eb13fa578735d4027d5c48fed3b7909ba5492140ef3e43dd95fe84fe3caa09d174", "c42bdc0775aff2be", "ddb0759a3199cd25"),
    "triangle": (of("triangle"), "9ec89ce003e83ff20bffff2002e47cfeff21fce8ff031c000e1000782d070d20e00e30c0ad452dd8b71f6080803f60e3071ffd60ed72783d9ab1f0ffff67f4ffa59f3fc5e88f02004c0a100006", "b14c304a7238c56d", "8099c17810586ad7"),
    "triangle_solid": (of("triangle"), "7f4f1e000400c2930700080084270f001000084f1e002000109e3c004000203c790080004078f200000180f0e401000200e1c903000400c2930700080084270f001000084f1e002000109e3c00", "1b297ad511b187c5", "16fe9bf53cbe98fb"),
    "square": (of("square"), "7fc89ceb37ea097d62c470f3cc28ff5cab114148e522b3aefe45be1d2d8a80ca0f17817f662e52c1cc5fc4037a8fc8fffc4591e10d", "ab8e33a3c1b88773", "46f7c789ca5811ba"),
    "rect": (of("rect"), "7fc89c1cea23d3f7f557f43b26d58d94526479d10ba6b726d2fd30624680def17de807a45415a9553e5d23e7d39e6304d4796f88fa5ffa15d15f07", "627c18d68e8b1ac2", "b14e262f60a6ef06"),
    "rotrect": (of("rotrect"), "8ac89cfeed7f64fa3efe1ad0cfb88ef746c0a1e6ba0fed7efa300304f09d9afd500b96febd443f58ad9a1da954c66c33a4887ea39ad0e0eb3d9e45fe2734aa100171", "c322fe6fd9da68bc", "c0d1fc3a7b4ba330"),
    "pixel": (of("pixel", 16), "9e0821086108a108e10823086308a308e32825286528a528e52827286728a728e7", "374dcde1402e9aa6", "a1e2339bf347d245"),
    "circle_palette": (replace(of("circle", 8), palette=PAL8), "7f5c7fb1bff64c8a69fd0d2a5b11bfebf245bf58b004", "5da1deead26168bd", "d2232eb7664cb7b6"),
    "triangle_rgb888": (of("triangle").with_color(24), "7f9898401fc0ff3f7f32100104ff7f807fa07df0c0cfe90040dc006c00000080f8a7fdfffbfb03cd7ef08105f807da871f50800f00b48c01031c4017480b60bc032c0090ae5c9af7546e2001098004000040dcf6ebbffe498106", "9da84a7b5ef7a138", "f97dd97c4f882a50"),
    "circle_search": (of("circle"), "7fc89ceb2fea0fbf5ba4fd29b50800e33e91dff98922a08f5a442e9d31899ef3c015e540b32002e6fe3c74fef96fe8ff84ffd01f07", "f001d22b6c1a86eb", "57c3128f2876c2f5"),
}


def fnv(data: bytes) -> str:
    h = 0xCBF29CE484222325
    for b in data:
        h = ((h ^ b) * 0x100000001B3) & (2**64 - 1)
    return f"{h:016x}"


def picture(rows) -> tuple[int, int, bytes]:
    w, h = rows[0].w, rows[0].h
    img = np.zeros((h, w, 4), dtype=np.uint8)
    for r in rows:
        img[r.y, r.x] = (r.r, r.g, r.b, r.a)
    return w, h, img.tobytes()


@pytest.mark.parametrize("name", GOLDEN)
def test_svg(spark, name):
    codec, hash_, _, want = GOLDEN[name]
    svg = shapes.to_svg(spark.createDataFrame([(hash_,)], "hash string"), codec, base=64).collect()[0].svg
    assert fnv(svg.encode()) == want, svg


@pytest.mark.parametrize("name", ["circle_gradient", "triangle", "square", "rect", "rotrect", "pixel", "circle_palette", "triangle_rgb888"])
def test_picture(spark, name):
    codec, hash_, want, _ = GOLDEN[name]
    w, h, rgba = picture(shapes.decode(spark.createDataFrame([(hash_,)], "hash string"), codec, base=32).collect())
    assert fnv(w.to_bytes(4, "little") + h.to_bytes(4, "little") + rgba) == want


def pixel_rows(spark, img, key=1):
    h, w, _ = img.shape
    return spark.createDataFrame([(key, y, x, *map(int, img[y, x])) for y in range(h) for x in range(w)], "vec_id int, y int, x int, r int, g int, b int")


def test_pixel_hashes(spark):
    y, x = np.mgrid[0:29, 0:48]
    img = np.stack((np.floor(x * 255 / 47 + 0.5), np.floor(y * 255 / 28 + 0.5), np.full_like(x, 64)), axis=2).astype(int)
    assert shapes.encode_cells(pixel_rows(spark, img), of("pixel", 16)).collect()[0].hash == GOLDEN["pixel"][1]
    red = np.full((48, 48, 3), (255, 0, 0))
    pico = replace(of("pixel", 48), palette=palettes.get("pico8"))
    assert shapes.encode_cells(pixel_rows(spark, red), pico).collect()[0].hash == "7f" + "88" * 24
    tiny = shapes.encode_cells(pixel_rows(spark, np.zeros((1, 1, 3))), of("pixel", 4)).collect()[0].hash
    assert tiny == "7f" + "0000" * 4


def test_styles(spark):
    codec, hash_, _, _ = GOLDEN["rotrect"]
    d = spark.createDataFrame([(hash_,)], "hash string")
    svg = shapes.to_svg(d, codec, blur=2.5, corner_radius=3.0, aspect=2.0).withColumn("svg", shapes.stretched(F.col("svg"))).collect()[0].svg
    minidom.parseString(svg)
    assert svg.startswith('<svg preserveAspectRatio="none"') and 'stdDeviation="2.5"' in svg and ' rx="3" ry="3"' in svg and 'viewBox="0 0 256 128"' in svg
    hard, soft, sampled = (np.frombuffer(picture(shapes.decode(d, codec, base=24, **k).collect())[2], dtype=np.uint8).astype(int) for k in ({}, {"corner_radius": 2.0}, {"aa": 2}))
    assert 0 < np.abs(hard - soft).mean() < 25 and 0 < np.abs(hard - sampled).mean() < 25
    with pytest.raises(ValueError):
        shapes.to_svg(d, of("dct"))


def test_rows_and_symbols(spark):
    codec, hash_, _, _ = GOLDEN["rect"]
    d = spark.createDataFrame([(1, hash_), (2, ""), (3, hash_[:20])], "id int, hash string")
    rows = shapes.shape_rows(d, codec).collect()
    assert len(rows) == 36 and {r.idx for r in rows} == set(range(12))
    out = shapes.symbols(d, codec)
    assert out.where("id = 1").count() == 12 * 8
    back = {(r.field, r.pos): r.sym for r in out.where("id = 2").collect()}
    assert set(back.values()) == {0}
    # an index beyond a palette has no colour
    odd = Codec("circle", 1, palette="000000111111222222")
    assert shapes.shape_rows(spark.createDataFrame([("ff" * 8,)], "hash string"), odd).collect()[0].color is None


@pytest.mark.parametrize("kind", ["circle", "square", "rect", "rotrect", "triangle"])
def test_covered_pixels_are_those_inside(spark, kind):
    rng = np.random.default_rng(6)
    rows = [(i, tuple(map(int, v[:8])), float(v[8])) for i, v in enumerate(np.column_stack((rng.integers(-6, 20, (300, 6)), rng.integers(0, 14, (300, 2)), rng.uniform(0, 3, 300))))]
    d = spark.createDataFrame([(i, *v, t) for i, v, t in rows], "id int, cx int, cy int, x1 int, y1 int, x2 int, y2 int, w int, h int, theta double")
    d = d.select("id", F.struct("cx", "cy", "x1", "y1", "x2", "y2", "w", "h", "theta").alias("s"))
    got = shapes.covered(d, kind, "s", 12, 9)
    # no row is compared pixel by pixel
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "filter(" not in plan and got.columns == ["id", "s", "covered"]
    each = d.select("id", "s", F.explode(F.sequence(F.lit(0), F.lit(107))).alias("i"))
    hit = shapes.inside(kind, F.col("s"), F.col("i") % 12, F.floor(F.col("i") / 12).cast("int"))
    want = {r.id: r.n for r in each.groupBy("id").agg(F.sum(hit.cast("int")).alias("n")).collect()}
    assert {r.id: r.covered for r in got.collect()} == want and len(set(want.values())) > 5
