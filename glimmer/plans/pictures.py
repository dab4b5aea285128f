"""Queries over the 8 x 8 pictures made of embeddings: pixel and frequency hashes, sums, metrics."""

from __future__ import annotations

from math import pi

from pyspark.sql import functions as F

from .. import palettes
from ..codec import of
from ..functions import color
from ..functions.rows import computed
from ..operators import dct, shapes, sums
from ..operators import images as ops
from ..operators.effects import RenderStyle
from ..operators.render import kernel
from ..registry import query
from .fixtures import BYTE, IMAGES, LINEAR, images, named_colors, pictures, pixels, rows_of, six, table

PIXEL16 = of("pixel", 16)
_LIN = f"lin AS (SELECT vec_id, y, x, {LINEAR.format('r')} AS r, {LINEAR.format('g')} AS g, {LINEAR.format('b')} AS b FROM px)"
_MEAN = "mean AS (SELECT vec_id, y // 2 AS gy, x // 2 AS gx, round(avg(r), 9) AS r, round(avg(g), 9) AS g, round(avg(b), 9) AS b FROM lin GROUP BY ALL)"
_U8 = f"u8 AS (SELECT vec_id, gy, gx, {BYTE.format('r')} AS r, {BYTE.format('g')} AS g, {BYTE.format('b')} AS b FROM mean)"
_CODE = "code AS (SELECT vec_id, gy, gx, ((r >> 3) << 11) | ((g >> 2) << 5) | (b >> 3) AS p FROM u8)"


@query(
    "pixel_encode",
    f"WITH {IMAGES}, {_LIN}, {_MEAN}, {_U8}, {_CODE} SELECT vec_id, '7f' || string_agg(lower(printf('%02x%02x', p % 256, p // 256)), '' ORDER BY gy, gx) AS hash FROM code GROUP BY vec_id",
)
def pixel_encode(spark, sf):
    return ops.cells(pictures(spark, sf), PIXEL16).select("vec_id", "hash")


_BACK = "back AS (SELECT vec_id, gy, gx, ((p >> 11) << 3) | ((p >> 11) >> 2) AS r, (((p >> 5) & 63) << 2) | (((p >> 5) & 63) >> 4) AS g, ((p & 31) << 3) | ((p & 31) >> 2) AS b FROM code)"


@query("pixel_decode_nearest", f"WITH {IMAGES}, {_LIN}, {_MEAN}, {_U8}, {_CODE}, {_BACK} SELECT vec_id, gy * 2 + i AS y, gx * 2 + j AS x, r::INT AS r, g::INT AS g, b::INT AS b FROM back, (SELECT unnest(range(2)) AS i), (SELECT unnest(range(2)) AS j)")
def pixel_decode_nearest(spark, sf):
    return rows_of(ops.decode(pixel_encode(spark, sf), PIXEL16, base=8), "vec_id")


_AT = "at_ AS (SELECT v, least(greatest(floor((v + 0.5::DOUBLE) / 2 - 0.5::DOUBLE), 0), 3)::INT AS low, (v + 0.5::DOUBLE) / 2 - 0.5::DOUBLE AS f FROM (SELECT unnest(range(8))::INT AS v)), share AS (SELECT v, low, least(low + 1, 3) AS high, least(greatest(f - low, 0), 1) AS d FROM at_)"
_BLENDED = ", ".join(f"floor((1 - sy.d) * ((1 - sx.d) * a.{c} + sx.d * b.{c}) + sy.d * ((1 - sx.d) * c.{c} + sx.d * d.{c}) + 1e-9)::INT AS {c}" for c in "rgb")


@query(
    "pixel_decode_smooth",
    f"""WITH {IMAGES}, {_LIN}, {_MEAN}, {_U8}, {_CODE}, {_BACK}, {_AT} SELECT a.vec_id, sy.v AS y, sx.v AS x, {_BLENDED} FROM share sy CROSS JOIN share sx JOIN back a ON a.gy = sy.low AND a.gx = sx.low
    JOIN back b ON b.vec_id = a.vec_id AND b.gy = sy.low AND b.gx = sx.high JOIN back c ON c.vec_id = a.vec_id AND c.gy = sy.high AND c.gx = sx.low JOIN back d ON d.vec_id = a.vec_id AND d.gy = sy.high AND d.gx = sx.high""",
)
def pixel_decode_smooth(spark, sf):
    """Cells blended bilinearly."""
    return rows_of(ops.decode(pixel_encode(spark, sf), PIXEL16, base=8, style=RenderStyle(smooth=True)), "vec_id")


_GAUSS = kernel(1.0)
_SOFT = ", ".join(f"least(greatest(floor(round(sum(ky.k * kx.k * p.{c}), 9) + 0.5::DOUBLE), 0), 255)::INT AS {c}" for c in "rgb")


@query(
    "gaussian_blur",
    f"""WITH {IMAGES}, {_LIN}, {_MEAN}, {_U8}, {_CODE}, {_BACK}, drawn AS (SELECT vec_id, gy * 2 + i AS y, gx * 2 + j AS x, r, g, b FROM back, (SELECT unnest(range(2)) AS i), (SELECT unnest(range(2)) AS j)),
    k AS (SELECT unnest({_GAUSS}::DOUBLE[]) AS k, unnest(range({len(_GAUSS)})) - {len(_GAUSS) // 2} AS o), at_ AS (SELECT v, least(greatest(v + o, 0), 7) AS p, sum(k) AS k FROM k, (SELECT unnest(range(8)) AS v) GROUP BY ALL)
    SELECT p.vec_id, ky.v::INT AS y, kx.v::INT AS x, {_SOFT} FROM drawn p JOIN at_ ky ON ky.p = p.y JOIN at_ kx ON kx.p = p.x GROUP BY ALL""",
)
def gaussian_blur(spark, sf):
    """Pixel hashes decoded at 8 pixels and blurred inside the picture's row."""
    return rows_of(ops.decode(pixel_encode(spark, sf), PIXEL16, base=8, style=RenderStyle(blur=1.0)), "vec_id")


@query(
    "pixel_svg",
    f"""WITH {IMAGES}, {_LIN}, {_MEAN}, {_U8}, {_CODE}, {_BACK}, h AS (SELECT *, [printf('%02x', r), printf('%02x', g), printf('%02x', b)] AS d FROM back),
    c AS (SELECT vec_id, gy, gx, '<rect x="' || gx * 16 || '" y="' || gy * 16 || '" width="16" height="16" fill="#' || CASE WHEN list_bool_and(list_transform(d, lambda t: t[1] = t[2])) THEN d[1][1] || d[2][1] || d[3][1] ELSE d[1] || d[2] || d[3] END || '"/>' AS e FROM h)
    SELECT vec_id, '<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 64 64">' || string_agg(e, '' ORDER BY gy, gx) || '</svg>' AS svg FROM c GROUP BY vec_id""",
)
def pixel_svg(spark, sf):
    return shapes.to_svg(pixel_encode(spark, sf), PIXEL16, base=64).select("vec_id", "svg")


_PICO = [tuple(int(palettes.get("pico8")[6 * i + j : 6 * i + j + 2], 16) for j in (0, 2, 4)) for i in range(16)]
_PAL = "pal AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, {r}, {g}, {b})" for i, (r, g, b) in enumerate(_PICO)) + ") AS t(idx, pr, pg, pb))"


@query(
    "palette_nearest",
    f"""WITH {IMAGES}, {_LIN}, {_PAL}, pl AS (SELECT idx, {LINEAR.format('pr')} AS r, {LINEAR.format('pg')} AS g, {LINEAR.format('pb')} AS b FROM pal)
    SELECT vec_id, y, x, min((round((lin.r - pl.r) * (lin.r - pl.r) + (lin.g - pl.g) * (lin.g - pl.g) + (lin.b - pl.b) * (lin.b - pl.b), 12), idx))[2]::INT AS idx FROM lin, pl GROUP BY ALL""",
)
def palette_nearest(spark, sf):
    d = pixels(spark, sf).select("vec_id", "y", "x", *(color.linear(F.col(c)).alias(c) for c in "rgb"))
    return d.select("vec_id", "y", "x", palettes.nearest(palettes.linear_array(palettes.get("pico8")), *(F.col(c) for c in "rgb")).alias("idx"))


_NAMES = list(palettes.NAMED)


@query(
    "palette_spread",
    f"""WITH {named_colors(palettes.NAMED)}, n AS (SELECT a.name, a.idx, min((a.r - b.r) ** 2 + (a.g - b.g) ** 2 + (a.b - b.b) ** 2) AS d FROM t a JOIN t b ON a.name = b.name AND a.idx <> b.idx GROUP BY ALL),
    s AS (SELECT name, round(avg(sqrt(d)), 6) AS spread FROM n GROUP BY name) SELECT p_partkey, name, spread FROM part JOIN s ON name = {_NAMES!r}[(p_partkey % {len(_NAMES)} + 1)::INT]""",
)
def palette_spread(spark, sf):
    """The spread of the palette that each part's key gives."""
    parts = table(spark, sf, "part").select("p_partkey", F.element_at(F.array(*map(F.lit, _NAMES)), (F.col("p_partkey") % len(_NAMES) + 1).cast("int")).alias("name"))
    return parts.join(F.broadcast(palettes.spreads(spark)), "name").select("p_partkey", "name", six(F.col("spread")).alias("spread"))


@query(
    "palette_posterize",
    f"""WITH {IMAGES}, {_PAL}, s AS (SELECT avg(sqrt(d)) AS s FROM (SELECT a.idx, min((a.pr - b.pr) ** 2 + (a.pg - b.pg) ** 2 + (a.pb - b.pb) ** 2) AS d FROM pal a JOIN pal b ON a.idx <> b.idx GROUP BY a.idx)),
    o AS (SELECT px.*, (({[v for row in color.BAYER for v in row]}[y * 8 + x + 1] + 0.5::DOUBLE) / 64 - 0.5::DOUBLE) * s AS o FROM px, s)
    SELECT vec_id, y, x, min((round((r + o - pr) ** 2 + (g + o - pg) ** 2 + (b + o - pb) ** 2, 6), idx))[2]::INT AS idx FROM o, pal GROUP BY ALL""",
)
def palette_posterize(spark, sf):
    from ..operators.render import posterised

    return posterised(pixels(spark, sf), palettes.get("pico8"), dither=True, pitch=1).select("vec_id", "y", "x", "idx")


@query("bayer_dither", f"WITH {IMAGES} SELECT vec_id, y, x, least(greatest(floor(r * 0.731::DOUBLE + ({[v for row in color.BAYER for v in row]}[y * 8 + x + 1] + 0.5::DOUBLE) / 64), 0), 255)::INT AS v FROM px")
def bayer_dither(spark, sf):
    return pixels(spark, sf).select("vec_id", "y", "x", color.quantised(F.col("r") * 0.731, color.dither_threshold(F.col("x"), F.col("y"))).alias("v"))


# Frequencies of the pictures' first channel, in 0..1.
_GRAY = "gray AS (SELECT vec_id, y, x, r / 255.0::DOUBLE AS v FROM px)"
_MASK = "mask AS (SELECT cy, cx FROM (SELECT unnest(range(7)) AS cy), (SELECT unnest(range(7)) AS cx) WHERE cx * 7 < 7 * (7 - cy))"
_PROJECT = f"coef AS (SELECT vec_id, cy::INT AS cy, cx::INT AS cx, sum(v * cos({pi!r} / 8 * cx * (x + 0.5::DOUBLE)) * cos({pi!r} / 8 * cy * (y + 0.5::DOUBLE))) / 64 AS v FROM gray, mask GROUP BY ALL)"
_AC = "ac AS (SELECT vec_id, cy, cx, round(v, 9) AS v FROM coef WHERE cy + cx > 0)"


@query("dct_mask", "WITH d AS (SELECT unnest(range(1, 8)) AS nx), e AS (SELECT nx, unnest(range(1, 8)) AS ny FROM d), c AS (SELECT nx, ny, (SELECT count(*) FROM range(7) a(cy), range(7) b(cx) WHERE cy < ny AND cx < nx AND cx * ny < nx * (ny - cy))::INT AS n FROM e) SELECT p_partkey, nx::INT AS nx, ny::INT AS ny, n FROM part JOIN c ON nx = p_partkey % 7 + 1 AND ny = p_partkey // 7 % 7 + 1")
def dct_mask(spark, sf):
    """How many frequencies are kept for the numbers of columns and rows that each part's key gives."""
    key = F.col("p_partkey")
    d = table(spark, sf, "part").select("p_partkey", (key % 7 + 1).cast("int").alias("nx"), (F.floor(key / 7) % 7 + 1).cast("int").alias("ny"))
    return d.select("p_partkey", "nx", "ny", F.size(dct.mask(F.col("nx"), F.col("ny"))).alias("n"))


def coefficients(spark, sf):
    d = computed(images(spark, sf), v=F.transform("u", lambda b: b / 255.0), m=dct.mask(F.lit(7), F.lit(7)))
    return computed(d, c=dct.project(F.col("v"), F.col("m"), F.lit(8), F.lit(8)))


@query("dct_project", f"WITH {IMAGES}, {_GRAY}, {_MASK}, {_PROJECT} SELECT vec_id, cy, cx, round(v, 6) + 0.0 AS v FROM coef")
def dct_project(spark, sf):
    d = coefficients(spark, sf).select("vec_id", F.explode(F.arrays_zip("m", "c")).alias("z"))
    return d.select("vec_id", "z.m.cy", "z.m.cx", six(F.col("z.c")).alias("v"))


def _ac(spark, sf):
    d = coefficients(spark, sf)
    return computed(d, ac=F.transform(F.slice("c", F.lit(2), F.size("c") - 1), lambda x: F.round(x, 9)))


@query("dct_compand", f"WITH {IMAGES}, {_GRAY}, {_MASK}, {_PROJECT}, {_AC} SELECT vec_id, cy, cx, round(sign(v) * pow(abs(v), 0.6), 6) + 0.0 AS v FROM ac")
def dct_compand(spark, sf):
    d = _ac(spark, sf).select("vec_id", F.explode(F.arrays_zip(F.slice("m", F.lit(2), F.size("m") - 1).alias("m"), "ac")).alias("z"))
    return d.select("vec_id", "z.m.cy", "z.m.cx", six(color.power(F.col("z.ac"), 0.6)).alias("v"))


_NIBBLE = "SELECT ac.vec_id, cy, cx, {scale} AS s, (SELECT min((round(abs(sign(v) * pow(abs(v), 0.6) - (i / 7.5::DOUBLE - 1) * pow({scale}, 0.6)), 9), i)) FROM range(16) t(i))[2]::INT AS n FROM ac"


@query("dct_nibbles", f"WITH {IMAGES}, {_GRAY}, {_MASK}, {_PROJECT}, {_AC} SELECT vec_id, cy, cx, n FROM ({_NIBBLE.format(scale='0.25::DOUBLE')})")
def dct_nibbles(spark, sf):
    d = computed(_ac(spark, sf), n=dct.nibbles(F.col("ac"), F.lit(0.25), 0.6))
    return d.select("vec_id", F.explode(F.arrays_zip(F.slice("m", F.lit(2), F.size("m") - 1).alias("m"), "n")).alias("z")).select("vec_id", "z.m.cy", "z.m.cx", "z.n")


@query("dct_encode")
def dct_encode(spark, sf):
    """Frequency hashes of all pictures; tests hold the encoder against published vectors."""
    return dct.encode(pictures(spark, sf)).select("vec_id", "hash")


@query("dct_scale_search")
def dct_scale_search(spark, sf):
    """The best scale of lightness coefficients; near ties may fall differently in other engines, so tests compare errors instead."""
    return _ac(spark, sf).select("vec_id", dct.best_scale(F.col("ac"), 31, 0.6).alias("scale"))


@query("dct_decode")
def dct_decode(spark, sf):
    """Pictures of the hashes of :func:`dct_encode` at 8 pixels."""
    return rows_of(ops.decode(dct_encode(spark, sf), of("dct"), base=8), "vec_id")


_TWICE = "CASE WHEN {0} = 0 THEN 1 ELSE 2 END"


@query("dct_palette")
def dct_palette(spark, sf):
    """Pictures of the hashes of :func:`dct_encode` at 32 pixels in a palette of 16 colours, dithered."""
    style = RenderStyle(palette=palettes.get("pico8"), dither=True)
    return rows_of(ops.decode(dct_encode(spark, sf), of("dct"), base=32, style=style), "vec_id")


@query(
    "dct_idct",
    f"""WITH {IMAGES}, {_GRAY}, {_MASK}, {_PROJECT}, p AS (SELECT unnest(range(8)) AS y), q AS (SELECT unnest(range(8)) AS x)
    SELECT vec_id, y::INT AS y, x::INT AS x, round(sum(v * cos({pi!r} / 8 * (x + 0.5::DOUBLE) * cx) * {_TWICE.format('cx')} * cos({pi!r} / 8 * (y + 0.5::DOUBLE) * cy) * {_TWICE.format('cy')}), 6) + 0.0 AS v FROM coef, p, q GROUP BY vec_id, y, x""",
)
def dct_idct(spark, sf):
    d = computed(coefficients(spark, sf), k=F.transform(F.arrays_zip("m", "c"), lambda z: F.struct(z["m"]["cy"].alias("cy"), z["m"]["cx"].alias("cx"), z["c"].alias("v"))))
    d = d.select("vec_id", "k", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("y")).select("vec_id", "k", "y", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("x"))
    return d.select("vec_id", "y", "x", six(dct.wave(F.col("k"), F.col("x"), F.col("y"), F.lit(8), F.lit(8))).alias("v"))


# Shapes and canvases for sums: a circle about each picture's darkest place, on its mean colour.
_CANVAS = f"""{_LIN}, bg AS (SELECT vec_id, avg(r) AS c_r, avg(g) AS c_g, avg(b) AS c_b FROM lin GROUP BY vec_id),
tc AS (SELECT lin.vec_id, y, x, r AS t_r, g AS t_g, b AS t_b, c_r, c_g, c_b FROM lin JOIN bg USING (vec_id)),
cov AS (SELECT * FROM tc WHERE (x - vec_id % 8) ** 2 + (y - vec_id // 8 % 8) ** 2 <= (vec_id % 4 + 1) ** 2)"""
_SUMS = "sums AS (SELECT vec_id, count(*) AS n, " + ", ".join(f"sum(t_{k}) AS st_{k}, sum(c_{k}) AS sc_{k}, sum(t_{k} * t_{k}) AS stt_{k}, sum(c_{k} * c_{k}) AS scc_{k}, sum(t_{k} * c_{k}) AS stc_{k}" for k in "rgb") + " FROM cov GROUP BY vec_id)"


def canvas(spark, sf):
    lin = pixels(spark, sf).select("vec_id", "y", "x", *(color.linear(F.col(c)).alias(f"t_{c}") for c in "rgb"))
    bg = lin.groupBy("vec_id").agg(*(F.avg(f"t_{c}").alias(f"c_{c}") for c in "rgb"))
    return lin.join(bg, "vec_id")


def covered(spark, sf):
    v = F.col("vec_id")
    dx, dy, r = F.col("x") - v % 8, F.col("y") - F.floor(v / 8) % 8, v % 4 + 1
    return canvas(spark, sf).where(dx * dx + dy * dy <= r * r)


@query("shape_sums", f"WITH {IMAGES}, {_CANVAS}, {_SUMS} SELECT vec_id, n, round(st_r, 6) AS st_r, round(sc_g, 6) AS sc_g, round(stt_b, 6) AS stt_b, round(scc_r, 6) AS scc_r, round(stc_g, 6) AS stc_g FROM sums")
def shape_sums(spark, sf):
    d = sums.shape_sums(covered(spark, sf), ["vec_id"])
    return d.select("vec_id", "n", *(six(F.col(c)).alias(c) for c in ("st_r", "sc_g", "stt_b", "scc_r", "stc_g")))


def _final(alpha: str) -> str:
    p = ", ".join(f"least(greatest((st_{k} - (1 - {alpha}) * sc_{k}) / ({alpha} * n), 0.0::DOUBLE), 1.0::DOUBLE) AS p_{k}" for k in "rgb")
    d = " + ".join(
        f"(2 * stc_{k} - scc_{k} - 2 * (1 - a) * stc_{k} + (1 - a) * (1 - a) * scc_{k} - 2 * a * p_{k} * st_{k} + 2 * a * (1 - a) * p_{k} * sc_{k} + a * a * p_{k} * p_{k} * n)" for k in "rgb"
    )
    return f"fin AS (SELECT *, {d} AS delta FROM (SELECT *, {alpha} AS a, {p} FROM {{0}}))"


@query("delta_sse", f"WITH {IMAGES}, {_CANVAS}, {_SUMS}, {_final('0.5::DOUBLE').format('sums')} SELECT vec_id, round(p_r, 6) AS p_r, round(p_g, 6) AS p_g, round(p_b, 6) AS p_b, round(delta, 6) + 0.0 AS delta FROM fin")
def delta_sse(spark, sf):
    d = sums.finalised(sums.shape_sums(covered(spark, sf), ["vec_id"]), F.lit(0.5))
    return d.select("vec_id", *(six(F.col(c)).alias(c) for c in ("p_r", "p_g", "p_b", "delta")))


@query(
    "alpha_sweep",
    f"""WITH {IMAGES}, {_CANVAS}, {_SUMS}, lv AS (SELECT sums.*, i, 0.20::DOUBLE + (0.90::DOUBLE - 0.20::DOUBLE) * i / 7 AS al FROM sums, (SELECT unnest(range(8)) AS i)), {_final('al').format('lv')},
    best AS (SELECT vec_id, min((round(delta, 6), i)) AS m FROM fin GROUP BY vec_id) SELECT vec_id, m[1] + 0.0 AS delta, m[2]::INT AS code FROM best""",
)
def alpha_sweep(spark, sf):
    from ..functions.quant import alpha_levels

    d = sums.swept(sums.shape_sums(covered(spark, sf), ["vec_id"]), alpha_levels(), ["vec_id"], digits=6)
    return d.select("vec_id", six(F.col("delta")).alias("delta"), "code")


@query("row_integral", f"WITH {IMAGES} SELECT vec_id, y, x, sum(r) OVER (PARTITION BY vec_id, y ORDER BY x)::BIGINT AS along FROM px")
def row_integral(spark, sf):
    return sums.row_integral(pixels(spark, sf), F.col("r")).select("vec_id", "y", "x", "along")


@query("integral_2d", f"WITH {IMAGES}, a AS (SELECT *, sum(r) OVER (PARTITION BY vec_id, y ORDER BY x) AS s FROM px) SELECT vec_id, y, x, sum(s) OVER (PARTITION BY vec_id, x ORDER BY y)::BIGINT AS area FROM a")
def integral_2d(spark, sf):
    return sums.area_integral(pixels(spark, sf), F.col("r")).select("vec_id", "y", "x", "area")


@query(
    "box_sums",
    f"""WITH {IMAGES}, ids AS (SELECT DISTINCT vec_id FROM px), four AS (SELECT vec_id, unnest(range(4))::INT AS box FROM ids), begun AS (SELECT *, (vec_id + box) % 10 - 1 AS x0, (3 * vec_id + box) % 10 - 1 AS y0 FROM four),
    ended AS (SELECT *, x0 + (vec_id + 2 * box) % 7 - 1 AS x1, y0 + (vec_id + box) % 8 - 1 AS y1 FROM begun)
    SELECT ended.vec_id, box, coalesce(sum(r), 0)::BIGINT AS total FROM ended LEFT JOIN px ON px.vec_id = ended.vec_id AND x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 GROUP BY ALL""",
)
def box_sums(spark, sf):
    """Four boxes in each picture; some reach over its edges, some are empty."""
    d, v, box = pixels(spark, sf), F.col("vec_id"), F.col("box")
    boxes = d.select("vec_id").distinct().select("vec_id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("box"))
    boxes = boxes.withColumns({"x0": (v + box) % 10 - 1, "y0": (3 * v + box) % 10 - 1})
    boxes = boxes.withColumns({"x1": F.col("x0") + (v + 2 * box) % 7 - 1, "y1": F.col("y0") + (v + box) % 8 - 1})
    return sums.box_sums(d, boxes, F.col("r"), 8, 8)


@query("residual_cdf", f"WITH {IMAGES}, {_CANVAS} SELECT vec_id, y, x, round(sum((t_r - c_r) ** 2 + (t_g - c_g) ** 2 + (t_b - c_b) ** 2) OVER (PARTITION BY vec_id ORDER BY y * 8 + x), 6) AS cdf FROM tc")
def residual_cdf(spark, sf):
    return sums.residual_cdf(canvas(spark, sf), 8).select("vec_id", "y", "x", six(F.col("cdf")).alias("cdf"))


@query("sse_total", f"WITH {IMAGES}, {_CANVAS} SELECT vec_id, round(sum((t_r - c_r) ** 2 + (t_g - c_g) ** 2 + (t_b - c_b) ** 2), 6) AS sse FROM tc GROUP BY vec_id")
def sse_total(spark, sf):
    return sums.squared_error(canvas(spark, sf), ["vec_id"]).select("vec_id", six(F.col("sse")).alias("sse"))


_PAIR = f"{_LIN}, {_MEAN}, {_U8}, {_CODE}, {_BACK}, two AS (SELECT px.vec_id, px.r AS r1, px.g AS g1, px.b AS b1, back.r AS r2, back.g AS g2, back.b AS b2 FROM px JOIN back ON px.vec_id = back.vec_id AND px.y // 2 = gy AND px.x // 2 = gx)"


def compared(spark, sf):
    a = pixels(spark, sf)
    b = pixel_decode_nearest(spark, sf).select("vec_id", "y", "x", *(F.col(c).alias(f"{c}2") for c in "rgb"))
    return a.join(b, ["vec_id", "y", "x"])


@query("psnr", f"WITH {IMAGES}, {_PAIR}, q AS (SELECT vec_id, avg(((r1 - r2) ** 2 + (g1 - g2) ** 2 + (b1 - b2) ** 2) / 3.0::DOUBLE) AS mse FROM two GROUP BY vec_id) SELECT vec_id, CASE WHEN mse <= 1e-12 THEN 'Infinity'::DOUBLE ELSE round(20 * log10(255 / sqrt(mse)), 6) END AS psnr FROM q")
def psnr(spark, sf):
    from ..operators.metrics import psnr as of_mse

    d = sum(((F.col(c) - F.col(f"{c}2")) * (F.col(c) - F.col(f"{c}2")) for c in "rgb"), F.lit(0)) / 3.0
    return compared(spark, sf).groupBy("vec_id").agg(F.avg(d).alias("mse")).select("vec_id", F.round(of_mse(F.col("mse")), 6).alias("psnr"))


@query("mean_abs_diff", f"WITH {IMAGES}, {_PAIR} SELECT vec_id, round(avg((abs(r1 - r2) + abs(g1 - g2) + abs(b1 - b2)) / 3.0::DOUBLE), 6) AS diff FROM two GROUP BY vec_id")
def mean_abs_diff(spark, sf):
    d = sum((F.abs(F.col(c) - F.col(f"{c}2")) for c in "rgb"), F.lit(0)) / 3.0
    return compared(spark, sf).groupBy("vec_id").agg(six(F.avg(d)).alias("diff"))


@query("linear_mse", f"WITH {IMAGES}, {_PAIR} SELECT vec_id, round(avg((({LINEAR.format('r1')}) - ({LINEAR.format('r2')})) ** 2), 6) AS mse FROM two GROUP BY vec_id")
def linear_mse(spark, sf):
    d = color.linear(F.col("r")) - color.linear(F.col("r2"))
    return compared(spark, sf).groupBy("vec_id").agg(six(F.avg(d * d)).alias("mse"))


_BOX = "avg({0}) OVER (PARTITION BY vec_id, {1} ORDER BY {2} ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS {0}"
_TERMS = ("a", "b", "aa", "bb", "ab")


@query(
    "ssim",
    f"""WITH {IMAGES}, {_LIN}, {_MEAN}, {_U8}, {_CODE}, {_BACK}, two AS (SELECT px.vec_id, px.y, px.x, px.r::DOUBLE AS a, back.r::DOUBLE AS b FROM px JOIN back ON px.vec_id = back.vec_id AND px.y // 2 = gy AND px.x // 2 = gx),
    t AS (SELECT *, a * a AS aa, b * b AS bb, a * b AS ab FROM two), h AS (SELECT vec_id, y, x, {", ".join(_BOX.format(k, "y", "x") for k in _TERMS)} FROM t), v AS (SELECT vec_id, y, x, {", ".join(_BOX.format(k, "x", "y") for k in _TERMS)} FROM h),
    w AS (SELECT vec_id, a, b, (aa - a * a) * 49 / 48 AS va, (bb - b * b) * 49 / 48 AS vb, (ab - a * b) * 49 / 48 AS vab FROM v WHERE y BETWEEN 3 AND 4 AND x BETWEEN 3 AND 4)
    SELECT vec_id, round(avg((2 * a * b + 6.5025::DOUBLE) * (2 * vab + 58.5225::DOUBLE) / ((a * a + b * b + 6.5025::DOUBLE) * (va + vb + 58.5225::DOUBLE))), 6) AS ssim FROM w GROUP BY vec_id""",
)
def ssim(spark, sf):
    from ..operators.metrics import ssim as of_pixels

    return of_pixels(compared(spark, sf), "vec_id", "r", "r2").select("vec_id", six(F.col("ssim")).alias("ssim"))
