"""Scalar rules over keys and sizes of the driver's tables."""

from __future__ import annotations

from math import pi

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bits, color, quant
from ..registry import query
from .fixtures import BYTE, LINEAR, six, table

_DIMS = "d AS (SELECT p_partkey, (p_size + 1)::INT AS w, (p_partkey % 97 + 1)::INT AS h FROM part)"
_ASPECT = "least(greatest(round((log2(w::DOUBLE / h::DOUBLE) + 3) / 6 * 254.0::DOUBLE), 0), 254)::INT"


def dims(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", (F.col("p_size") + 1).cast("int").alias("w"), (F.col("p_partkey") % 97 + 1).cast("int").alias("h"))


@query("aspect_code", f"WITH {_DIMS} SELECT p_partkey, w, h, {_ASPECT} AS code FROM d")
def aspect_code(spark, sf):
    return dims(spark, sf).withColumn("code", quant.aspect_code(F.col("w"), F.col("h")))


@query("aspect_decode", f"WITH {_DIMS} SELECT p_partkey, round(pow(2.0::DOUBLE, {_ASPECT} / 254.0::DOUBLE * 6 - 3), 6) AS aspect FROM d")
def aspect_decode(spark, sf):
    d = dims(spark, sf)
    return d.select("p_partkey", six(quant.aspect_of_code(quant.aspect_code(F.col("w"), F.col("h")))).alias("aspect"))


_SHORT = "greatest({rule}({b}::DOUBLE * 48 / greatest({a}, 1))::INT, 1)"


@query(
    "fit_long_edge",
    f"""WITH {_DIMS}, k AS (SELECT *, greatest(w, h) <= 48 AS fits FROM d)
    SELECT p_partkey,
      CASE WHEN fits THEN w WHEN w >= h THEN 48 ELSE {_SHORT.format(rule="floor", a="h", b="w")} END::INT AS w_floor,
      CASE WHEN fits THEN h WHEN w >= h THEN {_SHORT.format(rule="floor", a="w", b="h")} ELSE 48 END::INT AS h_floor,
      CASE WHEN fits THEN w WHEN w >= h THEN 48 ELSE {_SHORT.format(rule="round_even", a="h", b="w").replace(" / greatest(h, 1))", " / greatest(h, 1), 0)")} END::INT AS w_even,
      CASE WHEN fits THEN h WHEN w >= h THEN {_SHORT.format(rule="round_even", a="w", b="h").replace(" / greatest(w, 1))", " / greatest(w, 1), 0)")} ELSE 48 END::INT AS h_even
    FROM k""",
)
def fit_long_edge(spark, sf):
    d = dims(spark, sf)
    a, b = quant.fit_long_edge(F.col("w"), F.col("h"), 48, "floor")
    c, e = quant.fit_long_edge(F.col("w"), F.col("h"), 48, "even")
    return d.select("p_partkey", a.alias("w_floor"), b.alias("h_floor"), c.alias("w_even"), e.alias("h_even"))


@query(
    "decode_size",
    f"""WITH {_DIMS}, a AS (SELECT p_partkey, pow(2.0::DOUBLE, {_ASPECT} / 254.0::DOUBLE * 6 - 3) AS a FROM d)
    SELECT p_partkey, CASE WHEN a >= 1 THEN 256 ELSE greatest(round(a * 256), 1) END::INT AS w, CASE WHEN a >= 1 THEN greatest(round(256 / a), 1) ELSE 256 END::INT AS h FROM a""",
)
def decode_size(spark, sf):
    d = dims(spark, sf).select("p_partkey", quant.aspect_of_code(quant.aspect_code(F.col("w"), F.col("h"))).alias("a"))
    w, h = quant.output_size(F.col("a"), 256)
    return d.select("p_partkey", w.alias("w"), h.alias("h"))


_CANVAS = "c AS (SELECT l_orderkey, l_linenumber, l_quantity::DOUBLE AS v, (l_partkey % 60 + 1)::INT AS w, (l_suppkey % 47 + 1)::INT AS h FROM lineitem)"


def canvases(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("double").alias("v"), (F.col("l_partkey") % 60 + 1).cast("int").alias("w"), (F.col("l_suppkey") % 47 + 1).cast("int").alias("h"))


_LOG_Q = "least(greatest(round(round(log2(greatest(v, lo) / lo) / log2(hi / lo) * 15.0::DOUBLE, 9) / 15 * 15.0::DOUBLE), 0), 15)::INT"


@query(
    "radius_quant",
    f"""WITH {_CANVAS}, r AS (SELECT *, greatest(1.0::DOUBLE, least(w, h) / 24.0::DOUBLE) AS lo FROM c), s AS (SELECT *, greatest(lo + 1, greatest(w, h)::DOUBLE) AS hi FROM r),
    q AS (SELECT *, {_LOG_Q} AS q FROM s) SELECT l_orderkey, l_linenumber, q, round(lo * pow(hi / lo, q / 15.0::DOUBLE), 6) AS r FROM q""",
)
def radius_quant(spark, sf):
    d = canvases(spark, sf).withColumn("q", quant.radius_code(F.col("v"), F.col("w"), F.col("h")))
    return d.select("l_orderkey", "l_linenumber", "q", six(quant.radius_of_code(F.col("q"), F.col("w"), F.col("h"))).alias("r"))


@query(
    "dim_quant",
    f"""WITH {_CANVAS}, r AS (SELECT *, greatest(1.0::DOUBLE, w / 24.0::DOUBLE) AS lo FROM c), s AS (SELECT *, greatest(lo + 1, w::DOUBLE) AS hi FROM r),
    q AS (SELECT *, {_LOG_Q} AS q FROM s) SELECT l_orderkey, l_linenumber, q, round(lo * pow(hi / lo, q / 15.0::DOUBLE), 6) AS dim FROM q""",
)
def dim_quant(spark, sf):
    d = canvases(spark, sf).withColumn("q", quant.extent_code(F.col("v"), F.col("w")))
    return d.select("l_orderkey", "l_linenumber", "q", six(quant.extent_of_code(F.col("q"), F.col("w"))).alias("dim"))


@query(
    "theta_quant",
    f"""WITH t AS (SELECT l_orderkey, l_linenumber, (l_quantity::DOUBLE - 25) / 7 + 0.001 AS v FROM lineitem),
    q AS (SELECT *, least(greatest(floor((v - {pi!r} * floor(v / {pi!r})) / {pi!r} * 32), 0), 31)::INT AS q FROM t)
    SELECT l_orderkey, l_linenumber, q, round((q + 0.5::DOUBLE) / 32 * {pi!r}, 6) AS theta FROM q""",
)
def theta_quant(spark, sf):
    d = canvases(spark, sf).withColumn("q", quant.angle_code((F.col("v") - 25) / 7 + 0.001))
    return d.select("l_orderkey", "l_linenumber", "q", six(quant.angle_of_code(F.col("q"))).alias("theta"))


@query(
    "xy_quant",
    f"""WITH {_CANVAS}, q AS (SELECT *, least(greatest(round(v / greatest(w - 1, 1)::DOUBLE * 31.0::DOUBLE), 0), 31)::INT AS q FROM c)
    SELECT l_orderkey, l_linenumber, q, round(q / 31.0::DOUBLE * greatest(w - 1, 0)::DOUBLE)::INT AS xy FROM q""",
)
def xy_quant(spark, sf):
    d = canvases(spark, sf).withColumn("q", quant.position_code(F.col("v"), F.col("w")))
    return d.select("l_orderkey", "l_linenumber", "q", quant.position_of_code(F.col("q"), F.col("w")).alias("xy"))


@query(
    "alpha_quant",
    """WITH l AS (SELECT i, 0.20::DOUBLE + (0.90::DOUBLE - 0.20::DOUBLE) * i / 7 AS v FROM (SELECT unnest(range(8)) AS i)),
    a AS (SELECT l_orderkey, l_linenumber, l_quantity::DOUBLE / 50 + 0.0013 AS a FROM lineitem)
    SELECT l_orderkey, l_linenumber, (SELECT min((abs(a.a - l.v), i)) FROM l)[2]::INT AS q FROM a""",
)
def alpha_quant(spark, sf):
    d = canvases(spark, sf)
    return d.select("l_orderkey", "l_linenumber", quant.alpha_code(F.col("v") / 50 + 0.0013, quant.alpha_levels()).alias("q"))


_COLORS = "c AS (SELECT o_orderkey AS k, (o_orderkey % 256)::INT AS r, (o_orderkey * 7 % 256)::INT AS g, (o_orderkey * 13 % 256)::INT AS b FROM orders)"


def colors(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, sf, "orders").select(k.alias("k"), (k % 256).cast("int").alias("r"), (k * 7 % 256).cast("int").alias("g"), (k * 13 % 256).cast("int").alias("b"))


_RGB = ("r", "g", "b")


@query(
    "rgb565_roundtrip",
    f"""WITH {_COLORS}, p AS (SELECT k, ((r >> 3) << 11) | ((g >> 2) << 5) | (b >> 3) AS p FROM c), u AS (SELECT k, p, (p >> 11) & 31 AS r5, (p >> 5) & 63 AS g6, p & 31 AS b5 FROM p)
    SELECT k, p::INT AS packed, ((r5 << 3) | (r5 >> 2))::INT AS r8, ((g6 << 2) | (g6 >> 4))::INT AS g8, ((b5 << 3) | (b5 >> 2))::INT AS b8 FROM u""",
)
def rgb565_roundtrip(spark, sf):
    d = colors(spark, sf).withColumn("packed", color.rgb565(*map(F.col, _RGB)))
    return d.select("k", "packed", *(x.alias(n) for x, n in zip(color.from_rgb565(F.col("packed")), ("r8", "g8", "b8"), strict=True)))


@query("srgb_linear", f"WITH {_COLORS} SELECT k, round({LINEAR.format('r')}, 9) AS rl, round({LINEAR.format('g')}, 9) AS gl, round({LINEAR.format('b')}, 9) AS bl FROM c")
def srgb_linear(spark, sf):
    return colors(spark, sf).select("k", *(F.round(color.linear(F.col(c)), 9).alias(c + "l") for c in _RGB))


@query("linear_srgb", f"WITH {_COLORS} SELECT k, {BYTE.format('((r * 5 - 100) / 1000.0::DOUBLE)')} AS a, {BYTE.format('((g + b) / 510.0::DOUBLE)')} AS b FROM c")
def linear_srgb(spark, sf):
    return colors(spark, sf).select("k", color.srgb_u8((F.col("r") * 5 - 100) / 1000).alias("a"), color.srgb_u8((F.col("g") + F.col("b")) / 510).alias("b"))


def _product(matrix: tuple, names: tuple[str, str, str], out: tuple[str, str, str], wrap: str = "{}", scale: tuple = ("", "", "")) -> str:
    """SQL of a matrix times three columns."""
    return ", ".join(wrap.format(f"({names[0]} * {m[0]!r}::DOUBLE + {names[1]} * {m[1]!r}::DOUBLE + {names[2]} * {m[2]!r}::DOUBLE)") + s + f" AS {o}" for m, o, s in zip(matrix, out, scale, strict=True))


LIN = f"lin AS (SELECT k, {LINEAR.format('r')} AS rl, {LINEAR.format('g')} AS gl, {LINEAR.format('b')} AS bl FROM c)"
LMS_SQL = f"lms AS (SELECT k, {_product(color.LMS, ('rl', 'gl', 'bl'), ('l', 'm', 's'), 'cbrt{}')} FROM lin)"
LAB_SQL = f"lab AS (SELECT k, {_product(color.LAB, ('l', 'm', 's'), ('ll', 'aa', 'bb'), scale=('', ' * 5.0::DOUBLE', ' * 5.0::DOUBLE'))} FROM lms)"


@query("oklab_fwd", f"WITH {_COLORS}, {LIN}, {LMS_SQL}, {LAB_SQL} SELECT k, round(ll, 6) + 0.0 AS l, round(aa, 6) + 0.0 AS a, round(bb, 6) + 0.0 AS b FROM lab")
def oklab_fwd(spark, sf):
    lab = color.oklab(*(color.linear(F.col(c)) for c in _RGB))
    return colors(spark, sf).select("k", *(six(x).alias(n) for x, n in zip(lab, "lab", strict=True)))


_BACK = f"""x AS (SELECT k, {_product(color.LAB_BACK, ("ll", "(aa / 5.0::DOUBLE)", "(bb / 5.0::DOUBLE)"), ("l", "m", "s"))} FROM lab),
y AS (SELECT k, l * l * l AS l, m * m * m AS m, s * s * s AS s FROM x), z AS (SELECT k, {_product(color.LMS_BACK, ("l", "m", "s"), ("rl", "gl", "bl"))} FROM y)"""


@query("oklab_inv", f"WITH {_COLORS}, {LIN}, {LMS_SQL}, {LAB_SQL}, {_BACK} SELECT k, {BYTE.format('rl')} AS r, {BYTE.format('gl')} AS g, {BYTE.format('bl')} AS b FROM z")
def oklab_inv(spark, sf):
    lab = color.oklab(*(color.linear(F.col(c)) for c in _RGB))
    return colors(spark, sf).select("k", *(color.srgb_u8(x).alias(n) for x, n in zip(color.from_oklab(*lab), _RGB, strict=True)))


@query(
    "hex_color",
    f"""WITH {_COLORS}, x AS (SELECT k, [lower(printf('%02x', r)), lower(printf('%02x', g)), lower(printf('%02x', b))] AS d FROM (SELECT k, CASE WHEN k % 5 = 0 THEN r % 16 * 17 ELSE r END AS r, CASE WHEN k % 5 = 0 THEN g % 16 * 17 ELSE g END AS g, CASE WHEN k % 5 = 0 THEN b % 16 * 17 ELSE b END AS b FROM c))
    SELECT k, CASE WHEN list_bool_and(list_transform(d, lambda h: h[1] = h[2])) THEN '#' || d[1][1] || d[2][1] || d[3][1] ELSE '#' || d[1] || d[2] || d[3] END AS color FROM x""",
)
def hex_color(spark, sf):
    k = F.col("k")
    some = [F.when(k % 5 == 0, F.col(c) % 16 * 17).otherwise(F.col(c)) for c in _RGB]
    return colors(spark, sf).select("k", color.hex_color(*some).alias("color"))


@query(
    "fmt_num",
    """WITH v AS (SELECT l_orderkey, l_linenumber, round(l_quantity::DOUBLE * (l_linenumber % 4) / 32 * 100) / 100 AS v FROM lineitem),
    t AS (SELECT *, regexp_replace(regexp_replace(printf('%.2f', v), '0+$', ''), '\\.$', '') AS t FROM v)
    SELECT l_orderkey, l_linenumber, CASE WHEN v > 0 AND v < 1 THEN regexp_replace(t, '^0', '') ELSE t END AS text FROM t""",
)
def fmt_num(spark, sf):
    d = table(spark, sf, "lineitem")
    return d.select("l_orderkey", "l_linenumber", color.number_text(F.col("l_quantity").cast("double") * (F.col("l_linenumber") % 4) / 32).alias("text"))




@query(
    "bit_pack",
    """WITH f AS (SELECT o_orderkey, (o_orderkey % 256) + (o_custkey % 32) * 256 + (o_orderkey % 8) * 8192 + (o_custkey % 4096) * 65536 AS v FROM orders)
    SELECT o_orderkey, lower(printf('%02x%02x%02x%02x', v % 256, v // 256 % 256, v // 65536 % 256, v // 16777216 % 256)) AS packed FROM f""",
)
def bit_pack(spark, sf):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return table(spark, sf, "orders").select("o_orderkey", bits.pack([(k % 256, 8), (c % 32, 5), (k % 8, 3), (c % 4096, 12)]).alias("packed"))


@query(
    "bit_unpack",
    """SELECT o_orderkey, (o_orderkey % 256)::INT AS a, (o_custkey % 32)::INT AS b, (o_orderkey % 8)::INT AS c, (o_custkey % 4096)::INT AS d, 0 AS past FROM orders""",
)
def bit_unpack(spark, sf):
    d = bit_pack(spark, sf).select("o_orderkey", bits.from_hex(F.col("packed")).alias("s"))
    s = F.col("s")
    return d.select("o_orderkey", bits.read(s, 0, 8).alias("a"), bits.read(s, 8, 5).alias("b"), bits.read(s, 13, 3).alias("c"), bits.read(s, 16, 12).alias("d"), bits.read(s, 40, 6).alias("past"))


@query(
    "hex_roundtrip",
    """WITH t AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN upper(printf('%08x', o_orderkey)) WHEN 1 THEN ' ' || printf('%04x', o_orderkey % 65536) || chr(10) WHEN 2 THEN 'abc' ELSE 'zz' END AS t FROM orders),
    c AS (SELECT o_orderkey, lower(regexp_replace(t, '\\s', '', 'g')) AS t FROM t)
    SELECT o_orderkey, CASE WHEN regexp_full_match(t, '([0-9a-f]{2})*') THEN t END AS clean FROM c""",
)
def hex_roundtrip(spark, sf):
    k = F.col("o_orderkey")
    t = F.when(k % 4 == 0, F.upper(F.format_string("%08x", k))).when(k % 4 == 1, F.concat(F.lit(" "), F.format_string("%04x", k % 65536), F.lit("\n"))).when(k % 4 == 2, F.lit("abc")).otherwise(F.lit("zz"))
    return table(spark, sf, "orders").select("o_orderkey", bits.clean_hex(t).alias("clean"))


@query(
    "pixel_grid",
    f"""WITH {_DIMS}, a AS (SELECT p_partkey, pow(2.0::DOUBLE, {_ASPECT} / 254.0::DOUBLE * 6 - 3) AS a FROM d), g AS (SELECT unnest([1, 2, 3, 4, 6, 8, 12, 16, 24, 48]) AS gw),
    b AS (SELECT p_partkey, min((abs(ln(gw::DOUBLE / (48 // gw)) - ln(a)), gw)) AS best FROM a, g GROUP BY p_partkey) SELECT p_partkey, best[2]::INT AS gw, (48 // best[2])::INT AS gh FROM b""",
)
def pixel_grid(spark, sf):
    d = dims(spark, sf).select("p_partkey", quant.pixel_grid(48, quant.aspect_of_code(quant.aspect_code(F.col("w"), F.col("h")))).alias("g"))
    return d.select("p_partkey", "g.gw", "g.gh")


@query(
    "hsl_rgb",
    """WITH h AS (SELECT p_partkey AS k, (p_partkey % 360)::DOUBLE AS h, (p_size % 11) / 10.0::DOUBLE AS s, (p_partkey % 7) / 6.0::DOUBLE AS l FROM part),
    n AS (SELECT k, unnest(['r', 'g', 'b']) AS c, unnest([0, 8, 4]) AS n, h, s * least(l, 1 - l) AS a, l FROM h),
    v AS (SELECT k, c, round((l - a * greatest(-1.0::DOUBLE, least(t - 3, 9 - t, 1.0::DOUBLE))) * 255)::INT AS v FROM (SELECT *, (h / 30 + n) % 12 AS t FROM n))
    SELECT k, max(v) FILTER (c = 'r') AS r, max(v) FILTER (c = 'g') AS g, max(v) FILTER (c = 'b') AS b FROM v GROUP BY k""",
)
def hsl_rgb(spark, sf):
    d = table(spark, sf, "part")
    rgb = color.hsl((F.col("p_partkey") % 360).cast("double"), (F.col("p_size") % 11) / 10, (F.col("p_partkey") % 7) / 6)
    return d.select(F.col("p_partkey").alias("k"), *(x.alias(n) for x, n in zip(rgb, _RGB, strict=True)))


@query(
    "square_cells",
    f"""WITH {_DIMS}, a AS (SELECT p_partkey, w::DOUBLE / h AS a FROM d), i AS (SELECT *, sqrt(48 * a) AS iw, sqrt(48 / a) AS ih FROM a),
    t AS (SELECT p_partkey, a, unnest([floor(iw), floor(iw), ceil(iw), ceil(iw)]) AS gw, unnest([floor(ih), ceil(ih), floor(ih), ceil(ih)]) AS gh, unnest([0, 1, 2, 3]) AS place FROM i),
    s AS (SELECT p_partkey, min((round(abs(ln(greatest(a * gh / gw, 1e-9))) * 5 + abs(gw * gh - 48) / 48, 9), place, gw, gh)) AS best FROM t WHERE gw >= 1 AND gh >= 1 GROUP BY p_partkey)
    SELECT p_partkey, best[3]::INT AS gw, best[4]::INT AS gh FROM s""",
)
def square_cells(spark, sf):
    d = dims(spark, sf).select("p_partkey", quant.square_cells(48, F.col("w").cast("double") / F.col("h")).alias("g"))
    return d.select("p_partkey", "g.gw", "g.gh")
