"""Codec algebra: lengths, presets, palettes, compatibility."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import codec as C
from .. import palettes as P
from ..registry import query
from .fixtures import named_colors, of_parts, of_parts_sql, table

_PRESETS = list(C.presets())
_NAMED = list(P.NAMED)
_AUTOMATIC = [2, 4, 8, 16, 32, 64, 256]
_SHAPES = ("circle", "triangle", "square", "rect", "rotrect", "pixel", "dct")


def parts(spark: SparkSession, sf: str) -> DataFrame:
    """(p_partkey, codec): codecs whose fields follow from the key and size of each part."""
    k, size = F.col("p_partkey"), F.col("p_size")
    shape = F.element_at(F.array(*map(F.lit, _SHAPES)), (k % 7 + 1).cast("int"))
    palette = F.when(k % 3 == 0, F.substring(F.lit("00" * 3 * 50), F.lit(1), ((size % 40 + 2) * 6).cast("int")))
    fields = {
        "shape": shape, "n_shapes": size, "cx_bits": k % 6 + 2, "cy_bits": k % 5 + 2, "r_bits": k % 4 + 1, "alpha_bits": k % 4, "color_bits": F.when(k % 2 == 0, 16).otherwise(24), "theta_bits": k % 8,
        "palette": palette, "palette_k": F.lit(None), "alpha_levels": F.lit(None), "grid_aspect": F.lit(None),
    }
    return table(spark, sf, "part").select("p_partkey", F.struct(*(fields[f.name].cast(f.dataType).alias(f.name) for f in C.SCHEMA)).alias("codec"))


_PARTS = f"""c AS (SELECT p_partkey, {list(_SHAPES)!r}[(p_partkey % 7 + 1)::INT] AS shape, p_size::INT AS n, p_partkey % 6 + 2 AS cx, p_partkey % 5 + 2 AS cy, p_partkey % 4 + 1 AS rb, p_partkey % 4 AS ab,
  CASE WHEN p_partkey % 2 = 0 THEN 16 ELSE 24 END AS cb, p_partkey % 8 AS tb, CASE WHEN p_partkey % 3 = 0 THEN p_size % 40 + 2 END AS k FROM part),
f AS (SELECT *, CASE WHEN k IS NULL THEN cb ELSE ceil(log2(k)) END AS col FROM c),
p AS (SELECT *, CASE shape WHEN 'circle' THEN cx + cy + rb + col + ab WHEN 'square' THEN cx + cy + rb + col + ab WHEN 'rect' THEN cx + cy + 2 * rb + col + ab WHEN 'rotrect' THEN cx + cy + 2 * rb + tb + col + ab
  WHEN 'triangle' THEN 3 * (cx + cy) + col + ab WHEN 'pixel' THEN col ELSE 0 END AS per, CASE shape WHEN 'dct' THEN 40 WHEN 'pixel' THEN 8 ELSE 8 + col END AS head FROM f)"""


@query("codec_bits", f"WITH {_PARTS} SELECT p_partkey, shape, CASE WHEN k IS NULL THEN 0 ELSE ceil(log2(k)) END::INT AS palette_bits, col::INT AS color_bits, per::INT AS per_shape, head::INT AS header FROM p")
def codec_bits(spark, sf):
    c = F.col("codec")
    return parts(spark, sf).select("p_partkey", c["shape"].alias("shape"), C.palette_bits(c).alias("palette_bits"), C.color_field_bits(c).alias("color_bits"), C.per_shape_bits(c).alias("per_shape"), C.header_bits(c).alias("header"))


@query("codec_total", f"WITH {_PARTS} SELECT p_partkey, CASE WHEN shape = 'dct' THEN CASE WHEN p_partkey % 2 = 1 THEN 40 ELSE 27 END ELSE ceil((head + n * per) / 8.0) END::INT AS bytes FROM p")
def codec_total(spark, sf):
    return parts(spark, sf).select("p_partkey", C.bytes_total(F.col("codec"), F.col("p_partkey") % 2 == 1).cast("int").alias("bytes"))


@query(
    "preset_expand",
    f"""WITH s AS (SELECT unnest(['small', 'medium', 'large']) AS size, unnest([12, 24, 64]) AS n, unnest([16, 24, 64]) AS cells), m AS (SELECT unnest(['triangle', 'circle', 'pixel', 'rect', 'square']) AS shape),
    a AS (SELECT size || '_' || shape AS name, false AS deprecated, shape, CASE shape WHEN 'pixel' THEN cells ELSE n END AS n FROM s, m),
    o AS (SELECT CASE size WHEN 'small' THEN 'placeholder' ELSE 'detail' END || '_' || shape AS name, true AS deprecated, shape, n FROM (SELECT *, split_part(name, '_', 1) AS size FROM a) WHERE size IN ('small', 'large') AND shape IN ('triangle', 'circle', 'pixel')),
    t AS (SELECT * FROM a UNION ALL SELECT * FROM o UNION ALL VALUES ('dct', false, 'dct', 12), ('tiny_dct', true, 'dct', 12))
    SELECT p_partkey, name, deprecated, shape, n::INT AS n, CASE shape WHEN 'dct' THEN 27 WHEN 'pixel' THEN ceil((8 + 16 * n) / 8.0) WHEN 'triangle' THEN ceil((24 + n * 49) / 8.0) WHEN 'rect' THEN ceil((24 + n * 37) / 8.0) ELSE ceil((24 + n * 33) / 8.0) END::INT AS bytes FROM t JOIN part ON name = {_PRESETS!r}[(p_partkey % {len(_PRESETS)} + 1)::INT]""",
)
def preset_expand(spark, sf):
    """The preset that each part's key gives."""
    c = F.col("codec")
    parts_ = table(spark, sf, "part").select("p_partkey", (F.col("p_partkey") % len(_PRESETS)).cast("int").alias("ord"))
    return parts_.join(F.broadcast(C.preset_frame(spark)), "ord").select("p_partkey", "name", "deprecated", c["shape"].alias("shape"), c["n_shapes"].alias("n"), C.bytes_total(c).cast("int").alias("bytes"))


@query(
    "byte_compat_join",
    f"""WITH {_PARTS}, s AS (SELECT unnest({list(_SHAPES)!r}) AS shape)
    SELECT a.p_partkey AS a, b.p_partkey AS b FROM f a JOIN f b ON a.shape = b.shape AND a.n = b.n AND a.cx = b.cx AND a.cy = b.cy AND a.rb = b.rb AND a.ab = b.ab AND a.cb = b.cb AND a.tb = b.tb AND a.k IS NOT DISTINCT FROM b.k AND a.p_partkey < b.p_partkey""",
)
def byte_compat_join(spark, sf):
    all_ = parts(spark, sf)
    a, b = all_.select(F.col("p_partkey").alias("a"), F.col("codec").alias("ca")), all_.select(F.col("p_partkey").alias("b"), F.col("codec").alias("cb"))
    return a.join(b, C.compatible(F.col("ca"), F.col("cb")) & (F.col("a") < F.col("b"))).select("a", "b")


@query("palette_table", f"WITH {named_colors(P.NAMED)}, {of_parts_sql(_NAMED)}")
def palette_table(spark, sf):
    """A colour of a named palette for each part."""
    return of_parts(spark, sf, P.frame(spark), _NAMED)


_LEVEL = "round(i * 255.0 / {0})::INT"


@query(
    "auto_palettes",
    f"""WITH g AS (SELECT k, i, round(i * 255.0::DOUBLE / (k - 1))::INT AS v FROM (SELECT unnest([2, 4, 8]) AS k), LATERAL (SELECT unnest(range(k)) AS i)),
    sixteen AS (SELECT 16 AS k, i, round(i * 255.0::DOUBLE / 7)::INT AS v FROM (SELECT unnest(range(8)) AS i)),
    hue AS (SELECT 16 AS k, 8 + i AS i, unnest(['r', 'g', 'b']) AS c, unnest([0, 8, 4]) AS n, i * 45.0::DOUBLE AS h FROM (SELECT unnest(range(8)) AS i)),
    hv AS (SELECT k, i, c, round((0.5::DOUBLE - 0.36::DOUBLE * greatest(-1.0::DOUBLE, least(t - 3, 9 - t, 1.0::DOUBLE))) * 255)::INT AS v FROM (SELECT *, (h / 30 + n) % 12 AS t FROM hue)),
    b AS (SELECT k, rb, gb, bb, unnest(range(1 << rb)) AS r FROM (SELECT unnest([32, 64, 256]) AS k, unnest([2, 2, 3]) AS rb, unnest([2, 2, 3]) AS gb, unnest([1, 2, 2]) AS bb)),
    cube AS (SELECT k, ((r * (1 << gb) + g) * (1 << bb) + b)::INT AS i, round(r * 255.0::DOUBLE / ((1 << rb) - 1))::INT AS r, round(g * 255.0::DOUBLE / ((1 << gb) - 1))::INT AS g, round(b * 255.0::DOUBLE / ((1 << bb) - 1))::INT AS b
      FROM b, LATERAL (SELECT unnest(range(1 << gb)) AS g), LATERAL (SELECT unnest(range(1 << bb)) AS b)),
    t AS (SELECT k, i::INT AS idx, v AS r, v AS g, v AS b FROM g UNION ALL SELECT k, i::INT, v, v, v FROM sixteen
    UNION ALL SELECT k, i::INT, max(v) FILTER (c = 'r'), max(v) FILTER (c = 'g'), max(v) FILTER (c = 'b') FROM hv GROUP BY k, i UNION ALL SELECT k, i, r, g, b FROM cube), {of_parts_sql(_AUTOMATIC, "k")}""",
)
def auto_palettes(spark, sf):
    """A colour of an automatic palette for each part."""
    frames = [P.automatic(spark, k) for k in _AUTOMATIC]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return of_parts(spark, sf, out, _AUTOMATIC, "k")


@query("coord_bits", "SELECT p_partkey, least(greatest(round(log2(greatest(p_partkey % 600, 8) / 8.0::DOUBLE)), 2), 8)::INT AS cx, least(greatest(least(greatest(round(log2(greatest(p_partkey % 600, 8) / 8.0::DOUBLE)), 2), 8) - 1, 1), 6)::INT AS r FROM part")
def coord_bits(spark, sf):
    cx, r = P.coordinate_bits(F.col("p_partkey") % 600)
    return table(spark, sf, "part").select("p_partkey", cx.alias("cx"), r.alias("r"))


def variants() -> list[C.Codec]:
    """The codecs that tests compare: every preset's, and some with other colours."""
    return [c for c, _ in C.presets().values()] + [replace(C.of("circle", 8), palette="000000ffffff"), C.of("triangle").with_color(24)]
