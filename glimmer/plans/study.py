"""Cues, sweeps, symbol streams and whole-number rules, as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import palettes
from ..codec import of
from ..functions import quant
from ..functions.color import linear
from ..operators import analytics as A
from ..operators import cues, metrics, shapes, sweep
from ..registry import query
from .analytics import _RD, _RUNS, rd, runs
from .fixtures import IMAGES, LINEAR, named_colors, of_parts, of_parts_sql, pictures, pixels, six, table

_A, _B = "l_orderkey * 7919 - l_partkey * 100003", "l_suppkey % 13 - 6"


@query(
    "whole_division",
    f"""WITH d AS (SELECT l_orderkey, l_linenumber, {_A} AS a, {_B} AS b, l_orderkey * l_partkey * l_linenumber - 5 AS n FROM lineitem)
    SELECT l_orderkey, l_linenumber, CASE WHEN b <> 0 THEN floor(a::DOUBLE / b)::BIGINT END AS low, CASE WHEN b <> 0 THEN ceil(a::DOUBLE / b)::BIGINT END AS high, floor(sqrt(greatest(n, 0)::DOUBLE))::BIGINT AS root FROM d""",
)
def whole_division(spark, sf):
    a, b, n = F.expr(_A), F.expr(_B), F.expr("l_orderkey * l_partkey * l_linenumber - 5")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", quant.floor_div(a, b).alias("low"), quant.ceil_div(a, b).alias("high"), quant.isqrt(n).alias("root"))


_LIGHT = f"lin AS (SELECT vec_id, y, x, {', '.join(f'{LINEAR.format(c)} AS {c}' for c in 'rgb')} FROM px)"
_CENTER = "exp(-1.5::DOUBLE * (pow((y - 3.5::DOUBLE) / 4, 2) + pow((x - 3.5::DOUBLE) / 4, 2)))"
_WEIGHTS = f"""{_LIGHT}, lum AS (SELECT *, 0.2126::DOUBLE * r + 0.7152::DOUBLE * g + 0.0722::DOUBLE * b AS l, sqrt(pow(r - avg(r) OVER p, 2) + pow(g - avg(g) OVER p, 2) + pow(b - avg(b) OVER p, 2)) AS apart FROM lin WINDOW p AS (PARTITION BY vec_id)),
nb AS (SELECT m.vec_id, m.y, m.x, m.r, m.g, m.b, m.apart, coalesce(e.l - w.l, 0) AS gx, coalesce(s.l - n.l, 0) AS gy FROM lum m LEFT JOIN lum e ON e.vec_id = m.vec_id AND e.y = m.y AND e.x = m.x + 1 LEFT JOIN lum w ON w.vec_id = m.vec_id AND w.y = m.y AND w.x = m.x - 1
  LEFT JOIN lum s ON s.vec_id = m.vec_id AND s.x = m.x AND s.y = m.y + 1 LEFT JOIN lum n ON n.vec_id = m.vec_id AND n.x = m.x AND n.y = m.y - 1),
cue AS (SELECT vec_id, y, x, r, g, b, unnest(['edge', 'center', 'saliency']) AS cue, unnest([sqrt(gx * gx + gy * gy), {_CENTER}, apart / (max(apart) OVER (PARTITION BY vec_id) + 1e-9) * {_CENTER}]) AS c FROM nb),
weights AS (SELECT *, 1 + 2 * c / (max(c) OVER (PARTITION BY vec_id, cue) + 1e-9) AS weight FROM cue)"""


def weights(spark, sf):
    """The weights of every cue at strength 2."""
    light = pixels(spark, sf).select("vec_id", "y", "x", *(linear(F.col(c)).alias(c) for c in "rgb"))
    parts = [cues.weighted(light, ["vec_id"], cue, 2.0).withColumn("cue", F.lit(cue)) for cue in cues.CUES[1:]]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("weight_cues", f"WITH {IMAGES}, {_WEIGHTS} SELECT vec_id, cue, y, x, round(weight, 6) AS weight FROM weights")
def weight_cues(spark, sf):
    return weights(spark, sf).select("vec_id", "cue", "y", "x", six(F.col("weight")).alias("weight"))


@query("weighted_background", f"WITH {IMAGES}, {_WEIGHTS} SELECT vec_id, cue, {', '.join(f'round(sum(weight * {c}) / sum(weight), 6) AS {c}' for c in 'rgb')} FROM weights GROUP BY ALL")
def weighted_background(spark, sf):
    d = cues.background(weights(spark, sf), ["vec_id", "cue"])
    return d.select("vec_id", "cue", *(six(F.col(c)).alias(c) for c in "rgb"))


@query("luminance_steps", "WITH " + IMAGES + """ SELECT vec_id, y, x, (coalesce(lead(r) OVER across - lag(r) OVER across, 0))::DOUBLE AS gx, (coalesce(lead(r) OVER down - lag(r) OVER down, 0))::DOUBLE AS gy FROM px
  WINDOW across AS (PARTITION BY vec_id, y ORDER BY x), down AS (PARTITION BY vec_id, x ORDER BY y)""")  # fmt: skip
def luminance_steps(spark, sf):
    return cues.differences(pixels(spark, sf), ["vec_id"], F.col("r").cast("double")).select("vec_id", "y", "x", "gx", "gy")


@query(
    "worst_place",
    f"""WITH {IMAGES}, f AS (SELECT vec_id, y, x, (g - r) * (g - r) AS e FROM px WHERE NOT ((y IN (0, 7) AND x IN (0, 7)) OR (y * 8 + x) % 8 = vec_id % 8))
    SELECT vec_id, y AS gy, x AS gx, e FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY e DESC, y, x) AS k FROM f) WHERE k = 1""",
)
def worst_place(spark, sf):
    """The pixel of the largest error besides the corners and one used column."""
    p = pixels(spark, sf).select("vec_id", F.col("y").alias("gy"), F.col("x").alias("gx"), ((F.col("g") - F.col("r")) * (F.col("g") - F.col("r"))).alias("e"))
    return cues.worst_place(p, p.where("(gy IN (0, 7) AND gx IN (0, 7)) OR (gy * 8 + gx) % 8 = vec_id % 8"), ["vec_id"])


_TRIANGLES = of("triangle", 12)
_BITS = """h AS (SELECT s_suppkey, md5(s_suppkey || '-0') || md5(s_suppkey || '-1') || md5(s_suppkey || '-2') || md5(s_suppkey || '-3') || md5(s_suppkey || '-4') AS hash FROM supplier),
v AS (SELECT s_suppkey, list_transform(range(640), lambda k: (('0x' || substr(hash, 2 * (k // 8) + 1, 2))::INT >> (k % 8)) & 1) AS b FROM h),
f AS (SELECT unnest(['x0', 'y0', 'x1', 'y1', 'x2', 'y2', 'blue', 'green', 'red', 'alpha']) AS field, unnest([0, 5, 10, 15, 20, 25, 30, 35, 41, 46]) AS off, unnest([5, 5, 5, 5, 5, 5, 5, 6, 5, 3]) AS n),
r AS (SELECT s_suppkey, pos, field, list_sum(list_transform(range(n), lambda i: b[25 + pos * 49 + off + i] << i))::INT AS sym FROM v, f, (SELECT unnest(range(12))::INT AS pos))"""


def _triangle_symbols(deltas: bool):
    def run(spark, sf):
        name = F.col("s_suppkey").cast("string")
        hashes = table(spark, sf, "supplier").select("s_suppkey", F.concat(*(F.md5(F.concat(name, F.lit(f"-{i}"))) for i in range(5))).alias("hash"))
        return shapes.symbols(hashes, _TRIANGLES, deltas=deltas).select("s_suppkey", "field", "pos", "sym")

    return run


query("triangle_symbols", f"WITH {_BITS} SELECT s_suppkey, field, pos, sym FROM r")(_triangle_symbols(False))
query(
    "triangle_deltas",
    f"WITH {_BITS}, o AS (SELECT *, max(sym) FILTER (field = 'x0') OVER s AS x0, max(sym) FILTER (field = 'y0') OVER s AS y0 FROM r WINDOW s AS (PARTITION BY s_suppkey, pos)) SELECT s_suppkey, field, pos, (CASE WHEN field IN ('x1', 'x2') THEN sym - x0 + 31 WHEN field IN ('y1', 'y2') THEN sym - y0 + 31 ELSE sym END)::INT AS sym FROM o",
)(_triangle_symbols(True))


@query("rate_points", f"WITH {_RD}, m AS (SELECT image % 5 AS g, bytes, psnr, ceil(CASE WHEN v BETWEEN 1 AND 63 THEN (64 * -(v / 64::DOUBLE * log2(v / 64::DOUBLE) + (1 - v / 64::DOUBLE) * log2(1 - v / 64::DOUBLE)) + 18 * 8 + v * 3 + 16) / 8 ELSE (18 * 8 + v * 3 + 16) / 8::DOUBLE END)::INT AS size FROM (SELECT *, bytes AS v FROM rd)) SELECT g, round(avg(size), 6) AS size, round(avg(psnr), 6) AS psnr, count(*) AS n FROM m GROUP BY g")
def rate_points(spark, sf):
    """Mean size and quality of meshes of 64 cells and 8 colours at every rate point."""
    d = rd(spark, sf).select((F.col("image") % 5).alias("g"), metrics.mesh_bytes(F.lit(64), F.col("bytes"), F.lit(8)).alias("size"), "psnr")
    return A.means(d, ["g"], ["size", "psnr"]).select("g", six(F.col("size")).alias("size"), six(F.col("psnr")).alias("psnr"), "n")


@query("refine_percent", f"WITH {_RD}, m AS (SELECT split_part(method, '-', 1) AS mode, image % 4 AS setting, round(avg(psnr), 6) AS psnr FROM rd GROUP BY ALL), b AS (SELECT mode, psnr AS base FROM m WHERE setting = 0) SELECT mode, setting, psnr, base, CASE WHEN base <> 0 THEN round((psnr / base - 1) * 100, 4) + 0.0 END AS change FROM m JOIN b USING (mode)")
def refine_percent(spark, sf):
    m = rd(spark, sf).select(A.family(F.col("method")).alias("mode"), (F.col("image") % 4).alias("setting"), "psnr")
    d = A.against_first(A.means(m, ["mode", "setting"], ["psnr"]).withColumn("psnr", six(F.col("psnr"))), ["mode"], "setting", "psnr")
    return d.select("mode", "setting", "psnr", "base", (F.round("change", 4) + F.lit(0.0)).alias("change"))


@query(
    "gallery_overview",
    f"""WITH {_RUNS}, s AS (SELECT impl, min(us) AS lo, min(event_id % 7 + 20) AS l, max(event_id % 7 + 20) AS h, count(*) AS n, avg(us) AS e, avg(us * 2) AS d FROM runs GROUP BY impl)
    SELECT impl, n, round(e, 6) AS encode, round(d, 6) AS decode, CASE WHEN l = h THEN l || ' B' ELSE l || '–' || h || ' B' END AS sizes, lo AS fastest, l AS smallest FROM s""",
)
def gallery_overview(spark, sf):
    d = runs(spark, sf).select("impl", "us", (F.col("us") * 2).alias("back"), (F.col("event_id") % 7 + 20).alias("size"))
    d = A.overview(d, ["impl"], "us", "back", "size")
    return d.withColumns({"encode": six(F.col("encode")), "decode": six(F.col("decode"))})


@query("milliseconds", f"WITH {_RUNS} SELECT event_id, CASE WHEN us IS NULL OR us = 0 THEN '—' WHEN us * 1.37::DOUBLE >= 100 THEN printf('%.0f ms', us * 1.37::DOUBLE) WHEN us * 1.37::DOUBLE >= 10 THEN printf('%.1f ms', us * 1.37::DOUBLE) ELSE printf('%.2f ms', us * 1.37::DOUBLE) END AS text FROM runs")
def milliseconds(spark, sf):
    return runs(spark, sf).select("event_id", A.milliseconds_text(F.col("us") * 1.37, even=True).alias("text"))


_THEMES = [*palettes.THEMED, *palettes.ALSO]


@query("themed_palettes", f"WITH {named_colors({n: palettes.ALL[n] for n in _THEMES})}, {of_parts_sql(_THEMES)}")
def themed_palettes(spark, sf):
    """A colour of a themed palette for each part."""
    return of_parts(spark, sf, palettes.frame(spark, _THEMES), _THEMES)


@query("rd_sweep")
def rd_sweep(spark, sf):
    """Bytes and quality of every picture by frequencies and by pixel hashes of every size."""
    d = sweep.rate_distortion(pictures(spark, sf), ["vec_id"], sweep.methods(("pixel",)), 8)
    return d.select("vec_id", "method", "bytes", six(F.col("psnr")).alias("psnr"), "error")
