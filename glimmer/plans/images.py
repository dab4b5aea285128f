"""Pictures in arrays by codecs that differ from row to row, on white, and with errors."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import palettes
from ..codec import of
from ..operators import images as ops
from ..operators.fit import SearchOptions
from ..registry import query
from .fixtures import IMAGES, pictures, rows_of
from .pictures import _BACK, _CODE, _LIN, _MEAN, _PAL, _U8

_PIXEL16, _PIXEL4 = of("pixel", 16), of("pixel", 4).with_color(24)
_PICO16 = _PIXEL16.with_palette(palettes.get("pico8"))


def mixed(spark, sf):
    """The pictures with a codec beside each: a third each of 16 cells, 4 cells in full colours, 16 cells of a palette; every tenth has none."""
    k = F.col("vec_id") % 3
    codec = F.when(F.col("vec_id") % 10 == 9, F.lit(None)).when(k == 0, _PIXEL16.column()).when(k == 1, _PIXEL4.column()).otherwise(_PICO16.column())
    return pictures(spark, sf).withColumn("codec", codec)


_FOURTH = "m4 AS (SELECT vec_id, y // 4 AS gy, x // 4 AS gx, round(avg(r), 9) AS r, round(avg(g), 9) AS g, round(avg(b), 9) AS b FROM lin GROUP BY ALL)"


def _u8(of_table: str) -> str:
    return _U8.split(" AS (", 1)[1].replace("FROM mean", f"FROM {of_table}")


_MIXED = f"""{_LIN}, {_MEAN}, {_U8}, {_CODE}, {_BACK}, {_FOURTH}, u4 AS ({_u8('m4')}, {_PAL}, lp AS (SELECT idx, {{0}}),
near AS (SELECT vec_id, gy, gx, min((round((mean.r - lp.r) * (mean.r - lp.r) + (mean.g - lp.g) * (mean.g - lp.g) + (mean.b - lp.b) * (mean.b - lp.b), 12), idx))[2]::INT AS idx FROM mean, lp GROUP BY ALL),
h AS (SELECT vec_id, 0 AS k, string_agg(lower(printf('%02x%02x', p % 256, p // 256)), '' ORDER BY gy, gx) AS body FROM code GROUP BY vec_id
  UNION ALL SELECT vec_id, 1, string_agg(lower(printf('%02x%02x%02x', r, g, b)), '' ORDER BY gy, gx) FROM u4 GROUP BY vec_id
  UNION ALL SELECT vec_id, 2, string_agg(lower(printf('%02x', a.idx + 16 * b.idx)), '' ORDER BY a.gy, a.gx) FROM near a JOIN near b USING (vec_id) WHERE a.gx % 2 = 0 AND b.gy = a.gy AND b.gx = a.gx + 1 GROUP BY vec_id),
hashes AS (SELECT img.vec_id, CASE WHEN img.vec_id % 10 <> 9 THEN '7f' || body END AS hash, CASE WHEN img.vec_id % 10 = 9 THEN 'the codec is null or not valid' END AS error FROM img JOIN h ON h.vec_id = img.vec_id AND h.k = img.vec_id % 3)"""


def _mixed_sql() -> str:
    from .fixtures import LINEAR

    light = ", ".join(f"{LINEAR.format('p' + c)} AS {c}" for c in "rgb")
    return _MIXED.replace("{0}", light + " FROM pal")


@query("encode_mixed", f"WITH {IMAGES}, {_mixed_sql()} SELECT vec_id, hash, error FROM hashes")
def encode_mixed(spark, sf):
    return ops.encode(mixed(spark, sf), "codec").select("vec_id", "hash", "error")


@query(
    "decode_mixed",
    f"""WITH {IMAGES}, {_mixed_sql()}, c AS (SELECT vec_id, 0 AS k, gy * 2 AS y0, gx * 2 AS x0, 2 AS s, r, g, b FROM back UNION ALL SELECT vec_id, 1, gy * 4, gx * 4, 4, r, g, b FROM u4 UNION ALL SELECT vec_id, 2, gy * 2, gx * 2, 2, pr, pg, pb FROM near JOIN pal USING (idx))
    SELECT vec_id, (y0 + i)::INT AS y, (x0 + j)::INT AS x, r::INT AS r, g::INT AS g, b::INT AS b FROM c, (SELECT unnest(range(4)) AS i), (SELECT unnest(range(4)) AS j) WHERE k = vec_id % 3 AND vec_id % 10 <> 9 AND i < s AND j < s""",
)
def decode_mixed(spark, sf):
    hashes = ops.encode(mixed(spark, sf), "codec").select("vec_id", "codec", "hash")
    return rows_of(ops.decode(hashes, "codec", base=8), "vec_id")


@query(
    "decode_errors",
    f"""WITH {IMAGES}, {_mixed_sql()}, d AS (SELECT vec_id, CASE vec_id % 5 WHEN 0 THEN left(hash, 8) WHEN 1 THEN 'no hex' WHEN 2 THEN NULL ELSE hash END AS hash FROM hashes)
    SELECT vec_id, CASE WHEN vec_id % 10 = 9 THEN 'the codec is null or not valid' WHEN vec_id % 5 < 3 THEN 'the hash is no hex or too short' END AS error FROM d""",
)
def decode_errors(spark, sf):
    """Why hashes that were cut, spoilt or lost give no picture."""
    k = F.col("vec_id") % 5
    spoilt = F.when(k == 0, F.substring("hash", 1, 8)).when(k == 1, "no hex").when(k == 2, F.lit(None)).otherwise(F.col("hash"))
    d = ops.encode(mixed(spark, sf), "codec").select("vec_id", "codec", spoilt.alias("hash"))
    return ops.decode(d, "codec", base=8).select("vec_id", "error")


@query("over_white", f"WITH {IMAGES} SELECT vec_id, y, x, floor(g / 255.0::DOUBLE * r + (1 - g / 255.0::DOUBLE) * 255)::INT AS v FROM px")
def over_white(spark, sf):
    """The first channel seen on white through the second as opacity."""
    from .fixtures import pixels

    return pixels(spark, sf).select("vec_id", "y", "x", ops.over_white(F.col("r"), F.col("g")).alias("v"))


def sized(edge: int, shape: str):
    """Pictures of ``edge`` pixels by the smallest preset of a shape, at the operator's own search."""

    def run(spark, sf):
        codec = of(shape, 16 if shape == "pixel" else 12)
        return ops.encode(pictures(spark, sf, edge), codec, options=None if shape in ("dct", "pixel") else SearchOptions(n_random=50, n_attempts=3) if shape == "triangle" else SearchOptions()).select("vec_id", "hash")

    return run


def drawn(edge: int, shape: str, base: int = 256):
    """Those hashes drawn at ``base`` pixels, as arrays."""

    def run(spark, sf):
        d = ops.decode(sized(edge, shape)(spark, sf), of(shape, 16 if shape == "pixel" else 12), base=base)
        return d.select("vec_id", "w", "h", "r", "g", "b")

    return run
