"""Frequency hashes: encoding and decoding inside the row of an image, without a shuffle.

An image is a row with its width, height and flat arrays of its bytes.
"""

from __future__ import annotations

from math import pi

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import color, quant
from ..functions.rows import computed
from .fit import by_size, sized
from .kernel import LINEAR, aspect_code

#: Exponents that compand coefficients: lightness, chroma, opacity, mean chroma.
LIGHT, CHROMA, OPACITY, MEAN_CHROMA = 0.6, 0.5, 0.6, 0.4


def mask(nx: Column, ny: Column) -> Column:
    """Structs (cy, cx) of the triangle of low frequencies, rows first."""
    pairs = F.flatten(F.transform(F.sequence(F.lit(0), ny - 1), lambda cy: F.transform(F.sequence(F.lit(0), nx - 1), lambda cx: F.struct(cy.alias("cy"), cx.alias("cx")))))
    return F.filter(pairs, lambda m: m["cx"] * ny < nx * (ny - m["cy"]))


def frequencies(aspect: Column, has_alpha: Column) -> tuple[Column, Column]:
    """Numbers of horizontal and vertical frequencies of lightness."""
    limit = F.when(has_alpha, 5.0).otherwise(7.0)
    wide = aspect >= 1
    part = lambda x: F.greatest(F.round(x), F.lit(1.0))
    return F.greatest(F.when(wide, limit).otherwise(part(limit * aspect)), F.lit(3.0)).cast("int"), F.greatest(F.when(wide, part(limit / aspect)).otherwise(limit), F.lit(3.0)).cast("int")


def project(plane: Column, masked: Column, w: Column, h: Column) -> Column:
    """Coefficients of a plane (flat array) at the masked frequencies."""

    def one(m: Column) -> Column:
        wave = F.transform(plane, lambda v, i: v * F.cos(pi / w * m["cx"] * (i % w + 0.5)) * F.cos(pi / h * m["cy"] * (F.floor(i / w) + 0.5)))
        return F.aggregate(wave, F.lit(0.0), lambda a, x: a + x) / (w * h)

    return F.transform(masked, one)


def level(i: Column, scale: Column, p: float) -> Column:
    """What the nibble ``i`` stands for, still companded."""
    return (i / 7.5 - 1) * F.pow(scale, F.lit(p))


def nibbles(ac: Column, scale: Column, p: float) -> Column:
    """The nearest of 16 equally spaced levels for each coefficient, the lower of equals; 8 where the scale is 0."""
    place = lambda c: F.ceil((color.power(c, p) / F.pow(scale, F.lit(p)) + 1) * 7.5 - 0.5)
    return F.transform(ac, lambda c: F.when(scale <= 0, 8).otherwise(F.least(F.greatest(place(c), F.lit(0)), F.lit(15)).cast("int")))


def best_scale(ac: Column, steps: int, p: float) -> Column:
    """The quantised scale with the least squared error; 0 drops all coefficients."""
    most = F.array_max(F.transform(ac, F.abs))
    round_ = lambda x: F.round(x).cast("int")
    tried = F.transform(F.sequence(F.lit(0), F.lit(18)), lambda i: round_(steps * (0.55 + 0.45 * i / 18) * most))
    anchor = round_(steps * most)
    tried = F.filter(F.array_union(tried, F.array(*(anchor + k for k in (-1, 0, 1, 2)))), lambda q: q > 0)

    def error(q: Column) -> Column:
        scale = q / steps
        kept = F.transform(nibbles(ac, scale, p), lambda n: color.power(level(n, scale, p), 1 / p))
        return F.aggregate(F.zip_with(ac, kept, lambda c, k: (c - k) * (c - k)), F.lit(0.0), lambda a, x: a + x)

    dropped = F.aggregate(ac, F.lit(0.0), lambda a, c: a + c * c)
    all_ = F.concat(F.array(F.struct(dropped.alias("e"), F.lit(0).alias("q"))), F.transform(tried, lambda q: F.struct(error(q).alias("e"), q.alias("q"))))
    return F.when(F.coalesce(most, F.lit(0.0)) <= 0, 0.0).otherwise(F.array_min(all_)["q"] / steps)


def _hex_bytes(value: Column, n: int) -> Column:
    """A number as ``n`` little-endian bytes in hex."""
    return F.concat(*(F.lower(F.lpad(F.hex(F.shiftright(value.cast("long"), 8 * i).bitwiseAND(255)), 2, "0")) for i in range(n)))


def _hex_nibbles(digits: Column) -> Column:
    """Nibbles as bytes, the first one low; an odd last one has 0 above it."""
    text = F.array_join(F.transform(digits, lambda n: F.lower(F.hex(n.cast("long")))), "")
    text = F.when(F.length(text) % 2 == 1, F.concat(text, F.lit("0"))).otherwise(text)
    return F.array_join(F.transform(F.sequence(F.lit(0), (F.length(text) / 2).cast("int") - 1), lambda i: F.reverse(F.substring(text, i * 2 + 1, F.lit(2)))), "")


def spectra(df: DataFrame, w: str, h: str, r: str, g: str, b: str, a: str | None) -> DataFrame:
    """``df`` with _has (opacity) and coefficients _cl, _cp, _cq, _ca of its pictures; all null where arrays don't fit the size.

    Pictures of one size are transformed together: the cosines of a size are computed once,
    and a plane takes two matrix products, rows before columns.
    """
    names = ("_has", "_cl", "_cp", "_cq", "_ca")

    def most(aspect: float, limit: int) -> tuple[int, int]:
        part = lambda x: max(int(np.floor(x + 0.5)), 1)
        return (max(limit, 3), max(part(limit / aspect), 3)) if aspect >= 1 else (max(part(limit * aspect), 3), max(limit, 3))

    @F.arrow_udf("_has boolean, _cl array<double>, _cp array<double>, _cq array<double>, _ca array<double>")
    def transformed(given: pa.Array) -> pa.Array:
        n, columns = len(given), given.flatten()
        planes, ws, hs = sized(pa.RecordBatch.from_arrays(columns, names=list("whrgba")[: len(columns)]), 0, len(columns) - 2)
        out: list[list] = [[None] * n for _ in names]
        for (wide, tall), rows in by_size(planes, ws, hs).items():
            by, bx = (np.cos(pi / n * np.arange(8)[:, None] * (np.arange(n) + 0.5)) for n in (tall, wide))
            aspect = 2.0 ** (aspect_code(wide, tall) / 254 * 6 - 3)

            def masked(plane, nx: int, ny: int, by=by, bx=bx, size=wide * tall):
                full = by @ plane @ bx.T / size
                return np.stack([full[:, cy, cx] for cy in range(ny) for cx in range(nx) if cx * ny < nx * (ny - cy)], axis=1)

            for at in range(0, len(rows), step := max(1, (1 << 19) // (wide * tall))):
                some = rows[at : at + step]
                u8 = np.stack([np.stack([p[i] for i in some]) for p in planes[:3]], axis=-1)
                alpha = np.stack([planes[3][i] for i in some]) / 255.0 if a else np.ones(u8.shape[:2])
                seen = alpha.sum(axis=1) < wide * tall
                lin = LINEAR[u8]
                if seen.any():
                    total = alpha[seen].sum(axis=1)[:, None]
                    mean = np.where(total > 0, (u8[seen] * alpha[seen][..., None]).sum(axis=1) / 255 / np.maximum(total, 1e-300), 0.0)
                    over = np.clip((1 - alpha[seen][..., None]) * mean[:, None] + alpha[seen][..., None] * u8[seen] / 255, 0, 1)
                    lin[seen] = np.where(over <= 0.04045, over / 12.92, ((over + 0.055) / 1.055) ** 2.4)
                lab = np.cbrt(lin @ np.array(color.LMS).T) @ np.array(color.LAB).T * np.array([1.0, color.CHROMA, color.CHROMA])
                lab = lab.reshape(len(some), tall, wide, 3)
                small = [masked(lab[..., k], 3, 3) for k in (1, 2)]
                light = {flag: masked(lab[..., 0], *most(aspect, 5 if flag else 7)) for flag in set(seen.tolist())}
                wide_ = masked(alpha.reshape(len(some), tall, wide), 5, 5) if seen.any() else None
                for j, i in enumerate(some):
                    flag = bool(seen[j])
                    out[0][i], out[1][i], out[2][i], out[3][i] = flag, light[flag][j], small[0][j], small[1][j]
                    out[4][i] = wide_[j] if flag else None
        types = [pa.bool_(), *[pa.list_(pa.float64())] * 4]
        return pa.StructArray.from_arrays([pa.array(v, type=t) for v, t in zip(out, types, strict=True)], names=list(names))

    size = [F.col(c).cast("int").alias(k) for c, k in ((w, "w"), (h, "h"))]
    planes_of = [F.col(c).cast("array<int>").alias(k) for c, k in ((r, "r"), (g, "g"), (b, "b"), (a, "a")) if c]
    d = df.withColumn("_spectra", transformed(F.struct(*size, *planes_of)))
    return d.select("*", *(F.col(f"_spectra.{c}").alias(c) for c in names)).drop("_spectra")


def encode(df: DataFrame, w: str = "w", h: str = "h", r: str = "r", g: str = "g", b: str = "b", a: str | None = None, out: str = "hash") -> DataFrame:
    """``df`` with the hash (hex) of the pictures in its flat byte arrays.

    With ``a``, an array of opacity bytes, colours are drawn over their own mean and the
    hash holds the opacity, unless all of it is 255.  Arrays that don't fit the size give null.
    """
    keep = [c for c in df.columns if c != out]
    d = spectra(df.select(*(f"`{c}`" for c in keep)), w, h, r, g, b, a)
    d = computed(d, _code=F.when(F.col("_has").isNotNull(), quant.aspect_code(F.col(w).cast("int"), F.col(h).cast("int"))))
    d = d.withColumn("_ok", F.col("_has").isNotNull())
    ac = lambda c: F.slice(c, F.lit(2), F.greatest(F.size(c) - 1, F.lit(0)))
    d = computed(d, _al=ac(F.col("_cl")), _ap=ac(F.col("_cp")), _aq=ac(F.col("_cq")), _aa=F.when(F.col("_has"), ac(F.col("_ca"))))
    d = computed(d, _sl=best_scale(F.col("_al"), 31, LIGHT), _sp=best_scale(F.col("_ap"), 15, CHROMA), _sq=best_scale(F.col("_aq"), 15, CHROMA), _sa=F.when(F.col("_has"), best_scale(F.col("_aa"), 15, OPACITY)))
    bounded = lambda x, top: F.least(F.greatest(F.round(x), F.lit(0.0)), F.lit(float(top))).cast("long")
    dc = lambda c: bounded(31.5 + 31.5 * color.power(F.element_at(c, 1), MEAN_CHROMA), 63)
    head = bounded(63 * F.element_at("_cl", 1), 63) + dc(F.col("_cp")) * 64 + dc(F.col("_cq")) * 4096 + bounded(31 * F.col("_sl"), 31) * 262144 + F.when(F.col("_has"), 1 << 23).otherwise(0)
    second = F.col("_code") + bounded(15 * F.col("_sp"), 15) * 256 + bounded(15 * F.col("_sq"), 15) * 4096
    third = F.when(F.col("_has"), _hex_bytes(bounded(15 * F.element_at("_ca", 1), 15) + bounded(15 * F.col("_sa"), 15) * 16, 1)).otherwise("")
    all_ = F.concat(nibbles(F.col("_al"), F.col("_sl"), LIGHT), nibbles(F.col("_ap"), F.col("_sp"), CHROMA), nibbles(F.col("_aq"), F.col("_sq"), CHROMA))
    all_ = F.when(F.col("_has"), F.concat(all_, nibbles(F.col("_aa"), F.col("_sa"), OPACITY))).otherwise(all_)
    value = F.concat(_hex_bytes(head, 3), _hex_bytes(second, 2), third, _hex_nibbles(all_))
    return d.select(*(f"`{c}`" for c in keep), F.when(F.col("_ok"), value).alias(out))


def byte_length(w: Column, h: Column, has_alpha: Column) -> Column:
    """Exact number of bytes of a picture's hash."""
    nx, ny = frequencies(quant.aspect_of_code(quant.aspect_code(w, h)), has_alpha)
    many = F.size(mask(nx, ny)) - 1 + 10 + F.when(has_alpha, 14).otherwise(0)
    return (F.when(has_alpha, 6).otherwise(5) + F.ceil(many / 2)).cast("int")


def coefficients(df: DataFrame, hash_: str = "hash") -> DataFrame:
    """``df`` with ``_head_*`` (numbers of the header) and arrays of (cy, cx, v) for lightness, chroma and opacity.

    Missing bytes of the header are 0, missing nibbles 8.
    """
    digits = F.col(hash_)
    byte = lambda i: F.coalesce(F.conv(F.nullif(F.substring(digits, F.lit(2 * i + 1), F.lit(2)), F.lit("")), 16, 10).cast("int"), F.lit(0))
    h24 = byte(0) + byte(1) * 256 + byte(2) * 65536
    part = lambda v, shift, n: F.shiftright(v, shift).bitwiseAND((1 << n) - 1)
    mean = lambda shift: color.power(part(h24, shift, 6) / 31.5 - 1, 1 / MEAN_CHROMA)
    has = part(h24, 23, 1) == 1
    aspect = quant.aspect_of_code(byte(3))
    nx, ny = frequencies(aspect, has)
    head = F.struct(
        (part(h24, 0, 6) / 63.0).alias("l"), mean(6).alias("p"), mean(12).alias("q"), (part(h24, 18, 5) / 31.0).alias("sl"), has.alias("has"), aspect.alias("aspect"),
        (part(byte(4), 0, 4) / 15.0).alias("sp"), (part(byte(4), 4, 4) / 15.0).alias("sq"), F.when(has, part(byte(5), 0, 4) / 15.0).otherwise(1.0).alias("a"), F.when(has, part(byte(5), 4, 4) / 15.0).otherwise(0.0).alias("sa"),
    )
    d = computed(df, _head=head)
    d = d.select(*df.columns, *(F.col(f"_head.{f.name}").alias(f"_head_{f.name}") for f in d.schema["_head"].dataType.fields))
    start = F.when(F.col("_head_has"), 12).otherwise(10)
    text = F.substring(digits, start + 1, F.greatest(F.length(digits) - start, F.lit(0)))
    codes = F.transform(F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0))), lambda i: F.conv(F.substring(text, F.when(i % 2 == 0, i + 2).otherwise(i), F.lit(1)), 16, 10).cast("int"))
    d = computed(d, _codes=F.when(F.length(text) == 0, F.array().cast("array<int>")).otherwise(codes), _mask=mask(nx, ny), _small=mask(F.lit(3), F.lit(3)), _wide=mask(F.lit(5), F.lit(5)))

    def plane(masked: str, dc: str, scale: str, p: float, skip: Column) -> Column:
        s = F.col(f"_head_{scale}")
        code = lambda i: F.coalesce(F.try_element_at(F.col("_codes"), (skip + i).cast("int")), F.lit(8))
        value = lambda i: F.when(i == 0, F.col(f"_head_{dc}")).when(s <= 0, 0.0).otherwise(color.power(level(code(i), s, p), 1 / p))
        return F.transform(masked, lambda m, i: F.struct(m["cy"].alias("cy"), m["cx"].alias("cx"), value(i).alias("v")))

    # a channel whose scale is 0 takes no nibbles from the stream
    used = lambda masked, scale: F.when(F.col(f"_head_{scale}") > 0, F.size(masked) - 1).otherwise(0)
    at = [F.lit(0), used("_mask", "sl"), used("_mask", "sl") + used("_small", "sp"), used("_mask", "sl") + used("_small", "sp") + used("_small", "sq")]
    return computed(d, _l=plane("_mask", "l", "sl", LIGHT, at[0]), _p=plane("_small", "p", "sp", CHROMA, at[1]), _q=plane("_small", "q", "sq", CHROMA, at[2]), _al=plane("_wide", "a", "sa", OPACITY, at[3]))


def wave(coefs: Column, x: Column, y: Column, w: Column, h: Column) -> Column:
    """The inverse transform at one pixel; all but the mean of an axis count twice."""
    twice = lambda c: F.when(c == 0, 1.0).otherwise(2.0)
    term = lambda m: m["v"] * F.cos(pi / w * (x + 0.5) * m["cx"]) * twice(m["cx"]) * F.cos(pi / h * (y + 0.5) * m["cy"]) * twice(m["cy"])
    return F.aggregate(F.transform(coefs, term), F.lit(0.0), lambda a, v: a + v)


def decode(df: DataFrame, hash_: str = "hash", base: int = 256, dither: bool = False) -> DataFrame:
    """A row for each pixel: the columns of ``df`` with w, h, y, x, r, g, b, a."""
    keep = df.columns
    w, h = quant.output_size(F.col("_head_aspect"), base, strict=True)
    d = computed(coefficients(df, hash_), _w=w, _h=h)
    d = d.select("*", F.explode(F.sequence(F.lit(0), F.col("_h") - 1)).alias("y"))
    # along a row the vertical cosines stay: they go into coefficients by horizontal frequency first
    twice = lambda c: F.when(c == 0, 1.0).otherwise(2.0)

    def along(coefs: str) -> Column:
        term = lambda m: F.struct(m["cx"].alias("cx"), (m["v"] * F.cos(pi / F.col("_h") * (F.col("y") + 0.5) * m["cy"]) * twice(m["cy"]) * twice(m["cx"])).alias("v"))
        return F.transform(coefs, term)

    d = computed(d, _rl=along("_l"), _rp=along("_p"), _rq=along("_q"), _ra=F.when(F.col("_head_has"), along("_al")))
    d = d.drop("_l", "_p", "_q", "_al").select("*", F.explode(F.sequence(F.lit(0), F.col("_w") - 1)).alias("x"))
    at = lambda c: F.aggregate(c, F.lit(0.0), lambda s, m: s + m["v"] * F.cos(pi / F.col("_w") * (F.col("x") + 0.5) * m["cx"]))
    d = computed(d, _lab=F.struct(at("_rl").alias("l"), at("_rp").alias("p"), at("_rq").alias("q"), F.when(F.col("_head_has"), at("_ra")).alias("a")))
    rgb = color.from_oklab(F.col("_lab.l"), F.col("_lab.p"), F.col("_lab.q"))
    t = color.dither_threshold(F.col("x"), F.col("y")) if dither else F.lit(0.5)
    byte = lambda c: color.quantised(color.companded(c) * 255, t)
    a = F.when(F.col("_head_has"), color.quantised(F.col("_lab.a") * 255, t)).otherwise(255)
    return d.select(*keep, F.col("_w").alias("w"), F.col("_h").alias("h"), "y", "x", *(byte(c).alias(n) for c, n in zip(rgb, "rgb", strict=True)), a.alias("a"))
