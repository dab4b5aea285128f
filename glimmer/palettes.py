"""Named and computed palettes as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.color import hsl

# Colours of the named palettes, in order.
NAMED = {
    "gb_dmg": "0F380F 306230 8BAC0F 9BBC0F",
    "gb_pocket": "000000 545454 A9A9A9 FFFFFF",
    "cga_mode4_p1": "000000 55FFFF FF55FF FFFFFF",
    "c64_basic8": "000000 FFFFFF 880000 AAFFEE CC44CC 00CC55 0000AA EEEE77",
    "pico8": "000000 1D2B53 7E2553 008751 AB5236 5F574F C2C3C7 FFF1E8 FF004D FFA300 FFEC27 00E436 29ADFF 83769C FF77A8 FFCCAA",
    "sweetie_16": "1A1C2C 5D275D B13E53 EF7D57 FFCD75 A7F070 38B764 257179 29366F 3B5DC9 41A6F6 73EFF7 F4F4F4 94B0C2 566C86 333C57",
    "nes_16": "000000 FCFCFC F8F8F8 BCBCBC 7C7C7C A4E4FC 3CBCFC 0078F8 0000FC B8B8F8 6888FC 0058F8 0000BC D8B8F8 9878F8 6844FC",
    "c64": "000000 FFFFFF 880000 AAFFEE CC44CC 00CC55 0000AA EEEE77 DD8855 664400 FF7777 333333 777777 AAFF66 0088FF BBBBBB",
    "endesga_32": "BE4A2F D77643 EAD4AA E4A672 B86F50 733E39 3E2731 A22633 E43B44 F77622 FEAE34 FEE761 63C74D 3E8948 265C42 193C3E "
    "124E89 0099DB 2CE8F5 FFFFFF C0CBDC 8B9BB4 5A6988 3A4466 262B44 181425 FF0044 68386C B55088 F6757A E8B796 C28569",
    "aap_splendor_32": "050403 0E0C0C 2D1B1E 612721 B9451D F1641F FCA570 FFE0B7 FFFFFF FFF089 F8C53A E88A36 B05B2C 672D1F 452326 5D3B61 "
    "AD5B91 DF8BAD C2B0D1 8E7DA5 65517A 39314C 1A1932 1E3E5E 1A6291 30A7D7 53D2FF C3F4FF 55B57F 1E7541 0E3E2C 192418",
}

# Colours of the themed palettes that aren't named ones, in order.
THEMED = {
    "mono": "000000 FFFFFF",
    "gb-pocket": "000000 555555 AAAAAA FFFFFF",
    "gb-dmg": "081820 346856 88C070 E0F8D0",
    "gba-warm": "2A1B2A 6F5257 B99882 F3E5C0",
    "cga": "000000 55FFFF FF55FF FFFFFF",
    "resurrect-64": "2E222F 3E3546 625565 966C6C AB947A 694F62 7F708A 9BABB2 C7DCD0 FFFFFF 6E2727 B33831 EA4F36 F57D4A AE2334 E83B3B "
    "FB6B1D F79617 F9C22B 7A3045 9E4539 CD683D E6904E FBB954 4C3E24 676633 A2A947 D5E04B FBFF86 165A4C 239063 1EBC73 "
    "91DB69 CDDF6C 313638 374E4A 547E64 92A984 B2BA90 0B5E65 0B8A8F 0EAF9B 30E1B9 8FF8E2 323353 484A77 4D65B4 4D9BE6 "
    "8FD3FF 45293F 6B3E75 905EA9 A884F3 EAADED 753C54 A24B6F CF657F ED8099 831C5D C32454 F04F78 F68181 FCA790 FDCBB0",
    "pc98": "000000 221433 442A5A 6E3D8C A855C0 E088D8 F6B8D8 D83A7A 3A4EA8 4A90D8 6AD0E0 58B880 C88858 F0C888 F8E8B8 F8F0E0",
    "oil-6": "FBF5EF F2D3AB C69FA5 8B6D9C 494D7E 272744",
    "lospec500": "10121C 2C1E31 6B2643 AC2847 EC273F 94493A DE5D3A E98537 F3A833 4D3533 6E4C30 A26D3F CE9248 DAB163 E8D282 F7F3B7 "
    "1E4044 006554 26854C 5AB552 9DE64E 008B8B 62A477 A6CB96 D3EED3 3E3B65 3859B3 3388DE 36C5F4 6DEAD6 5E5B8C 8C78A5 "
    "B0A7B8 DECEED 9A4D76 C878AF CC99FF FA6E79 FFA2AC FFD1D5 F6E8E0 FFFFFF",
}
#: Themed names of palettes that are named ones too.
ALSO = {"endesga-32": "endesga_32"}
#: All palettes by name; a name in both sets means the named one.
ALL = THEMED | {theme: NAMED[name] for theme, name in ALSO.items()} | NAMED


def get(name: str) -> str:
    """A palette's colours as hex, six digits each."""
    if name not in ALL:
        raise KeyError(f"unknown palette {name!r}; known: {sorted(ALL)}")
    return ALL[name].replace(" ", "").lower()


def from_hex(colors: list[str]) -> str:
    """A palette of colours written #rrggbb or rrggbb."""
    plain = [c.removeprefix("#").lower() for c in colors]
    if any(len(c) != 6 or int(c, 16) < 0 for c in plain):
        raise ValueError("a colour has six digits")
    return "".join(plain)


def from_rgb(colors: list[tuple[int, int, int]]) -> str:
    return "".join(f"{r:02x}{g:02x}{b:02x}" for r, g, b in colors)


def frame(spark: SparkSession, names: list[str] | None = None) -> DataFrame:
    """(name, idx, r, g, b) of the named palettes, or of those asked for."""
    texts = spark.createDataFrame([(n, ALL[n]) for n in names or NAMED], "name string, colors string")
    byte = lambda at: F.conv(F.substring("color", at, 2), 16, 10).cast("int")
    return texts.select("name", F.posexplode(F.split("colors", " ")).alias("idx", "color")).select("name", "idx", byte(1).alias("r"), byte(3).alias("g"), byte(5).alias("b"))


def _level(i: Column, n: int) -> Column:
    return F.lit(128) if n == 1 else F.round(i * 255.0 / (n - 1)).cast("int")


def automatic(spark: SparkSession, k: int) -> DataFrame:
    """(k, idx, r, g, b): grey steps up to 8, 8 greys and 8 hues for 16, else a cube with spare bits on red and green."""
    rows = spark.range(k).select(F.lit(k).alias("k"), F.col("id").cast("int").alias("idx"))
    i = F.col("idx")
    if k <= 8:
        rgb = [_level(i, k)] * 3
    elif k == 16:
        hue = hsl((i - 8) * 45.0, F.lit(0.72), F.lit(0.5))
        rgb = [F.when(i < 8, _level(i, 8)).otherwise(h) for h in hue]
    else:
        bits = (k - 1).bit_length()
        g, r = -(-bits // 3), -(-(bits - (-(-bits // 3))) // 2)
        b = bits - g - r
        low = lambda shift, n: F.shiftright(i, shift).bitwiseAND((1 << n) - 1)
        rgb = [_level(low(g + b, r), 1 << r), _level(low(b, g), 1 << g), _level(low(0, b), 1 << b)]
    return rows.select("k", "idx", *(x.alias(n) for x, n in zip(rgb, "rgb", strict=True)))


def coordinate_bits(base: Column) -> tuple[Column, Column]:
    """Bits of positions and of radii for images of that long edge."""
    cx = F.least(F.greatest(F.round(F.log2(F.greatest(base, F.lit(8)).cast("double") / 8)), F.lit(2.0)), F.lit(8.0)).cast("int")
    return cx, F.least(F.greatest(cx - 1, F.lit(1)), F.lit(6))


def linear_array(palette: str, k: int | None = None) -> Column:
    """Structs (idx, r, g, b) of a hex palette's first ``k`` colours in linear light."""
    from .functions.color import linear

    n = len(palette) // 6 if k is None else k
    rows = []
    for i in range(n):
        r, g, b = (F.lit(int(palette[6 * i + j : 6 * i + j + 2], 16)) for j in (0, 2, 4))
        rows.append(F.struct(F.lit(i).alias("idx"), linear(r).alias("r"), linear(g).alias("g"), linear(b).alias("b")))
    return F.array(*rows)


def nearest(colors: Column, r: Column, g: Column, b: Column) -> Column:
    """Index of the nearest of ``colors`` (structs idx, r, g, b), the first of equals."""
    d = lambda c: (c["r"] - r) * (c["r"] - r) + (c["g"] - g) * (c["g"] - g) + (c["b"] - b) * (c["b"] - b)
    return F.array_min(F.transform(colors, lambda c: F.struct(d(c).alias("d"), c["idx"].alias("i"))))["i"]


def spreads(spark: SparkSession, names: list[str] | None = None) -> DataFrame:
    """(name, spread): mean distance of each named palette's colours to their nearest others."""
    a = frame(spark, names)
    b = a.select("name", F.col("idx").alias("j"), *(F.col(c).alias(f"{c}2") for c in "rgb"))
    d = sum(((F.col(c) - F.col(f"{c}2")) * (F.col(c) - F.col(f"{c}2")) for c in "rgb"), F.lit(0))
    near = a.join(b, "name").where("idx <> j").groupBy("name", "idx").agg(F.sqrt(F.min(d)).alias("d"))
    return near.groupBy("name").agg(F.avg("d").alias("spread"))
