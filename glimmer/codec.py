"""Codecs: the parameters without which a hash means nothing.

A codec is a struct column of one flat shape, so that it can be stored beside each hash,
compared null-safely and joined on.
"""

from __future__ import annotations

import warnings
from dataclasses import asdict, dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MODES = ("dct", "circle", "triangle", "square", "rect", "rotrect", "pixel")
LEAST_COLORS, MOST_COLORS = 2, 1024

SCHEMA = T.StructType(
    [
        T.StructField("shape", T.StringType()),
        T.StructField("n_shapes", T.IntegerType()),
        T.StructField("cx_bits", T.IntegerType()),
        T.StructField("cy_bits", T.IntegerType()),
        T.StructField("r_bits", T.IntegerType()),
        T.StructField("alpha_bits", T.IntegerType()),
        T.StructField("color_bits", T.IntegerType()),
        T.StructField("theta_bits", T.IntegerType()),
        T.StructField("palette", T.StringType()),
        T.StructField("palette_k", T.IntegerType()),
        T.StructField("alpha_levels", T.ArrayType(T.DoubleType())),
        T.StructField("grid_aspect", T.DoubleType()),
    ]
)


@dataclass(frozen=True)
class Codec:
    """One codec on the driver; ``palette`` is hex, six digits a colour."""

    shape: str = "dct"
    n_shapes: int = 12
    cx_bits: int = 5
    cy_bits: int = 5
    r_bits: int = 4
    alpha_bits: int = 3
    color_bits: int = 16
    theta_bits: int = 5
    palette: str | None = None
    palette_k: int | None = None
    alpha_levels: tuple[float, ...] | None = None
    grid_aspect: float | None = None

    def __post_init__(self) -> None:
        if self.shape == "rotated_rect":
            object.__setattr__(self, "shape", "rotrect")
        if self.shape not in MODES:
            raise ValueError(f"unknown shape {self.shape!r}")
        if self.color_bits not in (16, 24):
            raise ValueError("color_bits must be 16 or 24")
        if self.palette is None:
            if self.palette_k is not None:
                raise ValueError("palette_k without a palette")
        else:
            if len(self.palette) % 6 or not all(c in "0123456789abcdefABCDEF" for c in self.palette):
                raise ValueError("a palette is hex, six digits a colour")
            k = len(self.palette) // 6
            if self.palette_k is not None and self.palette_k > k:
                raise ValueError("palette_k is beyond the palette")
            if not LEAST_COLORS <= self.colors <= MOST_COLORS:
                raise ValueError("a palette has 2 to 1024 colours")
        if self.alpha_levels is not None and len(self.alpha_levels) != 1 << self.alpha_bits:
            raise ValueError("alpha_levels needs one value for each code")

    @property
    def colors(self) -> int:
        """Active colours of the palette, 0 without one."""
        return 0 if self.palette is None else self.palette_k if self.palette_k is not None else len(self.palette) // 6

    @property
    def palette_bits(self) -> int:
        return (self.colors - 1).bit_length() if self.colors >= LEAST_COLORS else 0

    @property
    def color_field(self) -> int:
        return self.palette_bits if self.palette is not None else self.color_bits

    @property
    def levels(self) -> list[float]:
        from .functions.quant import alpha_levels

        return list(self.alpha_levels) if self.alpha_levels is not None else alpha_levels(self.alpha_bits)

    def with_color(self, bits: int) -> Codec:
        """Plain colours of that width; a palette goes.  Frequency hashes have no colour field."""
        return self if self.shape == "dct" else replace(self, color_bits=bits, palette=None, palette_k=None)

    def with_palette(self, palette: str, k: int | None = None) -> Codec:
        return self if self.shape == "dct" else replace(self, palette=palette.lower(), palette_k=k)

    def with_theta_bits(self, bits: int) -> Codec:
        return replace(self, theta_bits=bits) if self.shape == "rotrect" else self

    def with_grid_aspect(self, aspect: float) -> Codec:
        return replace(self, grid_aspect=aspect) if self.shape == "pixel" else self

    def column(self) -> Column:
        """The codec as a literal struct."""
        row = asdict(self)
        fields = []
        for f in SCHEMA:
            v = row[f.name]
            value = F.array(*map(F.lit, v)) if isinstance(v, tuple) else F.lit(v)
            fields.append(value.cast(f.dataType).alias(f.name))
        return F.struct(*fields)


def of(shape: str, n: int = 12) -> Codec:
    return Codec(shape) if shape == "dct" else Codec(shape, n_shapes=n)


def presets() -> dict[str, tuple[Codec, bool]]:
    """Codec and deprecation of every preset, active ones first."""
    found = {"dct": (of("dct"), False)}
    for size, n, cells in (("small", 12, 16), ("medium", 24, 24), ("large", 64, 64)):
        for shape in ("triangle", "circle", "pixel", "rect", "square"):
            found[f"{size}_{shape}"] = (of(shape, cells if shape == "pixel" else n), False)
    found["tiny_dct"] = (of("dct"), True)
    for old, new in (("placeholder", "small"), ("detail", "large")):
        for shape in ("triangle", "circle", "pixel"):
            found[f"{old}_{shape}"] = (found[f"{new}_{shape}"][0], True)
    return found


def preset(name: str) -> Codec:
    """A preset by name; old names warn."""
    found = presets()
    if name not in found:
        raise KeyError(f"unknown preset {name!r}; known: {sorted(found)}")
    codec, old = found[name]
    if old:
        warnings.warn(f"preset {name} is deprecated", DeprecationWarning, stacklevel=2)
    return codec


def preset_frame(spark: SparkSession) -> DataFrame:
    """(ord, name, deprecated, codec)."""
    rows = [(i, name, old, tuple(asdict(c).values())) for i, (name, (c, old)) in enumerate(presets().items())]
    return spark.createDataFrame(rows, T.StructType([T.StructField("ord", T.IntegerType()), T.StructField("name", T.StringType()), T.StructField("deprecated", T.BooleanType()), T.StructField("codec", SCHEMA)]))


# The length law on codec columns.


def colors(codec: Column) -> Column:
    return F.coalesce(codec["palette_k"], F.floor(F.length(codec["palette"]) / 6).cast("int"))


def palette_bits(codec: Column) -> Column:
    k = colors(codec)
    return F.when(k >= LEAST_COLORS, F.length(F.bin((k - 1).cast("long")))).otherwise(0)


def color_field_bits(codec: Column) -> Column:
    return F.when(codec["palette"].isNotNull(), palette_bits(codec)).otherwise(codec["color_bits"])


def per_shape_bits(codec: Column) -> Column:
    xy, col, a, r = codec["cx_bits"] + codec["cy_bits"], color_field_bits(codec), codec["alpha_bits"], codec["r_bits"]
    return (
        F.when(codec["shape"].isin("circle", "square"), xy + r + col + a)
        .when(codec["shape"] == "rect", xy + 2 * r + col + a)
        .when(codec["shape"] == "rotrect", xy + 2 * r + codec["theta_bits"] + col + a)
        .when(codec["shape"] == "triangle", 3 * xy + col + a)
        .when(codec["shape"] == "pixel", col)
        .otherwise(0)
    )


def header_bits(codec: Column) -> Column:
    return F.when(codec["shape"] == "dct", 40).when(codec["shape"] == "pixel", 8).otherwise(8 + color_field_bits(codec))


def bytes_total(codec: Column, has_alpha: Column | bool = False) -> Column:
    """Bytes of a hash; for frequency hashes the most they can have."""
    has_alpha = F.lit(has_alpha) if isinstance(has_alpha, bool) else has_alpha
    dct = F.when(has_alpha, 40).otherwise(27)
    return F.when(codec["shape"] == "dct", dct).otherwise(F.ceil((header_bits(codec) + codec["n_shapes"] * per_shape_bits(codec)) / 8).cast("int"))


def long_enough(hash_hex: Column, codec: Column) -> Column:
    """Whether a hash can be decoded: five bytes of a frequency hash, all of another."""
    return F.length(hash_hex) / 2 >= F.when(codec["shape"] == "dct", 5).otherwise(bytes_total(codec))


def compatible(a: Column, b: Column, strict: bool = False) -> Column:
    """Whether hashes of one codec can be read with the other; ``strict`` also asks for equal opacities and grids."""
    names = ["shape", "n_shapes", "cx_bits", "cy_bits", "r_bits", "alpha_bits", "color_bits", "theta_bits"] + ["alpha_levels", "grid_aspect"] * strict
    same = F.lit(True)
    for n in names:
        same = same & a[n].eqNullSafe(b[n])
    active = lambda c: F.lower(F.substring(c["palette"], F.lit(1), colors(c) * 6))
    return same & active(a).eqNullSafe(active(b))


def supports_svg(codec: Column) -> Column:
    return codec["shape"] != "dct"


def supports_corners(codec: Column) -> Column:
    return codec["shape"].isin("rect", "square", "rotrect")


def palette_mode(codec: Column) -> Column:
    return codec["palette"].isNotNull()
