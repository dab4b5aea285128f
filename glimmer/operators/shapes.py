"""Hashes made of shapes or cells: parsed, drawn and written as SVG, all as native columns.

The parsed shapes of a hash are an array in paint order; nothing here shuffles.
"""

from __future__ import annotations

from math import pi

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..codec import Codec
from ..functions import bits, color, quant
from ..functions.rows import computed
from ..palettes import linear_array


def _palette_bytes(codec: Codec) -> Column:
    p = codec.palette
    return F.array(*(F.struct(*(F.lit(int(p[6 * i + j : 6 * i + j + 2], 16)).alias(n) for j, n in ((0, "r"), (2, "g"), (4, "b")))) for i in range(codec.colors)))


def _color(s: Column, at: Column, codec: Codec) -> Column:
    """Struct (r, g, b) of bytes; null where an index is beyond the palette."""
    if codec.palette is not None:
        return F.try_element_at(_palette_bytes(codec), (bits.read(s, at, codec.palette_bits) + 1).cast("int"))
    if codec.color_bits == 16:
        rgb = color.from_rgb565(bits.read(s, at, 16))
    else:
        rgb = tuple(bits.read(s, at + 8 * i, 8) for i in range(3))
    return F.struct(*(x.alias(n) for x, n in zip(rgb, "rgb", strict=True)))


def _record_bits(codec: Codec) -> int:
    xy, col, a, r = codec.cx_bits + codec.cy_bits, codec.color_field, codec.alpha_bits, codec.r_bits
    return {"circle": xy + r + col + a, "square": xy + r + col + a, "rect": xy + 2 * r + col + a, "rotrect": xy + 2 * r + codec.theta_bits + col + a, "triangle": 3 * xy + col + a, "pixel": col}[codec.shape]


def parse(df: DataFrame, codec: Codec, hash_: str = "hash", base: int = 256, aspect: float | None = None, scale: int = 1) -> DataFrame:
    """``df`` with _w, _h (canvas), _quant (aspect in the hash), _bg and _shapes.

    Shapes are structs kind-independent in form: cx, cy, w, h (pixels; w the radius of a
    circle, w = h the side of a square), theta, x1, y1, x2, y2 (a triangle's other
    corners), alpha, color.  Bits past the end of a hash are zero.
    """
    if codec.shape == "dct":
        raise ValueError("a frequency hash has no shapes")
    d = computed(df, _s=bits.from_hex(F.col(hash_)))
    d = d.withColumn("_quant", quant.aspect_of_code(bits.read(F.col("_s"), 0, 8)))
    w, h = quant.output_size(F.col("_quant") if aspect is None else F.lit(float(aspect)), base)
    d = computed(d, _w=w * scale, _h=h * scale)
    s, ww, hh, x, y, r = F.col("_s"), F.col("_w"), F.col("_h"), codec.cx_bits, codec.cy_bits, codec.r_bits
    per = _record_bits(codec)
    head = 8 if codec.shape == "pixel" else 8 + codec.color_field
    levels = F.array(*map(F.lit, codec.levels))

    def record(i: Column) -> Column:
        at = i * per + head
        zero = F.lit(0)
        f = {"cx": zero, "cy": zero, "w": zero, "h": zero, "theta": F.lit(0.0), "x1": zero, "y1": zero, "x2": zero, "y2": zero}
        if codec.shape == "pixel":
            return F.struct(*(v.alias(k) for k, v in f.items()), F.lit(1.0).alias("alpha"), _color(s, at, codec).alias("color"))
        point = lambda k: (quant.position_of_code(bits.read(s, at + k, x), ww, x), quant.position_of_code(bits.read(s, at + k + x, y), hh, y))
        f["cx"], f["cy"] = point(0)
        k = x + y
        whole = lambda v: F.round(v).cast("int")
        if codec.shape == "triangle":
            (f["x1"], f["y1"]), (f["x2"], f["y2"]) = point(k), point(2 * k)
            k *= 3
        elif codec.shape in ("circle", "square"):
            f["w"] = f["h"] = whole(quant.radius_of_code(bits.read(s, at + k, r), ww, hh, r))
            k += r
        else:
            f["w"] = whole(quant.extent_of_code(bits.read(s, at + k, r), ww, r))
            f["h"] = whole(quant.extent_of_code(bits.read(s, at + k + r, r), hh, r))
            k += 2 * r
            if codec.shape == "rotrect":
                f["theta"] = quant.angle_of_code(bits.read(s, at + k, codec.theta_bits), codec.theta_bits)
                k += codec.theta_bits
        code = bits.read(s, at + k + codec.color_field, codec.alpha_bits)
        alpha = F.element_at(levels, F.least(code + 1, F.lit(len(codec.levels))).cast("int"))
        return F.struct(*(v.alias(n) for n, v in f.items()), alpha.alias("alpha"), _color(s, at + k, codec).alias("color"))

    bg = F.lit(None).cast("struct<r:int,g:int,b:int>") if codec.shape == "pixel" else _color(s, F.lit(8), codec)
    d = computed(d, _bg=bg)
    d = computed(d, _shapes=F.transform(F.sequence(F.lit(0), F.lit(codec.n_shapes - 1)), record))
    return d.drop("_s")


def shape_rows(df: DataFrame, codec: Codec, hash_: str = "hash", base: int = 256) -> DataFrame:
    """A row for each shape: the columns of ``df``, idx and the shape's fields."""
    d = parse(df, codec, hash_, base).select(*df.columns, F.posexplode("_shapes").alias("idx", "s"))
    return d.select(*df.columns, F.lit(codec.shape).alias("kind"), "idx", "s.*")


def symbols(df: DataFrame, codec: Codec, hash_: str = "hash", deltas: bool = False) -> DataFrame:
    """A row for each coded number: the columns of ``df``, field, pos, sym; what entropy models are fitted on.

    With ``deltas`` the second and third corner of a triangle are given by their distance
    from the first one, shifted to be 0 or more.
    """
    per, head, x, y, r = _record_bits(codec), 8 if codec.shape == "pixel" else 8 + codec.color_field, codec.cx_bits, codec.cy_bits, codec.r_bits
    layout: list[tuple[str, int]] = {
        "circle": [("x", x), ("y", y), ("r", r)], "square": [("x", x), ("y", y), ("r", r)], "rect": [("x", x), ("y", y), ("w", r), ("h", r)],
        "rotrect": [("x", x), ("y", y), ("w", r), ("h", r), ("theta", codec.theta_bits)], "triangle": [("x0", x), ("y0", y), ("x1", x), ("y1", y), ("x2", x), ("y2", y)], "pixel": [],
    }[codec.shape]
    layout += [("palette", codec.palette_bits)] if codec.palette is not None else [("red", 5), ("green", 6), ("blue", 5)][::-1] if codec.color_bits == 16 else [("red", 8), ("green", 8), ("blue", 8)]
    layout += [("alpha", codec.alpha_bits)] if codec.shape != "pixel" else []
    fields, at = [], 0
    for name, n in layout:
        fields.append((name, at, n))
        at += n
    assert at == per
    d = computed(df, _s=bits.from_hex(F.col(hash_))).select(*df.columns, "_s", F.explode(F.sequence(F.lit(0), F.lit(codec.n_shapes - 1))).alias("pos"))
    sym = {name: bits.read(F.col("_s"), F.col("pos") * per + head + k, n) for name, k, n in fields if n}
    if deltas and codec.shape == "triangle":
        sym |= {c: (sym[c] - sym[c[0] + "0"] + ((1 << (x if c[0] == "x" else y)) - 1)) for c in ("x1", "y1", "x2", "y2")}
    items = F.array(*(F.struct(F.lit(name).alias("field"), v.alias("sym")) for name, v in sym.items()))
    return d.select(*df.columns, "pos", F.explode(items).alias("i")).select(*df.columns, "i.field", "pos", "i.sym")


def _edge(ax: Column, ay: Column, bx: Column, by: Column, x: Column, y: Column) -> Column:
    return (bx - ax).cast("long") * (y - ay) - (by - ay).cast("long") * (x - ax)


def _inside_polygon(points: list[tuple[Column, Column]], x: Column, y: Column) -> Column:
    """Edges and corners belong to it; a polygon without area (by its first three corners) is empty."""
    area = _edge(*points[0], *points[1], *points[2])
    sides = [_edge(*points[i], *points[(i + 1) % len(points)], x, y) for i in range(len(points))]
    left, right = F.lit(True), F.lit(True)
    for e in sides:
        left, right = left & (e >= 0), right & (e <= 0)
    return F.when(area > 0, left).when(area < 0, right).otherwise(False)


def corners(s: Column) -> list[tuple[Column, Column]]:
    """The rounded corners of a rotated rectangle."""
    c, n = F.cos(s["theta"]), F.sin(s["theta"])
    out = []
    for a, b in ((-0.5, -0.5), (0.5, -0.5), (0.5, 0.5), (-0.5, 0.5)):
        x, y = s["w"] * a, s["h"] * b
        out.append((F.round(s["cx"] + (x * c - y * n)).cast("int"), F.round(s["cy"] + (x * n + y * c)).cast("int")))
    return out


def inside(kind: str, s: Column, x: Column, y: Column) -> Column:
    """Whether a shape with hard edges covers a pixel."""
    if kind == "circle":
        dx, dy = x - s["cx"], y - s["cy"]
        return (s["w"] > 0) & (dx * dx + dy * dy <= s["w"] * s["w"])
    if kind == "triangle":
        return _inside_polygon([(s["cx"], s["cy"]), (s["x1"], s["y1"]), (s["x2"], s["y2"])], x, y)
    if kind == "rotrect":
        return _inside_polygon(corners(s), x, y)
    x0, y0 = s["cx"] - F.floor(s["w"] / 2), s["cy"] - F.floor(s["h"] / 2)
    return (x >= x0) & (x <= x0 + F.greatest(s["w"] - 1, F.lit(0))) & (y >= y0) & (y <= y0 + F.greatest(s["h"] - 1, F.lit(0)))


def covered(df: DataFrame, kind: str, shape: str, w: int, h: int, out: str = "covered") -> DataFrame:
    """``df`` with the number of pixels of a canvas of ``w`` x ``h`` that the shape with hard edges in a column covers.

    What ``inside`` says of each pixel, from the span of each row: work grows with the rows and not with the pixels.
    """
    s = F.col(f"`{shape}`")
    between = lambda low, high, n: F.greatest(F.least(high, F.lit(n - 1)) - F.greatest(low, F.lit(0)) + 1, F.lit(0))
    if kind in ("square", "rect"):
        x0, y0 = s["cx"] - F.floor(s["w"] / 2), s["cy"] - F.floor(s["h"] / 2)
        many = between(x0, x0 + F.greatest(s["w"] - 1, F.lit(0)), w) * between(y0, y0 + F.greatest(s["h"] - 1, F.lit(0)), h)
        return df.select("*", many.cast("int").alias(out))
    rows = F.sequence(F.lit(0), F.lit(h - 1))
    if kind == "circle":
        d = computed(df, _at=F.struct(s["cx"].alias("x"), s["cy"].alias("y"), s["w"].cast("long").alias("r")))
        x, y, r = (F.col("_at")[c] for c in "xyr")

        def along(v: Column) -> Column:
            left = r * r - (v - y) * (v - y)
            half = F.floor(F.sqrt(left))  # whole roots are exact
            return F.when(left >= 0, between(x - half, x + half, w)).otherwise(F.lit(0))

        many = F.when(r > 0, F.aggregate(rows, F.lit(0).cast("long"), lambda n, v: n + along(v))).otherwise(F.lit(0))
        return d.select("*", many.cast("int").alias(out)).drop("_at")
    points = [(s["cx"], s["cy"]), (s["x1"], s["y1"]), (s["x2"], s["y2"])] if kind == "triangle" else corners(s)
    names = [f"{c}{i}" for i in range(len(points)) for c in "xy"]
    d = computed(df, _p=F.struct(*(v.cast("long").alias(n) for n, v in zip(names, (v for p in points for v in p), strict=True))))
    points = [(F.col("_p")[f"x{i}"], F.col("_p")[f"y{i}"]) for i in range(len(points))]
    d = computed(d, _turn=F.signum(_edge(*points[0], *points[1], *points[2])))
    sides = {}
    for i, (px, py) in enumerate(points):
        qx, qy = points[(i + 1) % len(points)]
        # inside: m * x <= a * y + b; quotients of whole numbers this small have the right floor
        sides |= {f"m{i}": (qy - py), f"a{i}": (qx - px), f"b{i}": (qy - py) * px - (qx - px) * py}
    d = computed(d, _sides=F.struct(*((F.col("_turn") * v).alias(n) for n, v in sides.items())))

    def across(y: Column) -> Column:
        low, high = [F.lit(0).cast("long")], [F.lit(w - 1).cast("long")]
        for i in range(len(points)):
            m, a, b = (F.col("_sides")[f"{c}{i}"] for c in "mab")
            k = a * y + b
            high.append(F.when(m > 0, F.floor(k / m)).when((m == 0) & (k < 0), F.lit(-1)))
            low.append(F.when(m < 0, F.ceil(k / m)))
        return F.greatest(F.least(*high) - F.greatest(*low) + 1, F.lit(0))  # sides that don't bound a row are null, and don't count

    many = F.when(F.col("_turn") != 0, F.aggregate(rows, F.lit(0).cast("long"), lambda n, y: n + across(y))).otherwise(F.lit(0))
    return d.select("*", many.cast("int").alias(out)).drop("_p", "_turn", "_sides")


def coverage(kind: str, s: Column, x: Column, y: Column, radius: float) -> Column:
    """Share of a pixel that a rectangle with rounded corners covers, from its distance to the edge."""
    hw, hh = s["w"] * 0.5, s["h"] * 0.5
    r = F.least(F.lit(float(radius)), hw, hh)
    dx, dy = x + 0.5 - s["cx"], y + 0.5 - s["cy"]
    if kind == "rotrect":
        c, n = F.cos(s["theta"]), F.sin(s["theta"])
        dx, dy = c * dx + n * dy, c * dy - n * dx
    qx, qy = F.greatest(F.abs(dx) - (hw - r), F.lit(0.0)), F.greatest(F.abs(dy) - (hh - r), F.lit(0.0))
    share = F.least(F.greatest(0.5 - (F.sqrt(qx * qx + qy * qy) - r), F.lit(0.0)), F.lit(1.0))
    return F.when((hw > 0) & (hh > 0), share).otherwise(0.0)


def _lit_color(c: Column) -> Column:
    return F.struct(*(color.linear(c[n]).cast("float").alias(n) for n in "rgb"))


def decode(df: DataFrame, codec: Codec, hash_: str = "hash", base: int = 256, aspect: float | None = None, aa: int = 1, corner_radius: float = 0.0, smooth: bool = False) -> DataFrame:
    """A row for each pixel: the columns of ``df`` with w, h, y, x, r, g, b, a.

    ``aa`` samples a pixel that many times each way; ``corner_radius`` (output pixels) rounds
    rectangles and squares; ``smooth`` blends the cells of a pixel hash.
    """
    keep = df.columns
    d = parse(df, codec, hash_, base, aspect, 1 if codec.shape == "pixel" else aa)
    n = 1 if codec.shape == "pixel" else aa
    d = d.withColumns({"w": (F.col("_w") / n).cast("int"), "h": (F.col("_h") / n).cast("int")})
    if codec.shape == "pixel":
        grid = F.lit(codec.grid_aspect) if codec.grid_aspect is not None else F.col("_quant")
        d = d.withColumn("_grid", quant.pixel_grid(codec.n_shapes, grid)).withColumns({"_gw": F.col("_grid.gw"), "_gh": F.col("_grid.gh")}).drop("_grid")
    else:
        d = computed(d, _lin=F.transform("_shapes", lambda s: s.withField("color", _lit_color(s["color"]))), _under=_lit_color(F.col("_bg"))).drop("_shapes")
    d = d.select("*", F.explode(F.sequence(F.lit(0), F.col("h") - 1)).alias("y")).select("*", F.explode(F.sequence(F.lit(0), F.col("w") - 1)).alias("x"))
    if codec.shape == "pixel":
        rgb = _cells(F.col("_shapes"), smooth)
    else:
        rgb = _painted(codec.shape, n, corner_radius * n)
    d = computed(d, _rgb=rgb)
    return d.select(*keep, "w", "h", "y", "x", F.col("_rgb.r").alias("r"), F.col("_rgb.g").alias("g"), F.col("_rgb.b").alias("b"), F.lit(255).alias("a"))


def _painted(kind: str, aa: int, radius: float) -> Column:
    rounded = radius > 0 and kind in ("rect", "square", "rotrect")

    def at(x: Column, y: Column) -> Column:
        def paint(acc: Column, s: Column) -> Column:
            if rounded:
                a = (s["alpha"].cast("float") * coverage(kind, s, x, y, radius).cast("float")).cast("float")
                hit = a > 0
            else:
                a, hit = s["alpha"].cast("float"), inside(kind, s, x, y)
            over = lambda n: F.when(hit, ((F.lit(1.0).cast("float") - a) * acc[n] + a * s["color"][n]).cast("float")).otherwise(acc[n])
            return F.struct(*(over(n).alias(n) for n in "rgb"))

        return F.aggregate("_lin", F.col("_under"), paint)

    if aa == 1:
        p = at(F.col("x"), F.col("y"))
        return F.aggregate(F.array(p), F.lit(None).cast("struct<r:int,g:int,b:int>"), lambda _, c: F.struct(*(color.srgb_u8(c[n]).alias(n) for n in "rgb")))
    samples = F.transform(F.sequence(F.lit(0), F.lit(aa * aa - 1)), lambda k: at(F.col("x") * aa + k % aa, F.col("y") * aa + F.floor(k / aa).cast("int")))
    zero = F.struct(*(F.lit(0.0).alias(n) for n in "rgb"))
    return F.aggregate(samples, zero, lambda t, c: F.struct(*((t[n] + c[n]).alias(n) for n in "rgb")), lambda t: F.struct(*(color.srgb_u8(t[n] / (aa * aa)).alias(n) for n in "rgb")))


def _cells(cells: Column, smooth: bool) -> Column:
    """A pixel's colour from the cells of a grid; hard edges lie at rounded shares of the width."""
    color_at = lambda gx, gy: F.element_at(cells, (gy * F.col("_gw") + gx + 1).cast("int"))["color"]
    if not smooth:

        def cell(v: Column, n: Column, size: Column) -> Column:
            # the last cell that starts at or before the pixel
            starts = F.transform(F.sequence(F.lit(0), n - 1), lambda g: F.greatest(F.round(g * size / n), F.lit(0.0)))
            return F.size(F.filter(starts, lambda s: s <= v)) - 1

        return color_at(cell(F.col("x"), F.col("_gw"), F.col("w")), cell(F.col("y"), F.col("_gh"), F.col("h")))
    fx, fy = (F.col("x") + 0.5) * F.col("_gw") / F.col("w") - 0.5, (F.col("y") + 0.5) * F.col("_gh") / F.col("h") - 0.5
    low = lambda f, n: F.least(F.greatest(F.floor(f), F.lit(0)), n - 1).cast("int")
    x0, y0 = low(fx, F.col("_gw")), low(fy, F.col("_gh"))
    x1, y1 = F.least(x0 + 1, F.col("_gw") - 1), F.least(y0 + 1, F.col("_gh") - 1)
    share = lambda f, g: F.least(F.greatest(f - g, F.lit(0.0)), F.lit(1.0))
    dx, dy = share(fx, x0), share(fy, y0)
    blend = lambda n: F.floor((1 - dy) * ((1 - dx) * color_at(x0, y0)[n] + dx * color_at(x1, y0)[n]) + dy * ((1 - dx) * color_at(x0, y1)[n] + dx * color_at(x1, y1)[n]) + 1e-9).cast("int")
    return F.struct(*(blend(n).alias(n) for n in "rgb"))


def _fill(c: Column) -> Column:
    return color.hex_color(c["r"], c["g"], c["b"])


def _opacity(alpha: Column) -> Column:
    return F.when(alpha >= 1, "").otherwise(F.concat(F.lit(' fill-opacity="'), color.number_text(alpha), F.lit('"')))


def _spaced(n: Column) -> Column:
    return F.when(n < 0, n.cast("string")).otherwise(F.concat(F.lit(" "), n.cast("string")))


def element(kind: str, s: Column, corner_radius: float = 0.0) -> Column:
    """The SVG element of one shape."""
    text = lambda v: v.cast("string")
    fill, opacity = _fill(s["color"]), _opacity(s["alpha"])
    if kind == "circle":
        return F.concat(F.lit('<circle cx="'), text(s["cx"]), F.lit('" cy="'), text(s["cy"]), F.lit('" r="'), text(F.greatest(s["w"], F.lit(1))), F.lit('" fill="'), fill, F.lit('"'), opacity, F.lit("/>"))
    if kind == "triangle":
        steps = [s["x1"] - s["cx"], s["y1"] - s["cy"], s["x2"] - s["x1"], s["y2"] - s["y1"]]
        return F.concat(F.lit('<path fill="'), fill, F.lit('"'), opacity, F.lit(' d="M'), text(s["cx"]), _spaced(s["cy"]), F.lit("l"), text(steps[0]), *map(_spaced, steps[1:]), F.lit('z"/>'))
    half = lambda v: F.floor(v / 2).cast("int")
    corner = F.concat(F.lit(' rx="'), color.number_text(F.lit(corner_radius)), F.lit('" ry="'), color.number_text(F.lit(corner_radius)), F.lit('"')) if corner_radius > 0 else F.lit("")
    turn = F.concat(F.lit(' transform="rotate('), color.number_text(s["theta"] * 180 / pi), F.lit(" "), text(s["cx"]), F.lit(" "), text(s["cy"]), F.lit(')"')) if kind == "rotrect" else F.lit("")
    size = [F.greatest(s["w"], F.lit(0)), F.greatest(s["h"], F.lit(0))]
    return F.concat(F.lit('<rect x="'), text(s["cx"] - half(s["w"])), F.lit('" y="'), text(s["cy"] - half(s["h"])), F.lit('" width="'), text(size[0]), F.lit('" height="'), text(size[1]), F.lit('" fill="'), fill, F.lit('"'), opacity, corner, turn, F.lit("/>"))


def to_svg(df: DataFrame, codec: Codec, hash_: str = "hash", base: int = 256, aspect: float | None = None, blur: float = 0.0, corner_radius: float = 0.0, out: str = "svg") -> DataFrame:
    """``df`` with the SVG text of its hashes; frequency hashes have none (``ValueError``)."""
    keep = df.columns
    d = parse(df, codec, hash_, base, aspect)
    text = lambda v: v.cast("string")
    if codec.shape == "pixel":
        grid = F.lit(codec.grid_aspect) if codec.grid_aspect is not None else F.col("_quant")
        g = quant.pixel_grid(codec.n_shapes, grid)
        d = d.withColumn("_g", g).withColumns({"_gw": F.col("_g.gw"), "_gh": F.col("_g.gh")}).drop("_g")
        edge = lambda i, size, n: i * size / n

        def cell(s: Column, i: Column) -> Column:
            gx, gy, num = i % F.col("_gw"), F.floor(i / F.col("_gw")), color.number_text
            x, y = edge(gx, F.col("_w"), F.col("_gw")), edge(gy, F.col("_h"), F.col("_gh"))
            w, h = edge(gx + 1, F.col("_w"), F.col("_gw")) - x, edge(gy + 1, F.col("_h"), F.col("_gh")) - y
            return F.concat(F.lit('<rect x="'), num(x), F.lit('" y="'), num(y), F.lit('" width="'), num(w), F.lit('" height="'), num(h), F.lit('" fill="'), _fill(s["color"]), F.lit('"/>'))

        body = F.array_join(F.transform("_shapes", cell), "")
    else:
        under = F.concat(F.lit('<path fill="'), _fill(F.col("_bg")), F.lit('" d="M0 0h'), text(F.col("_w")), F.lit("v"), text(F.col("_h")), F.lit('H0z"/>'))
        body = F.concat(under, F.array_join(F.transform("_shapes", lambda s: element(codec.shape, s, corner_radius)), ""))
    if blur > 0:
        body = F.concat(F.lit('<filter id="b" x="0" y="0" width="100%" height="100%" primitiveUnits="userSpaceOnUse"><feGaussianBlur stdDeviation="'), color.number_text(F.lit(blur)), F.lit('"/></filter><g filter="url(#b)">'), body, F.lit("</g>"))
    svg = F.concat(F.lit('<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 '), text(F.col("_w")), F.lit(" "), text(F.col("_h")), F.lit('">'), body, F.lit("</svg>"))
    return d.select(*keep, svg.alias(out))


def stretched(svg: Column) -> Column:
    """An SVG that fills its box whatever its shape."""
    return F.regexp_replace(svg, "^<svg ", '<svg preserveAspectRatio="none" ')


def encode_cells(pixels: DataFrame, codec: Codec, key: str = "vec_id") -> DataFrame:
    """(key, hash) of pictures given as pixel rows (key, y, x, r, g, b): mean colours of a grid's cells.

    One aggregation by picture and cell, one by picture; a picture of any size only ever
    gives its cells to the second.
    """
    size = pixels.groupBy(key).agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))
    grid = F.lit(codec.grid_aspect) if codec.grid_aspect is not None else quant.aspect_of_code(quant.aspect_code(F.col("w"), F.col("h")))
    size = size.withColumn("g", quant.pixel_grid(codec.n_shapes, grid)).select(key, "w", "h", "g.gw", "g.gh")
    cells = size.select("*", F.explode(F.sequence(F.lit(0), F.lit(codec.n_shapes - 1))).alias("cell"))
    gx, gy = F.col("cell") % F.col("gw"), F.floor(F.col("cell") / F.col("gw"))
    bound = lambda g, n, edge: F.round(g * F.col(edge) / F.col(n)).cast("int")
    cells = cells.withColumns({"x0": bound(gx, "gw", "w"), "x1": bound(gx + 1, "gw", "w"), "y0": bound(gy, "gh", "h"), "y1": bound(gy + 1, "gh", "h")})
    cells = cells.withColumns({"x1": F.least(F.greatest("x1", F.col("x0") + 1), F.col("w")), "y1": F.least(F.greatest("y1", F.col("y0") + 1), F.col("h"))})
    p = pixels.select(F.col(key).alias("_key"), "y", "x", *(color.linear(F.col(c)).alias(c) for c in "rgb"))
    within = (F.col(key) == F.col("_key")) & (F.col("x") >= F.col("x0")) & (F.col("x") < F.col("x1")) & (F.col("y") >= F.col("y0")) & (F.col("y") < F.col("y1"))
    # means are rounded so that the order of a sum can't move a colour across a code's edge
    means = cells.join(p, within, "left").groupBy(key, "w", "h", "cell").agg(*(F.round(F.coalesce(F.avg(c), F.lit(0.0)), 9).alias(c) for c in "rgb"))
    if codec.palette is not None:
        from ..palettes import nearest

        code = bits.bits_of(nearest(linear_array(codec.palette, codec.colors), F.col("r"), F.col("g"), F.col("b")), codec.palette_bits)
        n = codec.palette_bits
    else:
        u8 = [color.srgb_u8(F.col(c)) for c in "rgb"]
        n = codec.color_bits
        code = bits.bits_of(color.rgb565(*u8), 16) if n == 16 else F.concat(*(bits.bits_of(u, 8) for u in u8))
    body = means.withColumn("code", F.substring(code, 1, n)).groupBy(key, "w", "h").agg(F.array_sort(F.collect_list(F.struct("cell", "code"))).alias("codes"))
    stream = F.concat(F.substring(bits.bits_of(quant.aspect_code(F.col("w"), F.col("h")), 8), 1, 8), F.array_join(F.transform("codes", lambda c: c["code"]), ""))
    return body.select(key, bits.to_hex(stream).alias("hash"))
