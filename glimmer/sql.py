"""The operators as SQL functions: ``register`` makes them known to a session.

A codec is its JSON text, as ``codec_to_json`` writes it.

* ``ph_encode(w, h, r, g, b, codec)``: the hash (hex) of flat byte arrays; null where they don't fit.
* ``ph_decode(hash, codec, base)``: a struct of w, h and the flat arrays r, g, b.
* ``ph_shapes(hash, codec, base)`` and ``ph_symbols(hash, codec)``: table functions, a row for
  each shape (idx, field, value) and for each coded number (field, pos, sym); none where the codec is
  none, or the hash is no hex or too short.

Frequency hashes, and SVG, are columns of ``operators.dct`` and ``operators.images`` only:
SQL functions give null for them.  The table functions are for looking into single
hashes; ``operators.shapes`` is for tables of them.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf, udtf

from .codec import SCHEMA, Codec
from .operators import fit, images
from .operators.kernel import LINEAR, Forms, fields


def codec_to_json(codec: Codec) -> str:
    """A codec as JSON: all fields in order, the palette as a list of #rrggbb."""
    value = {f.name: getattr(codec, f.name) for f in SCHEMA}
    if codec.palette is not None:
        value["palette"] = [f"#{codec.palette[i : i + 6].lower()}" for i in range(0, len(codec.palette), 6)]
    value["alpha_levels"] = None if codec.alpha_levels is None else list(codec.alpha_levels)
    return json.dumps({k: v for k, v in value.items() if v is not None}, separators=(",", ":"))


@lru_cache(maxsize=1024)
def codec_from_json(text: str) -> Codec:
    """The codec that JSON text describes; ``ValueError`` where it is none."""
    value = json.loads(text)
    if not isinstance(value, dict) or set(value) - {f.name for f in SCHEMA}:
        raise ValueError("not a codec")
    if isinstance(value.get("palette"), list):
        value["palette"] = "".join(c.removeprefix("#") for c in value["palette"])
    if value.get("alpha_levels") is not None:
        value["alpha_levels"] = tuple(value["alpha_levels"])
    return Codec(**{k: v for k, v in value.items() if v is not None})


def codec_column_to_json(codec: Column) -> Column:
    """The same of a codec column, inside the engine."""
    colors = F.transform(F.sequence(F.lit(0), (F.length(codec["palette"]) / 6).cast("int") - 1), lambda i: F.concat(F.lit("#"), F.lower(F.substring(codec["palette"], i * 6 + 1, F.lit(6)))))
    return F.to_json(F.struct(*(F.when(codec["palette"].isNotNull(), colors).alias("palette") if f.name == "palette" else codec[f.name].alias(f.name) for f in SCHEMA)))


def _groups(codecs: pa.Array) -> dict[Codec, list[int]]:
    """The rows of each codec of a batch; rows without a valid one are left out."""
    out: dict[Codec, list[int]] = {}
    for i, text in enumerate(codecs.to_pylist()):
        try:
            out.setdefault(codec_from_json(text), []).append(i)
        except (ValueError, TypeError, AttributeError):
            continue
    return out


def _encode(w: pa.Array, h: pa.Array, r: pa.Array, g: pa.Array, b: pa.Array, codec: pa.Array) -> pa.Array:
    planes, ws, hs = fit.sized(pa.RecordBatch.from_arrays([w, h, r, g, b], names=list("whrgb")), 0)
    out: list[str | None] = [None] * len(w)
    wanted = {i: c for c, rows in _groups(codec).items() for i in rows}
    for (wide, tall), rows in fit.by_size(planes, ws, hs).items():
        for one in dict.fromkeys(wanted[i] for i in rows if i in wanted):
            some = [i for i in rows if wanted.get(i) == one]
            light = LINEAR[np.stack([np.stack([planes[k][i] for k in range(3)], axis=-1) for i in some]).reshape(len(some), tall, wide, 3)]
            if one.shape == "dct":
                continue  # needs the columns of operators.dct
            found = images._cells(light, one) if one.shape == "pixel" else fit._Search(light, one, fit.defaults(one.shape)).run(0)[0]
            for i, text in zip(some, found, strict=True):
                out[i] = text
    return pa.array(out, type=pa.string())


_PICTURE = "w int, h int, r array<smallint>, g array<smallint>, b array<smallint>"


def _decode(hashes: pa.Array, codec: pa.Array, base: pa.Array) -> pa.Array:
    texts, edges = hashes.to_pylist(), base.to_pylist()
    out: list[dict | None] = [None] * len(texts)
    for one, rows in _groups(codec).items():
        total = _total(one)
        for i in rows:
            try:
                raw = bytes.fromhex(texts[i])
            except (ValueError, TypeError):
                continue
            if one.shape == "dct" or len(raw) < total or not edges[i] or edges[i] < 1:
                continue
            aspect = float(2.0 ** (raw[0] / 254 * 6 - 3))
            w, h = images._size(aspect, edges[i])
            drawn = images._Drawn(one, w, h).run(images._bits([texts[i]], total), aspect)[0]
            if drawn.min() >= 0:
                out[i] = {"w": w, "h": h, **{c: drawn[..., k].reshape(-1) for k, c in enumerate("rgb")}}
    kind = pa.struct([("w", pa.int32()), ("h", pa.int32()), *((c, pa.list_(pa.int16())) for c in "rgb")])
    return pa.array(out, type=kind)


def _total(codec: Codec) -> int:
    """Bytes of a hash of shapes or cells."""
    per = codec.color_field if codec.shape == "pixel" else sum(b for _, b in fields(codec)) + codec.color_field + codec.alpha_bits
    return -(-(8 + (codec.shape != "pixel") * codec.color_field + codec.n_shapes * per) // 8)


def _read(text: str, codec: Codec) -> list[list[tuple[str, int, int]]]:
    """The coded numbers (field, bits, value) of each shape; bits past the end are zero."""
    bits = images._bits([text], _total(codec))
    layout = [] if codec.shape == "pixel" else fields(codec)
    layout = layout + [("color", codec.color_field)] + ([("alpha", codec.alpha_bits)] if codec.shape != "pixel" else [])
    at, out = 8 + (codec.shape != "pixel") * codec.color_field, []
    for _ in range(codec.n_shapes):
        one = []
        for name, n in layout:
            one.append((name, n, int((bits[0, at : at + n].astype(np.int64) << np.arange(n)).sum())))
            at += n
        out.append(one)
    return out


def _good(text: str | None, codec: str | None) -> Codec | None:
    """The codec of a row whose hash is of shapes or cells, hexadecimal and long enough; else None."""
    try:
        one = codec_from_json(codec)
        return one if one.shape != "dct" and len(bytes.fromhex(text)) >= _total(one) else None
    except (ValueError, TypeError, AttributeError):
        return None


@udtf(returnType="idx int, field string, value double")
class _Shapes:
    def eval(self, text: str, codec: str, base: int):
        """The drawn fields of each shape on a canvas whose long edge is ``base``."""
        one = _good(text, codec)
        if one is None or one.shape == "pixel" or not base or base < 1:
            return
        w, h = images._size(float(2.0 ** (int(text[:2], 16) / 254 * 6 - 3)), base)
        forms = Forms(one, w, h)
        for idx, numbers in enumerate(_read(text, one)):
            for (name, _, value), table in zip(numbers, forms.tables, strict=False):
                yield idx, name, float(table[value])
            yield idx, "alpha", float(one.levels[min(numbers[-1][2], len(one.levels) - 1)])


@udtf(returnType="field string, pos int, sym int")
class _Symbols:
    def eval(self, text: str, codec: str):
        """Every coded number of a hash."""
        one = _good(text, codec)
        if one is None:
            return
        for pos, numbers in enumerate(_read(text, one)):
            for name, bits, value in numbers:
                if bits:
                    yield name, pos, value


def register(spark: SparkSession) -> None:
    """Makes the functions known to a session."""

    @arrow_udf("string")
    def encode(w: pa.Array, h: pa.Array, r: pa.Array, g: pa.Array, b: pa.Array, codec: pa.Array) -> pa.Array:
        return _encode(w, h, r, g, b, codec)

    @arrow_udf(_PICTURE)
    def decode(hashes: pa.Array, codec: pa.Array, base: pa.Array) -> pa.Array:
        return _decode(hashes, codec, base)

    spark.udf.register("ph_encode", encode)
    spark.udf.register("ph_decode", decode)
    spark.udtf.register("ph_shapes", _Shapes)
    spark.udtf.register("ph_symbols", _Symbols)
