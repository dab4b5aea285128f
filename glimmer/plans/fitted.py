"""Fitted shapes, parsed hashes and effects over the pictures of embeddings (no SQL: iterative, or checked by published vectors)."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..codec import of, presets
from ..operators import fit, shapes
from ..registry import query
from .fixtures import pictures, pixels
from .pictures import dct_encode, pixel_encode

#: Shapes a hash has in these queries: those of the small presets.
SHAPES = presets()["small_circle"][0].n_shapes


def _fitted(kind: str):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return fit.fit(pixels(spark, sf), of(kind, SHAPES)).select("vec_id", "hash", F.round("sse", 6).alias("sse"))

    return run


for _kind in ("circle", "triangle", "square", "rect", "rotrect"):
    query(f"fit_{_kind}")(_fitted(_kind))


def _searched(kind: str, strategy: str):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        options = replace(fit.defaults(kind), strategy=strategy, n_topk=4)
        return fit.fitted(pictures(spark, sf), of(kind, SHAPES), options=options).select("vec_id", "hash", F.round("sse", 6).alias("sse"))

    return run


for _kind in ("circle", "triangle"):
    query(f"fit_{_kind}_walk")(_searched(_kind, "primitive"))
    query(f"fit_{_kind}_uniform")(_searched(_kind, "topk-uniform"))


@query("fit_weighted")
def fit_weighted(spark, sf):
    """Circles fitted where edges weigh up to three times as much."""
    d = fit.fitted(pictures(spark, sf), of("circle", SHAPES), cue="edge", strength=2.0)
    return d.select("vec_id", "hash", F.round("sse", 6).alias("sse"))


@query("shape_rows")
def shape_rows(spark, sf):
    """Parsed shapes of the fitted circles."""
    d = _fitted("circle")(spark, sf).select("vec_id", "hash")
    return shapes.shape_rows(d, of("circle", SHAPES), base=48).select("vec_id", "idx", "cx", "cy", "w", F.round("alpha", 6).alias("alpha"))


@query("hash_symbols")
def hash_symbols(spark, sf):
    """Coded numbers of the pixel hashes."""
    return shapes.symbols(pixel_encode(spark, sf), of("pixel", 16)).select("vec_id", "field", "pos", "sym")


@query("hash_sizes")
def hash_sizes(spark, sf):
    """How many frequency hashes have each length."""
    return dct_encode(spark, sf).groupBy((F.length("hash") / 2).cast("int").alias("bytes")).agg(F.count(F.lit(1)).alias("n"))
