"""Meshes of the pictures at every rate point (no SQL: triangulated and searched, tests hold their parts)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import analytics as A
from ..operators import mesh
from ..registry import query
from .fixtures import pictures, six

#: Pixels along an edge of the pictures that meshes are fitted to.
EDGE = 24


@query("mesh_curve")
def mesh_curve(spark, sf):
    """Bytes and quality of every picture's mesh at every rate point."""
    d = mesh.curve(pictures(spark, sf, EDGE))
    return d.select("vec_id", "grid", "vertices", "colors", "bytes", six(F.col("psnr")).alias("psnr"))


@query("mesh_means")
def mesh_means(spark, sf):
    """Mean size and quality of all pictures at every rate point."""
    d = A.means(mesh.curve(pictures(spark, sf, EDGE)), ["grid", "vertices", "colors"], ["bytes", "psnr"])
    return d.select("grid", "vertices", "colors", *(six(F.col(c)).alias(c) for c in ("bytes", "psnr")), "n")
