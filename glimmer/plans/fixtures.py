"""Images and shapes derived from the driver's tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rows import computed


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Pictures that a task works on at most, or nearly so.
ROWS = 4096


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt evenly over all cores, some ROWS to a task; work a row is far more than moving it.

    Partitions of a read say little about rows: a file of one group of rows is cut into several, of which one holds all.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores * max(1, -(-df.count() // (cores * ROWS))))


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, u): every embedding as the 64 bytes of an 8 x 8 picture, by its own minimum and maximum."""
    e = spread(table(spark, sf_dir, "embeddings").where("embedding is not null").select("vec_id", F.col("embedding").cast("array<double>").alias("v")))
    e = e.withColumns({"lo": F.array_min("v"), "hi": F.array_max("v")})
    byte = lambda x: F.when(F.col("hi") == F.col("lo"), 0).otherwise(F.floor((x - F.col("lo")) * 255 / (F.col("hi") - F.col("lo")))).cast("int")
    return e.select("vec_id", F.transform("v", byte).alias("u"))


def pictures(spark: SparkSession, sf_dir: str, edge: int = 8) -> DataFrame:
    """(vec_id, w, h, r, g, b): :func:`images` with three channels, each pixel repeated to an edge of ``edge``."""
    d = images(spark, sf_dir)
    at = [i // edge * 8 // edge * 8 + i % edge * 8 // edge for i in range(edge * edge)]
    place = lambda k: F.transform(F.array(*(F.lit((i + k) % 64 + 1) for i in at)), lambda i: F.element_at("u", i))
    return computed(d, r=place(0), g=place(21), b=place(42)).select("vec_id", F.lit(edge).alias("w"), F.lit(edge).alias("h"), "r", "g", "b")


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, y, x, r, g, b) of :func:`images`; green and blue are the bytes 21 and 42 further on."""
    at = images(spark, sf_dir).select("vec_id", "u", F.posexplode("u").alias("i", "r"))
    other = lambda k: F.element_at("u", F.pmod(F.col("i") + k, F.lit(64)) + 1)
    return at.select("vec_id", (F.col("i") / 8).cast("int").alias("y"), F.pmod("i", F.lit(8)).alias("x"), "r", other(21).alias("g"), other(42).alias("b"))


#: The same in SQL, as common table expressions ``img`` and ``px``.
IMAGES = """
e AS (SELECT vec_id, list_transform(embedding, lambda v: v::DOUBLE) AS v FROM embeddings WHERE embedding IS NOT NULL),
m AS (SELECT vec_id, v, list_min(v) AS lo, list_max(v) AS hi FROM e),
img AS (SELECT vec_id, list_transform(v, lambda x: CASE WHEN hi = lo THEN 0 ELSE floor((x - lo) * 255 / (hi - lo))::INT END) AS u FROM m),
px AS (SELECT vec_id, (i // 8)::INT AS y, (i % 8)::INT AS x, u[i + 1] AS r, u[(i + 21) % 64 + 1] AS g, u[(i + 42) % 64 + 1] AS b
       FROM img, (SELECT unnest(range(64)) AS i))
"""

#: sRGB byte to linear light, and back, in SQL.
LINEAR = "CASE WHEN {0} / 255.0::DOUBLE <= 0.04045 THEN {0} / 255.0::DOUBLE / 12.92 ELSE pow(({0} / 255.0::DOUBLE + 0.055) / 1.055, 2.4) END"
CLAMPED = "least(greatest({0}, 0.0::DOUBLE), 1.0::DOUBLE)"
BYTE = "floor((CASE WHEN " + CLAMPED + " <= 0.0031308 THEN " + CLAMPED + " * 12.92 ELSE pow(" + CLAMPED + ", 1 / 2.4::DOUBLE) * 1.055 - 0.055 END) * 255 + 0.5)::INT"


def six(x: Column) -> Column:
    """Rounded to six decimals, without negative zeros."""
    return F.round(x, 6) + F.lit(0.0)


def rows_of(df: DataFrame, *keys: str) -> DataFrame:
    """A row for each pixel of pictures in arrays: the keys, y, x, r, g, b."""
    d = df.select(*keys, "w", F.posexplode(F.arrays_zip("r", "g", "b")).alias("i", "p"))
    return d.select(*keys, F.floor(F.col("i") / F.col("w")).cast("int").alias("y"), (F.col("i") % F.col("w")).cast("int").alias("x"), *(F.col(f"p.{c}").cast("int").alias(c) for c in "rgb"))


def of_parts(spark: SparkSession, sf_dir: str, known: DataFrame, names: list, by: str = "name") -> DataFrame:
    """(p_partkey, ``by``, idx, r, g, b): one colour for each part, of the palette and place that its key gives.

    ``known`` (``by``, idx, r, g, b) holds the colours of ``names``, at most a few hundred rows.
    """
    key, n = F.col("p_partkey"), len(names)
    parts = table(spark, sf_dir, "part").select("p_partkey", F.element_at(F.array(*map(F.lit, names)), (key % n + 1).cast("int")).alias(by), F.floor(key / n).alias("place"))
    listed = known.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("idx", "r", "g", "b"))).alias("colors"))
    one = F.element_at("colors", (F.col("place") % F.size("colors") + 1).cast("int")).alias("one")
    return parts.join(F.broadcast(listed), by).select("p_partkey", by, one).select("p_partkey", by, "one.*")


def named_colors(palettes: dict[str, str]) -> str:
    """SQL of table t (name, idx, r, g, b) from palettes of hex colours a space apart."""
    values = ", ".join(f"('{n}', '{c}')" for n, c in palettes.items())
    return f"""p(name, colors) AS (VALUES {values}), c AS (SELECT name, string_split(colors, ' ') AS l FROM p), i AS (SELECT name, l, unnest(range(len(l)))::INT AS idx FROM c),
    t AS (SELECT name, idx, ('0x' || l[idx + 1][1:2])::INT AS r, ('0x' || l[idx + 1][3:4])::INT AS g, ('0x' || l[idx + 1][5:6])::INT AS b FROM i)"""


def of_parts_sql(names: list, by: str = "name") -> str:
    """What :func:`of_parts` gives, from a table t (``by``, idx, r, g, b)."""
    return f"""m AS (SELECT {by}, count(*) AS size FROM t GROUP BY {by}), q AS (SELECT p_partkey, {names!r}[(p_partkey % {len(names)} + 1)::INT] AS {by}, p_partkey // {len(names)} AS place FROM part)
    SELECT p_partkey, q.{by}, idx, r, g, b FROM q JOIN m USING ({by}) JOIN t ON t.{by} = q.{by} AND idx = place % size"""
