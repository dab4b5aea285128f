"""Hashes and benchmark rows as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.bits import clean_hex

#: Benchmark lines; sizes may be numbers or words, so they are read as text.
BENCH = "impl string, mode string, op string, w int, h int, median_us double, p95_us double, min_us double, iters int, mpix_per_s double, hash_bytes int, base_size string"
#: Rate-distortion rows.
RD = "image string, method string, bytes int, psnr double, ssim double, lpips double, dists double"


def read_bench(spark: SparkSession, *paths: str) -> DataFrame:
    """Lines of JSON that begin with a brace, of several files; others and blanks are skipped."""
    lines = spark.read.text(list(paths)).where(F.trim("value").startswith("{"))
    return lines.select(F.from_json("value", BENCH, {"mode": "PERMISSIVE"}).alias("r")).where("r.impl is not null").select("r.*")


def read_rd(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RD).option("header", "true").csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "true").csv(path)


def read_hashes(spark: SparkSession, path: str, form: str = "hex") -> DataFrame:
    """(path, hash) of files of hashes, raw or hex; broken hex has a null hash."""
    files = spark.read.format("binaryFile").load(path)
    text = F.lower(F.hex("content")) if form == "raw" else clean_hex(F.col("content").cast("string"))
    return files.select("path", text.alias("hash"))


def write_hashes(df: DataFrame, path: str, hash_: str = "hash") -> None:
    """One hash a line, in lower-case hex."""
    df.select(F.lower(hash_)).write.mode("overwrite").text(path)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(name, input, codec, expected_hex) of a JSON file of test vectors, a row each."""
    d = spark.read.option("multiLine", "true").json(path)
    return d.select(F.explode("vectors").alias("v")).select("v.*")
