"""The corpus pipeline: documents in, token digests out.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept, and
is written as Parquet before the next one reads it.  All stages but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glimmer.llm.bpe import DEFAULT_FILE, Vocabulary, encode_decode_digests
from glimmer.llm.linededup import deduplicate_lines
from glimmer.llm.minhash import deduplicate
from glimmer.llm.mixing import mix
from glimmer.llm.quality import fit, grades_of, select
from glimmer.llm.workspace import Workspace

#: No SQL: stages are trained, or iterate.  tests/llm/test_pipeline.py checks them instead.
ORACLE_SQL: str | None = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal classifier, fitted on the labels of ``docs``, doesn't reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return select(docs, fit(docs, grades_of(labels)))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier one is like; ``n_chars`` counts what is left.

    A document stays even if no line of it does, until :func:`mixing`.
    """
    return deduplicate_lines(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, similarity 0.8)."""
    return deduplicate(docs)


def filled(docs: DataFrame, original: DataFrame) -> DataFrame:
    """``docs`` without those that line dedup left no word; what had none in ``original`` stays."""
    bare = ~F.coalesce(F.col("text").rlike("[^\\x20\\x09-\\x0D]"), F.lit(False))
    as_read = original.where(bare).select(F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_copy")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_copy"))
    return docs.where(~bare).unionByName(docs.where(bare).join(as_read, same, "left_semi"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated so that all sources weigh the same, in global random order.

    Documents whose lines are all copies of earlier ones neither count nor come out.
    """
    docs = filled(docs, spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return mix(docs).select(*docs.columns)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every row."""
    out = encode_decode_digests(docs, Vocabulary.load(DEFAULT_FILE()))
    return out.select("doc_id", "source", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [("quality classifier", quality), ("line dedup", line_dedup), ("MinHash near-dedup", near_dedup), ("mixing", mixing), ("BPE", bpe)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is written to the shared folder."""
    ws = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = ws.keep(docs, f"{k}-{name.replace(' ', '-')}")
    return docs
