"""Mixing sources to target weights by Poisson replication (DataFrame functions only).

A source with target weight w and n of the N documents repeats each of its documents
w * total / n times on average.  A document's number of copies is the inverse of that
Poisson distribution at a number in [0, 1) that a seeded hash of the document gives; so
it depends neither on partitions nor on order, and a lost task gives the same copies
again.  Means above 16 are split into equal parts with a draw each, because the sum of
Poisson numbers is one.  All copies are then shuffled by a hash of document and copy.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import free, named, numbered

#: Largest mean of one draw.
PART = 16
#: Copies of one draw at most; beyond it lies less than 1e-30 of a Poisson distribution of mean 16.
TERMS = 80
#: Sources whose rates are broadcast; with more of them Spark chooses the join.
BROADCAST_SOURCES = 10_000


def _draw(*parts: Column) -> Column:
    """A number in [0, 1) with 52 bits, from a hash of the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def rates(docs: DataFrame, source: str, weights: dict[str | None, float] | None, total: int | None) -> DataFrame:
    """(_mix_source, _mix_parts, _mix_cdf) of every source that is to be repeated at all."""
    counts = docs.groupBy(F.col(f"`{source}`").alias("_mix_source")).agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        weighed = counts.withColumn("w", F.lit(1.0))
    else:
        w = F.lit(0.0)
        for name, value in weights.items():
            w = F.when(F.col("_mix_source").eqNullSafe(F.lit(name)), F.lit(float(value))).otherwise(w)
        weighed = counts.withColumn("w", w)
    all_rows, all_weights = weighed.agg(F.sum("n"), F.sum("w")).first()
    if not all_rows or not all_weights:
        return weighed.where(F.lit(False)).select("_mix_source", F.lit(1).alias("_mix_parts"), F.array(F.lit(1.0)).alias("_mix_cdf"))
    mean = F.col("w") / F.lit(all_weights) * F.lit(float(all_rows if total is None else total)) / F.col("n")
    split = weighed.where("w > 0").withColumn("mean", mean).withColumn("_mix_parts", F.greatest(F.lit(1), F.ceil(F.col("mean") / PART)).cast("int"))
    one = F.col("mean") / F.col("_mix_parts")
    start = F.struct(F.exp(-one).alias("p"), F.array(F.exp(-one)).alias("c"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * one / k
        return F.struct(p.alias("p"), F.array_append(acc["c"], F.element_at(acc["c"], -1) + p).alias("c"))

    return split.select("_mix_source", "_mix_parts", F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), start, step, lambda acc: acc["c"]).alias("_mix_cdf"))


def mix(df: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", weights: dict[str | None, float] | None = None, total: int | None = None, seed: int = 9) -> DataFrame:
    """The rows of ``df`` repeated to the target weights, with ``_copy`` (from 1) and ``_shuffle``, in global random order.

    ``weights`` maps sources to weights; without it all sources weigh the same, and sources
    it doesn't name weigh nothing.  ``total`` is the expected number of rows out, as many
    as come in by default.  A null source is a source like others.  Rows without an id are
    drawn by their text.  Rows that repeat id (or text) get the same number of copies each.
    Other columns of any name stay; where ``_copy`` or ``_shuffle`` is one, ours has a
    further underscore.
    """
    mine, kind, words = (F.col(f"_in_{df.columns.index(c)}") for c in (doc_id, source, text))
    who = F.coalesce(mine.cast("string"), F.concat(F.lit("text "), F.md5(F.coalesce(words, F.lit("")))))
    per_source = rates(df, source, weights, total)
    if per_source.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        per_source = F.broadcast(per_source)
    joined = numbered(df).join(per_source, kind.eqNullSafe(F.col("_mix_source"))).withColumn("_mix_who", who)

    def of_draw(j: Column) -> Column:
        return F.struct(_draw(F.lit(str(seed)), F.col("_mix_who"), j.cast("string")).alias("u"))

    draws = F.transform(F.sequence(F.lit(1), F.col("_mix_parts")), of_draw)
    n = F.aggregate(draws, F.lit(0), lambda acc, d: acc + F.size(F.filter("_mix_cdf", lambda c: c <= d["u"])))
    copies = joined.withColumn("_mix_n", n).where("_mix_n > 0").select("*", F.explode(F.sequence(F.lit(1), F.col("_mix_n"))).alias("_copy"))
    key = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(f"{seed} shuffle"), "_mix_who", F.col("_copy").cast("string"))), 1, 13), 16, 10).cast("long")
    shuffled = copies.withColumn("_shuffle", key).repartition(F.col("_shuffle")).sortWithinPartitions("_shuffle")
    return named(shuffled, df.columns, F.col("_copy").alias(free(df, "_copy")), F.col("_shuffle").alias(free(df, "_shuffle")))


#: The same for equal weights and the default total, in DuckDB's dialect.
ORACLE = f"""
WITH c AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
r AS (SELECT source, (sum(n) OVER ())::DOUBLE / (count(*) OVER ()) / n AS mean FROM c),
p AS (SELECT source, mean, greatest(1, ceil(mean / {PART}))::INT AS parts FROM r),
cdf AS (
  SELECT source, sum(exp(k * ln(mean / parts) - mean / parts - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS c
  FROM p, (SELECT unnest(range(0, {TERMS + 1})) AS k)
),
d AS (SELECT row_number() OVER () AS row_id, doc_id, source, text, coalesce(doc_id::VARCHAR, 'text ' || md5(coalesce(text, ''))) AS who FROM documents),
u AS (
  SELECT row_id, d.source, ('0x' || left(md5('9:' || who || ':' || j), 13))::BIGINT / {1 << 52}.0::DOUBLE AS u
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source, LATERAL (SELECT unnest(range(1, parts + 1)) AS j)
),
k AS (SELECT row_id, count(c) AS n FROM u LEFT JOIN cdf ON u.source IS NOT DISTINCT FROM cdf.source AND c <= u GROUP BY row_id),
e AS (SELECT d.doc_id, d.source, d.text, d.who, unnest(range(1, n + 1))::INT AS copy FROM k JOIN d USING (row_id) WHERE n > 0)
SELECT doc_id, copy, source, ('0x' || left(md5('9 shuffle:' || who || ':' || copy), 13))::BIGINT AS shuffle_key, text FROM e
"""
