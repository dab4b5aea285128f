"""Joins, ranks and comparisons of benchmark and rate-distortion rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_of(df: DataFrame, keys: list[str], order: Column, value: str) -> DataFrame:
    """One row a key: the value of the last row in order."""
    return df.groupBy(*keys).agg(F.max_by(value, order).alias(value))


def percentile_by_counts(df: DataFrame, keys: list[str], value: str, p: float) -> DataFrame:
    """The value at place int(n p) of each key's sorted values, without interpolation; p = 0.5 is the upper median.

    Values are counted first, so that a hot key is spread over its distinct values; the
    place is then found by a running count.
    """
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    totals = counts.groupBy(*keys).agg(F.sum("_n").alias("_all"))
    w = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    placed = counts.withColumn("_upto", F.sum("_n").over(w)).join(totals, keys)
    return placed.where(F.col("_upto") > F.floor(F.col("_all") * p)).groupBy(*keys).agg(F.min(value).alias(value))


def against_first(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """``df`` with ``base``, the value of the key's first row by ``order``, and the change against it in percent."""
    base = df.groupBy(*keys).agg(F.min_by(value, order).alias("base"))
    out = df.join(base, keys)
    return out.withColumn("change", F.when(F.col("base") != 0, (F.col(value) / F.col("base") - 1) * 100))


def frontier(df: DataFrame, cost: str, gain: str, keys: list[str]) -> DataFrame:
    """Rows that no cheaper or equally cheap row of their key beats in gain."""
    best = df.groupBy(*keys, cost).agg(F.max(gain).alias(gain))
    w = Window.partitionBy(*keys).orderBy(cost).rowsBetween(Window.unboundedPreceding, -1)
    return best.withColumn("_before", F.max(gain).over(w)).where(F.col("_before").isNull() | (F.col(gain) > F.col("_before"))).drop("_before")


def symbol_costs(train: DataFrame, test: DataFrame, alphabet: DataFrame) -> DataFrame:
    """(field, bits, n): cost in bits of coding ``test`` (field, sym) with a model of ``train``, one added to each count.

    ``alphabet`` has all (field, sym).
    """
    counts = alphabet.join(train.groupBy("field", "sym").agg(F.count(F.lit(1)).alias("c")), ["field", "sym"], "left").withColumn("c", F.coalesce("c", F.lit(0)) + 1)
    totals = counts.groupBy("field").agg(F.sum("c").alias("t"))
    cost = counts.join(totals, "field").select("field", "sym", (-F.log2(F.col("c") / F.col("t"))).alias("bits"))
    seen = test.groupBy("field", "sym").agg(F.count(F.lit(1)).alias("n"))
    return seen.join(cost, ["field", "sym"]).groupBy("field").agg(F.sum(F.col("bits") * F.col("n")).alias("bits"), F.sum("n").alias("n"))


def base_label(label: Column) -> Column:
    """A run's label without what tells timed from counted runs."""
    return F.regexp_replace(label, "-(timed|counts)$", "")


def family(method: Column) -> Column:
    """A method's name without its size; photographic formats by their first word."""
    return F.when(method.rlike("^(jpeg|webp)"), F.regexp_extract(method, "^([^-]*)", 1)).otherwise(F.regexp_replace(method, "-?[0-9.]+$", ""))


def _fixed(x: Column, digits: int, even: bool) -> Column:
    """``x`` (not negative) with so many decimals, rounded by its exact binary value; exact halves to even or up."""
    scale = 10.0**digits
    below = F.floor(x * scale).cast("double")
    # both parts have few enough bits for exact products
    coarse = x.cast("float").cast("double")
    above_half = (coarse * (2 * scale) - (2 * below + 1)) + (x - coarse) * (2 * scale)
    up = (above_half > 0) | ((above_half == 0) & (F.lit(True) if not even else below % 2 == 1))
    return F.format_string(f"%.{digits}f", (below + up.cast("int")) / scale)


def duration_text(us: Column) -> Column:
    """Microseconds below a thousand, else milliseconds."""
    return F.when(us < 1000, F.concat(_fixed(us, 1, True), F.lit(" us"))).otherwise(F.concat(_fixed(us / 1000, 2, True), F.lit(" ms")))


def markdown(df: DataFrame, columns: list[str]) -> DataFrame:
    """(line): rows as lines of a Markdown table, to be written as text."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))


def milliseconds_text(ms: Column, even: bool = False) -> Column:
    """Milliseconds in three significant digits or so, exact halves up or to even; a dash for none."""
    text = F.concat(F.when(ms >= 100, _fixed(ms, 0, even)).when(ms >= 10, _fixed(ms, 1, even)).otherwise(_fixed(ms, 2, even)), F.lit(" ms"))
    return F.when(ms.isNull() | F.isnan(ms) | (ms == 0) | (F.abs(ms) == float("inf")), "—").otherwise(text)


def overview(df: DataFrame, keys: list[str], encode: str, decode: str, size: str) -> DataFrame:
    """(keys, n, encode, decode, sizes, fastest, smallest): mean times, the sizes as text, the least time and size."""
    d = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(encode).alias("encode"), F.avg(decode).alias("decode"),
        F.min(encode).alias("fastest"), F.min(size).alias("smallest"), F.max(size).alias("_most"),
    )
    one = F.concat(F.col("smallest").cast("string"), F.lit(" B"))
    several = F.concat_ws("–", F.col("smallest").cast("string"), F.concat(F.col("_most").cast("string"), F.lit(" B")))
    return d.withColumn("sizes", F.when(F.col("smallest") == F.col("_most"), one).otherwise(several)).drop("_most")


def means(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """(keys, values, n): means of a rate point's rows."""
    return df.groupBy(*keys).agg(*(F.avg(v).alias(v) for v in values), F.count(F.lit(1)).alias("n"))
