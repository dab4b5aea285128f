"""Benchmark and rate-distortion analytics over events and line items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.bits import clean_hex
from ..functions.rows import computed
from ..operators import analytics as A
from ..operators import render, shapes
from ..registry import query
from .fixtures import six, table

_RUNS = "runs AS (SELECT event_id, event_type AS impl, user_id % 4 AS op, value AS us, event_id % 3 AS part FROM events)"


def runs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", F.col("event_type").alias("impl"), (F.col("user_id") % 4).alias("op"), F.col("value").alias("us"), (F.col("event_id") % 3).alias("part"))


def _last(part: int, name: str) -> str:
    return f"{name} AS (SELECT impl, op, arg_max(us, event_id) AS us FROM runs WHERE part = {part} GROUP BY impl, op)"


@query("bench_join", f"WITH {_RUNS}, {_last(0, 'a')}, {_last(1, 'b')}, {_last(2, 'c')} SELECT impl, op, a.us AS us_a, b.us AS us_b, c.us AS us_c, CASE WHEN b.us <> 0 THEN round(a.us / b.us, 6) END AS ratio FROM a JOIN b USING (impl, op) JOIN c USING (impl, op)")
def bench_join(spark, sf):
    r = runs(spark, sf)
    a, b, c = (A.last_of(r.where(F.col("part") == k), ["impl", "op"], F.col("event_id"), "us").withColumnRenamed("us", f"us_{n}") for k, n in enumerate("abc"))
    return a.join(b, ["impl", "op"]).join(c, ["impl", "op"]).withColumn("ratio", F.when(F.col("us_b") != 0, F.round(F.col("us_a") / F.col("us_b"), 6)))


@query(
    "timed_counts_full_outer",
    f"""WITH {_RUNS}, t AS (SELECT impl, event_id // 50 AS img, arg_max(us, event_id) AS us FROM runs WHERE event_id % 2 = 0 GROUP BY ALL), c AS (SELECT impl, event_id // 50 + 1 AS img, count(*) AS evals FROM runs WHERE event_id % 2 = 1 GROUP BY ALL)
    SELECT coalesce(t.impl, c.impl) AS impl, coalesce(t.img, c.img) AS img, us, evals FROM t FULL JOIN c ON t.impl = c.impl AND t.img = c.img""",
)
def timed_counts_full_outer(spark, sf):
    r = runs(spark, sf)
    img = F.floor(F.col("event_id") / 50)
    t = A.last_of(r.where("event_id % 2 = 0").withColumn("img", img), ["impl", "img"], F.col("event_id"), "us")
    c = r.where("event_id % 2 = 1").groupBy("impl", (img + 1).alias("img")).agg(F.count(F.lit(1)).alias("evals"))
    return t.join(c, ["impl", "img"], "full_outer")


@query(
    "baseline_delta",
    f"""WITH {_RUNS}, m AS (SELECT impl, op, part, round(avg(us), 6) AS us FROM runs GROUP BY ALL), f AS (SELECT impl, op, arg_min(us, part) AS base FROM m GROUP BY ALL)
    SELECT impl, op, part, us, base, CASE WHEN base <> 0 THEN round((us / base - 1) * 100, 4) + 0.0 END AS change FROM m JOIN f USING (impl, op)""",
)
def baseline_delta(spark, sf):
    m = runs(spark, sf).groupBy("impl", "op", "part").agg(six(F.avg("us")).alias("us"))
    return A.against_first(m, ["impl", "op"], "part", "us").withColumn("change", F.round("change", 4) + F.lit(0.0))


@query(
    "speed_quality_left",
    f"""WITH {_RUNS}, s AS (SELECT impl || '-' || op AS method, round(avg(us), 6) AS ms FROM runs GROUP BY ALL), q AS (SELECT impl || '-' || op AS method, round(max(us), 6) AS lpips FROM runs WHERE op < 3 GROUP BY ALL)
    SELECT method, ms, coalesce(lpips, 'NaN'::DOUBLE) AS lpips FROM s LEFT JOIN q USING (method)""",
)
def speed_quality_left(spark, sf):
    r = runs(spark, sf).withColumn("method", F.concat_ws("-", "impl", "op"))
    s = r.groupBy("method").agg(six(F.avg("us")).alias("ms"))
    q = r.where("op < 3").groupBy("method").agg(F.round(F.max("us"), 6).alias("lpips"))
    return s.join(q, "method", "left").withColumn("lpips", F.coalesce("lpips", F.lit(float("nan"))))


@query(
    "hash_set_match",
    f"""WITH {_RUNS}, s AS (SELECT impl, op, part, list_sort(list(DISTINCT (event_id % 5)::VARCHAR)) AS hashes FROM runs WHERE us > 20 GROUP BY ALL), b AS (SELECT impl, op, hashes AS base FROM s WHERE part = 0)
    SELECT impl, op, part, CASE WHEN base IS NULL THEN '?' WHEN hashes = base THEN 'yes' ELSE 'DIFF' END AS same FROM s LEFT JOIN b USING (impl, op)""",
)
def hash_set_match(spark, sf):
    s = runs(spark, sf).where("us > 20").groupBy("impl", "op", "part").agg(F.array_sort(F.collect_set((F.col("event_id") % 5).cast("string"))).alias("hashes"))
    b = s.where("part = 0").select("impl", "op", F.col("hashes").alias("base"))
    same = F.when(F.col("base").isNull(), "?").when(F.col("hashes") == F.col("base"), "yes").otherwise("DIFF")
    return s.join(b, ["impl", "op"], "left").select("impl", "op", "part", same.alias("same"))


@query("median_interp", f"WITH {_RUNS} SELECT impl, op, round(quantile_cont(us, 0.5), 6) AS us FROM runs GROUP BY ALL")
def median_interp(spark, sf):
    return runs(spark, sf).groupBy("impl", "op").agg(F.round(F.median("us"), 6).alias("us"))


@query("median_upper", f"WITH {_RUNS}, l AS (SELECT impl, op, list_sort(list(us)) AS s FROM runs GROUP BY ALL) SELECT impl, op, s[len(s) // 2 + 1] AS us FROM l")
def median_upper(spark, sf):
    return A.percentile_by_counts(runs(spark, sf), ["impl", "op"], "us", 0.5)


@query("p95_nearest_rank", f"WITH {_RUNS}, l AS (SELECT impl, op, list_sort(list(us)) AS s FROM runs GROUP BY ALL) SELECT impl, op, s[floor(len(s) * 0.95::DOUBLE)::INT + 1] AS us FROM l")
def p95_nearest_rank(spark, sf):
    return A.percentile_by_counts(runs(spark, sf), ["impl", "op"], "us", 0.95)


@query("median_of_medians", f"WITH {_RUNS}, m AS (SELECT impl, event_id // 9 AS img, quantile_cont(us, 0.5) AS us FROM runs GROUP BY ALL) SELECT impl, round(quantile_cont(us, 0.5), 6) AS us FROM m GROUP BY impl")
def median_of_medians(spark, sf):
    m = runs(spark, sf).groupBy("impl", F.floor(F.col("event_id") / 9).alias("img")).agg(F.median("us").alias("us"))
    return m.groupBy("impl").agg(F.round(F.median("us"), 6).alias("us"))


@query("bench_summary", f"WITH {_RUNS} SELECT impl, count(*) AS iters, min(us) AS least, max(us) AS most, count(DISTINCT op) AS ops, round(10000 / quantile_cont(us, 0.5), 6) AS mpix FROM runs GROUP BY impl")
def bench_summary(spark, sf):
    return runs(spark, sf).groupBy("impl").agg(F.count(F.lit(1)).alias("iters"), F.min("us").alias("least"), F.max("us").alias("most"), F.countDistinct("op").alias("ops"), F.round(10000 / F.median("us"), 6).alias("mpix"))


_RD = "rd AS (SELECT l_orderkey AS image, l_returnflag || '-' || l_linenumber AS method, l_quantity::INT AS bytes, l_extendedprice::DOUBLE / 1000 AS psnr, l_discount::DOUBLE AS ssim FROM lineitem)"


def rd(spark, sf):
    d = table(spark, sf, "lineitem")
    return d.select(F.col("l_orderkey").alias("image"), F.concat_ws("-", "l_returnflag", "l_linenumber").alias("method"), F.col("l_quantity").cast("int").alias("bytes"), (F.col("l_extendedprice").cast("double") / 1000).alias("psnr"), F.col("l_discount").cast("double").alias("ssim"))


@query("rd_means", f"WITH {_RD} SELECT method, round(avg(bytes), 6) AS bytes, round(avg(psnr), 6) AS psnr, round(avg(ssim), 6) AS ssim, count(*) AS n FROM rd GROUP BY method")
def rd_means(spark, sf):
    return rd(spark, sf).groupBy("method").agg(*(six(F.avg(c)).alias(c) for c in ("bytes", "psnr", "ssim")), F.count(F.lit(1)).alias("n"))


@query("refine_delta", f"WITH {_RD}, m AS (SELECT split_part(method, '-', 1) AS mode, image % 4 AS setting, round(avg(psnr), 6) AS psnr FROM rd GROUP BY ALL), b AS (SELECT mode, psnr AS base FROM m WHERE setting = 0) SELECT mode, setting, psnr, round(psnr - base, 6) + 0.0 AS delta FROM m JOIN b USING (mode)")
def refine_delta(spark, sf):
    m = rd(spark, sf).groupBy(A.family(F.col("method")).alias("mode"), (F.col("image") % 4).alias("setting")).agg(six(F.avg("psnr")).alias("psnr"))
    base = m.where("setting = 0").select("mode", F.col("psnr").alias("base"))
    return m.join(base, "mode").select("mode", "setting", "psnr", six(F.col("psnr") - F.col("base")).alias("delta"))


@query(
    "pareto_frontier",
    f"WITH {_RD}, b AS (SELECT split_part(method, '-', 1) AS family, bytes, max(round(psnr, 6)) AS psnr FROM rd GROUP BY ALL), f AS (SELECT *, max(psnr) OVER (PARTITION BY family ORDER BY bytes ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM b) SELECT family, bytes, psnr FROM f WHERE p IS NULL OR psnr > p",
)
def pareto_frontier(spark, sf):
    d = rd(spark, sf).select(A.family(F.col("method")).alias("family"), "bytes", F.round("psnr", 6).alias("psnr"))
    return A.frontier(d, "bytes", "psnr", ["family"])


@query(
    "entropy_model",
    """WITH s AS (SELECT l_orderkey AS image, unnest(['q', 's', 'd']) AS field, unnest([l_quantity::INT % 32, l_suppkey % 16, (l_discount * 100)::INT]) AS sym FROM lineitem),
    al AS (SELECT unnest(['q', 's', 'd']) AS field, unnest([32, 16, 16]) AS k), a AS (SELECT field, unnest(range(k)) AS sym FROM al),
    c AS (SELECT a.field, a.sym, count(s.sym) + 1 AS c FROM a LEFT JOIN s ON a.field = s.field AND a.sym = s.sym AND s.image % 2 = 0 GROUP BY ALL), t AS (SELECT field, sum(c) AS t FROM c GROUP BY field)
    SELECT s.field, round(sum(-log2(c::DOUBLE / t)), 4) AS bits, count(*) AS n FROM s JOIN c ON s.field = c.field AND s.sym = c.sym JOIN t ON t.field = s.field WHERE s.image % 2 = 1 GROUP BY s.field""",
)
def entropy_model(spark, sf):
    d = table(spark, sf, "lineitem")
    fields = {"q": F.col("l_quantity").cast("int") % 32, "s": F.col("l_suppkey") % 16, "d": F.round(F.col("l_discount").cast("double") * 100).cast("int")}
    s = d.select(F.col("l_orderkey").alias("image"), F.explode(F.array(*(F.struct(F.lit(k).alias("field"), v.cast("int").alias("sym")) for k, v in fields.items()))).alias("i")).select("image", "i.*")
    sizes = spark.createDataFrame([("q", 32), ("s", 16), ("d", 16)], "field string, k int")
    alphabet = sizes.select("field", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("sym"))
    return A.symbol_costs(s.where("image % 2 = 0"), s.where("image % 2 = 1"), alphabet).select("field", F.round("bits", 4).alias("bits"), "n")


@query("topk_candidates", "WITH r AS (SELECT l_suppkey, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice, l_orderkey, l_linenumber) AS r FROM lineitem) SELECT l_suppkey, l_orderkey, l_linenumber, r::INT AS rank FROM r WHERE r <= 3")
def topk_candidates(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("l_suppkey").orderBy("l_extendedprice", "l_orderkey", "l_linenumber")
    return table(spark, sf, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", F.row_number().over(w).alias("rank")).where("rank <= 3")


@query(
    "area_rank_tiers",
    """WITH s AS (SELECT l_orderkey, l_linenumber AS idx, l_quantity::INT * (l_suppkey % 7 + 1) AS area FROM lineitem), w AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY area DESC, idx) - 1 AS slot, count(*) OVER (PARTITION BY l_orderkey) AS n FROM s)
    SELECT l_orderkey, idx, slot::INT AS slot, CASE WHEN n > 1 THEN round(slot / (n - 1)::DOUBLE, 6) ELSE 0 END AS delay, least(3, floor(slot::DOUBLE / n * 4))::INT AS tier FROM w""",
)
def area_rank_tiers(spark, sf):
    s = table(spark, sf, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("idx"), (F.col("l_quantity").cast("int") * (F.col("l_suppkey") % 7 + 1)).alias("area"))
    return render.revealed(s, "l_orderkey", F.col("area")).select("l_orderkey", "idx", "slot", F.round("delay", 6).alias("delay"), "tier")


@query("union_filter_sort", f"WITH {_RUNS}, u AS (SELECT impl, op, us, 'even' AS file FROM runs WHERE event_id % 2 = 0 UNION ALL SELECT impl, op, us, NULL FROM runs WHERE event_id % 2 = 1) SELECT op, impl, file, us FROM u WHERE impl = (SELECT min(impl) FROM runs)")
def union_filter_sort(spark, sf):
    r = runs(spark, sf)
    even = r.where("event_id % 2 = 0").select("impl", "op", "us", F.lit("even").alias("file"))
    u = even.unionByName(r.where("event_id % 2 = 1").select("impl", "op", "us"), allowMissingColumns=True)
    least = r.agg(F.min("impl").alias("impl"))
    return u.join(F.broadcast(least), "impl", "left_semi").orderBy("op", "us").select("op", "impl", "file", "us")


@query("key_union", f"WITH {_RUNS} SELECT impl, op FROM runs WHERE us > 90 UNION SELECT impl, op FROM runs WHERE us < 5")
def key_union(spark, sf):
    r = runs(spark, sf)
    return r.where("us > 90").select("impl", "op").union(r.where("us < 5").select("impl", "op")).distinct()


@query("report_lines", f"WITH {_RUNS} SELECT '| ' || impl || ' | ' || count(*) || ' | ' || CASE WHEN max(us) < 1000 THEN printf('%.1f', max(us)) || ' us' ELSE printf('%.2f', max(us) / 1000) || ' ms' END || ' |' AS line FROM runs GROUP BY impl")
def report_lines(spark, sf):
    d = runs(spark, sf).groupBy("impl").agg(F.count(F.lit(1)).alias("n"), A.duration_text(F.max("us")).alias("most"))
    return A.markdown(d, ["impl", "n", "most"])


# Shapes of line items on a canvas of 48.
_SHAPES = """s AS (SELECT l_orderkey, l_linenumber, (l_partkey % 48)::INT AS cx, (l_suppkey % 48)::INT AS cy, (l_quantity::INT % 24 + 1) AS w, (l_partkey % 31 + 1)::INT AS h, (l_orderkey % 48)::INT AS x1, (l_partkey * 3 % 48)::INT AS y1, (l_suppkey * 5 % 48)::INT AS x2, (l_orderkey * 7 % 48)::INT AS y2,
  0.20::DOUBLE + 0.70::DOUBLE * (l_linenumber % 8) / 7 AS alpha, printf('%02x%02x%02x', l_partkey % 256, l_suppkey * 3 % 256, l_orderkey % 256) AS c FROM lineitem),
t AS (SELECT *, '#' || CASE WHEN c[1] = c[2] AND c[3] = c[4] AND c[5] = c[6] THEN c[1] || c[3] || c[5] ELSE c END AS fill, ' fill-opacity="' || regexp_replace(regexp_replace(regexp_replace(printf('%.2f', round(alpha * 100) / 100), '0+$', ''), '\\.$', ''), '^0', '') || '"' AS op FROM s)"""


def drawn(spark, sf):
    d = table(spark, sf, "lineitem")
    p, q, o = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_orderkey")
    fields = {"cx": p % 48, "cy": q % 48, "w": F.col("l_quantity").cast("int") % 24 + 1, "h": p % 31 + 1, "x1": o % 48, "y1": p * 3 % 48, "x2": q * 5 % 48, "y2": o * 7 % 48}
    c = F.struct((p % 256).alias("r"), (q * 3 % 256).alias("g"), (o % 256).alias("b"))
    s = F.struct(*(v.cast("int").alias(k) for k, v in fields.items()), F.lit(0.0).alias("theta"), (0.20 + 0.70 * (F.col("l_linenumber") % 8) / 7).alias("alpha"), c.alias("color"))
    return d.select("l_orderkey", "l_linenumber", s.alias("s"))


def _elements(kind):
    return lambda spark, sf: drawn(spark, sf).select("l_orderkey", "l_linenumber", shapes.element(kind, F.col("s")).alias("svg"))


svg_circle = query("svg_circle", f"""WITH {_SHAPES} SELECT l_orderkey, l_linenumber, '<circle cx="' || cx || '" cy="' || cy || '" r="' || w || '" fill="' || fill || '"' || op || '/>' AS svg FROM t""")(_elements("circle"))
svg_rect = query("svg_rect", f"""WITH {_SHAPES} SELECT l_orderkey, l_linenumber, '<rect x="' || cx - w // 2 || '" y="' || cy - h // 2 || '" width="' || w || '" height="' || h || '" fill="' || fill || '"' || op || '/>' AS svg FROM t""")(_elements("rect"))
_SEP = "CASE WHEN {0} < 0 THEN '' ELSE ' ' END || ({0})"
svg_triangle = query(
    "svg_triangle",
    f"""WITH {_SHAPES} SELECT l_orderkey, l_linenumber, '<path fill="' || fill || '"' || op || ' d="M' || cx || ' ' || cy || 'l' || (x1 - cx) || {_SEP.format('y1 - cy')} || {_SEP.format('x2 - x1')} || {_SEP.format('y2 - y1')} || 'z"/>' AS svg FROM t""",
)(_elements("triangle"))


_COVER = {
    "circle": "(x - cx) ** 2 + (y - cy) ** 2 <= w ** 2",
    "rect": "x >= cx - w // 2 AND x <= cx - w // 2 + w - 1 AND y >= cy - h // 2 AND y <= cy - h // 2 + h - 1",
    "triangle": """CASE WHEN a = 0 THEN false WHEN a > 0 THEN least((x1 - cx) * (y - cy) - (y1 - cy) * (x - cx), (x2 - x1) * (y - y1) - (y2 - y1) * (x - x1), (cx - x2) * (y - y2) - (cy - y2) * (x - x2)) >= 0
      ELSE greatest((x1 - cx) * (y - cy) - (y1 - cy) * (x - cx), (x2 - x1) * (y - y1) - (y2 - y1) * (x - x1), (cx - x2) * (y - y2) - (cy - y2) * (x - x2)) <= 0 END""",
}


#: Shapes at a quarter of their size, so that every place of their canvas is looked at.
_QUARTER = "q AS (SELECT l_orderkey, l_linenumber, " + ", ".join(f"{c} // 4 AS {c}" for c in ("cx", "cy", "x1", "y1", "x2", "y2")) + ", w // 4 + 1 AS w, h // 4 + 1 AS h FROM t)"


def _coverage(kind):
    def run(spark, sf):
        s = F.col("s")
        for c in ("cx", "cy", "x1", "y1", "x2", "y2", "w", "h"):
            s = s.withField(c, F.floor(F.col("s")[c] / 4).cast("int") + (1 if c in "wh" else 0))
        return shapes.covered(computed(drawn(spark, sf), small=s), kind, "small", 12, 12, "hits").select("l_orderkey", "l_linenumber", "hits")

    return run


for _kind, _sql in _COVER.items():
    query(
        f"cover_{_kind}",
        f"""WITH {_SHAPES}, {_QUARTER}, u AS (SELECT *, row_number() OVER () AS rid, (x1 - cx) * (y2 - cy) - (y1 - cy) * (x2 - cx) AS a FROM q), g AS (SELECT gx.v AS x, gy.v AS y FROM (SELECT unnest(range(12)) AS v) gx, (SELECT unnest(range(12)) AS v) gy)
        SELECT l_orderkey, l_linenumber, count(*) FILTER ({_sql})::INT AS hits FROM u, g GROUP BY rid, l_orderkey, l_linenumber""",
    )(_coverage(_kind))


@query("clean_colors", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN printf('%02x', o_orderkey % 256) END AS c FROM orders")
def clean_colors(spark, sf):
    k = F.col("o_orderkey")
    text = F.when(k % 2 == 0, F.format_string(" %02X ", k % 256)).otherwise(F.format_string("%X.", k % 16))
    return table(spark, sf, "orders").select("o_orderkey", clean_hex(text).alias("c"))


