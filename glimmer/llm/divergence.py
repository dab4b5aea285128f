"""How far the sources of a language differ in their words, by DuckDB over shards of terms.

1. Each task counts its texts' terms by (lang, source) before anything is shuffled,
   and packs what goes to one shard.
2. Spark deals the counts to shards by the hash of (lang, term), so that a shard holds all of a
   term; DuckDB sums each shard and keeps the terms of enough documents.
3. Spark sums the kept counts by group and language: the totals and vocabulary sizes that
   every probability needs.
4. Each shard meets the totals of all groups; DuckDB turns counts into probabilities and makes the
   shard's partial sums over pairs of sources and its highest terms.
5. Spark adds the partial sums and ranks them.

A hot language, source or term is many shards' work, or one row a task: nothing is gathered
by language or source before it is a sum.  The number of shards follows the bytes of text.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .workspace import Workspace

#: Bytes outside the terms become spaces, A-Z become a-z; terms are what is left between spaces.
_TERM = bytes(32 if b < 0x41 or 0x5B <= b <= 0x60 or 0x7B <= b <= 0x7F else b + 32 if b <= 0x5A else b for b in range(256))
#: A task holds this many counted terms before it passes them on; there is a shard for so many bytes of text.
HELD, SHARD_BYTES = 1 << 19, 8 << 20
#: Parts of a thousand millionth, and what is added to each count.
SCALE, ADDED = 1_000_000_000, 5

_COUNTED = "shard int, groups array<struct<lang:string,source:string,n:long>>, terms binary, counts binary"
_KEPT = "lang string, source string, term string, n long, lead boolean"
_PARTIAL = "lang string, source string, part string, item string, value long"


def _counting(shards: int):
    """A function from a task's texts to counts by shard: a row for each shard, its terms joined by spaces, group after group."""
    kind = pa.list_(pa.struct([("lang", pa.string()), ("source", pa.string()), ("n", pa.int64())]))

    def packed(words: dict[tuple, Counter], docs: dict[tuple, Counter]) -> Iterator[pa.RecordBatch]:
        groups = sorted(words)
        sizes = [len(words[g]) for g in groups]
        terms = [t for g in groups for t in words[g]]
        if not terms:
            return
        seeds = [crc32(lang.encode()) for lang, _ in groups]
        shard = np.fromiter((crc32(t, seed) % shards for g, seed in zip(groups, seeds, strict=True) for t in words[g]), dtype=np.int64, count=len(terms))
        counts = np.empty((len(terms), 2), dtype=np.int64)
        counts[:, 0] = [n for g in groups for n in words[g].values()]
        counts[:, 1] = [docs[g][t] for g in groups for t in words[g]]
        group = np.repeat(np.arange(len(groups)), sizes)
        order = np.argsort(shard, kind="stable")  # groups stay in order within a shard
        shard, group, counts = shard[order], group[order], counts[order]
        terms = [terms[i] for i in order.tolist()]
        cuts = np.flatnonzero(np.concatenate(([True], shard[1:] != shard[:-1], [True])))
        rows: list[list] = [[], [], []]
        for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            here, n = np.unique(group[x:y], return_counts=True)
            rows[0].append([{"lang": groups[g][0], "source": groups[g][1], "n": k} for g, k in zip(here.tolist(), n.tolist(), strict=True)])
            rows[1].append(b" ".join(terms[x:y]))
            rows[2].append(counts[x:y].tobytes())
        types = [kind, pa.binary(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(shard[cuts[:-1]].astype(np.int32)), *(pa.array(c, type=t) for c, t in zip(rows, types, strict=True))], names=["shard", "groups", "terms", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[tuple, Counter] = {}
        docs: dict[tuple, Counter] = {}
        held = 0
        for batch in batches:
            texts = batch.column(2).cast(pa.binary())
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts, strict=True):
                found = text.as_py().translate(_TERM).split()
                key = lang, source
                n, d = words.setdefault(key, Counter()), docs.setdefault(key, Counter())
                before = len(n)
                n.update(found)
                d.update(set(found))
                held += len(n) - before
                if held >= HELD:
                    yield from packed(words, docs)
                    words, docs, held = {}, {}, 0
        yield from packed(words, docs)

    return run


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs), a term a row."""
    for batch in batches:
        for groups, terms, counts in zip(*(batch.column(i) for i in (1, 2, 3)), strict=True):
            of = groups.values
            row = pa.array(np.repeat(np.arange(len(of)), np.asarray(of.field("n"))))
            n = np.frombuffer(counts.as_py(), dtype=np.int64).reshape(-1, 2)
            term = pa.array(terms.as_py().split(b" "), type=pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([of.field("lang").take(row), of.field("source").take(row), term, pa.array(n[:, 0].copy()), pa.array(n[:, 1].copy())], names=["lang", "source", "term", "n", "docs"])


def _in_duckdb(sql: str, schema: str, opened=iter):
    """A function over the batches of one shard: ``sql`` reads what ``opened`` makes of them as ``shard`` and gives columns of ``schema``."""
    names = [c.split()[0] for c in schema.split(", ")]
    types = [{"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}[c.split()[1]] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = opened(batches)
        first = next(batches, None)
        if first is None:
            return

        def all_batches() -> Iterator[pa.RecordBatch]:
            yield first
            yield from batches

        with duckdb.connect(":memory:", config={"threads": 1, "preserve_insertion_order": False, "temp_directory": ""}) as con:
            con.register("arriving", pa.RecordBatchReader.from_batches(first.schema, all_batches()))
            con.execute("CREATE TABLE shard AS SELECT * FROM arriving")
            reader = con.execute(sql).to_arrow_reader(65536)
            for out in reader:
                yield pa.RecordBatch.from_arrays([out.column(i).cast(t) for i, t in enumerate(types)], names=names)

    return run


def _kept_sql(least: int) -> str:
    """Counts of the terms that ``least`` documents of their language hold; ``lead`` marks one row of each."""
    return f"""
WITH s AS (SELECT lang, source, term, sum(n)::BIGINT AS n, sum(docs)::BIGINT AS docs FROM shard GROUP BY ALL),
w AS (SELECT lang, source, term, n, sum(docs) OVER of_term AS held, min(source) OVER of_term AS first_source FROM s WINDOW of_term AS (PARTITION BY lang, term))
SELECT lang, source, term, n, source = first_source AS lead FROM w WHERE held >= {least}"""


def _partial_sql(ranks: int) -> str:
    """Sums of differences over the shard's terms for each pair of sources, and each group's highest terms here.

    Rows without a term are groups with their totals.
    """
    return f"""
WITH g AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY lang, source)::INTEGER AS g FROM (SELECT DISTINCT lang, source, total, lang_total, v FROM shard WHERE term IS NULL)),
c AS (SELECT lang, source, term, n FROM shard WHERE term IS NOT NULL),
k AS MATERIALIZED (SELECT lang, term, sum(n) AS n, row_number() OVER ()::INTEGER AS k FROM c GROUP BY lang, term),
d AS MATERIALIZED (SELECT k.k, g.g, coalesce(c.n, 0) AS n, (1 + ({SCALE}::HUGEINT * (coalesce(c.n, 0) + {ADDED})) // (g.total + {ADDED} * g.v))::BIGINT AS p
  FROM k JOIN g ON g.lang = k.lang LEFT JOIN c ON c.lang = k.lang AND c.term = k.term AND c.source = g.source),
pairs AS (SELECT x.g AS a, y.g AS b, sum(abs(x.p - y.p))::BIGINT AS value FROM d x JOIN d y ON x.k = y.k AND x.g < y.g GROUP BY ALL),
over_lang AS (SELECT d.g, k.term, d.p - (1 + ({SCALE}::HUGEINT * (k.n + {ADDED})) // (g.lang_total + {ADDED} * g.v))::BIGINT AS value FROM d JOIN k ON k.k = d.k JOIN g ON g.g = d.g WHERE d.n > 0),
high AS (SELECT * FROM over_lang WHERE value > 0 QUALIFY row_number() OVER (PARTITION BY g ORDER BY value DESC, term) <= {ranks})
SELECT g.lang, g.source, 'pair' AS part, o.source AS item, value FROM pairs JOIN g ON g.g = a JOIN g o ON o.g = b
UNION ALL SELECT g.lang, g.source, 'pair', o.source, value FROM pairs JOIN g ON g.g = b JOIN g o ON o.g = a
UNION ALL SELECT g.lang, g.source, 'term', term, value FROM high JOIN g ON g.g = high.g"""


def _shard(shards: int) -> Column:
    return F.pmod(F.xxhash64("lang", "term"), F.lit(shards)).cast("int")


def audit(df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least: int = 30, ranks: int = 50) -> DataFrame:
    """lang, source, part, item, value, rank: how far each source is from the others of its language.

    A term is kept for a language if ``least`` of its rows hold it.  With N the occurrences of kept
    terms in a group and V their number, a term has p = 1 + floor(10^9 (count + 5) / (N + 5 V)) there,
    in the language as a whole likewise.  Part ``pair`` has for each other source the sum of the
    differences of p over all kept terms; part ``term`` the ``ranks`` kept terms of the group whose p is
    most above the language's.  The highest value comes first, ties by item.

    Null text, lang and source count as empty; a group without terms has its pairs too; a repeated
    row counts again; a language of one source has no pairs; an empty table gives no rows.  Other
    columns are not read.
    """
    spark = df.sparkSession
    ws = Workspace(spark, "divergence")
    docs = df.select(*(F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-size // SHARD_BYTES))
    counted = docs.mapInArrow(_counting(shards), _COUNTED).repartitionById(shards, "shard")
    kept = ws.keep(counted.mapInArrow(_in_duckdb(_kept_sql(least), _KEPT, _unpacked), _KEPT), "kept")

    groups = docs.select("lang", "source").distinct()
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = kept.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.count(F.when(F.col("lead"), 1)).alias("v"))
    sized = groups.join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    sized = ws.keep(sized.select("lang", "source", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "lang_total", "v"))), "groups")

    empty = F.lit(None).cast("long")
    terms = kept.select(_shard(shards).alias("shard"), "lang", "source", "term", "n", *(empty.alias(c) for c in ("total", "lang_total", "v")))
    everywhere = sized.where("v > 0").select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), "lang", "source", F.lit(None).cast("string").alias("term"), empty.alias("n"), "total", "lang_total", "v")
    met = terms.unionByName(everywhere).repartitionById(shards, "shard").drop("shard")
    partial = ws.keep(met.mapInArrow(_in_duckdb(_partial_sql(ranks), _PARTIAL), _PARTIAL), "partial")

    other = sized.select("lang", F.col("source").alias("item"))
    no_terms = sized.select("lang", "source").join(other, "lang").where(F.col("source") != F.col("item")).select("lang", "source", F.lit("pair").alias("part"), "item", F.lit(0).cast("long").alias("value"))
    pairs = partial.where("part = 'pair'").unionByName(no_terms).groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    best = partial.where("part = 'term'").withColumn("rank", rank).where(F.col("rank") <= ranks)
    return pairs.withColumn("rank", rank).unionByName(best).select("lang", "source", "part", "item", "value", "rank")


#: The registered query by counting everything at once.
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents),
t AS (SELECT i, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS lang_n FROM t GROUP BY ALL HAVING count(DISTINCT i) >= 30),
g AS (SELECT DISTINCT lang, source FROM d),
n AS (SELECT lang, source, term, count(*) AS n FROM t GROUP BY ALL),
f AS (SELECT g.lang, g.source, k.term, k.lang_n, coalesce(n.n, 0) AS n FROM g JOIN kept k ON k.lang = g.lang LEFT JOIN n ON n.lang = g.lang AND n.source = g.source AND n.term = k.term),
z AS (SELECT *, sum(n) OVER (PARTITION BY lang, source) + 5 * count(*) OVER (PARTITION BY lang, source) AS below, sum(lang_n) OVER (PARTITION BY lang, source) + 5 * count(*) OVER (PARTITION BY lang, source) AS lang_below FROM f),
p AS (SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 5)) // below AS p, 1 + (1000000000::HUGEINT * (lang_n + 5)) // lang_below AS q FROM z),
pairs AS (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value FROM p x JOIN p y ON y.lang = x.lang AND y.term = x.term AND y.source <> x.source GROUP BY ALL),
u AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(value, 0) AS value FROM g x JOIN g y ON y.lang = x.lang AND y.source <> x.source LEFT JOIN pairs ON pairs.lang = x.lang AND pairs.source = x.source AND pairs.item = y.source
  UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM u)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM r WHERE part = 'pair' OR rank <= 50
"""
