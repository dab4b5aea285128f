"""Line deduplication by a deletion-neighbourhood join over words.

A line's tokens are its words (``[^\\x20\\x09-\\x0D]+``, A-Z lowered).  Two lines are alike
if their words are equal, or if both have at least ``min_words`` words and at most one
word is inserted, deleted or replaced between them.  A line goes if any earlier line, itself
kept or not, is alike.  Earlier means: smaller (doc_id, hash of the text, line number),
null ids first.

Neighbourhood: deleting word i of a line gives a variant, a hashed key.  Lines of equal
length whose variants with the same i are equal differ in word i alone; a line that equals
a variant of a longer one lacks one word.  Each key is reduced to its earliest line before
anything is joined, so that no group of lines is ever listed, however hot the key; the
found line and its earlier partner are then compared word by word.

Only lines whose first or last half is shared with another line emit their variants: one
edit leaves one of the two halves as it is, so this loses nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import numbered, slices
from .texthash import LOWER, mix
from .workspace import Workspace

MIN_WORDS = 8
_B = 0x9E3779B97F4A7C15
_BASE, _BASE_INV = np.uint64(_B), np.uint64(pow(_B, -1, 2**64))
_BYTE = np.random.Generator(np.random.PCG64(7)).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_NEWLINE = 10
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes hashed at a time; a longer text is one block.
_BLOCK = 1 << 20
_tables: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, for positions below ``n``."""
    if not _tables or len(_tables[0]) < n:
        size = max(n, 2 * _BLOCK)
        both = []
        for base in (_BASE, _BASE_INV):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            both.append(np.multiply.accumulate(steps))
        if size > 8 * _BLOCK:
            return both[0], both[1]
        _tables[:] = both
    return _tables[0], _tables[1]


class Lines:
    """The lines of several texts: word hashes and their running sums."""

    def __init__(self, texts: list[str | None]):
        data = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        raw = LOWER[np.frombuffer(b"\n" + b"\n".join(data) + b"\n", dtype=np.uint8)]
        space = _SPACE[raw]
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        starts, ends = edge[0::2], edge[1::2]
        up, down = _powers(len(raw) + 1)
        total = np.zeros(len(raw) + 1, dtype=np.uint64)
        np.cumsum(_BYTE[raw] * up[: len(raw)], out=total[1:])
        words = mix((total[ends] - total[starts]) * down[starts])
        breaks = np.flatnonzero(raw == _NEWLINE)
        #: first word of each line, and one past its last
        self.first = np.searchsorted(starts, breaks[:-1])
        self.last = np.searchsorted(starts, breaks[1:])
        self.n_words = self.last - self.first
        #: of each line, the text and the line's number in it
        offsets = np.cumsum([1] + [len(d) + 1 for d in data])
        self.text = np.searchsorted(offsets, breaks[:-1] + 1, side="right") - 1
        before = np.searchsorted(self.text, np.arange(len(data)))
        self.number = np.arange(len(self.text)) - before[self.text]
        self.up, self.down = _powers(len(words) + 2)
        self.sums = np.zeros(len(words) + 1, dtype=np.uint64)
        np.cumsum(words * self.up[: len(words)], out=self.sums[1:])

    def span(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Polynomial of the words from a to b, as if a were the first."""
        return (self.sums[b] - self.sums[a]) * self.down[a]

    def hashes(self) -> np.ndarray:
        return mix(self.span(self.first, self.last) + self.n_words.astype(np.uint64))

    def halves(self, lines: np.ndarray) -> np.ndarray:
        """Four keys a line: its two halves as the shorter or equal, and as the longer of a pair."""
        f, e, n = self.first[lines], self.last[lines], self.n_words[lines]
        keys = []
        for level in (n, n - 1):
            h = level // 2
            tag = level.astype(np.uint64) * np.uint64(2)
            keys.append(mix(mix(self.span(f, f + h)) + tag))
            keys.append(mix(mix(self.span(e - (level - h), e)) + tag + np.uint64(1)))
        return np.stack(keys, axis=1)

    def variants(self, line: int) -> np.ndarray:
        """Hashes of the line without its first, second, ... word, and at last of the whole line."""
        a, b = int(self.first[line]), int(self.last[line])
        at = np.arange(a, b)
        left = (self.sums[a:b] - self.sums[a]) * self.down[a]
        right = (self.sums[b] - self.sums[a + 1 : b + 1]) * self.down[a] * _BASE_INV
        gone = mix(left + right + np.uint64(b - a - 1))
        whole = mix(self.span(np.array([a]), np.array([b])) + np.uint64(b - a))
        return np.concatenate((gone, whole)) if len(at) else whole


def _pieces(text: str) -> Iterator[tuple[str, int]]:
    """A long text in pieces of whole lines, with the number of each piece's first line; a longer line stays whole."""
    at = line = 0
    while len(text) - at > 2 * _BLOCK:
        cut = text.rfind("\n", at, at + _BLOCK)
        if cut < 0:
            cut = text.find("\n", at + _BLOCK)
            if cut < 0:
                break
        piece = text[at:cut]
        yield piece, line
        at, line = cut + 1, line + piece.count("\n") + 1
    yield text[at:], line


def _blocks(texts: list[str | None]) -> Iterator[tuple[int, Lines]]:
    """Lines of runs of texts, or of pieces of a long one, with the place of the run's first text."""
    start = size = 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if size and size + n > _BLOCK:
            yield start, Lines(texts[start:i])
            start, size = i, 0
        if n > 2 * _BLOCK:
            for piece, line in _pieces(t):
                lines = Lines([piece])
                lines.number += line
                yield i, lines
            start, size = i + 1, 0
            continue
        size += n
    if start < len(texts):
        yield start, Lines(texts[start:])


_LINES = T.StructType(
    [
        T.StructField("copy", T.LongType()),
        T.StructField("line", T.IntegerType()),
        T.StructField("n_words", T.IntegerType()),
        T.StructField("hash", T.LongType()),
        T.StructField("halves", T.ArrayType(T.LongType())),
    ]
)


def _lines(docs: DataFrame, min_words: int) -> DataFrame:
    """A row for each line with a word; ``halves`` is null for lines of under ``min_words`` words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, batch.column(2)):
                ids, copies = part.column(0), part.column(1)
                for start, lines in _blocks(part.column(2).to_pylist()):
                    there = np.flatnonzero(lines.n_words)
                    rows = pa.array(start + lines.text[there])
                    long = lines.n_words[there] >= min_words
                    sizes = np.concatenate(([0], np.cumsum(np.where(long, 4, 0)))).astype(np.int32)
                    halves = lines.halves(there[long]).reshape(-1).view(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [
                            ids.take(rows),
                            copies.take(rows),
                            pa.array(lines.number[there].astype(np.int32)),
                            pa.array(lines.n_words[there].astype(np.int32)),
                            pa.array(lines.hashes()[there].view(np.int64)),
                            pa.ListArray.from_arrays(pa.array(sizes), pa.array(halves), mask=pa.array(~long)),
                        ],
                        names=["doc_id", *_LINES.names],
                    )

    return docs.select("doc_id", "copy", "text").mapInArrow(run, T.StructType([docs.schema["doc_id"], *_LINES]))


def _variants(texts: DataFrame) -> DataFrame:
    """(hash, n_words, variant, at) for one line a row (hash, text): ``at`` is the word deleted, or -1."""
    schema = "hash long, n_words int, variant long, at int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, batch.column(1)):
                lines = Lines(part.column(1).to_pylist())
                for some in np.array_split(np.arange(len(lines.first)), 1 + len(lines.sums) // 200_000):
                    found = [lines.variants(i) for i in some]
                    if not found:
                        continue
                    sizes = np.array([len(v) for v in found])
                    at = np.concatenate([np.append(np.arange(n - 1), -1) for n in sizes]).astype(np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).take(pa.array(np.repeat(some, sizes))), pa.array(np.repeat(lines.n_words[some], sizes).astype(np.int32)), pa.array(np.concatenate(found).view(np.int64)), pa.array(at)],
                        names=["hash", "n_words", "variant", "at"],
                    )

    return texts.select("hash", "text").mapInArrow(run, schema)


def _picked(df: DataFrame) -> DataFrame:
    """(hash, text) of the lines that ``some`` (line, hash) names in ``text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, batch.column(0)):
                hashes, found = [], []
                for text, some in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    all_ = text.split("\n")
                    hashes += [s["hash"] for s in some]
                    found += [all_[s["line"]] for s in some]
                yield pa.RecordBatch.from_arrays([pa.array(hashes, type=pa.int64()), pa.array(found, type=pa.string())], names=["hash", "text"])

    return df.mapInArrow(run, "hash long, text string")


def _words(text: Column) -> Column:
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(lower, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")


def _without(words: Column, at: Column) -> Column:
    return F.concat(F.slice(words, F.lit(1), at), F.slice(words, at + 2, F.greatest(F.size(words) - at - 1, F.lit(0))))


def duplicate_lines(docs: DataFrame, ws: Workspace, min_words: int = MIN_WORDS) -> tuple[DataFrame, DataFrame]:
    """All lines (doc_id, copy, line, n_words, hash, ...), and those to drop (doc_id, copy, line).

    ``docs`` has doc_id, copy (a hash of the text) and text.
    """
    lines = ws.keep(_lines(docs, min_words), "lines")
    order = F.struct("doc_id", "copy", "line")
    distinct = ws.keep(lines.groupBy("hash").agg(F.min(order).alias("earliest"), F.first("n_words").alias("n_words"), F.first("halves").alias("halves")), "distinct")

    # lines that share a half with another one emit their variants
    halves = distinct.where(F.col("halves").isNotNull()).select("hash", F.explode("halves").alias("half"))
    shared = halves.groupBy("half").agg(F.min("hash").alias("x"), F.max("hash").alias("y")).where("x <> y").select("half")
    sharing = distinct.join(halves.join(shared, "half", "left_semi").select("hash").distinct(), "hash", "left_semi").select("hash", "earliest")
    sharing = ws.keep(sharing, "sharing")
    wanted = sharing.select(F.col("earliest.doc_id").alias("doc_id"), F.col("earliest.copy").alias("copy"), F.col("earliest.line").alias("line"), "hash")
    per_doc = wanted.groupBy("doc_id", "copy").agg(F.collect_list(F.struct("line", "hash")).alias("some")).select(F.col("doc_id").alias("_id"), F.col("copy").alias("_copy"), "some")
    here = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("copy") == F.col("_copy"))
    texts = _picked(docs.join(per_doc, here).select("text", "some"))
    texts = ws.keep(texts.groupBy("hash").agg(F.first("text").alias("text")), "texts")

    variants = ws.keep(_variants(texts).join(sharing, "hash"), "variants")
    me = F.struct("earliest", "hash", "at")
    replaced = F.when(F.col("at") >= 0, F.xxhash64("variant", "at", "n_words"))
    found = []
    # (a) a word replaced: equal variants of lines of one length, deleted at the same place
    same = variants.where("at >= 0").withColumn("key", replaced)
    firsts = same.groupBy("key").agg(F.min(me).alias("first"), F.max("hash").alias("other"), F.min("hash").alias("one")).where("one <> other").select("key", "first")
    found.append(same.join(firsts, "key"))
    # (b) a word more or less: a whole line equals a variant of a longer one
    whole = variants.where("at < 0").withColumnRenamed("variant", "key")
    gone = variants.where("at >= 0").withColumnRenamed("variant", "key")
    found.append(gone.join(whole.select("key", me.alias("first")), "key"))
    found.append(whole.join(gone.join(whole.select("key"), "key", "left_semi").groupBy("key").agg(F.min(me).alias("first")), "key"))
    pairs = None
    for f in found:
        f = f.where("first.earliest < earliest").select("hash", "at", F.col("first.hash").alias("partner"), F.col("first.at").alias("partner_at"))
        pairs = f if pairs is None else pairs.unionByName(f)
    pairs = ws.keep(pairs.distinct(), "pairs")
    mine, other = _words(F.col("text")), _words(F.col("partner_text"))
    whole_or = lambda w, at: F.when(at < 0, w).otherwise(_without(w, F.greatest(at, F.lit(0))))
    near = pairs.join(texts, "hash").join(texts.select(F.col("hash").alias("partner"), F.col("text").alias("partner_text")), "partner").where(whole_or(mine, F.col("at")) == whole_or(other, F.col("partner_at"))).select("hash").distinct()

    near = ws.keep(near.withColumn("near", F.lit(True)), "near")
    judged = lines.select("doc_id", "copy", "line", "hash").join(distinct.select("hash", "earliest"), "hash").join(near, "hash", "left")
    # rows that repeat an id and a text are the same lines: each of them keeps its earliest
    repeated = ~(F.struct("doc_id", "copy", "line").eqNullSafe(F.col("earliest")))
    return lines, judged.where(repeated | F.col("near").isNotNull()).select("doc_id", "copy", "line")


def deduplicate_lines(df: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``df`` with every line dropped that an earlier one is alike; other columns stay as they are.

    Lines end at "\\n".  Lines without words stay.  A null text stays null; a text all of whose
    lines go becomes empty.  Rows that repeat both id and text count as one document.  Whole
    numbers order ids as numbers, ids of other types are ordered as text.  Other columns may
    have any names; ``n_chars`` isn't recomputed here.
    """
    ws = Workspace(df.sparkSession, "lines")
    whole = dict(df.dtypes)[doc_id] in ("tinyint", "smallint", "int", "bigint")
    docs = df.select(F.col(f"`{doc_id}`").cast("long" if whole else "string").alias("doc_id"), F.xxhash64(f"`{text}`").alias("copy"), F.col(f"`{text}`").alias("text"))
    _, drop = duplicate_lines(docs, ws, min_words)
    gone = drop.distinct().groupBy(F.col("doc_id").alias("_id"), F.col("copy").alias("_copy")).agg(F.collect_list("line").alias("_gone"))
    gone = ws.keep(gone, "gone")
    names, at, words = df.columns, df.columns.index(doc_id), df.columns.index(text)
    rows = numbered(df).withColumn("_hash", F.xxhash64(f"_in_{words}"))
    out = rows.join(gone, F.col(f"_in_{at}").cast("long" if whole else "string").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_copy")), "left")
    out = out.select(*(f"_in_{i}" for i in range(len(names))), "_gone")

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = batch.column(words).to_pylist()
            for i, gone in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                if gone:
                    gone = set(gone)
                    new[i] = "\n".join([x for j, x in enumerate(new[i].split("\n")) if j not in gone])
            columns = batch.columns[:-1]
            columns[words] = pa.array(new, type=columns[words].type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return out.mapInArrow(rewrite, df.schema)
