"""Byte strings that an earlier document holds too, removed by sorted suffixes of pieces.

Every window of ``size`` bytes belongs to the least hash of the GRAM-byte strings in it, its
anchor; equal windows have equal anchors.  A piece is a stretch of neighbouring windows
of one anchor.

1. Rows are packed into blocks of some MB, written once, bucketed so that later joins don't move them.
2. Each block sends 32 bits of its anchors' hashes, once each, to shards; a shard answers which of
   them another document may hold too.  All other windows are unique and go no further.
3. Pieces of those anchors go to shards by anchor, each different one once a block.  A shard puts
   equal pieces together and sorts the suffixes of the different pieces of an anchor column by column
   (:mod:`.bwt`); windows that share ``size`` bytes are neighbours with such a common prefix, and the
   least document of each group is known.
4. Each block gets back, for each piece it sent, the least document that holds the piece, and
   which windows of it a still smaller one holds, and removes what its documents don't have first.

An anchor with very many different pieces is dealt by whole windows instead, so that no shard
gets a hot one.  A passage that many documents share is one row a block.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import bwt
from .columns import free, named, numbered
from .texthash import mix, running
from .workspace import Workspace

#: Bytes of text in a block, and for each of the shards.
BLOCK_BYTES, SHARD_BYTES = 6 << 20, 12 << 20
#: Windows hashed together.
CHUNK = 1 << 19
#: Different pieces of an anchor (counted once a block) above which its windows go alone.
HOT = 4096
#: Pieces sorted in one collection; the pieces of an anchor stay together.
COLLECTION = 4096
_ODD = np.uint64(0xD6E8FEB86659FD93)


class Blocks:
    """What a window and an anchor are, for windows of ``size`` bytes."""

    def __init__(self, size: int, hot: int, shards: int):
        # as many strings as a power of two, at most two thirds of the window's bytes and 32
        self.span = 1 << min(5, max(0, (2 * size // 3).bit_length() - 1))
        self.gram = size - self.span + 1
        self.size, self.hot, self.shards = size, hot, shards

    def pieces(self, data: np.ndarray, first: np.ndarray, taking: np.ndarray) -> tuple[np.ndarray, ...]:
        """(start, windows, anchor, content) of all pieces of the texts from first[i] to first[i + 1] that take part."""
        out = []
        for lo in range(0, len(data), CHUNK):
            raw = data[lo : lo + CHUNK + self.size - 1]
            count = len(raw) - self.size + 1
            if count <= 0:
                break
            total, down = running(raw)
            least = mix((total[self.gram :] - total[: -self.gram]) * down[: len(raw) - self.gram + 1])
            step = 1
            while step < self.span:
                least = np.minimum(least[:-step], least[step:])
                step *= 2
            # windows that lie in one text
            text = np.searchsorted(first, np.arange(lo, lo + count, CHUNK >> 9), side="right") - 1
            doc = np.repeat(text, CHUNK >> 9)[:count]
            at = np.arange(lo, lo + count)
            late = at >= first[doc + 1]
            while late.any():
                doc[late] += 1
                late = at >= first[doc + 1]
            valid = (at + self.size <= first[doc + 1]) & taking[doc]
            edge = np.flatnonzero(np.concatenate(([True], (least[1:] != least[:-1]) | (valid[1:] != valid[:-1]), [True])))
            start, windows = edge[:-1], np.diff(edge)
            inside = valid[start]
            start, windows = start[inside], windows[inside]
            # a repetitive text has long stretches of one anchor
            parts = -(-windows // self.span)
            within = (np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)) * self.span
            start, windows = np.repeat(start, parts) + within, np.minimum(np.repeat(windows, parts) - within, self.span)
            out.append((start + lo, windows, least[start], self._content(total, down, start, windows)))
        if not out:
            return tuple(np.zeros(0, dtype=t) for t in (np.int64, np.int64, np.uint64, np.uint64))
        return tuple(np.concatenate(c) for c in zip(*out, strict=True))

    def _content(self, total: np.ndarray, down: np.ndarray, start: np.ndarray, windows: np.ndarray) -> np.ndarray:
        return mix(((total[start + windows + self.size - 1] - total[start]) * down[start]) ^ (windows.astype(np.uint64) * _ODD))

    def windows(self, data: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Hashes of single windows."""
        powers = np.multiply.accumulate(np.full(self.size, _ODD, dtype=np.uint64))
        out = np.empty(len(start), dtype=np.uint64)
        for at in range(0, len(start), 1 << 14):
            some = data[start[at : at + (1 << 14), None] + np.arange(self.size)]
            out[at : at + (1 << 14)] = mix(((some.astype(np.uint64) + np.uint64(1)) * powers).sum(axis=1, dtype=np.uint64))
        return out


class Block:
    """A block's texts, ids and pieces."""

    def __init__(self, plan: Blocks, rows: pa.RecordBatch, id_place: int, text_place: int):
        self.plan, self.rows = plan, rows
        text = rows.column(text_place).cast(pa.large_binary())
        offsets = np.frombuffer(text.buffers()[1], dtype=np.int64)[text.offset : text.offset + len(text) + 1] if len(text) else np.zeros(1, dtype=np.int64)
        whole = np.frombuffer(text.buffers()[2], dtype=np.uint8) if text.buffers()[2] is not None else np.zeros(0, dtype=np.uint8)
        self.data, self.first = whole[offsets[0] : offsets[-1]], offsets - offsets[0]
        ids = rows.column(id_place)
        self.ids = np.asarray(ids.fill_null(0))
        self.start, self.windows, self.anchor, self.content = plan.pieces(self.data, self.first, np.asarray(ids.is_valid()))

    def docs(self, start: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, start, side="right") - 1

    def tags(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The block's anchors by shard: (anchor, shard, whether two documents hold it, its different pieces)."""
        ids = self.ids[self.docs(self.start)]
        order = np.lexsort((self.content, self.anchor))
        anchor, content, ids = self.anchor[order], self.content[order], ids[order]
        new = np.concatenate(([True], anchor[1:] != anchor[:-1]))[: len(anchor)]
        other = np.concatenate(([True], (content[1:] != content[:-1]) | new[1:]))[: len(anchor)]
        first = np.flatnonzero(new)
        if not len(first):
            return anchor, anchor.astype(np.int64), new, first
        several = np.minimum.reduceat(ids, first) != np.maximum.reduceat(ids, first)
        pieces = np.add.reduceat(other.astype(np.int64), first)
        shard = (anchor[first] % np.uint64(self.plan.shards)).astype(np.int64)
        by = np.argsort(shard, kind="stable")
        return anchor[first][by], shard[by], several[by], pieces[by]

    def candidates(self, answers: list[tuple[int, bytes]]) -> None:
        """Leaves the pieces that others may hold, by the shards' answers on :meth:`tags`."""
        anchor, shard, _, _ = self.tags()
        said = np.zeros(len(anchor), dtype=np.uint8)
        for s, codes in answers:
            said[np.searchsorted(shard, s) : np.searchsorted(shard, s, side="right")] = np.frombuffer(codes, dtype=np.uint8)
        order = np.argsort(anchor)
        code = said[order][np.searchsorted(anchor[order], self.anchor)] if len(anchor) else said
        keep = code > 0
        hot = code[keep] == 2
        start, windows, anchor, content = (c[keep] for c in (self.start, self.windows, self.anchor, self.content))
        n = windows[hot]
        alone = np.repeat(start[hot], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        single = self.plan.windows(self.data, alone)
        self.start = np.concatenate((start[~hot], alone))
        self.windows = np.concatenate((windows[~hot], np.ones(len(alone), dtype=np.int64)))
        self.anchor, self.content = np.concatenate((anchor[~hot], single)), np.concatenate((content[~hot], single))

    def different(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number of each piece's text, a piece of each text, shard of each text), texts ordered by shard and anchor."""
        shard = self.anchor % np.uint64(self.plan.shards)
        lengths = self.windows + (self.plan.size - 1)
        order, first = _classes(self.data, self.start, lengths, self.anchor, self.content, shard)
        number = np.empty(len(order), dtype=np.int64)
        number[order] = np.cumsum(first) - 1
        example = order[first]
        return number, example, shard[example].astype(np.int64)


def _gather(data: np.ndarray, start: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The stretches one behind the other."""
    end = np.cumsum(lengths)
    return data[np.repeat(start - (end - lengths), lengths) + np.arange(int(end[-1]) if len(end) else 0)]


def _classes(data: np.ndarray, start: np.ndarray, lengths: np.ndarray, anchor: np.ndarray, content: np.ndarray, shard: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(order, first): stretches by shard, anchor and text, and where each text begins in that order.

    Texts are told apart by hash; each is compared with the one before it, and if any differs in
    spite of the hash, all are ordered by their bytes.
    """
    keys = (content, anchor) if shard is None else (content, anchor, shard)
    order = np.lexsort(keys)
    first = np.ones(len(order), dtype=bool)
    first[1:] = (content[order[1:]] != content[order[:-1]]) | (anchor[order[1:]] != anchor[order[:-1]])
    again = np.flatnonzero(~first)
    for at in range(0, len(again), 1 << 14):
        a, b = order[again[at : at + (1 << 14)]], order[again[at : at + (1 << 14)] - 1]
        if (lengths[a] != lengths[b]).any() or (_gather(data, start[a], lengths[a]) != _gather(data, start[b], lengths[a])).any():
            known: dict[bytes, int] = {}
            exact = [known.setdefault(data[s : s + n].tobytes(), len(known)) for s, n in zip(start.tolist(), lengths.tolist(), strict=True)]
            return _classes(data, start, lengths, anchor, np.array(exact, dtype=np.uint64), shard)
    return order, first


def _packed(inner: DataFrame, text_place: int) -> DataFrame:
    """(block, bytes, rows): rows in blocks of about BLOCK_BYTES of text, as Arrow streams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        number = (context.partitionId() if context else 0) << 32
        held: list[pa.RecordBatch] = []
        size = 0

        def flush() -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema) as stream:
                for part in held:
                    stream.write_batch(part)
            rows = sink.getvalue().to_pybytes()
            return pa.RecordBatch.from_arrays([pa.array([number]), pa.array([size]), pa.array([rows], type=pa.binary())], names=["block", "bytes", "rows"])

        for batch in batches:
            lengths = np.asarray(pa.compute.binary_length(batch.column(text_place)).fill_null(0), dtype=np.int64)
            at = 0
            while at < len(batch):
                ends = np.cumsum(lengths[at:])
                take = max(1, int(np.searchsorted(ends, BLOCK_BYTES - size, side="right")))
                held.append(batch.slice(at, take))
                size += int(ends[take - 1])
                at += take
                if size >= BLOCK_BYTES or at < len(batch):
                    yield flush()
                    held, size, number = [], 0, number + 1
        if held:
            yield flush()

    return inner.mapInArrow(run, "block long, bytes long, rows binary")


def _opened(rows: pa.Scalar) -> pa.RecordBatch:
    table = pa.ipc.open_stream(rows.as_buffer()).read_all().combine_chunks()
    return table.to_batches()[0]


def _bytes_of(a: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """The array's parts between the cuts, as binaries."""
    return pa.array([a[x:y].tobytes() for x, y in zip(cuts[:-1], cuts[1:], strict=True)], type=pa.binary())


def _answer(tags: list[np.ndarray], several: list[np.ndarray], pieces: list[np.ndarray], hot: int) -> list[np.ndarray]:
    """For each block's tags: 0 where no other document holds them, else 1, or 2 if they have many different pieces."""
    whole, n = np.unique(np.concatenate(tags), return_inverse=True)
    shared = (np.bincount(n, minlength=len(whole)) > 1) | (np.bincount(n, weights=np.concatenate(several), minlength=len(whole)) > 0)
    many = np.bincount(n, weights=np.concatenate(pieces), minlength=len(whole)) > hot
    code = np.where(shared, np.where(many, 2, 1), 0).astype(np.uint8)[n]
    return np.split(code, np.cumsum([len(t) for t in tags])[:-1])


def _decided(size: int, data: np.ndarray, lengths: np.ndarray, anchor: np.ndarray, content: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For pieces of whole anchors: the least document that holds the piece, and bits of the windows that a smaller one holds."""
    start = np.cumsum(lengths) - lengths
    order, first = _classes(data, start, lengths, anchor, content)
    number = np.empty(len(order), dtype=np.int64)
    number[order] = np.cumsum(first) - 1
    example = order[first]
    low = np.minimum.reduceat(least[order], np.flatnonzero(first))
    bits = np.zeros(len(low), dtype=np.int64)
    # anchors of several texts, in collections of whole anchors
    group = np.flatnonzero(np.concatenate(([True], anchor[example][1:] != anchor[example][:-1])))
    count = np.diff(np.append(group, len(example)))
    group, count = group[count > 1], count[count > 1]
    at = 0
    while at < len(group):
        to = max(at + 1, int(np.searchsorted(np.cumsum(count[at:]), COLLECTION, side="right")) + at)
        mine = np.repeat(group[at:to], count[at:to]) + np.arange(int(count[at:to].sum())) - np.repeat(np.cumsum(count[at:to]) - count[at:to], count[at:to])
        bits[mine] = _held_before(size, _gather(data, start[example[mine]], lengths[example[mine]]), lengths[example[mine]], low[mine])
        at = to
    return low[number], bits[number]


def _held_before(size: int, data: np.ndarray, lengths: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Bits of each piece's windows that occur in a piece of a smaller document."""
    found = bwt.build(data, lengths)
    group = np.cumsum(found.common < size) - 1
    rows = [(docs, np.full(len(docs), n), at) for n, docs, at in found.rows() if n >= size]
    docs, n, at = (np.concatenate(c) for c in zip(*rows, strict=True))
    least = np.full(int(group[-1]) + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, group[at], low[docs])
    earlier = least[group[at]] < low[docs]
    out = np.zeros(len(lengths), dtype=np.int64)
    np.add.at(out, docs[earlier], np.int64(1) << (lengths[docs[earlier]] - n[earlier]))
    return out


def remove_repeats(df: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 50, hot: int = HOT) -> DataFrame:
    """``df`` with ``spans`` (array of start, end: what goes from the text's bytes) and ``kept`` (the bytes left).

    A byte goes if a string of ``size`` bytes covers it that also starts in a row with a smaller id.
    Strings are those of the texts in UTF-8 as they came, and never cross rows; what is left may
    cut a character in two, so that it is binary.

    Ids are whole numbers; rows of one id are one document: none of them removes from another.  A row
    without an id neither loses anything nor counts for others.  A null text is an empty one; texts of
    fewer than ``size`` bytes stay; an empty table stays empty.  Where ``df`` has columns of these names,
    the new ones get underscores behind theirs.
    """
    spark = df.sparkSession
    ws = Workspace(spark, "suffixdup")
    if size < 3:
        raise ValueError("size must be 3 at least")
    names = df.columns
    places = names.index(doc_id), names.index(text)
    inner = numbered(df)
    inner = inner.withColumn(f"_in_{places[0]}", F.col(f"_in_{places[0]}").cast("long"))

    # bucketed by block: joins with it move the other side only
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"packed_{uuid.uuid4().hex}"
    _packed(inner, places[1]).write.format("parquet").bucketBy(parts, "block").option("path", f"{ws.root}/packed").saveAsTable(table)
    packed = spark.table(table)
    total = packed.agg(F.sum("bytes")).first()[0] or 0
    plan = Blocks(size, hot, max(1, -(-total // SHARD_BYTES)))

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, rows in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                anchor, shard, several, pieces = Block(plan, _opened(rows), *places).tags()
                cuts = np.flatnonzero(np.concatenate(([True], shard[1:] != shard[:-1], [True]))) if len(shard) else np.zeros(1, dtype=np.int64)
                columns = [(anchor >> np.uint64(32)).astype(np.uint32), several, np.minimum(pieces, 65535).astype(np.uint16)]
                yield pa.RecordBatch.from_arrays([pa.array(shard[cuts[:-1]].astype(np.int32)), pa.array([number] * (len(cuts) - 1), type=pa.int64()), *(_bytes_of(c, cuts) for c in columns)], names=["shard", "block", "tags", "several", "pieces"])

    def answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, rows in _by_shard(batches):
            tags, several, pieces = ([np.frombuffer(b, dtype=t) for b in c] for c, t in zip(rows[1:], (np.uint32, bool, np.uint16), strict=True))
            codes = _answer(tags, several, pieces, plan.hot)
            yield pa.RecordBatch.from_arrays([pa.array([shard] * len(codes), type=pa.int32()), pa.array(rows[0], type=pa.int64()), pa.array([c.tobytes() for c in codes], type=pa.binary())], names=["shard", "block", "codes"])

    tags = packed.select("block", "rows").mapInArrow(sent, "shard int, block long, tags binary, several binary, pieces binary")
    answers = tags.repartitionById(plan.shards, "shard").mapInArrow(answered, "shard int, block long, codes binary")
    answers = ws.keep(answers.groupBy("block").agg(F.collect_list(F.struct("shard", "codes")).alias("answers")), "answers")

    def candidates(batch: pa.RecordBatch, i: int) -> Block:
        block = Block(plan, _opened(batch.column(1)[i]), *places)
        block.candidates([(a["shard"], a["codes"]) for a in batch.column(2)[i].as_py() or []])
        return block

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, number in enumerate(batch.column(0).to_pylist()):
                block = candidates(batch, i)
                which, example, shard = block.different()
                low = np.full(len(example), np.iinfo(np.int64).max)
                np.minimum.at(low, which, block.ids[block.docs(block.start)])
                lengths = block.windows[example] + (size - 1)
                texts = _gather(block.data, block.start[example], lengths)
                cuts = np.flatnonzero(np.concatenate(([True], shard[1:] != shard[:-1], [True]))) if len(shard) else np.zeros(1, dtype=np.int64)
                at = np.concatenate(([0], np.cumsum(lengths)))[cuts]
                columns = [_bytes_of(c, cuts) for c in (block.anchor[example], block.content[example], low, lengths.astype(np.uint32))]
                yield pa.RecordBatch.from_arrays([pa.array(shard[cuts[:-1]].astype(np.int32)), pa.array([number] * (len(cuts) - 1), type=pa.int64()), *columns, _bytes_of(texts, at)], names=["shard", "block", "anchor", "content", "low", "lengths", "texts"])

    def sorted_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, rows in _by_shard(batches):
            anchor, content, low, lengths, texts = (np.concatenate([np.frombuffer(b, dtype=t) for b in c]) for c, t in zip(rows[1:], (np.uint64, np.uint64, np.int64, np.uint32, np.uint8), strict=True))
            least, bits = _decided(size, texts, lengths.astype(np.int64), anchor, content, low)
            cuts = np.concatenate(([0], np.cumsum([len(b) // 8 for b in rows[1]])))
            yield pa.RecordBatch.from_arrays([pa.array([shard] * len(rows[0]), type=pa.int32()), pa.array(rows[0], type=pa.int64()), _bytes_of(least, cuts), _bytes_of(bits.astype(np.uint32), cuts)], names=["shard", "block", "least", "bits"])

    asked = packed.select("block", "rows").join(answers, "block")
    pieces = asked.mapInArrow(dealt, "shard int, block long, anchor binary, content binary, low binary, lengths binary, texts binary")
    decided = pieces.repartitionById(plan.shards, "shard").mapInArrow(sorted_, "shard int, block long, least binary, bits binary")
    decided = decided.groupBy("block").agg(F.collect_list(F.struct("shard", "least", "bits")).alias("decided"))
    decided = ws.keep(answers.join(decided, "block", "left"), "decided")
    ws.drop("answers")

    spans, kept = free(df, "spans"), free(df, "kept")
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    schema = T.StructType([*inner.schema, T.StructField("_spans", span), T.StructField("_kept", T.BinaryType())])
    arrow = to_arrow_schema(schema)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                block = candidates(batch, i)
                gone = _removed(block, [(d["shard"], d["least"], d["bits"]) for d in batch.column(3)[i].as_py() or []])
                before = np.concatenate(([0], np.cumsum(~gone)))[block.first]
                left = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(before) - 1, [None, pa.py_buffer(before.astype(np.int64)), pa.py_buffer(block.data[~gone])]).cast(pa.binary())
                begins, ends = gone.copy(), gone.copy()
                begins[1:] &= ~gone[:-1]
                ends[:-1] &= ~gone[1:]
                inner_cuts = block.first[(block.first > 0) & (block.first < len(gone))]
                begins[inner_cuts] = gone[inner_cuts]
                ends[inner_cuts - 1] = gone[inner_cuts - 1]
                begin, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
                doc = block.docs(begin)
                struct = pa.StructArray.from_arrays([pa.array(begin - block.first[doc]), pa.array(end - block.first[doc])], names=["start", "end"])
                at = np.searchsorted(begin, block.first).astype(np.int32)
                columns = [*block.rows.columns, pa.ListArray.from_arrays(pa.array(at), struct).cast(kind), left]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    out = packed.select("block", "rows").join(decided, "block", "left").select("rows", "block", "answers", "decided").select("block", "rows", "answers", "decided").mapInArrow(cut, schema)
    return named(out, names, F.col("_spans").alias(spans), F.col("_kept").alias(kept))


def _by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[list]]]:
    """Each shard of a partition with the columns of its rows, blocks first."""
    shards: dict[int, list[list]] = {}
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        for i, shard in enumerate(columns[0]):
            mine = shards.setdefault(shard, [[] for _ in columns[1:]])
            for to, c in zip(mine, columns[1:], strict=True):
                to.append(c[i])
    yield from shards.items()


def _removed(block: Block, decided: list[tuple[int, bytes, bytes]]) -> np.ndarray:
    """Which of the block's bytes go."""
    number, _, shard = block.different()
    least, bits = np.full(len(shard), np.iinfo(np.int64).max), np.zeros(len(shard), dtype=np.uint32)
    for s, low, some in decided:
        here = slice(np.searchsorted(shard, s), np.searchsorted(shard, s, side="right"))
        least[here], bits[here] = np.frombuffer(low, dtype=np.int64), np.frombuffer(some, dtype=np.uint32)
    ids = block.ids[block.docs(block.start)]
    change = np.zeros(len(block.data) + 1, dtype=np.int64)
    later = ids > least[number]
    np.add.at(change, block.start[later], 1)
    np.add.at(change, block.start[later] + block.windows[later] + block.plan.size - 1, -1)
    some = np.flatnonzero(~later & (bits[number] > 0))
    for w in range(block.plan.span):
        one = some[(bits[number[some]] >> np.uint32(w)) & np.uint32(1) > 0]
        np.add.at(change, block.start[one] + w, 1)
        np.add.at(change, block.start[one] + w + block.plan.size, -1)
    return np.cumsum(change[:-1]) > 0
