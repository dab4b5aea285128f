"""Language identification by a byte convolutional network, trained in numpy.

A text's UTF-8 bytes are cut into windows of fixed length, the last one padded with zero
bytes.  The network embeds bytes, applies filters of several widths, takes each filter's
maximum over the window and puts a softmax on top.  A document's probabilities are the
mean over all its windows, weighted by their bytes.

Training takes one window from each of at most ``per_lang`` labelled texts a language, those
with the smallest text hashes.  To predict, embedding and filters are folded into tables
by byte pairs, so that a filter costs two look-ups at most.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .columns import slices

WINDOW = 192
WIDTHS = (2, 3, 4)
FILTERS, EMBEDDED = 16, 8
#: Texts of a language that training sees at most, and passes over them.
PER_LANG, EPOCHS = 600, 8
UNKNOWN = "und"
#: Gradient steps at least, however few the texts.
STEPS = 300
#: Languages whose counts are broadcast; with more of them Spark chooses the join.
BROADCAST_LANGS = 10_000
#: Windows that are predicted together.
_GROUP = 256


@dataclass
class Network:
    langs: list[str]
    embedding: np.ndarray
    filters: list[np.ndarray]
    biases: list[np.ndarray]
    top: np.ndarray
    offset: np.ndarray

    @classmethod
    def fresh(cls, langs: list[str], seed: int) -> Network:
        rng = np.random.Generator(np.random.PCG64(seed))
        normal = lambda *shape, scale: rng.normal(size=shape).astype(np.float32) * np.float32(scale)
        return cls(
            langs,
            normal(256, EMBEDDED, scale=0.3),
            [normal(w * EMBEDDED, FILTERS, scale=(w * EMBEDDED) ** -0.5) for w in WIDTHS],
            [np.zeros(FILTERS, dtype=np.float32) for _ in WIDTHS],
            normal(len(WIDTHS) * FILTERS, len(langs), scale=0.1),
            np.zeros(len(langs), dtype=np.float32),
        )

    def parameters(self) -> list[np.ndarray]:
        return [self.embedding, *self.filters, *self.biases, self.top, self.offset]

    def step(self, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        """Gradients of the mean cross-entropy over windows ``x`` (n x WINDOW) with labels ``y``."""
        n = len(x)
        e = self.embedding[x]
        unfolded, pooled, at = [], [], []
        for w, f, b in zip(WIDTHS, self.filters, self.biases, strict=True):
            u = np.concatenate([e[:, j : WINDOW - w + 1 + j] for j in range(w)], axis=2)
            h = u @ f + b
            k = h.argmax(axis=1)
            unfolded.append(u)
            at.append(k)
            pooled.append(np.take_along_axis(h, k[:, None], axis=1)[:, 0])
        p = np.concatenate(pooled, axis=1)
        a = np.maximum(p, 0)
        d = _softmax(a @ self.top + self.offset)
        d[np.arange(n), y] -= 1
        d /= n
        top, offset = a.T @ d, d.sum(axis=0)
        da = (d @ self.top.T) * (p > 0)
        embedding = np.zeros_like(self.embedding)
        filters, biases = [], []
        for i, (w, f) in enumerate(zip(WIDTHS, self.filters, strict=True)):
            g = da[:, i * FILTERS : (i + 1) * FILTERS]
            k = at[i]
            rows = np.arange(n)[:, None]
            picked = unfolded[i][rows, k]  # n x FILTERS x (w * EMBEDDED)
            filters.append(np.einsum("nfk,nf->kf", picked, g))
            biases.append(g.sum(axis=0))
            back = (g[:, :, None] * f.T[None]).reshape(n, FILTERS, w, EMBEDDED)
            for j in range(w):
                np.add.at(embedding, x[rows, k + j], back[:, :, j])
        return [embedding, *filters, *biases, top, offset]

    def tables(self) -> list[tuple[np.ndarray, np.ndarray | None]]:
        """For each width the table of its first two bytes, and of the byte or two after them."""
        out = []
        for w, f, b in zip(WIDTHS, self.filters, self.biases, strict=True):
            one = [self.embedding @ f[j * EMBEDDED : (j + 1) * EMBEDDED] for j in range(w)]
            first = (one[0][:, None] + one[1][None] + b).reshape(65536, FILTERS)
            rest = None if w == 2 else one[2] if w == 3 else (one[2][:, None] + one[3][None]).reshape(65536, FILTERS)
            out.append((first, rest))
        return out


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(windows: np.ndarray, labels: np.ndarray, langs: list[str], epochs: int = EPOCHS, seed: int = 3) -> Network:
    """A network trained with Adam on windows (n x WINDOW bytes)."""
    net = Network.fresh(langs, seed)
    rng = np.random.Generator(np.random.PCG64(seed + 1))
    first = [np.zeros_like(p) for p in net.parameters()]
    second = [np.zeros_like(p) for p in net.parameters()]
    t = 0
    for _ in range(max(epochs, -(-STEPS // max(1, -(-len(windows) // 64))))):
        order = rng.permutation(len(windows))
        for at in range(0, len(order), 64):
            some = order[at : at + 64]
            t += 1
            rate = 0.004 * (1 - 0.999**t) ** 0.5 / (1 - 0.9**t)
            for p, g, m, v in zip(net.parameters(), net.step(windows[some], labels[some]), first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= (rate * m / (np.sqrt(v) + 1e-7)).astype(np.float32)
    return net


class Predictor:
    """A network folded into tables; lives in one Python worker."""

    def __init__(self, net: Network):
        self.net = net
        self.tables = net.tables()

    def windows(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of windows (n x WINDOW bytes)."""
        out = np.empty((len(x), len(self.net.langs)))
        for at in range(0, len(x), _GROUP):
            part = x[at : at + _GROUP]
            flat = part.reshape(-1)
            pairs = flat.astype(np.int32)
            pairs[:-1] = pairs[:-1] * 256 + flat[1:]
            pairs[-1] *= 256
            pooled = []
            for w, (one, two) in zip(WIDTHS, self.tables, strict=True):
                h = one.take(pairs, axis=0)
                if two is not None:
                    after = flat if w == 3 else pairs
                    h[:-2] += two.take(after[2:], axis=0)
                pooled.append(h.reshape(len(part), WINDOW, FILTERS)[:, : WINDOW - w + 1].max(axis=1))
            a = np.maximum(np.concatenate(pooled, axis=1), 0)
            out[at : at + _GROUP] = _softmax(a @ self.net.top + self.net.offset)
        return out

    def texts(self, data: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The best language's index and mean probability of each text."""
        counts = np.array([max(1, -(-len(d) // WINDOW)) for d in data])
        buffer = np.zeros(int(counts.sum()) * WINDOW, dtype=np.uint8)
        weights = np.full(int(counts.sum()), float(WINDOW))
        at = 0
        for d, k in zip(data, counts, strict=True):
            buffer[at * WINDOW : at * WINDOW + len(d)] = np.frombuffer(d, dtype=np.uint8)
            weights[at + k - 1] = max(1, len(d) - (k - 1) * WINDOW)
            at += k
        p = self.windows(buffer.reshape(-1, WINDOW)) * weights[:, None]
        starts = np.cumsum(counts) - counts
        total = np.add.reduceat(p, starts, axis=0) / np.add.reduceat(weights, starts)[:, None]
        best = total.argmax(axis=1)
        return best, np.clip(total[np.arange(len(data)), best], 0, 1)


def has_letter(text: str) -> F.Column:
    return F.coalesce(F.col(f"`{text}`").rlike(r"\p{L}"), F.lit(False))


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", per_lang: int = PER_LANG) -> Network | None:
    """A network learned from at most ``per_lang`` different texts a language; None without any.

    Rows without a language or a letter aren't looked at.
    """
    data = F.col(f"`{text}`").cast("binary")
    spare = F.greatest(F.length(data) - WINDOW + 1, F.lit(1))
    start = (F.pmod(F.xxhash64(F.lit(1), data), spare) + 1).cast("int")
    rows = labelled.where(has_letter(text) & F.col(f"`{lang}`").isNotNull()).select(F.col(f"`{lang}`").alias("lang"), F.xxhash64(data).alias("order"), F.substring(data, start, F.lit(WINDOW)).alias("window"))
    # copies count once, here too, and hashes are thinned before they are ranked, so that no language's rows meet in a task
    counts = rows.select("lang", "order").distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    if counts.limit(BROADCAST_LANGS + 1).count() <= BROADCAST_LANGS:
        counts = F.broadcast(counts)
    place = F.shiftrightunsigned("order", 11) / float(1 << 53)
    few = rows.join(counts, "lang").where(place < 4.0 * per_lang / F.col("n")).select("lang", "order", "window").dropDuplicates(["lang", "order"])
    ranked = few.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("order", "window"))).where(F.col("r") <= per_lang)
    found = sorted((r.lang, r.r, bytes(r.window)) for r in ranked.select("lang", "r", "window").collect())
    if not found:
        return None
    langs = sorted({x[0] for x in found})
    x = np.frombuffer(b"".join(w.ljust(WINDOW, b"\0") for _, _, w in found), dtype=np.uint8).reshape(-1, WINDOW)
    return train(x, np.array([langs.index(name) for name, _, _ in found]), langs)


#: The predictor of this worker, by a token that came with its network.
_predictors: dict[str, Predictor] = {}


def predict(df: DataFrame, net: Network | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred and score for every row, from its whole text alone.

    A null text, or one without a letter, is ``und`` with score 0; so is every text
    where there was nothing to learn from.
    """
    rows = df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.when(has_letter(text), F.col(f"`{text}`")).alias("text"))
    if net is None:
        return rows.select("doc_id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = df.sparkSession.sparkContext.broadcast((uuid4().hex, net))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token, net = shared.value
        if token not in _predictors:
            _predictors.clear()
            _predictors[token] = Predictor(net)
        model = _predictors[token]
        for batch in batches:
            for part in slices(batch, batch.column(1)):
                data = part.column(1).cast(pa.binary()).to_pylist()
                there = [i for i, d in enumerate(data) if d]
                names, scores = [UNKNOWN] * len(data), np.zeros(len(data))
                if there:
                    best, score = model.texts([data[i] for i in there])
                    scores[there] = score
                    for i, b in zip(there, best.tolist(), strict=True):
                        names[i] = model.net.langs[b]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names), pa.array(scores)], names=["doc_id", "lang_pred", "score"])

    return rows.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def held_out(doc_id: str = "doc_id") -> F.Column:
    """Whether a document is in the fold that nothing is learned from."""
    return F.crc32(F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit(""))) % 4 == 2
