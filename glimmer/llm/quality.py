"""Quality classification by ordinal cumulative-link regression on hashed text.

Graded ratings (0, 1, ... K - 1) share one vector of weights over hashed words and a few
markers of a text's form; ordered thresholds cut the resulting score:
P(grade <= k) = 1 / (1 + exp(score - threshold_k)).  This gives an expected grade and tail
probabilities P(grade >= k), by which documents are selected.

A word, and the first PREFIX bytes of a word, counts once a text (A-Z lowered, split at
ASCII characters that are neither letter nor digit); the score takes the mean weight of
those that have one, since few bad words make a text no better than many.  Markers are rates of repeated neighbours, of ASCII symbols, digits and line
ends, and the mean length of words.  Weights are fitted in numpy on at most MAX_LABELLED
rated texts, those with the smallest hashes; only words get one whose frequency in some
grade is far above chance, so that long texts gather no noise.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columns import add_columns, named, numbered, slices
from .texthash import word_hashes

#: Bits of a word's hash; and of the table that tells most words without a weight.
BITS, TABLE = 30, 18
#: Bytes of a word's beginning that are a feature of their own.
PREFIX = 4
#: Rated texts that fitting sees at most.
MAX_LABELLED = 12_000
#: Words get a weight if they are in so many rated texts, and in some grade this many standard deviations and times above chance.
LEAST_TEXTS, TELLING, LIFT = 5, 6.0, 3
#: Weight below which a word is left out of the next fit, and number of fits.
LEAST_WEIGHT, FITS = 1.0, 3
#: Passes of gradient descent.
ROUNDS = 300
#: A document is kept if it reaches the best grade with this probability.
KEEP = 0.65

_SEPARATORS = np.ones(256, dtype=bool)
_SEPARATORS[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
_SYMBOLS = [b for b in range(0x21, 0x7F) if not chr(b).isalnum()]
MARKERS = len(_SYMBOLS) + 4


def markers(text: str, words: np.ndarray) -> np.ndarray:
    """Rates of a text's form, as log(1 + 100 rate), and of repeated neighbours."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    counts = np.bincount(data, minlength=256)
    n, w = max(1, len(data)), max(1, len(words))
    repeats = (words[1:] == words[:-1]).sum() / (w + 20)
    rates = [*(counts[_SYMBOLS] / n), counts[0x30:0x3A].sum() / n, counts[10] / n, n / w / 100]
    # repeats are frequent in clean texts too: their rate isn't stretched near zero
    return np.append(np.log1p(100 * np.array(rates)), 5 * repeats).astype(np.float32)


def _hashed(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each text the hashes of its words, and the buckets of words and of their beginnings."""
    for words, starts in zip(word_hashes(texts, _SEPARATORS), word_hashes(texts, _SEPARATORS, PREFIX), strict=True):
        both = np.concatenate((words, starts * np.uint64(0x9E3779B97F4A7C15)))
        yield words, (both >> np.uint64(64 - BITS)).astype(np.int32)


@dataclass
class Model:
    grades: int
    buckets: np.ndarray
    weights: np.ndarray
    markers: np.ndarray
    thresholds: np.ndarray

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= 1), P(grade >= 2), ... of each score."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None] - score[:, None], -500, 500)))

    def scores(self, texts: list[str]) -> np.ndarray:
        out = np.empty(len(texts))
        table = np.zeros(1 << TABLE, dtype=bool)
        table[self.buckets >> (BITS - TABLE)] = True
        for i, (text, (words, b)) in enumerate(zip(texts, _hashed(texts), strict=True)):
            there = np.isin(self.buckets, b[table[b >> (BITS - TABLE)]])
            out[i] = self.weights[there].sum() / max(1, there.sum()) + markers(text, words) @ self.markers
        return out


def _telling(grade: np.ndarray, rows: np.ndarray, buckets: np.ndarray, k: int) -> np.ndarray:
    """Buckets far more frequent in some grade than chance explains, in number and in share."""
    size = int(buckets.max()) + 1 if len(buckets) else 0
    share = np.bincount(grade, minlength=k) / len(grade)
    counts = np.stack([np.bincount(buckets[grade[rows] == g], minlength=size) for g in range(k)])
    total = counts.sum(axis=0)
    expected = total[None] * share[:, None]
    surely = (counts - expected) / np.sqrt(expected * (1 - share)[:, None] + 1e-9) >= TELLING
    mostly = counts >= total[None] * np.minimum(LIFT * share, (1 + share) / 2)[:, None]
    return (total >= LEAST_TEXTS) & (surely & mostly).any(axis=0)


def fit_model(grade: np.ndarray, rows: np.ndarray, buckets: np.ndarray, forms: np.ndarray, rounds: int = ROUNDS) -> Model:
    """Maximum likelihood with weight decay; ``rows`` and ``buckets`` are the texts' distinct words.

    The first fits find the words that matter, the last one weighs them alone.
    """
    k = int(grade.max()) + 1
    names, buckets = np.unique(buckets, return_inverse=True)
    names, rows, buckets = _only(_telling(grade, rows, buckets, k), names, rows, buckets)
    for _ in range(FITS - 1):
        before = _descend(grade, rows, buckets, len(names), forms, rounds)
        names, rows, buckets = _only(np.abs(before.weights) >= LEAST_WEIGHT, names, rows, buckets)
    model = _descend(grade, rows, buckets, len(names), forms, rounds)
    model.buckets = names
    return model


def _only(kept: np.ndarray, names: np.ndarray, rows: np.ndarray, buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words that are kept, numbered anew."""
    there = kept[buckets]
    return names[kept], rows[there], (np.cumsum(kept) - 1)[buckets[there]]


def _descend(grade: np.ndarray, rows: np.ndarray, buckets: np.ndarray, size: int, forms: np.ndarray, rounds: int) -> Model:
    """One fit by Adam of ``size`` words' weights, the markers' weights and the thresholds."""
    k, n = int(grade.max()) + 1, len(grade)
    share_of = 1 / np.maximum(1, np.bincount(rows, minlength=n))[rows]
    center, spread = forms.mean(axis=0), forms.std(axis=0) + 1e-6
    z = (forms - center) / spread
    share = np.clip(np.cumsum(np.bincount(grade, minlength=k))[:-1] / n, 1e-3, 1 - 1e-3)
    start = np.log(share / (1 - share))
    # thresholds: the first, and logarithms of the steps to the next ones
    parts = [np.zeros(size), np.zeros(forms.shape[1]), np.concatenate((start[:1], np.log(np.maximum(np.diff(start), 0.1))))]
    first, second = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts]
    for t in range(1, rounds + 1):
        w, m, cut = parts
        theta = np.concatenate((cut[:1], cut[0] + np.cumsum(np.exp(cut[1:]))))
        s = np.bincount(rows, weights=w[buckets] * share_of, minlength=n) + z @ m
        below = np.concatenate((np.zeros((n, 1)), 1 / (1 + np.exp(np.clip(s[:, None] - theta[None], -500, 500))), np.ones((n, 1))), axis=1)
        up, low = below[np.arange(n), grade + 1], below[np.arange(n), grade]
        p = np.maximum(up - low, 1e-12)
        ds = -(up + low - 1)
        dtheta = np.zeros(k - 1)
        np.add.at(dtheta, np.minimum(grade, k - 2), np.where(grade < k - 1, -up * (1 - up) / p, 0))
        np.add.at(dtheta, np.maximum(grade - 1, 0), np.where(grade > 0, low * (1 - low) / p, 0))
        dcut = np.concatenate(([dtheta.sum()], [dtheta[j:].sum() * np.exp(cut[j]) for j in range(1, k - 1)]))
        grads = [np.bincount(buckets, weights=ds[rows] * share_of, minlength=size) + 0.1 * w, z.T @ ds + 0.1 * m, dcut]
        for q, g, a, b in zip(parts, grads, first, second, strict=True):
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            q -= 0.05 * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.99**t)) + 1e-8)
    w, m, cut = parts
    theta = np.concatenate((cut[:1], cut[0] + np.cumsum(np.exp(cut[1:]))))
    # scores are taken of plain markers, so that their centring goes into the thresholds
    return Model(k, np.zeros(0), w, m / spread, theta + (center / spread) @ m)


def grades_of(labels: DataFrame) -> DataFrame:
    """(doc_id, grade) of labels with quality and toxic: 0 poor, 1 toxic, 2 clean; the lowest of repeated ones."""
    grade = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).when(F.col("quality") == 1, 2)
    return labels.select("doc_id", grade.alias("grade")).where("doc_id is not null and grade is not null").groupBy("doc_id").agg(F.min("grade").alias("grade"))


def fit(docs: DataFrame, rated: DataFrame, doc_id: str = "doc_id", text: str = "text", most: int = MAX_LABELLED) -> Model | None:
    """A model from texts and ``rated`` (doc_id, grade); None without texts of two grades."""
    chosen = rated.select(F.col("doc_id").alias("_id"), "grade").orderBy(F.xxhash64("_id"), "_id").limit(most)
    joined = docs.select(F.col(f"`{doc_id}`").alias("_id"), F.col(f"`{text}`").alias("text")).join(F.broadcast(chosen), "_id").where("text is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, batch.column(0)):
                texts = part.column(0).to_pylist()
                both = list(_hashed(texts))
                rows = [np.unique(b) for _, b in both]
                forms = [markers(t, w) for t, (w, _) in zip(texts, both, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(1), pa.array(rows, type=pa.list_(pa.int32())), pa.array(forms, type=pa.list_(pa.float32()))], names=["grade", "buckets", "forms"])

    found = joined.select("text", "grade").mapInArrow(run, "grade int, buckets array<int>, forms array<float>").where(F.size("buckets") > 0).toArrow()
    grade = np.asarray(found.column("grade"), dtype=np.int64)
    if len(np.unique(grade)) < 2:
        return None
    lists = found.column("buckets").combine_chunks()
    rows = np.repeat(np.arange(len(grade)), np.diff(np.asarray(lists.offsets)))
    forms = np.asarray(found.column("forms").combine_chunks().flatten(), dtype=np.float64).reshape(len(grade), MARKERS)
    return fit_model(grade, rows, np.asarray(lists.flatten()), forms)


_ADDED = "expected_grade double, tails array<double>"


def rate(df: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """``df`` with ``expected_grade`` and ``tails`` (P(grade >= 1), P(grade >= 2), ...).

    A null text, or one without words, has grade 0 for certain.  Without a model every
    other text has the one grade 1 for certain.
    """
    from pyspark.sql import types as T

    added = T.StructType([T.StructField("expected_grade", T.DoubleType()), T.StructField("tails", T.ArrayType(T.DoubleType()))])
    shared = df.sparkSession.sparkContext.broadcast(model)

    def compute(texts: list[str | None]):
        m: Model | None = shared.value
        worded = [i for i, w in enumerate(word_hashes(texts, _SEPARATORS)) if len(w)]
        k = 1 if m is None else m.grades - 1
        tails = np.zeros((len(texts), k))
        if worded:
            tails[worded] = 1.0 if m is None else m.tails(m.scores([texts[i] for i in worded]))
        return [tails.sum(axis=1), list(tails)]

    return add_columns(df, text, added, compute)


def select(df: DataFrame, model: Model | None, text: str = "text", keep: float = KEEP) -> DataFrame:
    """The rows of ``df`` that reach the best grade with probability ``keep`` or more."""
    rated = rate(numbered(df), model, f"_in_{df.columns.index(text)}")
    return named(rated.where(F.element_at("tails", -1) >= keep), df.columns)
