"""BPE encoding and decoding by forced boundaries.

A pair of neighbouring bytes that occurs inside no token of the vocabulary can never
be merged, so the text is certainly cut there.  Words (as the file's splitting pattern
gives them) are cut at such pairs, the fragments are encoded independently, and their
ids are concatenated.  All different words of a slice of texts are merged together, one
merge of every fragment at a time, and remembered in two generations: when the young one
is full, it becomes the old one, whose words come back as they are met.  Nothing here
trains a tokenizer; the vocabulary file's path is a parameter, and its bounded contents
are broadcast.

Supported files: ``tokenizers`` JSON of a byte-level BPE with an end-of-word suffix, whose
normaliser is NFC, white space to one space, lower case, and whose splitting pattern
never matches white space.  Others raise ``ValueError``.

Defined cases: a null or empty text has no ids and decodes to the empty text; special
tokens written in a text count as themselves; lone surrogates can't occur in Spark strings.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from array import array
from collections.abc import Iterable
from functools import cached_property
from hashlib import sha256

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .columns import add_columns

#: Words in a generation of the words that each Python worker remembers, of at most so many characters each.
CACHE_WORDS, CACHE_LENGTH = 200_000, 64
#: Fragments of more bytes are merged one by one.
LONG = 64
#: Texts without these characters are split by Python's own tables, whose letters, digits and
#: white space are then the library's: controls that are no separators, ASCII, Latin letters, and punctuation.
_RARE = re.compile("[^\x00-\x1b\x20-\x7f\xa1\xab\xbb\xbf-\u024f\u2010-\u2027]")
_PLAIN = {r"[\p{L}]": r"[^\W\d_]", r"[\p{N}]": r"\d", r"[^\s\p{L}\p{N}]": r"(?:[^\s\w]|_)"}
_NONE = np.iinfo(np.int64).max
# Where the library's Unicode tables differ from those of this Python.
#: Letters and digits of newer tables that the library's splitter takes for symbols.
SYMBOLS = (
    "\\u0558 \\u058b-\\u058c \\u088f \\u0c5c \\u0cdc \\u208f \\u209d \\ua7ce-\\ua7cf \\ua7d2 \\ua7d4 \\ua7dd \\ua7e2 \\ua7f1 \\uab6c-\\uab6d "
    "\\U000107bb-\\U000107bf \\U00010940-\\U00010959 \\U00010ec5-\\U00010ec7 \\U00010ed9-\\U00010eee \\U00011b0a \\U00011db0-\\U00011ddb \\U00011de0-\\U00011de9 "
    "\\U00011df1 \\U0001246f \\U00012475-\\U0001247f \\U00012550-\\U00012686 \\U00016ea0-\\U00016eb8 \\U00016ebb-\\U00016ed3 \\U00016ff2-\\U00016ff6 \\U000187f8-\\U000187ff "
    "\\U00018cd6-\\U00018cda \\U00018d09-\\U00018d20 \\U00018d80-\\U00018df2 \\U00018e00-\\U00019191 \\U000191a0-\\U000191d2 \\U0001b123-\\U0001b128 \\U0001b168 "
    "\\U0001d6a6 \\U0001df1f-\\U0001df24 \\U0001df2b-\\U0001df81 \\U0001df90-\\U0001df96 \\U0001dfcd-\\U0001dfff \\U0001e6c0-\\U0001e6de \\U0001e6e0-\\U0001e6e2 "
    "\\U0001e6e4-\\U0001e6e5 \\U0001e6e7-\\U0001e6ed \\U0001e6f0-\\U0001e6f4 \\U0001e6fe-\\U0001e6ff \\U0002b73a-\\U0002b73f \\U0002b81e \\U0002cea2-\\U0002cead "
    "\\U000323b0-\\U00033479 \\U0003d000-\\U0003fc3f"
).replace(" ", "")
#: Lower-case letters that the library knows and this Python doesn't.
LOWERED = {
    0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B,
    **{c: c + 0x20 for c in range(0x10D50, 0x10D66)}, **{c: c + 0x1B for c in range(0x16EA0, 0x16EB9)},
}
_FIRST_PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]


def byte_characters() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies."""
    shown = set(_FIRST_PRINTABLE)
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class Vocabulary:
    """Tokens, merges and forced boundaries of one tokenizer file."""

    def __init__(self, file: str | bytes):
        spec = json.loads(file)
        #: names the contents, so that a worker can tell what it holds
        self.token = sha256(file if isinstance(file, bytes) else file.encode()).hexdigest()
        model = spec["model"]
        if model["type"] != "BPE" or not model.get("end_of_word_suffix") or model.get("continuing_subword_prefix"):
            raise ValueError("not a BPE vocabulary with an end-of-word suffix")
        steps = [s["type"] for s in spec["normalizer"]["normalizers"]]
        splits = [s["type"] for s in spec["pre_tokenizer"]["pretokenizers"]]
        if steps != ["NFC", "Replace", "Lowercase"] or splits != ["Split", "ByteLevel"] or spec.get("decoder"):
            raise ValueError("a normaliser, splitter or decoder that isn't supported")
        self.suffix: str = model["end_of_word_suffix"]
        self.ids: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        size = max([*self.ids.values(), *self.special.values()]) + 1
        self.tokens = [""] * size
        for token, i in (self.ids | self.special).items():
            self.tokens[i] = token
        self.merges: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges.setdefault(self.ids[a] << 32 | self.ids[b], (rank, self.ids[a + b]))

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        with open(path, "rb") as f:
            return cls(f.read())

    @cached_property
    def inside(self) -> frozenset[int]:
        """Byte pairs (first * 256 + second) that occur inside some token; all others force a cut."""
        byte_of = {c: b for b, c in enumerate(byte_characters())}
        pairs = set()
        for token in self.ids:
            codes = [byte_of[c] for c in token.removesuffix(self.suffix)]
            pairs.update(a * 256 + b for a, b in zip(codes, codes[1:], strict=False))
        return frozenset(pairs)


class Encoder:
    """Encodes and decodes texts; lives in one Python worker."""

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        chars = byte_characters()
        self.plain = np.array([vocab.ids[c] for c in chars], dtype=np.int64)
        self.final = np.array([vocab.ids[c + vocab.suffix] for c in chars], dtype=np.int64)
        self.all_words = regex.compile(self._known(vocab.pattern), regex.V1)
        self.plain_words = self._by_own_tables(vocab.pattern)
        self.special = regex.compile("(" + "|".join(map(regex.escape, vocab.special)) + ")") if vocab.special else None
        self.inside = np.zeros(65536, dtype=bool)
        self.inside[list(vocab.inside)] = True
        pairs = sorted(vocab.merges)
        self.pairs = np.array([*pairs, _NONE], dtype=np.int64)
        self.ranks = np.array([*(vocab.merges[p][0] for p in pairs), _NONE], dtype=np.int64)
        self.made = np.zeros(1 + max((m[0] for m in vocab.merges.values()), default=0), dtype=np.int64)
        for rank, made in vocab.merges.values():
            self.made[rank] = made
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    @staticmethod
    def _by_own_tables(pattern: str) -> re.Pattern | None:
        """The pattern for texts without rare characters; None where it names other classes."""
        for theirs, ours in _PLAIN.items():
            pattern = pattern.replace(theirs, ours)
        return None if r"\p" in pattern else re.compile(pattern)

    @staticmethod
    def _known(pattern: str) -> str:
        """The pattern with the letters and digits of the library's tables."""
        for kind in (r"\p{L}", r"\p{N}"):
            pattern = pattern.replace(kind, f"[{kind}--[{SYMBOLS}]]")
        return pattern

    def _merged_long(self, ids: list[int]) -> list[int]:
        """Merges the lowest rank first, the leftmost of equal ranks, with a heap over a linked list."""
        merges = self.vocab.merges
        n = len(ids)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap: list[tuple[int, int, int, int]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j >= 0 and (m := merges.get(ids[i] << 32 | ids[j])):
                heapq.heappush(heap, (m[0], i, ids[i], ids[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = merges[a << 32 | b][1], -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [x for x in ids if x >= 0]

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The ranks of pairs, _NONE where they don't merge."""
        pair = a << 32 | b
        at = np.searchsorted(self.pairs, pair)
        return np.where(self.pairs[at] == pair, self.ranks[at], _NONE)

    def _merged(self, ids: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merged ids of fragments that lie one after another, and the fragment of each.

        ``cut`` tells where a fragment begins.  In each turn every fragment merges its lowest
        rank, the leftmost of equal ones; those that can't merge any more leave.
        """
        fragment = np.cumsum(cut) - 1
        rank = np.full(len(ids), _NONE)
        rank[:-1] = np.where(cut[1:], _NONE, self._rank(ids[:-1], ids[1:]))
        done_ids, done_fragment = [], []
        while len(ids):
            starts = np.flatnonzero(np.concatenate(([True], fragment[1:] != fragment[:-1])))
            sizes = np.diff(np.append(starts, len(ids)))
            lowest = np.minimum.reduceat(rank, starts)
            stays = np.repeat(lowest != _NONE, sizes)
            if not stays.all():
                done_ids.append(ids[~stays])
                done_fragment.append(fragment[~stays])
            at = np.flatnonzero((rank == np.repeat(lowest, sizes)) & stays)
            if not len(at):
                break
            at = at[np.concatenate(([True], fragment[at[1:]] != fragment[at[:-1]]))]
            ids[at] = self.made[rank[at]]
            stays[at + 1] = False
            place = np.cumsum(stays) - 1
            ids, fragment, rank, at = ids[stays], fragment[stays], rank[stays], place[at]
            # only the pairs before and behind what was merged have changed
            last = len(ids) - 1
            behind = np.minimum(at + 1, last)
            rank[at] = np.where((at < last) & (fragment[behind] == fragment[at]), self._rank(ids[at], ids[behind]), _NONE)
            before = at[(at > 0)]
            before = before[fragment[before - 1] == fragment[before]]
            rank[before - 1] = self._rank(ids[before - 1], ids[before])
        return np.concatenate(done_ids), np.concatenate(done_fragment)

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Ids (little-endian, 32 bits each) of words as the pattern gives them; none is empty."""
        if not words:
            return []
        data = [w.encode("utf-8", "surrogatepass") for w in words]
        ends = np.cumsum([len(d) for d in data])
        raw = np.frombuffer(b"".join(data), dtype=np.uint8).astype(np.int64)
        ids = self.plain[raw]
        ids[ends - 1] = self.final[raw[ends - 1]]
        cut = np.ones(len(raw), dtype=bool)
        cut[1:] = ~self.inside[raw[:-1] * 256 + raw[1:]]
        cut[ends[:-1]] = True
        starts = np.flatnonzero(cut)
        sizes = np.diff(np.append(starts, len(raw)))
        long = np.flatnonzero(sizes > LONG)
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        for f in long.tolist():
            some = self._merged_long(ids[starts[f] : starts[f] + sizes[f]].tolist())
            parts.append((np.array(some, dtype=np.int64), np.full(len(some), f)))
        short = np.repeat(sizes <= LONG, sizes)
        if short.any():
            number = np.flatnonzero(sizes <= LONG)
            found, fragment = self._merged(ids[short], cut[short])
            parts.append((found, number[fragment]))
        fragment = np.concatenate([p[1] for p in parts])
        order = np.argsort(fragment, kind="stable")
        flat = np.concatenate([p[0] for p in parts])[order].astype("<u4").tobytes()
        word = np.searchsorted(ends, starts, side="right")
        until = 4 * np.cumsum(np.bincount(word[fragment], minlength=len(words)))
        out, at = [], 0
        for e in until.tolist():
            out.append(flat[at:e])
            at = e
        return out

    def _split(self, text: str) -> list[str]:
        """The words of a text that holds no special token."""
        lower = unicodedata.normalize("NFC", text)
        if self.plain_words is not None and not _RARE.search(lower):
            return self.plain_words.findall(lower.lower())
        return self.all_words.findall(lower.replace("Σ", "σ").lower().translate(LOWERED))

    def _remember(self, words: Iterable[list[str]]) -> dict[str, bytes]:
        """The ids of all these words; those of short ones stay for later texts."""
        missing = set().union(*words) - self.young.keys()
        if len(self.young) + len(missing) > CACHE_WORDS:
            self.old, self.young = self.young, {}
            missing = set().union(*words)
        new = {}
        for w in missing:
            ids = self.old.get(w)
            if ids is not None:
                self.young[w] = ids
            else:
                new[w] = None
        new = dict(zip(new, self.encode_words(list(new)), strict=True))
        long = {w: ids for w, ids in new.items() if len(w) > CACHE_LENGTH}
        self.young.update(new)
        return long

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        special = self.vocab.special
        pieces: list[list[str] | bytes] = []
        of_text = []
        for text in texts:
            before = len(pieces)
            if text and self.special is not None and "<" in text and self.special.search(text):
                for part in self.special.split(text):
                    i = special.get(part)
                    pieces.append(self._split(part) if i is None else array("I", [i]).tobytes())
            elif text:
                pieces.append(self._split(text))
            of_text.append((before, len(pieces)))
        long = self._remember([p for p in pieces if isinstance(p, list)])
        ids = self.young.__getitem__
        coded = [p if isinstance(p, bytes) else b"".join(map(ids, p)) for p in pieces]
        for w in long:
            del self.young[w]
        return [coded[a] if b - a == 1 else b"".join(coded[a:b]) for a, b in of_text]

    def encode(self, text: str | None) -> bytes:
        """The ids of one text."""
        return self.encode_all([text])[0]

    def decode(self, ids: bytes | None) -> str:
        """Tokens joined by spaces, as the library does where a file names no decoder."""
        return " ".join(map(self.vocab.tokens.__getitem__, array("I", ids or b"")))


_encoders: dict[str, Encoder] = {}


def _encoder(shared) -> Encoder:
    vocab = shared.value
    if vocab.token not in _encoders:
        _encoders.clear()
        _encoders[vocab.token] = Encoder(vocab)
    return _encoders[vocab.token]


def encode_decode(df: DataFrame, vocab: Vocabulary, text: str = "text", ids: str = "ids", decoded: str | None = "decoded", keep: list[str] | None = None) -> DataFrame:
    """``df`` with ``ids`` (binary, little-endian 32-bit) and, if named, the text decoded from them."""
    shared = df.sparkSession.sparkContext.broadcast(vocab)
    added = T.StructType([T.StructField(ids, T.BinaryType()), *[T.StructField(decoded, T.StringType())] * bool(decoded)])

    def compute(texts: list[str | None]):
        coder = _encoder(shared)
        codes = coder.encode_all(texts)
        return [codes, [coder.decode(c) for c in codes]] if decoded else [codes]

    return add_columns(df, text, added, compute, keep)


def decode(df: DataFrame, vocab: Vocabulary, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``df`` with the text of its binary ids; null ids decode to the empty text."""
    shared = df.sparkSession.sparkContext.broadcast(vocab)

    def compute(codes: list[bytes | None]):
        coder = _encoder(shared)
        return [[coder.decode(c) for c in codes]]

    return add_columns(df, ids, T.StructType([T.StructField(decoded, T.StringType())]), compute)


def DEFAULT_FILE() -> str:  # noqa: N802
    """Path of the word-end vocabulary on this machine."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encode_decode_digests(df: DataFrame, vocab: Vocabulary, text: str = "text", names: tuple[str, str, str] = ("n_tokens", "ids_sha256", "decoded_sha256")) -> DataFrame:
    """``df`` with the number of tokens and the digests of ids and decoded text, by ``names``.

    Columns of ``df`` with one of these names give way to them.  The ids and the decoded text stay inside the task, so that only digests leave it.
    """
    shared = df.sparkSession.sparkContext.broadcast(vocab)
    added = T.StructType([T.StructField(n, t) for n, t in zip(names, (T.LongType(), T.StringType(), T.StringType()), strict=True)])

    def compute(texts: list[str | None]):
        coder = _encoder(shared)
        codes = coder.encode_all(texts)
        return [[len(c) // 4 for c in codes], [sha256(c).hexdigest() for c in codes], [sha256(coder.decode(c).encode()).hexdigest() for c in codes]]

    return add_columns(df, text, added, compute)
