"""Licence scan by a positional index of rare words (DataFrame functions only).

Templates are short word sequences; their words are the licence words.  One pass over the
texts finds each file's licence words, and where they stand in files that hold all words
of some key phrase; no other file can match.  What it finds is written and is small; the
document frequencies of licence words are counted from it.  The index lists where each word
stands in which templates.  Of each file its highest-IDF licence words are looked up there,
as many as it takes to meet a word of the key phrase of every template whose key phrase the
file may hold; so nothing that could be accepted is missed.  The places of these words give
alignments: a template and the place where it would start.  Alignments are intersected by
that place, weighed by the share of the template's IDF mass whose words stand where they
should, and accepted if that share is high enough and the template's key phrase stands
there word by word.  For a base phrase the key phrase is all of it.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` with A-Z lowered.  The only things that
leave the executors are the document frequencies of the templates' own words.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .workspace import Workspace

#: Share of a template's IDF mass that must stand in place.
SHARE = 0.75
_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    """A licence's words; ``key`` is the part that must stand there whole."""

    label: str
    words: tuple[str, ...]
    key: tuple[str, ...]
    base: bool = False

    @property
    def key_at(self) -> int:
        n = len(self.key)
        return next(i for i in range(len(self.words) - n + 1) if self.words[i : i + n] == self.key)


def template(label: str, text: str, key: str | None = None) -> Template:
    words = tuple(text.split())
    return Template(label, words, tuple(key.split()) if key else words, key is None)


#: Phrases that count at every place they stand.
BASE = (template("gpl", "gnu general public license"), template("apache", "apache license"), template("cc-by", "cc by"), template("mit", "mit license"))
#: Longer statements, found also with a word changed outside their key phrases.
STATEMENTS = (
    template("gpl-3", "this work is licensed under the gnu general public license version 3", "gnu general public license version 3"),
    template("gpl-2", "this work is licensed under the gnu general public license version 2", "gnu general public license version 2"),
    template("lgpl", "licensed under the gnu lesser general public license", "gnu lesser general public license"),
    template("agpl", "licensed under the gnu affero general public license", "gnu affero general public license"),
    template("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    template("mit-notice", "released under the mit license", "the mit license"),
    template("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software", "permission is hereby granted"),
    template("bsd-text", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
    template("mpl", "subject to the terms of the mozilla public license", "mozilla public license"),
    template("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    template("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    template("cc-by-nd", "licensed under cc by nd 4 0", "cc by nd"),
    template("cc0", "dedicated to the public domain under cc0", "cc0"),
)


def split_words(df: DataFrame, text: str, name: str) -> DataFrame:
    """``df`` with the words of a text in order, instead of the text; null has none."""
    # the Kelvin sign is the only other character that lower() makes an ASCII letter alone
    lowered = F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("K"), F.lit("é")))
    d = _barrier(df, "_parts", F.split(lowered, _SEPARATORS)).drop(text)
    parts = F.col("_parts")
    first, last = F.when(F.element_at(parts, 1) == "", 2).otherwise(1), F.when(F.element_at(parts, -1) == "", 1).otherwise(0)
    return _barrier(d, name, F.slice(parts, first, F.greatest(F.size(parts) - first + 1 - last, F.lit(0)))).drop("_parts")


def _strings(words) -> Column:
    return F.array(*map(F.lit, words))


def _looked_up(docs: DataFrame, templates: tuple[Template, ...]) -> DataFrame:
    """(doc_id, n_words, present, words) of ``docs`` (doc_id, text).

    ``present`` are a file's licence words, each once; ``words`` all its words in order, those
    that are no licence words empty, of files that hold all words of a key phrase, else null.
    """
    lexicon = _strings(sorted({w for t in templates for w in t.words}))
    keys = F.array(*(_strings(sorted(set(t.key))) for t in templates))
    d = split_words(docs, "text", "all")
    d = _barrier(d, "present", F.array_intersect("all", lexicon))
    may = F.exists(keys, lambda k: F.size(F.array_except(k, "present")) == 0)
    words = F.transform("all", lambda w: F.when(F.array_contains("present", w), w).otherwise(""))
    return d.select("doc_id", F.size("all").alias("n_words"), "present", F.when(may, words).alias("words"))


def document_frequencies(found: DataFrame, templates: tuple[Template, ...]) -> tuple[dict[str, int], int]:
    """For each word of the templates the number of files that have it, and the number of files."""
    counts = dict(found.select(F.explode(F.array_append("present", F.lit(""))).alias("word")).groupBy("word").count().collect())  # as many rows as the templates have words
    total = counts.pop("", 0)
    return {w: counts.get(w, 0) for t in templates for w in t.words}, total


def _idf(counts: dict[str, int], total: int) -> dict[str, float]:
    return {w: log((total + 2) / (n + 1)) for w, n in counts.items()}


def _barrier(df: DataFrame, name: str, value: Column, replace: bool = False) -> DataFrame:
    """``df`` with a column that is computed once a row, however often lambdas refer to it."""
    kept = [c for c in df.columns if not replace or c != name]
    return df.select(*kept, F.explode(F.array(value)).alias(name))


def scan(df: DataFrame, doc_id: str = "doc_id", text: str = "text", templates: tuple[Template, ...] = BASE + STATEMENTS) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for every row of ``df``.

    ``n_base`` counts the places of base phrases, ``first_word`` and ``last_word`` are the
    smallest and largest of them (null if none).  ``score`` is the largest share of IDF
    mass among accepted alignments, 0 without any.  A null or empty text has no words.
    Rows may repeat; each is scanned on its own.
    """
    ws = Workspace(df.sparkSession, "licenses")
    looked = ws.keep(_looked_up(df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")), templates), "words")
    counts, total = document_frequencies(looked, templates)
    idf = _idf(counts, total)
    order = lambda w: (-idf[w], w)
    described, rarest = [], []
    for t in templates:
        mass = sum(idf[w] for w in t.words)
        shares = [idf[w] / mass if mass else 1 / len(t.words) for w in t.words]
        described.append(F.struct(F.lit(t.label).alias("label"), F.lit(t.base).alias("base"), _strings(t.words).alias("words"), F.array(*map(F.lit, shares)).alias("shares"), _strings(t.key).alias("key"), F.lit(t.key_at).alias("key_at")))
        rarest.append(min(t.key, key=order))
    by_idf = _strings(sorted({w for t in templates for w in t.words}, key=order))
    index = F.array(*(F.struct(F.lit(w).alias("w"), F.lit(k).alias("t"), F.lit(i).alias("at")) for k, t in enumerate(templates) for i, w in enumerate(t.words)))
    table = F.array(*described)

    # a file's own index: the templates it may hold, and its rarest licence words until each of them is met
    rows = _barrier(looked, "may", F.when(F.col("words").isNotNull(), F.filter(F.sequence(F.lit(0), F.lit(len(templates) - 1)), lambda k: F.size(F.array_except(F.element_at(table, k + 1)["key"], "present")) == 0)))
    rows = _barrier(rows, "rare", F.filter(by_idf, lambda w: F.array_contains("present", w) & F.col("words").isNotNull()))
    reach = F.array_max(F.transform("may", lambda k: F.array_position("rare", F.element_at(_strings(rarest), k + 1))))
    rows = _barrier(rows, "rare", F.slice("rare", F.lit(1), F.coalesce(reach, F.lit(0)).cast("int")), replace=True)
    rows = _barrier(rows, "postings", F.filter(index, lambda p: F.array_contains("may", p["t"]) & F.array_contains("rare", p["w"])))
    places = F.filter(F.transform("words", lambda w, i: F.struct(i.alias("i"), w.alias("w"))), lambda x: F.array_contains("rare", x["w"]))
    rows = _barrier(rows.drop("present"), "places", places)
    starts = F.flatten(F.transform("places", lambda x: F.transform(F.filter("postings", lambda p: p["w"] == x["w"]), lambda p: F.struct(p["t"].alias("t"), (x["i"] - p["at"]).alias("o")))))
    rows = _barrier(rows, "starts", F.filter(F.array_distinct(starts), lambda s: s["o"] >= 0))

    def weighed(s: Column) -> Column:
        t = F.element_at(table, s["t"] + 1)
        here = F.slice("words", s["o"] + 1, F.size(t["words"]))
        right = F.zip_with(here, t["words"], lambda a, b: F.coalesce((a == b).cast("int"), F.lit(0)))
        share = F.aggregate(F.zip_with(right, t["shares"], lambda r, m: r * m), F.lit(0.0), lambda a, b: a + b)
        key = F.slice("words", s["o"] + 1 + t["key_at"], F.size(t["key"])) == t["key"]
        return F.struct(t["label"].alias("label"), t["base"].alias("base"), s["o"].alias("o"), share.alias("share"), key.alias("key"))

    accepted = F.filter(F.transform("starts", weighed), lambda a: a["key"] & (a["share"] >= SHARE))
    rows = _barrier(rows, "found", F.coalesce(accepted, F.array().cast("array<struct<label:string,base:boolean,o:int,share:double,key:boolean>>")))
    base = F.transform(F.filter("found", lambda a: a["base"]), lambda a: a["o"].cast("long"))
    joined = lambda x: F.array_join(F.array_sort(F.array_distinct(x)), ",")
    return rows.select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        F.size(base).cast("long").alias("n_base"),
        F.array_min(base).alias("first_word"),
        F.array_max(base).alias("last_word"),
        joined(F.transform(F.filter("found", lambda a: a["base"]), lambda a: a["label"])).alias("base_labels"),
        joined(F.transform("found", lambda a: a["label"])).alias("labels"),
        F.least(F.coalesce(F.array_max(F.transform("found", lambda a: a["share"])), F.lit(0.0)), F.lit(1.0)).alias("score"),
    )
