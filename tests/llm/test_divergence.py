"""Divergence of sources against exact arithmetic on dictionaries."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import pytest

from glimmer.llm import divergence
from glimmer.llm.divergence import audit

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def brute(rows, least, ranks):
    words = [(la or "", s or "", TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))) for t, la, s in rows]
    held, groups = defaultdict(Counter), defaultdict(Counter)
    for la, s, w in words:
        held[la].update(set(w))
        groups[la, s].update(w)
    out = []
    for (la, s), _ in groups.items():
        kept = {t for t, n in held[la].items() if n >= least}
        others = sorted((x for x in groups if x[0] == la), key=lambda x: x[1].encode())

        def p(count, kept=kept):
            total = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 5) // (total + 5 * len(kept)) for t in kept}

        mine, whole = p(groups[la, s]), p(sum((groups[x] for x in others), Counter()))
        pairs = [(-sum(abs(mine[t] - q[t]) for t in kept), x[1].encode()) for x in others if x[1] != s for q in [p(groups[x])]]
        terms = [(whole[t] - mine[t], t.encode()) for t in kept if groups[la, s][t] > 0 and mine[t] > whole[t]]
        for part, values in (("pair", sorted(pairs)), ("term", sorted(terms)[:ranks])):
            out += [(la, s, part, item.decode(), -v, i + 1) for i, (v, item) in enumerate(values)]
    return sorted(out)


def rows_of(seed, n=300):
    rng = random.Random(seed)
    words = ["Ähre", "the", "THE", "a1b", "x-y", "日本", "é", "z", "of", "and", "\x85q", "w0rd", "it's"]
    out = [(" ".join(rng.choices(words, k=rng.randrange(12))), rng.choice(["en", "de", None, ""]), rng.choice(["a", "b", "é", "Z", None])) for _ in range(n)]
    return [*out, (None, "fr", "a"), (None, "fr", "b"), ("only here", "xx", "lone"), ("12 34", "en", "digits"), *out[:20]]


@pytest.mark.parametrize("held,shard_bytes", [(1 << 19, 4 << 20), (3, 500)])
def test_against_brute_force(spark, monkeypatch, held, shard_bytes):
    monkeypatch.setattr(divergence, "HELD", held)
    monkeypatch.setattr(divergence, "SHARD_BYTES", shard_bytes)
    rows = rows_of(held)
    df = spark.createDataFrame(rows, "text string, lang string, source string").repartition(5)
    got = sorted(tuple(r) for r in audit(df, least=8, ranks=4).collect())
    assert got == brute(rows, 8, 4)


def test_groups_without_terms_and_other_columns(spark):
    rows = [("rare word", "en", s, 1, "x") for s in ("b", "a", "c", None)]
    df = spark.createDataFrame(rows, "text string, lang string, source string, value int, item string")
    got = sorted(tuple(r) for r in audit(df).where("source = 'b'").collect())
    assert got == [("en", "b", "pair", "", 0, 1), ("en", "b", "pair", "a", 0, 2), ("en", "b", "pair", "c", 0, 3)]
    assert audit(df.limit(0)).collect() == []
    assert audit(df.limit(1)).collect() == []


def test_one_term_in_most_rows(spark):
    rows = [("common " * (i % 4 + 1) + f"t{chr(97 + i % 26)}", "en", f"s{i % 7}") for i in range(4000)]
    df = spark.createDataFrame(rows, "text string, lang string, source string").repartition(6)
    assert sorted(tuple(r) for r in audit(df, least=30).collect()) == brute(rows, 30, 50)
