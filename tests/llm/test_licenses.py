"""The licence scan against brute force."""

from __future__ import annotations

import re
from math import log

import pytest

from glimmer.llm.licenses import BASE, SHARE, STATEMENTS, scan


def tokens(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def brute(rows):
    templates = BASE + STATEMENTS
    docs = [tokens(t) for _, t in rows]
    idf = {w: log((len(rows) + 2) / (sum(w in set(d) for d in docs) + 1)) for t in templates for w in t.words}
    out = []
    for (doc_id, _), d in zip(rows, docs, strict=True):
        base, labels, score = [], set(), 0.0
        for t in templates:
            mass = sum(idf[w] for w in t.words)
            for o in range(len(d)):
                here = d[o : o + len(t.words)]
                share = sum((idf[b] / mass if mass else 1 / len(t.words)) for a, b in zip(here, t.words, strict=False) if a == b)
                if share >= SHARE - 1e-9 and tuple(d[o + t.key_at : o + t.key_at + len(t.key)]) == t.key:
                    labels.add(t.label)
                    score = max(score, min(1, share))
                    if t.base:
                        base.append((o, t.label))
        out.append((doc_id, len(d), len(base), min(base)[0] if base else None, max(base)[0] if base else None, ",".join(sorted({x for _, x in base})), ",".join(sorted(labels)), round(score, 9)))
    return sorted(out, key=str)


def check(spark, df):
    rows = [(r.doc_id, r.text) for r in df.collect()]
    got = sorted(((*tuple(r)[:7], round(r.score, 9)) for r in scan(df).collect()), key=str)
    assert got == brute(rows)


def test_odd_rows(spark):
    rows = [
        (1, None), (2, ""), (None, "MIT License"), (3, "Released under the MIT License."), (3, "Released under the MIT License."),
        (4, "This work was licensed under the GNU General Public License, version 3."), (5, "under GNU GENERAL public\nlicense mit license apache-license"),
        (6, "mit KKelvin license; mit license"), (7, "cc-by cc/by CC BY-NC 4.0 cc"), (8, "license " * 3000 + "mit license"), (9, "... --- \n"), (10, "gnu gnu general public license public license"),
        (11, "MIT LICENSE\x7fMIT_LICENSE MITLICENSE"), (12, "Permission is hereby granted, free of charges, to any person obtaining a copy of this software"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("text", "doc_id", "1 as words", "2 as found")
    check(spark, df.select("doc_id", "text"))
    assert scan(df).count() == len(rows)
    assert scan(df.limit(0)).count() == 0


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_documents(spark, size):
    check(spark, spark.read.parquet(f"/root/testdata/{size}/documents.parquet").select("doc_id", "text"))
