"""BPE against the tokenizers library, with odd texts."""

from __future__ import annotations

import struct
from hashlib import sha256

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from glimmer.llm.bpe import DEFAULT_FILE, Encoder, Vocabulary, decode, encode_decode, encode_decode_digests

ODD = [
    "", " ", "\n\t ", "Hello, World! it's 3 o'clock", "STRASSE straße ΣΑΣ Σ", "é é ẞ İ ı", "a b c​d", "\x1c\x1d\x1e\x1f x\x1cy\x85z",
    "<|startoftext|>hi<|endoftext|> <|endoftext", "👩‍👩‍👧‍👦 emoji 🇩🇪", "x" * 3000, "日本語のテキスト 中文字", "﻿bom �", "1234567890", "don't we'll I'M", "İİ", "ab\0cd",
]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(DEFAULT_FILE())
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture(scope="module")
def coder():
    return Encoder(Vocabulary.load(DEFAULT_FILE()))


def same(library, coder, text: str) -> None:
    ids = library.encode(text, add_special_tokens=False).ids
    got = coder.encode(text)
    assert list(struct.unpack(f"<{len(got) // 4}I", got)) == ids, text
    assert coder.decode(got) == library.decode(ids, skip_special_tokens=False), text


@pytest.mark.parametrize("text", ODD)
def test_odd_texts(library, coder, text):
    same(library, coder, text)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(library, coder, text):
    same(library, coder, text)


def test_documents(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: r for r in encode_decode_digests(docs, Vocabulary.load(DEFAULT_FILE())).collect()}
    rows = docs.collect()
    assert len(got) == len({r.doc_id for r in rows})
    for r in rows:
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert got[r.doc_id].n_tokens == len(ids)
        assert got[r.doc_id].ids_sha256 == sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert got[r.doc_id].decoded_sha256 == sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_frames(spark, library):
    rows = [(1, None, "a"), (1, None, "a"), (2, "hello world", None), (None, "", "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    vocab = Vocabulary.load(DEFAULT_FILE())
    out = encode_decode(df, vocab)
    assert out.columns == ["doc_id", "text", "ids", "decoded"]
    back = sorted((str(r.doc_id), r.decoded) for r in decode(out.select("doc_id", "ids"), vocab).collect())
    assert back == sorted((str(a), "hello</w> world</w>" if t else "") for a, t, _ in rows)
    assert encode_decode(df.limit(0), vocab).count() == 0


def test_all_documents(library):
    import pyarrow.parquet as pq

    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet").column("text").to_pylist()
    coder = Encoder(Vocabulary.load(DEFAULT_FILE()))
    for at in range(0, len(texts), 100):
        some = texts[at : at + 100]
        want = library.encode_batch([t or "" for t in some], add_special_tokens=False)
        assert [struct.unpack(f"<{len(g) // 4}I", g) for g in coder.encode_all(some)] == [tuple(w.ids) for w in want]


def test_generations(coder, monkeypatch):
    from glimmer.llm import bpe

    monkeypatch.setattr(bpe, "CACHE_WORDS", 5)
    small = Encoder(coder.vocab)
    texts = [" ".join(f"word{i % 7}x{j % 3} again" for j in range(4)) + " " + "long" * 40 for i in range(40)]
    assert [small.encode(t) for t in texts] == [coder.encode(t) for t in texts]
    assert len(small.young) <= 12 and not any(len(w) > bpe.CACHE_LENGTH for w in small.young)
