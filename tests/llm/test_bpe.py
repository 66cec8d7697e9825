"""BPE against the tokenizers library, and exact round trips."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tests.llm.helpers import DIRECTORY, as_rows, awkward, documents, empty
from wardbook.llm import bpe, queries

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.no_padding()
    tokenizer.no_truncation()
    return tokenizer


def expected(library, doc, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    back = library.decode(ids, skip_special_tokens=False)
    return (doc, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
            hashlib.sha256(back.encode()).hexdigest())


def test_codec_on_all_kinds_of_characters(library):
    codec, rng = bpe.codec(PATH), random.Random(3)
    every = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    texts = ["", "a", "<|endoftext|>", "x<|endoftext|> <|endoftext|>y<|endoftext", "  \n\n a\t\x1c\x85 b  ", "I'll don't 'S",
             "a" * 5000, "ab" * 3000 + "é" * 999, "​﻿\x00"]
    texts += ["".join(rng.choice(every) for _ in range(20)) for _ in range(1500)]
    texts += ["".join(rng.choice(" \n\tabcABC'sredöé12.,!<|>") for _ in range(60)) for _ in range(500)]
    for text in texts:
        ids = codec.encode(text)
        assert ids == library.encode(text, add_special_tokens=False).ids
        assert codec.decode(ids) == text


def test_old_generation_gives_the_same_ids(library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHED_PIECES", 3)
    monkeypatch.setattr(bpe, "KEPT_PIECES", 2)
    codec = bpe.BytePairCodec(PATH)
    text = "one two three four one five two six one seven " * 3
    for _ in range(3):
        assert codec.encode(text) == library.encode(text, add_special_tokens=False).ids
        codec.packed.trim()
        assert len(codec.packed) <= 2


def test_query_on_the_test_tables(spark, library):
    docs = documents()
    assert as_rows(queries.op8_bpe(spark, DIRECTORY)) == sorted(
        (expected(library, d, t) for d, t in zip(docs.doc_id.tolist(), docs.text.tolist())), key=repr)


def test_awkward_rows_and_empty_tables(spark, library):
    docs = awkward(spark)
    pairs = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert as_rows(bpe.encode_documents(docs)) == sorted((expected(library, d, t) for d, t in pairs), key=repr)
    whole = bpe.encode_documents(docs, with_ids=True, with_text=True).collect()
    assert sorted(r["decoded"] for r in whole) == sorted(t or "" for _, t in pairs)
    assert all(len(r["ids"]) == r["n_tokens"] for r in whole)
    assert bpe.encode_documents(empty(spark)).count() == 0
