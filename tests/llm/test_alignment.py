"""Alignment against loops over all pairs of tokens, with the two libraries' own encoders."""

import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tests.llm.helpers import DIRECTORY, as_rows, awkward, documents, empty, sha
from wardbook.llm import alignment, queries
from wardbook.llm.bpe import byte_symbols

PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def encode():
    a = Tokenizer.from_file(PATHS[0])
    a.encode_special_tokens = True
    a.no_padding()
    a.no_truncation()
    b = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    symbols = byte_symbols()

    def piece(i):
        text = b.id_to_piece(i)
        return bytes([int(text[3:5], 16)]) if b.is_byte(i) else text.replace("▁", " ").encode()

    def spans(text):
        """(id, begin, end) by both; nothing for texts that do not come back."""
        ids_a, ids_b = a.encode(" " + (text or ""), add_special_tokens=False).ids, b.encode(text or "")
        bytes_a = [bytes(symbols[c] for c in a.id_to_token(i)) for i in ids_a]
        bytes_b = [piece(i) for i in ids_b]
        whole = (" " + (text or "")).encode()
        if not text or b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
            return [], []
        found = []
        for ids, parts in ((ids_a, bytes_a), (ids_b, bytes_b)):
            ends = np.cumsum([0, *map(len, parts)]).tolist()
            found.append(list(zip(ids, ends, ends[1:])))
        return tuple(found)

    return spans


def brute(encode, pairs):
    aligned = [(doc, *encode(text)) for doc, text in pairs]
    links = []
    for _, a, b in aligned:
        ends = {end: i for i, _, end in b}
        links.append([(i, ends[end]) for i, _, end in a if end in ends])
    count = Counter(x for of in links for x in of)
    highest = {}
    for (_, b), n in count.items():
        highest[b] = max(n, highest.get(b, 0))
    rows = []
    for (doc, a, b), of in zip(aligned, links):
        cuts = {e for _, _, e in a} & {e for _, _, e in b}
        in_groups = []
        for side in (a, b):
            in_groups.append([[]])
            for i, _, end in side:
                in_groups[-1][-1].append(str(i))
                if end in cuts:
                    in_groups[-1].append([])
        parts = [",".join(x) + "|" + ",".join(y) for x, y in zip(*in_groups) if x or y]
        shared = sum(len(x) * len(y) for x, y in zip(*in_groups))
        overlaps = sum(s < f and t < e for _, s, e in a for _, t, f in b) if len(a) < 300 else None
        rows.append((doc, len(a), len(b), len(parts), len(of), sum(count[x] == highest[x[1]] for x in of),
                     sum(count[x] for x in of), sha(";".join(parts)) if a else "", overlaps, shared))
    return rows


def compare(found, rows):
    """Overlaps of long texts are not in the brute-force version."""
    found, rows = (sorted(x, key=lambda r: repr(r[:8])) for x in (found, rows))
    assert [r if s[8] is not None else (*r[:8], None, r[9]) for r, s in zip(found, rows)] == rows and len(found) == len(rows)


def test_query_on_the_test_tables(spark, encode):
    pairs = list(documents()[["doc_id", "text"]].itertuples(index=False, name=None))
    pairs_of_short = [(d, t) for d, t in pairs]
    rows = brute(encode, pairs_of_short)
    compare(as_rows(queries.op11_alignment(spark, DIRECTORY)), rows)
    assert any(r[5] < r[4] for r in rows)


def test_awkward_rows_and_empty_tables(spark, encode):
    docs = awkward(spark)
    texts = ["▁ the sign itself", "<|endoftext|> <s> </s> <unk>", "  two  spaces ", "tab\tand\nline", "漢字かな \U0001f600‍"]
    docs = docs.unionByName(spark.createDataFrame([(100 + i, t) for i, t in enumerate(texts)], "doc_id long, text string"),
                            allowMissingColumns=True)
    pairs = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    rows = brute(encode, pairs)
    compare(as_rows(alignment.align_documents(docs)), rows)
    by_id = {r[0]: r for r in rows}
    assert by_id[100][1:] == (0, 0, 0, 0, 0, 0, "", 0, 0) and by_id[101][1] and by_id[103][1]
    assert alignment.align_documents(empty(spark)).count() == 0
    nothing = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert as_rows(alignment.align_documents(nothing)) == [(i, 0, 0, 0, 0, 0, 0, "", 0, 0) for i in (1, 2)]


def test_blocks_of_one_text_count_over_all(spark, encode, monkeypatch):
    monkeypatch.setattr(alignment, "groups", lambda texts: ((i, [t]) for i, t in enumerate(texts)))
    pairs = [(i, t) for i, t in enumerate(("one two", "one two three", "two one", "unalignable", "one", "one"))]
    docs = spark.createDataFrame(pairs, "doc_id long, text string").repartition(4)
    compare(as_rows(alignment.align_documents(docs)), brute(encode, pairs))


def test_both_encoders_of_a_give_the_same_ids():
    both, rng = alignment.aligner(*PATHS), random.Random(8)
    slow = alignment.Aligner(*PATHS)
    slow.by_rank = None
    assert both.by_rank is not None
    every = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    texts = [*documents().text.fillna(""), "a" * 5000, "<|endoftext|>", "ab" * 3000 + "é" * 999, " \n\n a\t\x1c\x85 b  "]
    texts += ["".join(rng.choice(every) for _ in range(20)) for _ in range(500)]
    texts += ["".join(rng.choice(" \n\tabcABC'sredöé12.,!<|>") for _ in range(60)) for _ in range(500)]
    for text in texts:
        assert both._encode_a(" " + text) == slow._encode_a(" " + text)


@pytest.mark.parametrize("kind", ("ends", "overlaps", "groups"))
def test_links_themselves(spark, encode, kind):
    pairs = [(1, "unbelievable tokenization, é漢字"), (2, None), (3, "short"), (None, "no id")]
    rows = set()
    for doc, text in pairs:
        a, b = encode(text)
        cuts = sorted({e for _, _, e in a} & {e for _, _, e in b})
        for x, (i, s, e) in enumerate(a):
            for y, (j, t, f) in enumerate(b):
                common = min(e, f) - max(s, t)
                linked = {"ends": e == f, "overlaps": common > 0,
                          "groups": np.searchsorted(cuts, e) == np.searchsorted(cuts, f)}[kind]
                if linked:
                    rows.add((doc, x, y, i, j, common if kind == "overlaps" else 1))
    found = as_rows(alignment.token_links(spark.createDataFrame(pairs, "doc_id long, text string"), kind))
    assert found == sorted(rows, key=repr)
    with pytest.raises(ValueError):
        alignment.token_links(spark.createDataFrame(pairs, "doc_id long, text string"), "others")


def test_row_products_equal_dense_ones():
    rng = np.random.default_rng(4)
    for at_once in (1, 7, 1 << 20):
        for _ in range(50):
            n, m, k = rng.integers(1, 9, 3)
            x, y = rng.integers(0, 3, (n, m)), rng.integers(0, 3, (m, k))
            matrices = []
            for dense in (x, y):
                of, columns = np.nonzero(dense)
                first = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(dense)))])
                matrices.append(alignment.Csr(first, columns, dense[of, columns], dense.shape[1]))
            result = np.zeros((n, k), int)
            for i, j, value in alignment.products(*matrices, at_once=at_once):
                result[i, j] += value
            assert (result == x @ y).all()
            turned = matrices[0].transposed()
            assert [(turned.columns[a:b].tolist()) for a, b in zip(turned.first, turned.first[1:])] == \
                [np.flatnonzero(c).tolist() for c in x.T]
            vector = rng.integers(0, 5, m)
            assert (matrices[0].times(vector) == x @ vector).all()
