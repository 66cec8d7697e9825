"""Jaccard components against the exact similarity of all pairs."""

import random
import re

import numpy as np
import pytest

from tests.llm.helpers import DIRECTORY, as_rows, awkward, documents, empty
from tests.llm.test_simhash import LOWER, components
from wardbook.llm import jaccard, queries


def plain_set(text, words=4):
    found = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(found[i:i + words]) for i in range(max(1, len(found) - words + 1))) if found else frozenset()


def brute(pairs, words=4, percent=85):
    sets = [plain_set(t, words) for _, t in pairs]
    by_shingle = {}
    for i, s in enumerate(sets):
        for shingle in s:
            by_shingle.setdefault(shingle, []).append(i)
    near = set()
    for group in by_shingle.values():
        near.update((i, j) for i in group for j in group if i < j)
    linked = [(i, j) for i, j in near
              if 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    of = components(range(len(pairs)), linked)
    least = {}
    for i, (doc, _) in enumerate(pairs):
        if doc is not None:
            least[of[i]] = min(doc, least.get(of[i], doc))
    return sorted(((doc, len(sets[i]), least.get(of[i]) if sets[i] else doc) for i, (doc, _) in enumerate(pairs)), key=repr)


def variants(rng, n, count, edits):
    base = [f"w{rng.randrange(5000)}" for _ in range(n)]
    for _ in range(count):
        words = list(base)
        for _ in range(rng.randrange(edits + 1)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(5000)}"
        yield " ".join(words)


@pytest.fixture(scope="module")
def near_copies():
    """Groups around the limit, chains of edits, sizes around the limit, and texts that share a passage."""
    rng, texts = random.Random(5), []
    for n in (1, 3, 4, 8, 9, 10, 20, 50, 120, 300):
        for _ in range(4):
            texts += variants(rng, n, 7, max(1, n // 25))
    words = [f"c{i}" for i in range(100)]
    for i in range(0, 100, 2):
        words[i] = f"d{i}"
        texts.append(" ".join(words))
    words = [f"e{i}" for i in range(60)]
    texts += [" ".join(words[:k]) for k in range(20, 61)]
    passage = " ".join(f"p{i}" for i in range(60))
    texts += [f"{passage} {' '.join(variants(rng, 30, 1, 0))}" for _ in range(20)]
    return list(enumerate(texts))


def frame(spark, pairs):
    return spark.createDataFrame(pairs, "doc_id long, text string").repartition(3)


def test_query_on_the_test_tables(spark):
    pairs = list(documents()[["doc_id", "text"]].itertuples(index=False, name=None))
    rows = brute(pairs)
    assert as_rows(queries.op12_jaccard_join(spark, DIRECTORY)) == rows
    assert len({r[2] for r in rows}) < len(rows)


@pytest.mark.parametrize("block, most, in_a_task", ((1 << 16, 1 << 22, 1 << 19), (11, 500, 0)))
def test_near_copies_in_blocks_of_any_size(spark, near_copies, monkeypatch, block, most, in_a_task):
    monkeypatch.setattr(jaccard, "LINKS_IN_A_TASK", in_a_task)
    decided_again, exact = [], jaccard._exact_links
    monkeypatch.setattr(jaccard, "_exact_links", lambda m, p, k: decided_again.append(m.count()) or exact(m, p, k))
    rows = brute(near_copies)
    assert as_rows(jaccard.jaccard_components(frame(spark, near_copies), block=block, most=most)) == rows
    assert decided_again[0] > 5  # sets of components whose first links did not all hold
    assert len(near_copies) // 4 < len({r[2] for r in rows}) < len(near_copies)


@pytest.mark.parametrize("words, percent", ((1, 50), (2, 95), (5, 70)))
def test_other_shingles_and_limits(spark, near_copies, words, percent):
    pairs = near_copies[::2]
    found = as_rows(jaccard.jaccard_components(frame(spark, pairs), words, percent, most=2000))
    assert found == brute(pairs, words, percent)


def test_bit_counts_never_lose_a_link():
    rng = np.random.default_rng(6)
    for _ in range(300):
        n = int(rng.integers(6, 400))
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        apart = int(rng.integers(0, n // 6 + 2))
        b = np.unique(np.concatenate([a[apart // 2:], rng.integers(0, 1 << 63, apart - apart // 2, dtype=np.uint64)]))
        bands = jaccard.band_of(len(a)), jaccard.band_of(len(b))
        if jaccard._linked(a, b, 85):
            assert abs(bands[0] - bands[1]) <= 1
            x, y = (np.frombuffer(jaccard.signature(s), "<u8").reshape(1, -1) for s in (a, b))
            words = min(x.shape[1], y.shape[1])
            for w in (words, max(2, words // 2)):
                d = int(np.bitwise_count(jaccard._folded(x, w) ^ jaccard._folded(y, w)).sum())
                assert d <= len(np.setxor1d(a, b)) <= jaccard._most_apart(len(a) + len(b), 85)


def test_a_tile_returns_a_forest_of_a_large_group(spark):
    rng = random.Random(7)
    pairs = list(enumerate(variants(rng, 200, 400, 3)))
    docs = frame(spark, pairs)
    sets = jaccard._signed(docs, 4, 85).dropDuplicates(["set"]).withColumnRenamed("doc_id", "node")
    many = sets.count()
    assert jaccard.passing_links(sets, 85).count() == many - 1
    assert as_rows(jaccard.jaccard_components(docs)) == brute(pairs)


def test_awkward_rows_and_empty_tables(spark):
    docs = awkward(spark)
    pairs = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert as_rows(jaccard.jaccard_components(docs)) == brute(pairs)
    assert jaccard.jaccard_components(empty(spark)).count() == 0
    blank = spark.createDataFrame([(1, None), (2, " "), (None, "")], "doc_id long, text string")
    assert as_rows(jaccard.jaccard_components(blank)) == [(1, 0, 1), (2, 0, 2), (None, 0, None)]
    with pytest.raises(ValueError):
        jaccard.jaccard_components(docs, percent=100)
