"""Runs against a period-by-period scan of whole documents."""

import hashlib
import random
import re
import zlib

import pytest

from tests.llm.helpers import DIRECTORY, as_rows, awkward, documents, empty, sha
from wardbook.llm import periodic_runs, queries


def plain_runs(words, least):
    """Every maximal stretch with a period; the smallest period finds it first."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(least, 2 * q):
                found.setdefault((i, length), q)
            i = max(j, i + 1)
    return sorted((s, length, q) for (s, length), q in found.items())


def expected(doc, text, planted):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), 0 if doc is None else zlib.crc32(str(doc).encode())
    if planted and doc is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words, 12)
    dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    rest = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc, len(runs), *rest, sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)),
            sha(" ".join(w for i, w in enumerate(words) if i not in dropped)))


def test_runs_of_random_words():
    rng = random.Random(1)
    for _ in range(1500):
        words = [rng.randrange(1, 1 + rng.randrange(1, 9)) for _ in range(rng.randrange(60))]
        for _ in range(rng.randrange(4)):
            i, p = rng.randrange(len(words) + 1), rng.randrange(1, 9)
            words[i:i] = words[i:i + p] * rng.randrange(1, 6)
        assert [tuple(r) for r in periodic_runs.runs(words).tolist()] == plain_runs(words, 2)


def test_what_is_left_out_is_in_no_run():
    rng = random.Random(2)
    for least in (2, 5, 12, 13):
        for _ in range(200):
            words = [rng.choice("abcdefg") for _ in range(rng.randrange(80))]
            for _ in range(3):
                i, p = rng.randrange(len(words) + 1), rng.randrange(1, 9)
                words[i:i] = words[i:i + p] * rng.randrange(1, 6)
                words.insert(i, f"w{i}")
            texts = [" ".join(words).encode(), b"", b" a b a b ", " ".join(words[::-1]).encode()]
            found = [[tuple(r) for r in runs.tolist()] for _, runs in periodic_runs._documents(texts, least)]
            assert found == [plain_runs(t.split(), least) for t in texts]


def test_suffix_tree_agrees_with_plain_comparison():
    rng = random.Random(3)
    for _ in range(100):
        s = [rng.randrange(1, 4) for _ in range(rng.randrange(2, 40))]
        tree = periodic_runs.SuffixTree(s)
        suffixes = sorted(range(len(s) + 1), key=lambda i: s[i:])
        assert tree.order == suffixes
        assert tree.opposite_order() == sorted(range(len(s) + 1), key=lambda i: [-x for x in s[i:]])
        pairs = [(i, j) for i in range(len(s)) for j in range(i + 1, len(s) + 1)]
        common = tree.common(*map(periodic_runs.np.array, zip(*pairs)))
        for (i, j), c in zip(pairs, common.tolist()):
            k = 0
            while j + k < len(s) and s[i + k] == s[j + k]:
                k += 1
            assert c == k


def test_query_on_the_test_tables(spark):
    docs = documents()
    found = as_rows(queries.op13_periodic_runs(spark, DIRECTORY))
    assert found == sorted((expected(d, t, True) for d, t in zip(docs.doc_id.tolist(), docs.text.tolist())), key=repr)
    assert any(r[1] for r in found)


def test_awkward_rows_and_empty_tables(spark):
    docs = awkward(spark)
    pairs = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    found = as_rows(periodic_runs.find_runs(docs))
    short = [p for p in pairs if len((p[1] or "").split()) < 1000]
    # The 80,000 words of the long text repeat with period 4.
    words, length = "alpha beta gamma delta".split(), 80_000
    long_row = (8, 1, 0, length, 4, 1000 * length // 4, sha(f"0,{length},4\n"), sha(" ".join(words)))
    assert found == sorted([*(expected(d, t, False) for d, t in short), long_row], key=repr)
    planted = as_rows(periodic_runs.find_runs(periodic_runs.with_planted_periods(docs)))
    assert [r for r in planted if r[0] != 8] == sorted((expected(d, t, True) for d, t in short), key=repr)
    assert periodic_runs.find_runs(empty(spark)).count() == 0
    assert periodic_runs.find_runs(periodic_runs.with_planted_periods(empty(spark))).count() == 0


def test_runs_and_collapsed_text_are_returned(spark):
    text = "start " + "x y z " * 6 + "end"
    row = periodic_runs.find_runs(spark.createDataFrame([(1, text)], "doc_id long, text string"), with_runs=True,
                                  with_text=True).first()
    assert [tuple(r) for r in row["runs"]] == [(1, 18, 3)]
    assert row["collapsed"] == "start x y z end"
    assert row["collapsed_sha256"] == hashlib.sha256(b"start x y z end").hexdigest()


@pytest.mark.parametrize("least", (4, 6))
def test_other_least_lengths(spark, least):
    text = "a b a b c c c c c d e d e d e"
    row = periodic_runs.find_runs(spark.createDataFrame([(1, text)], "doc_id long, text string"), least, with_runs=True).first()
    assert [tuple(r) for r in row["runs"]] == plain_runs(text.split(), least)
