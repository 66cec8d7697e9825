"""Exact duplicates: the trie on its own, and the operator against its SQL twin and a dictionary."""

import random

from tests.compare import connect, differences
from tests.llm.helpers import DIRECTORY, as_rows, awkward, empty, sha
from wardbook.llm import exact_dedup, queries
from wardbook.llm.exact_dedup import PatriciaTrie, combine


def brute(pairs):
    groups = {}
    for doc, text in pairs:
        groups.setdefault(text or "", []).append(doc)
    seen, found = set(), []
    for doc, text in pairs:
        text = text or ""
        known = [d for d in groups[text] if d is not None]
        keep = max(known) if known else None
        found.append((doc, keep, len(groups[text]), doc == keep and (doc, text) not in seen, sha(text)))
        seen.add((doc, text))
    return sorted(found, key=repr)


def test_trie_combines_and_spills():
    rng = random.Random(5)
    words = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(12))) for _ in range(800)]
    words += [b"", b"x" * 5000, b"x" * 5000 + b"y", b"x" * 4999, b"\x00", b"\x00\xff"] * 2
    expected = {}
    for i, w in enumerate(words):
        value = (1, None if i % 7 == 0 else i, None if i % 7 == 0 else i)
        expected[w] = combine(expected[w], value) if w in expected else value
    for limit in (1 << 30, 20_000, 2000, 1):
        trie = PatriciaTrie(limit)
        for i, w in enumerate(words):
            trie.insert(w, (1, None if i % 7 == 0 else i, None if i % 7 == 0 else i))
        assert bool(trie.spilled) == (limit < 1 << 30)
        found = list(trie.items())
        assert len(found) == len(expected) and dict(found) == expected


def test_query_against_its_twin(spark):
    assert differences(queries.op1_exact_dedup(spark, DIRECTORY), connect(DIRECTORY),
                       queries.ORACLE["op1_exact_dedup"]) == []


def test_hot_group_and_small_memory(spark):
    docs = [(i, "hot text") for i in range(400)] + [(1000 + i, f"text {i % 150}") for i in range(600)]
    docs += [(5, "hot text"), (399, "hot text")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    for trie_bytes in (1 << 30, 4000):
        assert as_rows(exact_dedup.exact_duplicates(frame, trie_bytes)) == brute(docs)


def test_awkward_rows_and_empty_tables(spark):
    docs = awkward(spark)
    pairs = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    found = exact_dedup.exact_duplicates(docs)
    assert as_rows(found) == brute(pairs)
    stay = exact_dedup.survivors(docs)
    assert stay.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"] or "") for r in stay.collect()), key=repr) == sorted(
        {(d, t or "") for d, t in pairs if (d, *brute_keep(pairs, t)) == (d, d)}, key=repr)
    assert exact_dedup.exact_duplicates(empty(spark)).count() == 0 and exact_dedup.survivors(empty(spark)).count() == 0


def brute_keep(pairs, text):
    known = [d for d, t in pairs if (t or "") == (text or "") and d is not None]
    return [max(known) if known else None]
