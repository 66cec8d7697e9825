"""Substring dedup against a look at every window of every document."""

import itertools
import random
import re

from pyspark.sql import functions as F

from tests.compare import connect, differences
from tests.llm.helpers import DIRECTORY, as_rows, awkward, documents, empty, sha
from wardbook.llm import queries, substring_dedup
from wardbook.llm.substring_dedup import COVER, PERIOD

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(docs):
    split = [(doc, WORD.findall(text or "")) for doc, text in docs]
    smallest = {}
    for doc, words in split:
        for i in range(len(words) - 12):
            if doc is not None:
                key = tuple(words[i:i + 13])
                smallest[key] = min(doc, smallest.get(key, doc))
    found = []
    for doc, words in split:
        gone = set()
        for i in range(len(words) - 12):
            if doc is not None and smallest[tuple(words[i:i + 13])] < doc:
                gone.update(range(i, i + 13))
        kept = [w for i, w in enumerate(words) if i not in gone]
        found.append((doc, len(words), len(gone), sha(" ".join(kept))))
    return sorted(found, key=repr)


def test_cover_has_every_difference():
    assert {(a - b) % PERIOD for a, b in itertools.product(COVER, COVER)} == set(range(PERIOD))


def test_query_on_the_test_tables(spark):
    expected = brute(documents()[["doc_id", "text"]].values.tolist())
    assert as_rows(queries.op3_substring_dedup(spark, DIRECTORY)) == expected
    assert any(r[2] for r in expected)


def test_query_against_its_twin(spark):
    result = queries.op3_substring_dedup(spark, DIRECTORY)
    assert differences(result, connect(DIRECTORY), queries.ORACLE["op3_substring_dedup"]) == []


def test_answers_hold_when_the_rows_of_the_join_come_in_another_order(spark, monkeypatch):
    """A task that runs again after a broadcast join over shuffled rows may read them in another order."""
    passage = " ".join(f"p{i}" for i in range(30))
    rows = [(i, f"own{i} {passage} {i} end") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    orders = []
    whole_join = type(docs).join

    def shuffled(self, other, on=None, how=None):
        joined = whole_join(self, other, on, how)
        if how is None and on == ["__llm_id", "__llm_hash"]:
            orders.append(len(orders))
            return joined.coalesce(1).sortWithinPartitions(F.xxhash64(F.lit(len(orders)), "__llm_id"))
        return joined

    monkeypatch.setattr(type(docs), "join", shuffled)
    expected = brute(rows)
    seen = []
    passed = substring_dedup.by_batch

    def spy(df, work, schema):
        if schema == substring_dedup.CELL and "found" in df.columns:
            seen.append([r["__llm_id"] for r in df.select("__llm_id").collect()])
        return passed(df, work, schema)

    monkeypatch.setattr(substring_dedup, "by_batch", spy)
    for _ in range(2):
        assert as_rows(substring_dedup.dedup_substrings(docs)) == expected
    assert len(orders) == 2 and seen[0] == seen[1] == sorted(seen[0])


def test_buckets_grow_with_the_text(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "word " * 100) for i in range(50)], "doc_id long, text string")
    assert substring_dedup._buckets(docs) == substring_dedup._buckets(empty(spark)) == 4 * 16
    monkeypatch.setattr(substring_dedup, "BYTES_PER_BUCKET", 100)
    assert substring_dedup._buckets(docs) == 250
    assert as_rows(substring_dedup.dedup_substrings(docs)) == brute([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_shared_passages_at_all_alignments(spark):
    rng = random.Random(7)
    passage = [f"p{i}" for i in range(60)]
    docs = []
    for i in range(150):
        words = [f"{rng.randrange(500)}" for _ in range(rng.randrange(40))]
        n = rng.choice([12, 13, 14, 20, 40])
        at = rng.randrange(60 - n)
        words += passage[at:at + n] * rng.choice([1, 1, 3]) + [f"{rng.randrange(500)}" for _ in range(rng.randrange(9))]
        docs.append((rng.randrange(120), "  ".join(words) + "\n"))
    docs += [(200, "a b " * 400), (201, "a b " * 9), (202, "b a " * 7), (203, "a b " * 6), (None, "a b " * 50)]
    docs += docs[:5]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    expected = brute(docs)
    assert as_rows(substring_dedup.dedup_substrings(frame)) == expected
    assert as_rows(substring_dedup.dedup_substrings(frame.repartition(23))) == expected


def test_awkward_rows_and_empty_tables(spark):
    docs = awkward(spark)
    pairs = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert as_rows(substring_dedup.dedup_substrings(docs)) == brute(pairs)
    assert substring_dedup.dedup_substrings(empty(spark)).count() == 0
    texts = {r["kept_text"] for r in substring_dedup.dedup_substrings(docs, with_text=True).collect()}
    assert "repeated id, other text" in texts
