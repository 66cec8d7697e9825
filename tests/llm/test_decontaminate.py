"""Decontamination against a search for every window in every document."""

import re

import pandas as pd

from tests.compare import connect, differences
from tests.llm.helpers import DIRECTORY, as_rows, awkward, documents, empty, sha
from wardbook.llm import decontaminate, queries

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(docs, items):
    windows = {}
    for item, text in items:
        words = words_of(text)
        n = min(10, len(words))
        for i in range(len(words) - n + 1 if n else 0):
            windows.setdefault(tuple(words[i:i + n]), set()).add(item)
    lengths = {len(w) for w in windows}
    found = []
    for doc, text in docs:
        words, hit, items_hit = words_of(text), set(), set()
        for n in lengths:
            for i in range(len(words) - n + 1):
                known = windows.get(tuple(words[i:i + n]))
                if known is not None:
                    hit.update(range(i, i + n))
                    items_hit |= known
        listed = sorted(str(i) for i in items_hit if i is not None)
        found.append((doc, len(words), len(hit), len(listed), sha(",".join(listed)), bool(hit)))
    return sorted(found, key=repr)


def test_query_on_the_test_tables(spark):
    items = pd.read_parquet(f"{DIRECTORY}/benchmark.parquet")
    expected = brute(documents()[["doc_id", "text"]].values.tolist(), items.values.tolist())
    assert as_rows(queries.op7_decontamination(spark, DIRECTORY)) == expected
    assert 0 < sum(r[-1] for r in expected) < len(expected)


def test_short_long_and_shared_items(spark):
    line = " ".join(f"w{i}" for i in range(40))
    items = [(1, line), (2, "W5 w6, w7"), (3, "zz"), (4, ""), (5, None), (None, "w1 w2"), (6, line), (6, line),
             (7, "p q r s t u v w x y"), (8, "p q r s t u v w x y z")]
    docs = [(1, line), (2, " ".join(f"w{i}" for i in range(3, 13))), (3, " ".join(f"w{i}" for i in range(3, 12))),
            (4, "a w5 w6 w7 b w5 w6"), (5, "zz " * 30), (6, None), (7, ""), (8, "p q r s t u v w x y Z"),
            (8, "p q r s t u v w x y Z"), (None, "w1 w2"), (9, "x" * 3_000_000 + " zz " + line * 2)]
    for bits in (24, 6):  # a crowded filter lets more through and changes nothing
        found = decontaminate.contamination(
            spark.createDataFrame(docs, "doc_id long, text string"),
            spark.createDataFrame(items, "item_id long, text string"), bits=bits)
        assert as_rows(found) == brute(docs, items)


def test_awkward_rows_and_empty_tables(spark):
    items = spark.createDataFrame([(1, "same text here"), (2, "alpha beta")], "item_id long, text string")
    docs = awkward(spark)
    pairs = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert as_rows(decontaminate.contamination(docs, items)) == brute(
        pairs, [(1, "same text here"), (2, "alpha beta")])
    kept = decontaminate.clean_documents(docs, items)
    assert kept.columns == docs.columns and kept.count() == docs.where(
        "text is null or not text rlike 'same text here|alpha'").count()
    assert decontaminate.contamination(empty(spark), items).count() == 0
    none = decontaminate.contamination(docs, items.limit(0))
    assert none.where("contaminated").count() == 0 and none.count() == docs.count()


def test_query_against_its_twin(spark):
    result = queries.op7_decontamination(spark, DIRECTORY)
    assert differences(result, connect(DIRECTORY), queries.ORACLE["op7_decontamination"]) == []
    assert 0 < result.where("contaminated").count() < result.count()
