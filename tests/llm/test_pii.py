"""Personal data: base spans against the plain patterns, and contexts that discover others."""

import re

import pytest

from tests.llm.helpers import DIRECTORY, as_rows, awkward, documents, empty, sha
from wardbook.llm import pii, queries

PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def plain_luhn(digits):
    total = 0
    for i, d in enumerate(reversed([int(c) for c in digits])):
        d = d * 2 if i % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def passes(kind, found):
    digits = "".join(c for c in found if c in "0123456789")
    return {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in found.split(".")),
            "card": lambda: 16 <= len(digits) <= 19 and plain_luhn(digits),
            "phone": lambda: 8 <= len(digits) <= 15}[kind]()


def brute(doc, text):
    spans = [(kind, m.start(), m.end()) for kind, p in PATTERNS.items() for m in p.finditer(text or "")
             if passes(kind, m.group())]
    return (doc, *(sum(s[0] == k for s in spans) for k in PATTERNS), sha(",".join(f"{k}:{a}:{b}" for k, a, b in spans)))


TRICKY = [
    "a@b", "a@b.c", "a@b.c.", "x a@b.c@d.e y", "a@b.c%d@e.f", "@b.c", "..a@b.c-d.e", "a@@b.c", "é@b.c ü.x@y.z",
    "1.2.3.4", "1.2.3.4.5", "1.2.3.4.5.6.7.8", "256.1.1.1 1.2.3.0004", "01.002.003.255", "1..2.3.4.5 1.2.3",
    "4111 1111 1111 1111", "4111-1111-1111-1111 4111-1111-1111-1112", "4111  1111 1111 1111 41111111111111111111",
    "+1 (017) 555-7713 +1", "+1 2", "+12345678", "+1234567", "+1234567890123456", "+1(2)3-4.5 6789)", "++1 234 567 89",
    "٣.٤.٥.٦ +٣٤٥٦٧٨٩٠", "a" * 50 + "@" * 20 + "b.c", "0" * 40 + ".1.1.1",
]


@pytest.mark.parametrize("text", TRICKY)
def test_base_spans(text):
    spans = [(pii.KINDS[k], a, b) for k, a, b in pii.base_spans(text)]
    expected = [(kind, m.start(), m.end()) for kind, p in PATTERNS.items() for m in p.finditer(text)
                if passes(kind, m.group())]
    assert spans == expected


def test_long_words_take_linear_time():
    for text in ("x" * 2_000_000, "x" * 2_000_000 + "@", "1" * 500_000 + "." + "1" * 500_000, "+1" + "(" * 500_000,
                 "1." * 300_000, "@a" * 300_000, "a1" * 500_000):
        pii.base_spans(text)
        list(pii.identifiers(text, []))


def test_query_on_the_test_tables(spark):
    found = queries.op5_pii(spark, DIRECTORY)
    docs = documents()
    assert as_rows(found.select("doc_id", *[f"n_{k}" for k in pii.KINDS], "base_sha256")) == sorted(
        (brute(d, t) for d, t in zip(docs.doc_id.tolist(), docs.text.tolist())), key=repr)
    for row in found.collect():
        base = [s for s in row["spans"].split(",") if s]
        assert len(base) == sum(row[f"n_{k}"] for k in pii.KINDS) + row["n_added"]


def test_contexts_discover_what_the_patterns_miss(spark):
    docs = [(i, f"please write to customer{i}@mail.example.com today") for i in range(8)]
    docs += [(100, "please write to clerk@intranet today"), (101, "he paid to 55@ shop"), (102, "please write to 7 people")]
    docs += [(103 + i, f"we saw the {i}.{i}.{i}.{i} there") for i in range(8)]
    docs += [(120 + i, f"we saw the +1 555 010{i}99 there") for i in range(8)]
    docs += [(130, "we saw the 300.300.300.300 there")]
    found = {r["doc_id"]: r for r in pii.find_identifiers(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert found[100]["spans"] == "email:16:30" and found[100]["n_email"] == 0 and found[100]["n_added"] == 1
    # Neither a context of its own nor one that two kinds share.
    assert [found[i]["spans"] for i in (101, 102, 130)] == ["", "", ""]
    assert found[0]["spans"] == "email:16:42"


def test_contexts_reach_grouped_numbers_and_long_words(spark):
    docs = [(i, f"please call me at +1 (407) 555-78{i:02} today") for i in range(40)]
    docs += [(50 + i, f"please pay with 4111 1111 1111 {card} now") for i, card in enumerate(
        ["1111", "1129", "1137", "1145", "1152", "1160"])]
    docs += [(60 + i, f"mail goes to user{i}@mail.example.com always") for i in range(8)]
    texts = ["please call me at (407) 555-7710 today", "please call me at 407 555 7710 today",
             "please call me at (407)555-7710 today", "please pay with 4635 3462 0334 6401 now",
             "mail goes to " + "x" * 300 + "@intranet always"]
    found = {r["doc_id"]: r for r in pii.find_identifiers(spark.createDataFrame(
        docs + list(enumerate(texts, 100)), "doc_id long, text string")).collect()}
    assert [found[i]["n_card"] for i in range(50, 56)] == [1] * 6
    assert [found[i]["spans"] for i in range(100, 105)] == [
        "phone:18:32", "phone:18:30", "phone:18:31", "card:16:35", "email:13:322"]
    base = [(3, 4, 12)]
    assert list(pii.grouped("1 2 +1234567 407 555 7710. (12 34) x1 2", base)) == [(0, 3), (13, 25), (28, 33)]
    for text in ("1 " * 300_000 + "x", "1" * 500_000 + "x", "(" * 500_000, "1(" * 300_000):
        list(pii.candidates(text, []))


def test_copies_teach_nothing(spark):
    docs = [(i, "please write to one@mail.example.com today") for i in range(50)]
    docs.append((100, "please write to clerk@intranet today"))
    found = pii.find_identifiers(spark.createDataFrame(docs, "doc_id long, text string"))
    assert found.where("n_added > 0").count() == 0


def test_awkward_rows_and_empty_tables(spark):
    docs = awkward(spark)
    found = pii.find_identifiers(docs)
    assert as_rows(found.select("doc_id", *[f"n_{k}" for k in pii.KINDS], "base_sha256")) == sorted(
        (brute(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()), key=repr)
    assert pii.find_identifiers(empty(spark)).count() == 0
