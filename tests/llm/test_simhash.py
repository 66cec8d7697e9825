"""SimHash: fingerprints bit by bit, components over all pairs."""

import random
import re

import numpy as np
import xxhash

from tests.llm.helpers import DIRECTORY, as_rows, awkward, documents, empty
from wardbook.llm import queries, simhash
from wardbook.llm.components import smallest_reachable

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    shingles = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(nodes, pairs):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in pairs:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {n: root(n) for n in nodes}


def brute(pairs):
    prints = [plain_fingerprint(t) for _, t in pairs]
    array = np.array(prints, "u8")
    linked = [(i, int(j)) for i in range(len(array))
              for j in np.flatnonzero(np.bitwise_count(array ^ array[i]) <= 4) if j > i]
    of = components(range(len(pairs)), linked)
    least = {}
    for i, (doc, _) in enumerate(pairs):
        if doc is not None:
            least[of[i]] = min(doc, least.get(of[i], doc))
    return sorted(((doc, f"{p:016x}", least.get(of[i])) for i, ((doc, _), p) in enumerate(zip(pairs, prints))), key=repr)


def test_query_on_the_test_tables(spark):
    pairs = list(documents()[["doc_id", "text"]].itertuples(index=False, name=None))
    expected = brute(pairs)
    assert as_rows(queries.op6_simhash_near_dedup(spark, DIRECTORY)) == expected
    assert len({r[2] for r in expected}) < len({r[1] for r in expected}) < len(expected)


def test_links_connect_what_is_close_in_blocks_of_any_size(spark):
    rng = random.Random(11)
    prints = [0, 1, (1 << 64) - 1, (1 << 64) - 2, 0b11111]
    for _ in range(60):
        chain = rng.getrandbits(64)
        for _ in range(rng.randrange(1, 12)):
            prints.append(chain)
            for _ in range(rng.randrange(1, 6)):
                chain ^= 1 << rng.randrange(64)
    signed = np.unique(np.array(prints, "u8").view("i8")).tolist()
    array = np.array(signed, "i8").view("u8")
    close = [(signed[i], signed[int(j)]) for i in range(len(array))
             for j in np.flatnonzero(np.bitwise_count(array ^ array[i]) <= 4) if j > i]
    expected = components(signed, close)
    frame = spark.createDataFrame([(s,) for s in signed], "fp long")
    for block in (1 << 17, 40, 7):
        links = simhash.links(frame, block=block)
        found = [(r["a"], r["b"]) for r in links.collect()]
        assert {tuple(sorted(p)) for p in found} <= {tuple(sorted(p)) for p in close}
        assert components(signed, found) == expected
    rooted = {r["node"]: r["root"] for r in smallest_reachable(links).collect()}
    assert rooted == {n: r for n, r in expected.items() if any(n in p for p in close)}


def test_components_of_chains_stars_and_nothing(spark):
    pairs = [(i, i + 1) for i in range(200)] + [(1000, i) for i in range(1001, 1400)] + [(7000, 7000), (None, 3), (9, 8)]
    roots = {r["node"]: r["root"] for r in smallest_reachable(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert roots == {**dict.fromkeys(range(201), 0), **dict.fromkeys(range(1000, 1400), 1000)}
    assert smallest_reachable(spark.createDataFrame([], "a long, b long")).count() == 0


def test_awkward_rows_and_empty_tables(spark):
    docs = awkward(spark)
    pairs = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    found = simhash.near_duplicates(docs)
    expected = brute(pairs)
    assert as_rows(found) == expected
    stay = simhash.representatives(docs)
    assert stay.columns == docs.columns
    assert stay.count() == len({(c, f if c is None else "") for _, f, c in expected})
    assert {r["doc_id"] for r in stay.collect()} == {c for _, _, c in expected}
    assert simhash.near_duplicates(empty(spark)).count() == 0 and simhash.representatives(empty(spark)).count() == 0
