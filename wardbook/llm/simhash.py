"""SimHash near-duplicates: 64-bit fingerprints compared exactly in tiles.

Distinct fingerprints are cut into blocks of one population count each. Two
fingerprints within the radius have counts that differ by no more than the radius, so
only such pairs of blocks meet; each pair is one group, compared tile by tile with
exclusive-or and bit counts. A group keeps a spanning forest of the links it finds,
never all pairs, and the forests are joined to components.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardbook.llm.common import by_batch, keep_rows, settle, text_hash, texts_of
from wardbook.llm.components import smallest_reachable

SHINGLE_WORDS = 4
MAX_DISTANCE = 4
SEED = 42
BLOCK = 1 << 17  # fingerprints of one block: 1 MB, or more beyond MOST_BLOCKS of them
MOST_BLOCKS = 512
TILE = 1 << 11  # fingerprints of one side of a tile
STRIPE = 128  # of the other side at once
HASHES_AT_ONCE = 1 << 15


def fingerprint(text: str, words: int = SHINGLE_WORDS) -> int:
    """Bit by bit the majority of the hashes of all word shingles; 0 without words.

    A-Z are lower-cased, words are what ASCII white space leaves, a shorter text is one shingle.
    """
    found = text.encode().lower().split()
    if not found:
        return 0
    line = b" ".join(found)
    ends = list(accumulate(len(w) + 1 for w in found))
    starts = [0, *ends[:-1]]
    n = max(1, len(found) - words + 1)
    spans = list(zip(starts[:n], ends[min(words, len(found)) - 1:]))
    counts = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for i in range(0, n, HASHES_AT_ONCE):
        hashes = np.array([digest(line[a:b - 1], SEED) for a, b in spans[i:i + HASHES_AT_ONCE]], "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, text_hash and fp, the fingerprint as a signed long, of every row. Null counts as the empty text."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t, words) for t in texts_of(batch)], "<u8").view("<i8")
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "text_hash": batch.column("text_hash"), "fp": pa.array(found)})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return by_batch(docs.select("doc_id", "text", text_hash().alias("text_hash")), work,
                    f"doc_id {kind}, text_hash long, fp long")


def _close_pairs(left: np.ndarray, right: np.ndarray, radius: int,
                 same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of fingerprints within the radius, tile by tile; of one block with itself, i < j."""
    # Written over for each stripe of a tile, so that they stay in the cache.
    xored, counted = np.empty((STRIPE, TILE), np.uint64), np.empty((STRIPE, TILE), np.uint8)
    counts_l, counts_r = (np.bitwise_count(x).astype(np.int16) for x in (left, right))
    for i in range(0, len(left), TILE):
        a, ca = left[i:i + TILE, None], counts_l[i:i + TILE]
        for j in range(i if same else 0, len(right), TILE):
            cb = counts_r[j:j + TILE]
            if int(ca.min()) - int(cb.max()) > radius or int(cb.min()) - int(ca.max()) > radius:
                continue
            for s in range(0, len(a), STRIPE):
                stripe = a[s:s + STRIPE]
                bits, distance = xored[:len(stripe), :len(cb)], counted[:len(stripe), :len(cb)]
                np.bitwise_xor(stripe, right[j:j + TILE], out=bits)
                np.bitwise_count(bits, out=distance)
                if distance.min() > radius:
                    continue
                x, y = np.nonzero(distance <= radius)
                x, y = x + i + s, y + j
                if same:
                    keep = x < y
                    x, y = x[keep], y[keep]
                if len(x):
                    yield x, y


def _forest(n: int, pairs: Iterable[tuple[np.ndarray, np.ndarray]]) -> list[tuple[int, int]]:
    """The pairs that join what was not joined before."""
    parent = np.arange(n)
    label = parent.copy()  # a root of each place, as of the last refresh
    kept = []
    for x, y in pairs:
        new = label[x] != label[y]
        x, y = x[new], y[new]
        for i, j in zip(x.tolist(), y.tolist()):
            u, v = i, j
            while parent[u] != u:
                parent[u] = u = parent[parent[u]]
            while parent[v] != v:
                parent[v] = v = parent[parent[v]]
            if u != v:
                parent[max(u, v)] = min(u, v)
                kept.append((i, j))
        if len(x) > 64:
            label = parent.copy()
            while (label != (up := label[label])).any():
                label = up
    return kept


def links(distinct: DataFrame, radius: int = MAX_DISTANCE, block: int = BLOCK) -> DataFrame:
    """(a, b): links between distinct fingerprints (column fp) that connect all within the radius.

    Every pair within the radius is connected by a path of returned links, each of
    which is within it. The broadcast tables hold blocks and pairs of blocks, whose
    number MOST_BLOCKS and the 65 population counts bound.
    """
    spark = distinct.sparkSession
    counted = distinct.select("fp", F.bit_count("fp").cast("int").alias("bits"))
    per_count = {r["bits"]: r["n"] for r in counted.groupBy("bits").agg(F.count("*").alias("n")).collect()}  # <= 65
    block = max(block, -(-sum(per_count.values()) // MOST_BLOCKS))
    blocks = [(bits, part) for bits, n in sorted(per_count.items()) for part in range(-(-n // block))]
    number = {b: i for i, b in enumerate(blocks)}
    pairs = [(number[p], number[q], pair) for pair, (p, q) in enumerate(
        (p, q) for p in blocks for q in blocks if p <= q and q[0] - p[0] <= radius)]
    # A row for each block that a pair needs: as many as pairs of blocks, whatever a block holds.
    places = [(i, pair, 0) for i, _, pair in pairs] + [(j, pair, 1) for i, j, pair in pairs if i != j]
    if not pairs:
        return spark.createDataFrame([], "a long, b long")
    sizes = spark.createDataFrame([(bits, part, i, -(-per_count[bits] // block)) for (bits, part), i in number.items()],
                                  "bits int, part long, block int, parts long")
    blocked = counted.join(F.broadcast(sizes.where("part = 0").select("bits", "parts")), "bits").select(
        "fp", "bits", F.pmod(F.xxhash64("fp"), F.col("parts")).alias("part"),
    ).join(F.broadcast(sizes.select("bits", "part", "block")), ["bits", "part"])
    dealt = blocked.select("fp", "block").join(
        F.broadcast(spark.createDataFrame(places, "block int, pair int, side int")), "block").select("pair", "side", "fp")

    def compare(group: pa.Table) -> pa.Table:
        side, fp = group["side"].to_numpy(), group["fp"].to_numpy().view("u8")
        left, right = np.sort(fp[side == 0]), np.sort(fp[side == 1])
        same = not len(right)
        nodes = left if same else np.concatenate([left, right])
        shift = 0 if same else len(left)
        found = _close_pairs(left, left if same else right, radius, same)
        kept = _forest(len(nodes), ((x, y + shift) for x, y in found))
        ends = np.array(kept, np.int64).reshape(-1, 2)
        signed = nodes.view("i8")
        return pa.table({"a": signed[ends[:, 0]], "b": signed[ends[:, 1]]})

    return dealt.groupBy("pair").applyInArrow(compare, "a long, b long")


def _rooted(marked: DataFrame, radius: int) -> DataFrame:
    """fp, root (the smallest fingerprint of its component) and the smallest row of every fingerprint."""
    # Ids that are null come last.
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    smallest = settle(marked.groupBy("fp").agg(F.min(row).alias("least")), "distinct_fingerprints")
    roots = settle(smallest_reachable(links(smallest, radius)), "components")
    return smallest.join(roots, smallest["fp"] == roots["node"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, words: int = SHINGLE_WORDS, radius: int = MAX_DISTANCE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every row.

    Documents link if their fingerprints differ in at most ``radius`` bits;
    component_id is the smallest doc_id reachable over links. Texts that are null,
    empty or white space have fingerprint 0 and link like others. A null doc_id is
    never the smallest; a component of such rows alone has a null id. Repeated rows
    share their component; other columns are not looked at.
    """
    marked = settle(fingerprints(docs, words), "fingerprints")
    rooted = _rooted(marked, radius)
    components = rooted.groupBy("root").agg(F.min("least").alias("first"))
    # Settled, so that a fingerprint with very many documents is split by the join.
    labelled = settle(rooted.join(components, "root").select(
        "fp", F.col("first.doc_id").alias("component_id")), "labelled_fingerprints")
    return marked.join(labelled, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def representatives(docs: DataFrame, words: int = SHINGLE_WORDS, radius: int = MAX_DISTANCE) -> DataFrame:
    """One document of each component, the one with the smallest id, with all its columns.

    Rows without an id stay only where nothing in their component has one, again one of them.
    """
    marked = settle(fingerprints(docs, words), "fingerprints")
    firsts = _rooted(marked, radius).groupBy("root").agg(F.min("least").alias("first"))
    return keep_rows(docs, firsts.select("first.doc_id", "first.text_hash"))
