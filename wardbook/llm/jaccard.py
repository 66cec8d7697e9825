"""N-gram Jaccard join: which texts share most of their word shingles, in size-banded tiles of bitmap signatures.

Each distinct set of shingles has a signature: a bitmap in which each shingle flips one bit by its hash. Where the
signatures of two sets differ in d bits, at least d shingles are in one set alone, so that the bit count of their
exclusive-or bounds the overlap from above. Sets are cut into blocks within bands of like size; only blocks of the same
or of neighbouring bands meet, as tiles that compare every pair by bit counts. What passes is decided by
intersecting the sorted hashes.

A tile hands on a spanning forest of the pairs that pass, never all of them. The edges are decided first. Where they hold, their
component is whole and done. Where some do not, the sets of that component are compared again in tiles that hold the
sorted hashes, which decide each pair that is not connected yet.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardbook.llm.common import by_batch, row_key, settle, text_hash, text_or_empty
from wardbook.llm.components import smallest_reachable
from wardbook.llm.words import SPACED, grams, groups, mix, split_words

SHINGLE_WORDS = 4
PERCENT = 85
BLOCK = 1 << 16  # sets of one block, or more beyond MOST_BLOCKS of them
MOST_BLOCKS = 512
STRIPE, TILE = 64, 1 << 11  # sets of the sides of a tile that are compared at once
HASHES_PER_BLOCK = 1 << 22  # of a block that holds the sorted hashes: 32 MB
LINKS_IN_A_TASK = 1 << 19  # that one task joins to components; more are joined by rounds over all tasks


def shingle_sets(texts: list[bytes], words: int = SHINGLE_WORDS) -> Iterator[np.ndarray]:
    """Of each text the sorted distinct hashes of its shingles; a shorter text is one shingle, one without words none."""
    for _, group in groups(texts):
        parts = split_words(group, SPACED, lower=True)
        hashes = parts.hashes()
        whole = grams(hashes, words)
        for a, b in zip(parts.first[:-1].tolist(), parts.first[1:].tolist()):
            if b - a >= words:
                yield np.unique(whole[a:b - words + 1])
            elif b > a:
                yield mix(grams(hashes[a:b], b - a) + np.uint64(b - a))
            else:
                yield hashes[:0]


def band_of(n: int, percent: int = PERCENT) -> int:
    """Sets that can be linked are in the same or in neighbouring bands."""
    return int(log(n) / log(100 / percent * 1.0001))


def _bits(band: int, percent: int) -> int:
    """Bits of the signatures of a band: some more than its largest set has shingles."""
    largest = (100 / percent * 1.0001) ** (band + 1)
    return max(128, 1 << int(np.ceil(np.log2(1.2 * largest))))


def signature(hashes: np.ndarray, percent: int = PERCENT) -> bytes:
    bits = _bits(band_of(len(hashes), percent), percent)
    flips = np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(flips.astype(np.uint8), bitorder="little").tobytes()


def _folded(signatures: np.ndarray, words: int) -> np.ndarray:
    """Signatures (a row each) of fewer words: each bit is the exclusive-or of those that fall together."""
    while signatures.shape[1] > words:
        half = signatures.shape[1] // 2
        signatures = signatures[:, :half] ^ signatures[:, half:]
    return signatures


def _linkable(percent: int) -> Column:
    """Whether a set of n shingles can be linked with another one."""
    return (100 - percent) * (2 * F.col("n") + 1) >= 100 + percent


def _most_apart(total: np.ndarray, percent: int) -> np.ndarray:
    """How many shingles at most only one of two linked sets has, by the sum of their sizes."""
    return (100 - percent) * total // (100 + percent)


class _Side:
    """Sets of a block, by size."""

    def __init__(self, table: pa.Table):
        self.n = table["n"].to_numpy()
        order = np.argsort(self.n, kind="stable")
        self.n = self.n[order]
        self.node = table["node"].to_numpy()[order]
        widths = {len(s) for s in table["signature"].to_pylist()}
        signatures = table["signature"].to_pylist()
        # A band has one width.
        self.words = min(widths, default=16) // 8
        rows = [np.frombuffer(signatures[i], "<u8").reshape(1, -1) for i in order.tolist()]
        if len(widths) > 1:
            rows = [_folded(r, self.words) for r in rows]
        self.signatures = np.concatenate(rows) if rows else np.zeros((0, self.words), np.uint64)

    def __len__(self) -> int:
        return len(self.n)


def _distance(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Differing bits of every row (words first) of ``left`` and of ``right``."""
    total = np.zeros((left.shape[1], right.shape[1]), np.uint16 if left.shape[0] < 1024 else np.uint32)
    for a, b in zip(left, right):
        total += np.bitwise_count(a[:, None] ^ b)
    return total


class _Joined:
    """Which places are connected; ``label`` of a place is its root as of the last refresh. Those of one class are from the start."""

    def __init__(self, classes: np.ndarray):
        _, first, of = np.unique(classes, return_index=True, return_inverse=True)
        self.parent = first[of]
        self.label = self.parent.copy()

    def top(self, i: int) -> int:
        parent = self.parent
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return int(i)

    def join(self, u: int, v: int) -> None:
        """Of two different roots."""
        self.parent[max(u, v)] = min(u, v)

    def refresh(self) -> None:
        while (self.parent != (up := self.parent[self.parent])).any():
            self.parent = up
        self.label = self.parent.copy()


def _passing(left: _Side, right: _Side, percent: int, joined: _Joined,
             shift: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of pairs, not joined yet, that the bit counts allow to be linked. Places on the right count on from
    ``shift``; without a shift a block meets itself, and i < j."""
    same = not shift
    words = min(left.words, right.words)
    whole_l, whole_r = _folded(left.signatures, words), _folded(right.signatures, words)
    rough = max(2, words // 2)
    rough_l, rough_r = (np.ascontiguousarray(_folded(x, rough).T) for x in (whole_l, whole_r))
    for i in range(0, len(left), STRIPE):
        n = left.n[i:i + STRIPE]
        lo = int(np.searchsorted(right.n, -(-n[0] * percent // 100), "left"))
        hi = int(np.searchsorted(right.n, n[-1] * 100 // percent, "right"))
        if same:
            lo = max(lo, i)
        for j in range(lo, hi, TILE):
            k = min(hi, j + TILE)
            total = n[:, None] + right.n[None, [k - 1]]
            x, y = np.nonzero(_distance(rough_l[:, i:i + STRIPE], rough_r[:, j:k]) <= _most_apart(total, percent))
            x, y = x + i, y + j
            for c in range(0, len(x), 1 << 14):
                u, v = x[c:c + (1 << 14)], y[c:c + (1 << 14)]
                open_yet = joined.label[u] != joined.label[v + shift]
                if same:
                    open_yet &= u < v
                u, v = u[open_yet], v[open_yet]
                apart = np.bitwise_count(whole_l[u] ^ whole_r[v]).sum(axis=1)
                keep = apart <= _most_apart(left.n[u] + right.n[v], percent)
                if keep.any():
                    yield u[keep], v[keep] + shift


def _blocked(sets: DataFrame, percent: int, block: int) -> DataFrame:
    """pair, side, node, n, signature: each set once for every pair of blocks that it is in.

    The broadcast tables hold blocks and pairs of blocks, whose number MOST_BLOCKS and the bands bound: a band for each
    sixth more shingles, 270 for any size that a long holds.
    """
    spark = sets.sparkSession
    per_band = {r["band"]: r["sets"] for r in sets.groupBy("band").agg(F.count("*").alias("sets")).collect()}
    block = max(block, -(-sum(per_band.values()) // MOST_BLOCKS))
    blocks = [(band, part) for band, many in sorted(per_band.items()) for part in range(-(-many // block))]
    number = {b: i for i, b in enumerate(blocks)}
    pairs = [(number[p], number[q], k) for k, (p, q) in enumerate(
        (p, q) for p in blocks for q in blocks if p <= q and q[0] - p[0] <= 1)]
    places = [(i, k, 0) for i, _, k in pairs] + [(j, k, 1) for i, j, k in pairs if i != j]
    parts = spark.createDataFrame([(band, part, number[band, part], -(-per_band[band] // block)) for band, part in blocks],
                                  "band int, part long, block int, parts long")
    return sets.join(F.broadcast(parts.where("part = 0").select("band", "parts")), "band").withColumn(
        "part", F.pmod(F.xxhash64("node"), F.col("parts")),
    ).join(F.broadcast(parts.select("band", "part", "block")), ["band", "part"]).join(
        F.broadcast(spark.createDataFrame(places, "block int, pair int, side int")), "block",
    ).select("pair", "side", "node", "n", "signature")


def _connect(group: pa.Table, percent: int, exact: bool) -> pa.Table:
    """(a, b): pairs of the sets of a tile that connect all that pass, or with ``exact`` all that are linked."""
    side = group["side"].to_numpy()
    left, right = _Side(group.filter(side == 0)), _Side(group.filter(side == 1))
    shift = len(left) if len(right) else 0
    nodes = np.concatenate([left.node, right.node])
    classes, hashes = nodes, {}
    if exact:
        of_node = group["node"].to_pylist()
        hashes = dict(zip(of_node, group["hashes"].to_pylist()))
        of_class = dict(zip(of_node, group["class"].to_pylist()))
        classes = np.array([of_class[v] for v in nodes.tolist()])
    joined, kept = _Joined(classes), []
    for x, y in _passing(left, right if shift else left, percent, joined, shift):
        for i, j in zip(x.tolist(), y.tolist()):
            u, v = joined.top(i), joined.top(j)
            if u != v and (not exact or _linked(hashes[nodes[i]], hashes[nodes[j]], percent)):
                joined.join(u, v)
                kept.append((nodes[i], nodes[j]))
        joined.refresh()
    ends = np.array(kept, np.int64).reshape(-1, 2)
    return pa.table({"a": ends[:, 0], "b": ends[:, 1]})


def passing_links(sets: DataFrame, percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """(a, b): pairs of sets that bit counts allow to be linked, as many as connect all such pairs.

    ``sets`` has node (long), n, band and signature.
    """
    if sets.isEmpty():
        return sets.sparkSession.createDataFrame([], "a long, b long")
    return _blocked(sets, percent, block).groupBy("pair").applyInArrow(
        lambda group: _connect(group, percent, exact=False), "a long, b long")


def _linked(of_a: bytes, of_b: bytes, percent: int) -> bool:
    """Whether two sorted arrays of distinct hashes have enough in common."""
    a, b = np.frombuffer(of_a, "<u8"), np.frombuffer(of_b, "<u8")
    if len(a) > len(b):
        a, b = b, a
    places = np.searchsorted(b, a)
    shared = int(np.count_nonzero(b[np.minimum(places, len(b) - 1)] == a))
    return 100 * shared >= percent * (len(a) + len(b) - shared)


def _decided(edges: DataFrame, hashes: DataFrame, percent: int) -> DataFrame:
    """``edges`` (a, b) with ``linked``, by intersecting the sorted hashes."""
    ends = edges.join(hashes.select(F.col("node").alias("a"), F.col("hashes").alias("of_a")), "a") \
        .join(hashes.select(F.col("node").alias("b"), F.col("hashes").alias("of_b")), "b")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pydict({
                "a": batch.column("a"), "b": batch.column("b"), "linked": pa.array([
                    _linked(x, y, percent)
                    for x, y in zip(batch.column("of_a").to_pylist(), batch.column("of_b").to_pylist())], pa.bool_())})

    return by_batch(ends.select("a", "b", "of_a", "of_b"), work, "a long, b long, linked boolean")


def _unsettled_tiles(members: DataFrame, most: int) -> DataFrame:
    """pair (with component) and side for the rows of ``members`` (component, class, node, n, ...).

    A class, whose sets are connected already, with more than ``most`` hashes has blocks of its own, which are not compared with
    each other; the others of a component share blocks.
    """
    sizes = members.groupBy("component", "class").agg(F.sum("n").alias("hashes"))
    own = F.col("hashes") > most
    sizes = sizes.select("component", "class", "hashes", F.when(own, F.col("class")).alias("alone"))
    blocks = sizes.groupBy("component", "alone").agg(F.ceil(F.sum("hashes") / most).alias("parts"))
    blocks = settle(blocks, "jaccard_blocks")
    placed = members.join(settle(sizes.drop("hashes"), "jaccard_classes"), ["component", "class"])
    # By class where classes share a block, by set where a class fills several.
    spread = F.when(F.col("alone").isNull(), F.xxhash64("class")).otherwise(F.xxhash64("node"))
    key = F.coalesce("alone", F.lit(-1))
    placed = placed.withColumn("alone", key).join(blocks.withColumn("alone", key), ["component", "alone"]).withColumn(
        "part", F.pmod(spread, F.col("parts")))
    every = blocks.withColumn("alone", key).select(
        "component", "alone", F.explode(F.expr("sequence(0L, cast(parts as long) - 1)")).alias("part"))
    left, right = (every.select("component", F.struct("alone", "part").alias(s)) for s in ("p", "q"))
    pairs = left.join(right, "component").where(
        (F.col("p") <= F.col("q")) & ((F.col("p.alone") < 0) | (F.col("p.alone") != F.col("q.alone"))))
    sides = pairs.select("component", F.struct("p", "q").alias("pair"), F.explode(F.array_distinct(F.array("p", "q"))).alias("of"))
    sides = sides.select("component", "pair", (F.col("of") != F.col("pair.p")).cast("int").alias("side"),
                         F.col("of.alone").alias("alone"), F.col("of.part").alias("part"))
    return placed.join(sides, ["component", "alone", "part"])


def _exact_links(members: DataFrame, percent: int, most: int) -> DataFrame:
    """(a, b): links between sets of different classes of one component that, with the classes, connect all of them."""
    tiles = _unsettled_tiles(members, most)
    return tiles.select("component", "pair", "side", "node", "class", "n", "signature", "hashes").groupBy(
        "component", "pair").applyInArrow(lambda group: _connect(group, percent, exact=True), "a long, b long")


def _components(links: DataFrame) -> DataFrame:
    """(node, root) of the written table ``links`` (a, b): the smallest node reachable, for every node.

    At most LINKS_IN_A_TASK links, a few megabytes, are joined by one task; more of them by rounds over all tasks.
    """
    if links.limit(LINKS_IN_A_TASK + 1).count() > LINKS_IN_A_TASK:
        return smallest_reachable(links)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends = [np.stack([b.column("a").to_numpy(), b.column("b").to_numpy()], axis=1) for b in batches]
        if not ends:
            return
        nodes, places = np.unique(np.concatenate(ends), return_inverse=True)
        joined = _Joined(nodes)
        for i, j in places.reshape(-1, 2).tolist():
            u, v = joined.top(i), joined.top(j)
            if u != v:
                joined.join(u, v)
        joined.refresh()
        yield pa.RecordBatch.from_pydict({"node": pa.array(nodes), "root": pa.array(nodes[joined.label])})

    return by_batch(links.coalesce(1), work, "node long, root long")


def _signed(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """doc_id, text_hash, n, set (a 128-bit digest), band and signature of every row."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [b"" if t is None else t for t in batch.column("text").cast(pa.binary()).to_pylist()]
            n, digests, bands, signatures = [], [], [], []
            for hashes in shingle_sets(texts, words):
                n.append(len(hashes))
                digests.append(hashlib.blake2b(hashes.tobytes(), digest_size=16).digest())
                bands.append(band_of(len(hashes), percent) if len(hashes) else -1)
                signatures.append(signature(hashes, percent) if len(hashes) else b"")
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "text_hash": batch.column("text_hash"), "n": pa.array(n, pa.int64()),
                "set": pa.array(digests, pa.binary()), "band": pa.array(bands, pa.int32()),
                "signature": pa.array(signatures, pa.binary())})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return by_batch(docs.select("doc_id", "text", text_hash().alias("text_hash")), work,
                    f"doc_id {kind}, text_hash long, n long, set binary, band int, signature binary")


def _hashes_of(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """node, n, signature and hashes of the sets in ``wanted`` (node, n, signature, least), from the texts they came from."""
    rows = wanted.select("node", "n", "signature", "least.doc_id", "least.text_hash")
    right = rows.select("node", "n", "signature", *(c.alias(k) for k, c in row_key(rows, F.col("text_hash")).items()))
    keys = row_key(docs, text_hash())
    # Rows that are repeated with their id and text come once.
    texts = docs.select(text_or_empty().alias("text"), *(c.alias(k) for k, c in keys.items())).join(right, [*keys]) \
        .select("node", "n", "signature", "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [h.tobytes() for h in shingle_sets(batch.column("text").cast(pa.binary()).to_pylist(), words)]
            yield pa.RecordBatch.from_pydict({**{c: batch.column(c) for c in ("node", "n", "signature")},
                                              "hashes": pa.array(found, pa.binary())})

    schema = "node long, n long, signature binary, hashes binary"
    return by_batch(texts, work, schema).dropDuplicates(["node"])


def _roots(sets: DataFrame, docs: DataFrame, words: int, percent: int, block: int, most: int) -> DataFrame:
    """node, root: for every set with links the smallest node of its component."""
    edges = settle(passing_links(sets.where(_linkable(percent)).select("node", "n", "band", "signature"), percent, block),
                   "jaccard_passing")
    ends = edges.select(F.col("a").alias("node")).union(edges.select(F.col("b").alias("node"))).distinct()
    hashes = settle(_hashes_of(docs, sets.join(ends, "node"), words), "jaccard_hashes")
    decided = settle(_decided(edges, hashes, percent), "jaccard_decided")
    links = decided.where("linked").select("a", "b")
    classes = settle(_components(links), "jaccard_classes")
    if decided.where("not linked").isEmpty():
        return classes
    components = settle(_components(edges), "jaccard_components").withColumnRenamed("root", "component")
    members = components.join(classes, "node", "left").select("component", F.coalesce("root", "node").alias("class"), "node")
    several = members.groupBy("component").agg(F.min("class").alias("x"), F.max("class").alias("y")).where("x <> y")
    members = settle(members.join(several.select("component"), "component").join(hashes, "node"), "jaccard_members")
    more = settle(_exact_links(members, percent, most).union(links), "jaccard_links")
    return settle(_components(more), "jaccard_roots")


def jaccard_components(docs: DataFrame, words: int = SHINGLE_WORDS, percent: int = PERCENT, block: int = BLOCK,
                       most: int = HASHES_PER_BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id of every row.

    A text's set holds its distinct shingles of ``words`` words, A-Z in lower case, words being what ASCII white space
    leaves; a shorter text is one shingle. Rows link if 100 times the shared shingles are at least ``percent`` times
    those of either; component_id is the smallest doc_id reachable over links. Texts that are null or without words have
    the empty set, which is linked with nothing: their component is their own id. A null doc_id is never the
    smallest; a component of such rows alone has a null id. Repeated rows share their component; other
    columns are not looked at. Shingles are told apart by 64-bit hashes, sets by 128-bit digests.
    """
    if not 0 < percent < 100:
        raise ValueError("percent is from 1 to 99")
    signed = settle(_signed(docs, words, percent), "jaccard_signed")
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    sets = signed.where("n > 0").groupBy("set").agg(
        F.min(row).alias("least"), F.first("n").alias("n"), F.first("band").alias("band"), F.first("signature").alias("signature"))
    sets = settle(sets.withColumn("node", F.monotonically_increasing_id()), "jaccard_sets")
    roots = _roots(sets, docs, words, percent, block, most)
    rooted = sets.join(roots, "node", "left").select("set", "least", F.coalesce("root", "node").alias("root"))
    first = rooted.groupBy("root").agg(F.min("least").alias("first"))
    # Settled, so that a set with very many documents is split by the join.
    labelled = settle(rooted.join(first, "root").select("set", F.col("first.doc_id").alias("component_id")), "jaccard_labelled")
    linked = signed.where("n > 0").select("doc_id", "n", "set").join(labelled, "set").select(
        "doc_id", F.col("n").alias("n_shingles"), "component_id")
    return linked.unionByName(signed.where("n = 0").select(
        "doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))
