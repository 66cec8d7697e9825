"""Exact duplicates: partitions by length and content hash, each with a compressed radix trie of whole texts.

Every task first merges the texts it reads in a trie of its own, so that a text is
shuffled once per task, however many copies it has. The partitions' owners are kept
at the terminal nodes. A trie that outgrows its memory gives its heaviest subtree to
an unnamed scratch file, which is worked off when the rest is done. Like Spark's own
spills it belongs to the running task alone: nobody else reads it, and a task that is run
again starts without it.
"""

from __future__ import annotations

import struct
import tempfile
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardbook.llm.common import by_batch, keep_rows, text_hash, text_or_empty

TRIE_BYTES = 128 << 20  # of labels and nodes, as estimated, in one task
NODE_BYTES = 400


class Node:
    """A place in the trie: the label that leads to it, children by their first byte, and what ends here."""

    __slots__ = ("label", "children", "value")

    def __init__(self, label: bytes, value: tuple | None = None):
        self.label, self.children, self.value = label, {}, value


def _common(a: bytes, b: bytes, start: int) -> int:
    """How far ``a`` and ``b`` from ``start`` agree, by halving."""
    low, high = 0, min(len(a), len(b) - start)
    while low < high:
        mid = (low + high + 1) // 2
        if a[:mid] == b[start:start + mid]:
            low = mid
        else:
            high = mid - 1
    return low


def combine(a: tuple, b: tuple) -> tuple:
    """(rows, the smallest id, the largest id) of two lots of one text; ids may be None."""
    low = b[1] if a[1] is None else a[1] if b[1] is None else min(a[1], b[1])
    high = b[2] if a[2] is None else a[2] if b[2] is None else max(a[2], b[2])
    return a[0] + b[0], low, high


class PatriciaTrie:
    """Whole byte strings with combined values, in bounded memory.

    ``limit`` bounds the estimated size; beyond it the heaviest child of the root
    goes to a scratch file, and strings that would go below it follow.
    """

    def __init__(self, limit: int = TRIE_BYTES):
        self.limit, self.size = limit, 0
        self.root = Node(b"")
        self.spilled: dict[int, BinaryIO] = {}

    def insert(self, key: bytes, value: tuple, at: int = 0) -> None:
        """``at``: bytes of ``key`` that lead to the root of this trie."""
        start = at
        if key[at:at + 1] and key[at] in self.spilled:
            _write(self.spilled[key[at]], key, value)
            return
        node = self.root
        while True:
            if at == len(key):
                node.value = value if node.value is None else combine(node.value, value)
                break
            child = node.children.get(key[at])
            if child is None:
                node.children[key[at]] = Node(key[at:], value)
                self.size += NODE_BYTES + len(key) - at
                break
            label = child.label
            if key.startswith(label, at):
                node, at = child, at + len(label)
                continue
            n = _common(label, key, at)
            middle = Node(label[:n])
            child.label = label[n:]
            middle.children[child.label[0]] = child
            node.children[key[at]] = middle
            self.size += NODE_BYTES
            node, at = middle, at + n
        if self.size > self.limit and self.root.children:
            self._spill(key[:start])

    def _spill(self, before: bytes) -> None:
        weights = {first: _weight(child) for first, child in self.root.children.items()}
        first = max(weights, key=weights.get)
        file = tempfile.TemporaryFile()
        for key, value in _walk(self.root.children.pop(first), before):
            _write(file, key, value)
        self.spilled[first] = file
        self.size -= weights[first]

    def items(self) -> Iterator[tuple[bytes, tuple]]:
        """All strings with their values. The trie is used up."""
        yield from _walk(self.root, b"")
        files = list(self.spilled.values())
        while files:
            # What all strings of a file begin with leads to the root of a trie for them; below, they part.
            with files.pop() as file:
                lead = _shared_prefix(file)
                below = PatriciaTrie(self.limit)
                for key, value in _entries(file):
                    below.insert(key, value, at=len(lead))
            yield from _walk(below.root, lead)
            files.extend(below.spilled.values())


def _shared_prefix(file: BinaryIO) -> bytes:
    lead = None
    for key, _ in _entries(file):
        lead = key if lead is None else lead[:_common(lead, key, 0)]
    return lead or b""


def _walk(top: Node, before: bytes) -> Iterator[tuple[bytes, tuple]]:
    stack = [(top, before)]
    while stack:
        node, path = stack.pop()
        path += node.label
        if node.value is not None:
            yield path, node.value
        stack.extend((child, path) for child in node.children.values())


def _weight(top: Node) -> int:
    total, stack = 0, [top]
    while stack:
        node = stack.pop()
        total += NODE_BYTES + len(node.label)
        stack.extend(node.children.values())
    return total


_ENTRY = struct.Struct("<qqqq?")


def _write(file: BinaryIO, key: bytes, value: tuple) -> None:
    n, low, high = value
    file.write(_ENTRY.pack(len(key), n, low or 0, high or 0, low is not None))
    file.write(key)


def _entries(file: BinaryIO) -> Iterator[tuple[bytes, tuple]]:
    file.seek(0)
    while head := file.read(_ENTRY.size):
        length, n, low, high, known = _ENTRY.unpack(head)
        yield file.read(length), (n, low, high) if known else (n, None, None)


SCHEMA = "text string, n long, low long, high long"
_ARROW = pa.schema([("text", pa.string()), ("n", pa.int64()), ("low", pa.int64()), ("high", pa.int64())])


def _emit(entries: Iterator[tuple[bytes, tuple]]) -> Iterator[pa.RecordBatch]:
    rows, size = [], 0
    for key, (n, low, high) in entries:
        rows.append((key, n, low, high))
        size += len(key) + 100
        if size > 4 << 20:
            yield _batch(rows)
            rows, size = [], 0
    if rows:
        yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    texts, *numbers = zip(*rows)
    return pa.RecordBatch.from_arrays(
        [pa.array(texts, pa.binary()).cast(pa.string()), *(pa.array(c, pa.int64()) for c in numbers)], schema=_ARROW)


def _merge(limit: int, whole: bool):
    """Combines equal texts of a task; without ``whole`` it hands on what it has when memory is full."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = PatriciaTrie(limit if whole else 1 << 62)
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("n", "low", "high")]
            for key, *value in zip(batch.column("text").cast(pa.binary()).to_pylist(), *columns):
                trie.insert(key, tuple(value))
            if not whole and trie.size > limit:
                yield from _emit(trie.items())
                trie = PatriciaTrie(1 << 62)
        yield from _emit(trie.items())

    return work


def owners(docs: DataFrame, trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """One row per distinct text: text, n (rows), low and high (smallest and largest doc_id).

    Null counts as the empty text. Ids are integers; null ids count as rows only.
    """
    rows = docs.select(
        text_or_empty().alias("text"), F.lit(1).cast("long").alias("n"), F.col("doc_id").cast("long").alias("low"),
        F.col("doc_id").cast("long").alias("high"))
    merged = by_batch(rows, _merge(trie_bytes // 4, whole=False), SCHEMA)
    dealt = merged.repartition(F.octet_length("text"), F.xxhash64("text"))
    return by_batch(dealt, _merge(trie_bytes, whole=True), SCHEMA)


def exact_duplicates(docs: DataFrame, trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row.

    Texts are equal if they are identical; null counts as the empty text. Of equal
    texts the row with the largest doc_id stays: keep_id. Of rows that repeat both id
    and text one is kept. Rows without an id give way to any row with one; if none of
    a group has one, keep_id is null and one of them is kept.
    """
    kind = docs.schema["doc_id"].dataType
    keys = ["length", "hash", "sha"]
    content = [F.octet_length("text").alias("length"), F.xxhash64("text").alias("hash"),
               F.sha2(F.col("text"), 256).alias("sha")]
    groups = owners(docs, trie_bytes).select(*content, F.col("high").cast(kind).alias("keep_id"),
                                             F.col("n").alias("group_size"))
    # Repeated rows are counted first, so that one of them can be told from the others.
    rows = docs.select("doc_id", text_or_empty().alias("text")).select("doc_id", *content)
    rows = rows.groupBy("doc_id", *keys).agg(F.count("*").alias("copies"))
    # Rows without an id are as many for one text as there are; they are one row here.
    found = rows.join(groups, keys).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return found.select(
        "doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
        F.col("sha").alias("text_sha256"))


def survivors(docs: DataFrame, trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """The kept rows of ``exact_duplicates``, with all their columns."""
    kind = docs.schema["doc_id"].dataType
    kept = owners(docs, trie_bytes).select(F.col("high").cast(kind).alias("doc_id"), text_hash().alias("text_hash"))
    return keep_rows(docs, kept)
