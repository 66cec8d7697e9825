"""Maximal repetitions of words (runs), by suffix trees and Lyndon roots.

For each document a suffix tree of its words and one of their reversal are built by
Ukkonen's algorithm. An Euler tour of a tree with a table of range minima answers how far
two places agree, forward or backward, in constant time. Every run holds a Lyndon root
under one of two opposite orders of the words, and the longest Lyndon word at a place ends
where the next smaller suffix begins; so at each place there are two candidates, which are extended both ways.

Words that can be in no run are left out of the trees first. Of a run with period q and ``min_length``
words at least, ``length - q`` is at least half of ``min_length``, so each of its
words is in a sequence of that many words which the document holds twice. Stretches without such words
become one symbol of their own, over which no run can reach.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardbook.llm.common import by_batch
from wardbook.llm.words import SPACED, grams, groups, mix, split_words

MIN_LENGTH = 12
TERMINAL = 0  # smaller than every word in both orders


class SuffixTree:
    """Of a sequence of symbols from 1 on. Inner nodes have numbers from 0 on, the leaf of suffix i is ~i."""

    def __init__(self, symbols: list[int]):
        self.n = len(symbols)
        edges, begin, end = self._grow([*symbols, TERMINAL])
        keys = np.fromiter(edges.keys(), np.int64, len(edges))
        order = np.argsort(keys)
        keys = keys[order]
        children = np.fromiter(edges.values(), np.int64, len(edges))[order]
        self.children: list[int] = children.tolist()
        self.first_child: list[int] = np.searchsorted(keys >> 32, np.arange(len(begin) + 1)).tolist()
        self.ends_here: list[bool] = ((keys & 0xFFFFFFFF) == TERMINAL).tolist()
        self._tour([e - b for b, e in zip(begin, end)])

    @staticmethod
    def _grow(s: list[int]) -> tuple[dict[int, int], list[int], list[int]]:
        """Ukkonen: (node, first symbol) -> child, and where the symbols of the edge to an inner node begin and end."""
        edges: dict[int, int] = {}
        begin, end, link = [0], [0], [0]
        leaf_begin: list[int] = []
        node = edge = length = waiting = 0
        for i, symbol in enumerate(s):
            waiting += 1
            unlinked = 0
            while waiting:
                if not length:
                    edge = i
                key = node << 32 | s[edge]
                child = edges.get(key)
                if child is None:
                    edges[key] = ~len(leaf_begin)
                    leaf_begin.append(i)
                    if unlinked:
                        link[unlinked] = node
                        unlinked = 0
                else:
                    if child < 0:
                        at = leaf_begin[~child]
                    else:
                        at = begin[child]
                        size = end[child] - at
                        if length >= size:
                            edge += size
                            length -= size
                            node = child
                            continue
                    if s[at + length] == symbol:
                        length += 1
                        if unlinked:
                            link[unlinked] = node
                        break
                    middle = len(begin)
                    begin.append(at)
                    end.append(at + length)
                    link.append(0)
                    edges[key] = middle
                    edges[middle << 32 | symbol] = ~len(leaf_begin)
                    leaf_begin.append(i)
                    if child < 0:
                        leaf_begin[~child] = at + length
                    else:
                        begin[child] = at + length
                    edges[middle << 32 | s[at + length]] = child
                    if unlinked:
                        link[unlinked] = middle
                    unlinked = middle
                waiting -= 1
                if node:
                    node = link[node]
                elif length:
                    length -= 1
                    edge = i - waiting + 1
        return edges, begin, end

    def _tour(self, edge_length: list[int]) -> None:
        """Euler tour over the inner nodes; a leaf has the place of its parent. Keeps the order of the suffixes."""
        children, first_child = self.children, self.first_child
        depths, place, order = [0], [0] * (self.n + 1), []
        above = []
        at, stop, depth = first_child[0], first_child[1], 0
        while True:
            if at == stop:
                if not above:
                    break
                at, stop, depth = above.pop()
                depths.append(depth)
                continue
            child = children[at]
            at += 1
            if child < 0:
                place[~child] = len(depths) - 1
                order.append(~child)
            else:
                above.append((at, stop, depth))
                depth += edge_length[child]
                depths.append(depth)
                at, stop = first_child[child], first_child[child + 1]
        self.place, self.order = np.array(place), order
        # minima[k][i]: of the depths at i .. i + 2**k - 1
        self.minima = [np.array(depths, np.int32)]
        while (half := 1 << len(self.minima) - 1) * 2 <= len(depths):
            last = self.minima[-1]
            self.minima.append(np.minimum(last[:-half], last[half:]))

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many symbols the suffixes at ``i`` and ``j`` (never the same) have in common: the depth of the
        lowest common ancestor."""
        a, b = self.place[i], self.place[j]
        a, b = np.minimum(a, b), np.maximum(a, b)
        level = np.frexp(b - a + 1)[1] - 1
        found = np.empty(len(a), np.int64)
        for k in np.unique(level).tolist():
            m = level == k
            found[m] = np.minimum(self.minima[k][a[m]], self.minima[k][b[m] - (1 << k) + 1])
        return found

    def opposite_order(self) -> list[int]:
        """Suffixes in the order with larger words first; the end still comes before every word."""
        children, first_child, ends_here = self.children, self.first_child, self.ends_here
        order, waiting = [], [0]
        while waiting:
            node = waiting.pop()
            if node < 0:
                order.append(~node)
                continue
            a, b = first_child[node], first_child[node + 1]
            if ends_here[a]:
                waiting += children[a + 1:b]
                waiting.append(children[a])
            else:
                waiting += children[a:b]
        return order


def _next_smaller(order: list[int]) -> np.ndarray:
    """For each suffix the place of the next that is smaller: where the longest Lyndon word from it ends."""
    n = len(order) - 1  # the empty suffix comes first
    rank = [0] * (n + 1)
    for r, i in enumerate(order):
        rank[i] = r
    following, waiting = [n] * n, [n]
    for i in range(n - 1, -1, -1):
        r = rank[i]
        while rank[waiting[-1]] > r:
            waiting.pop()
        following[i] = waiting[-1]
        waiting.append(i)
    return np.array(following)


def runs(symbols: list[int]) -> np.ndarray:
    """(start, length, smallest period) of all maximal repetitions of symbols from 1 on, twice the period at least."""
    n = len(symbols)
    if n < 2:
        return np.zeros((0, 3), np.int64)
    forward, backward = SuffixTree(symbols), SuffixTree(symbols[::-1])
    i = np.concatenate([np.arange(n), np.arange(n)])
    j = np.concatenate([_next_smaller(forward.order), _next_smaller(forward.opposite_order())])
    s = np.array(symbols)
    # A root is repeated after it or before it.
    inside = j < n
    i, j = i[inside], j[inside]
    goes_on = (s[i] == s[j]) | ((i > 0) & (s[i - 1] == s[j - 1]))
    i, j = i[goes_on], j[goes_on]
    right = forward.common(i, j)
    left = np.zeros(len(i), np.int64)
    later = np.flatnonzero(i > 0)
    left[later] = backward.common(n - i[later], n - j[later])
    period = j - i
    whole = left + right >= period
    found = np.stack([i - left, left + period + right, period], axis=1)[whole]
    return np.unique(found, axis=0)


def _in_repeats(hashes: np.ndarray, text: np.ndarray, size: int) -> np.ndarray:
    """Whether each word is in a sequence of ``size`` words whose hash its text holds more than once."""
    covered = np.zeros(len(hashes), bool)
    keys = grams(hashes, size)
    keep = np.flatnonzero(text[:len(keys)] == text[size - 1:])
    keys = mix(keys[keep] + text[keep].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(keys)
    same = keys[order][1:] == keys[order][:-1]
    twice = np.zeros(len(keys), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edges = np.zeros(len(hashes) + 1, np.int64)
    starts = keep[twice]
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + size, -1)
    covered[:] = np.cumsum(edges[:-1]) > 0
    return covered


def runs_of(words: list[bytes], in_repeats: np.ndarray, min_length: int = MIN_LENGTH) -> np.ndarray:
    """(start, length, period) of the runs of a document of ``min_length`` words at least, by start, then period."""
    edges = np.diff(in_repeats.view(np.int8), prepend=np.int8(0), append=np.int8(0))
    begins, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    long_enough = ends - begins >= min_length
    begins, ends = begins[long_enough].tolist(), ends[long_enough].tolist()
    if not begins:
        return np.zeros((0, 3), np.int64)
    number: dict[bytes, int] = {}
    symbols: list[int] = []
    origin: list[int] = []  # of each stretch its place in the document less that in symbols
    first: list[int] = []
    for begin, end in zip(begins, ends):
        first.append(len(symbols))
        origin.append(begin - len(symbols))
        symbols += [number.setdefault(w, len(number) + 1) for w in words[begin:end]]
        symbols.append(-1)
    symbols.pop()
    if len(begins) > 1:  # what parts two stretches occurs once
        own = len(number)
        for k in first[1:]:
            own += 1
            symbols[k - 1] = own
    found = runs(symbols)
    found = found[found[:, 1] >= min_length]
    found[:, 0] += np.array(origin)[np.searchsorted(first, found[:, 0], "right") - 1]
    return found


def _collapsed(words: list[bytes], found: np.ndarray) -> bytes:
    """The words but those of a run beyond its first period, joined by one space."""
    if not len(found):
        return b" ".join(words)
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, found[:, 0] + found[:, 2], 1)
    np.add.at(edges, found[:, 0] + found[:, 1], -1)
    kept = np.flatnonzero(np.cumsum(edges[:-1]) == 0)
    return b" ".join([words[i] for i in kept.tolist()])


def _documents(texts: list[bytes], min_length: int) -> Iterator[tuple[list[bytes], np.ndarray]]:
    """Words and runs of each text."""
    for _, group in groups(texts):
        parts = split_words(group, SPACED)
        covered = _in_repeats(parts.hashes(), parts.text_of(), -(-min_length // 2))
        for text, a, b in zip(group, parts.first[:-1].tolist(), parts.first[1:].tolist()):
            words = text.split()  # of bytes: at ASCII white space
            mask = covered[a:b]
            yield words, runs_of(words, mask, min_length) if mask.any() else np.zeros((0, 3), np.int64)


def find_runs(docs: DataFrame, min_length: int = MIN_LENGTH, with_runs: bool = False,
              with_text: bool = False) -> DataFrame:
    """doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256 of every row.

    Words are what ASCII white space leaves. A run is a stretch of words with smallest period q, twice q and
    ``min_length`` words long at least, that no neighbouring word extends; start, length, period and
    floor(1000 * length / period) are those of the longest (ties: smallest start, then
    period), null without a run. runs_sha256 is of the lines ``start,length,period`` of all runs by start and period.
    Collapsing drops from each run what follows its first period; optionally ``runs`` and the ``collapsed`` text
    are returned too. Null counts as the empty text, which has no runs. Rows are independent: repeated ones give repeated
    results, a null doc_id stays null, other columns are not looked at. Memory follows the longest
    text: some 500 bytes for each of its words that occur in repeats.
    """
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_runs long, start long, length long, " \
             "period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
    schema += ", runs array<struct<start:long,length:long,period:long>>" * with_runs + ", collapsed string" * with_text

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [b"" if t is None else t for t in batch.column("text").cast(pa.binary()).to_pylist()]
            n, longest, lines, kept, every, collapsed = [], [], [], [], [], []
            for words, found in _documents(texts, min_length):
                text = _collapsed(words, found)
                rows = found.tolist()
                n.append(len(rows))
                longest.append(min(rows, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None)))
                lines.append(hashlib.sha256("".join(f"{s},{l},{p}\n" for s, l, p in rows).encode()).hexdigest())
                kept.append(hashlib.sha256(text).hexdigest())
                if with_runs:
                    every.append([{"start": s, "length": l, "period": p} for s, l, p in rows])
                if with_text:
                    collapsed.append(text.decode())
            start, length, period = (pa.array([x[k] for x in longest], pa.int64()) for k in range(3))
            columns = {
                "doc_id": batch.column("doc_id"), "n_runs": pa.array(n, pa.int64()),
                "start": start, "length": length, "period": period,
                "exponent_milli": pa.array([None if p is None else 1000 * l // p for _, l, p in longest], pa.int64()),
                "runs_sha256": pa.array(lines, pa.string()), "collapsed_sha256": pa.array(kept, pa.string())}
            if with_runs:
                columns["runs"] = pa.array(every, pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])))
            if with_text:
                columns["collapsed"] = pa.array(collapsed, pa.string())
            yield pa.RecordBatch.from_pydict(columns)

    return by_batch(docs.select("doc_id", "text"), work, schema)


def with_planted_periods(docs: DataFrame) -> DataFrame:
    """doc_id and text, where the end of the text of one row in ten repeats itself.

    Let h be the CRC-32 of doc_id as decimal text and g = floor(h / 10). Where h % 10 = 0, each word i from
    a = g % n on becomes word a + (i - a) % p, with p = 1 + floor((n - a) / (3 + g % 8)), of the n words of the text, and
    the words are joined by one space. Other texts, null and texts without words stay as they are.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = docs.select("doc_id", "text", h.alias("h"), F.floor(h / 10).alias("g"),
                        F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), 1)).alias("w"))
    places = words.withColumn("n", F.size("w")).withColumn("a", F.when(F.col("n") > 0, F.expr("cast(g % n as int)")))
    places = places.withColumn("p", F.expr("cast(1 + floor((n - a) / (3 + g % 8)) as int)"))
    repeated = F.expr("array_join(transform(sequence(0, n - 1), i -> w[if(i >= a, a + (i - a) % p, i)]), ' ')")
    return places.select("doc_id", F.when(F.col("n") > 0, repeated).otherwise(F.col("text")).alias("text"))
