"""Substring dedup: words covered by long windows that an earlier document has too.

Difference-cover anchors. Runs of ``ANCHOR`` words are hashed only where the place in
the document modulo ``PERIOD`` is in ``COVER``. Every residue is a difference of two members
of the cover, so two equal windows of ``WINDOW = ANCHOR + PERIOD - 1`` words, wherever
they start, have an aligned anchor in common. What shares no anchor with another
document is done; the rest extends to whole windows, which are compared exactly, by
two independent hashes, for the smallest document.

Both steps ask the same kind of question of the whole corpus, and ask it in packed form: an
Arrow batch sends each hash once, in one binary cell per bucket, and the answer comes
back by batch. What a batch can answer itself is not asked, so that a window in
a third of all documents is sent once per batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardbook.llm.common import by_batch, row_key, text_hash, text_or_empty
from wardbook.llm.words import SPACED, Words, grams, groups, split_words

WINDOW = 13
PERIOD = 7
COVER = (1, 2, 4)
ANCHOR = WINDOW - PERIOD + 1
BUCKETS_PER_TASK = 4
BYTES_PER_BUCKET = 32 << 20  # of text; its anchors and windows take less in a cell

# A cell: of one batch and bucket the hashes, and of those that want an answer the place in the batch and the
# document. A directory: the documents of a batch by their first words.
CELL = ("bucket int, batch long, keys binary, checks binary, places binary, asking binary, "
        "known binary, first binary, ids binary, hashes binary")
ANSWER = "batch long, known binary, first binary, ids binary, hashes binary"
_CELL = pa.schema([("bucket", pa.int32()), ("batch", pa.int64())] + [
    (c, pa.binary()) for c in ("keys", "checks", "places", "asking", "known", "first", "ids", "hashes")])
_ANSWER = pa.schema([("batch", pa.int64())] + [(c, pa.binary()) for c in ("known", "first", "ids", "hashes")])


def _pack(numbers: np.ndarray, kind: str) -> bytes:
    """Numbers by byte planes, which compress better than whole numbers."""
    return numbers.astype(kind).view(np.uint8).reshape(-1, np.dtype(kind).itemsize).T.tobytes()


def _unpack(packed: bytes, kind: str) -> np.ndarray:
    planes = np.frombuffer(packed, np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def _pack_places(places: np.ndarray) -> bytes:
    return _pack(np.diff(places, prepend=0), "<u4")


def _unpack_places(packed: bytes) -> np.ndarray:
    return np.cumsum(_unpack(packed, "<u4").astype(np.int64))


class _Batch:
    """Words of all texts of an Arrow batch, hashed group by group."""

    def __init__(self, batch: pa.RecordBatch):
        texts = [b"" if t is None else t for t in batch.column("text").cast(pa.binary()).to_pylist()]
        self.ids = batch.column("__llm_id").to_numpy()
        self.known_id = ~batch.column("__llm_null").to_numpy(zero_copy_only=False)
        self.text_hashes = batch.column("__llm_hash").to_numpy()
        self.parts: list[tuple[int, Words]] = [(begin, split_words(t, SPACED)) for begin, t in groups(texts)]
        self.counts = np.concatenate([w.counts for _, w in self.parts]) if self.parts else np.zeros(0, np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.counts)])
        # Rows without an id neither have nor are an earlier document.
        self.asks = self.known_id & (self.counts >= WINDOW)

    def found(self, column: pa.Array) -> list:
        """By document the places that were found in it, None for none."""
        return [p if known else None for p, known in zip(column.to_pylist(), self.known_id.tolist())]

    def runs(self, n: int, kind: int, cover: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in the batch, document, hash) of the runs of ``n`` words, of all or at cover places."""
        found = []
        for begin, words in self.parts:
            hashes = grams(words.hashes(kind), n, kind)
            place = words.places()[:len(hashes)]
            text = words.text_of()[:len(hashes)] + begin
            keep = (place + n <= self.counts[text]) & self.asks[text]
            if cover:
                keep &= np.isin(place % PERIOD, COVER)
            at = np.flatnonzero(keep)
            found.append((at + self.first[begin], text[at], hashes[at]))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
        return tuple(np.concatenate(c) for c in zip(*found))

    def directory(self) -> dict[str, bytes]:
        return {"first": self.first.astype("<i8").tobytes(), "ids": self.ids.astype("<i8").tobytes(),
                "hashes": self.text_hashes.astype("<i8").tobytes()}


def _groups_of(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order in which equal keys are together, the rest as it was, and the group of each place of it."""
    order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0], kind="stable")
    change = np.zeros(len(order), bool)
    for k in keys:
        s = k[order]
        change[1:] |= s[1:] != s[:-1]
    return order, np.cumsum(change)


def _cells(number: int, buckets: int, keys: np.ndarray, checks: np.ndarray | None, places: np.ndarray,
           asking: np.ndarray, known: np.ndarray, directory: dict[str, bytes]) -> pa.RecordBatch:
    """One row per bucket, by the leading bits of the keys, and one with the directory and what is known."""
    bucket = (keys >> np.uint64(40)).astype(np.int64) % buckets
    order = np.argsort(bucket, kind="stable")
    bounds = np.flatnonzero(np.diff(bucket[order], prepend=-1, append=-1))
    rows = []
    for a, b in zip(bounds[:-1], bounds[1:]):
        at = order[a:b]
        rows.append({"bucket": int(bucket[at[0]]), "batch": number, "keys": _pack(keys[at], "<u8"),
                     "checks": None if checks is None else _pack(checks[at], "<u4"),
                     "places": _pack_places(places[at]), "asking": _pack(asking[at], "<i8")})
    rows.append({"bucket": number % buckets, "batch": number, "known": np.sort(known).astype("<u4").tobytes(), **directory})
    return pa.RecordBatch.from_pylist(rows, schema=_CELL)


def _numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Batches with numbers that no other task gives, the same ones if the task runs again."""
    task = TaskContext.get().partitionId()
    for i, batch in enumerate(batches):
        yield task << 32 | i, batch


def _ask_anchors(buckets: int):
    """Hashes of anchors, cut to 48 bits. asking: 1 for the first of its only document, 0 if two here share it."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, batch in _numbers(batches):
            b = _Batch(batch)
            place, text, key = b.runs(ANCHOR, 0, cover=True)
            key >>= np.uint64(16)
            order, group = _groups_of(key)
            place, text, key = place[order], text[order], key[order]
            n = int(group[-1]) + 1 if len(group) else 0
            head = np.searchsorted(group, np.arange(n))
            last = np.append(head[1:], len(group)) - 1
            shared = (text[head] != text[last]) if n else np.zeros(0, bool)
            known = place[shared[group]] if n else place
            by_place = head[np.argsort(place[head], kind="stable")]
            both = shared[group[by_place]] if n else shared
            yield _cells(number, buckets, key[by_place] << np.uint64(16), None, place[by_place],
                         np.where(both, 0, 1), known, b.directory())

    return work


def _ask_windows(buckets: int):
    """Hashes of windows that hold a shared anchor; asking: the smallest document here that has it."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, batch in _numbers(batches):
            b = _Batch(batch)
            shared = _expand(b, b.found(batch.column("found")), *b.runs(ANCHOR, 0, cover=True))
            place, text, key = b.runs(WINDOW, 0)
            check = b.runs(WINDOW, 1)[2]
            # A window holds the anchors that start at its first PERIOD words.
            ahead = np.concatenate([[0], np.cumsum(shared)])
            some = ahead[np.minimum(place + PERIOD, len(shared))] > ahead[place]
            place, text, key, check = place[some], text[some], key[some], (check[some] >> np.uint64(32)).astype("u4")
            ids = b.ids[text]
            order, group = _groups_of(key, check)
            n = int(group[-1]) + 1 if len(group) else 0
            least = np.full(n, np.iinfo(np.int64).max)
            np.minimum.at(least, group, ids[order])
            smallest = np.empty(len(place), bool)
            smallest[order] = ids[order] == least[group]
            known = place[~smallest]
            # Of the smallest document the first such window of each row asks.
            asking = order[smallest[order]]
            asked_group = group[smallest[order]]
            first = np.ones(len(asking), bool)
            first[1:] = (asked_group[1:] != asked_group[:-1]) | (text[asking][1:] != text[asking][:-1])
            at = np.sort(asking[first])
            yield _cells(number, buckets, key[at], check[at], place[at], ids[at], known, b.directory())

    return work


def _expand(b: _Batch, found: list, place: np.ndarray, text: np.ndarray, key: np.ndarray) -> np.ndarray:
    """For each word of the batch whether a run of a given kind starts there: those that were found, and
    those of the same document with the same hash."""
    marked = np.zeros(len(b.first) and int(b.first[-1]), bool)
    if not any(found):
        return marked
    for i, places in enumerate(found):
        if places is not None:
            marked[np.asarray(places, np.int64) + b.first[i]] = True
    order, group = _groups_of(text, key)
    hit = np.zeros(int(group[-1]) + 1 if len(group) else 0, bool)
    np.logical_or.at(hit, group, marked[place[order]])
    marked[place[order][hit[group]]] = True
    return marked


def _answer(asked_by_windows: bool):
    """Answers one bucket: which asked hashes another batch has too, or has in a smaller document."""
    def work(cells: pa.Table) -> pa.Table:
        rows, keys, checks, places, asking, batches = [], [], [], [], [], []
        for row in cells.to_pylist():
            if row["keys"] is None:
                rows.append({c: row[c] for c in _ANSWER.names})
                continue
            keys.append(_unpack(row["keys"], "<u8"))
            places.append(_unpack_places(row["places"]))
            asking.append(_unpack(row["asking"], "<i8"))
            checks.append(_unpack(row["checks"], "<u4") if asked_by_windows else np.zeros(len(keys[-1]), "u4"))
            batches.append(np.full(len(keys[-1]), row["batch"]))
        if keys:
            key, check, place, ask, batch = map(np.concatenate, (keys, checks, places, asking, batches))
            order, group = _groups_of(key, check)
            place, ask, batch = place[order], ask[order], batch[order]
            n = int(group[-1]) + 1
            if asked_by_windows:
                least = np.full(n, np.iinfo(np.int64).max)
                np.minimum.at(least, group, ask)
                yes = ask > least[group]
            else:
                yes = (np.bincount(group, minlength=n)[group] > 1) & (ask == 1)
            place, batch = place[yes], batch[yes]
            order = np.lexsort((place, batch))
            place, batch = place[order], batch[order]
            bounds = np.flatnonzero(np.diff(batch, prepend=-1, append=-1))
            rows.extend({"batch": int(batch[a]), "known": place[a:b].astype("<u4").tobytes()}
                        for a, b in zip(bounds[:-1], bounds[1:]))
        return pa.Table.from_pylist(rows, schema=_ANSWER)

    return work


def _by_document(answers: pa.Table) -> pa.Table:
    """Places in one batch -> places in its documents."""
    rows = answers.to_pylist()
    directory = next(r for r in rows if r["first"] is not None)
    first = np.frombuffer(directory["first"], "<i8")
    ids, hashes = np.frombuffer(directory["ids"], "<i8"), np.frombuffer(directory["hashes"], "<i8")
    place = np.sort(np.concatenate([np.frombuffer(r["known"], "<u4") for r in rows]).astype(np.int64))
    text = np.searchsorted(first, place, "right") - 1
    bounds = np.flatnonzero(np.diff(text, prepend=-1, append=-1))
    some = text[bounds[:-1]]
    found = [place[a:b] - first[t] for a, b, t in zip(bounds[:-1], bounds[1:], some)]
    return pa.table({"__llm_id": ids[some], "__llm_hash": hashes[some],
                     "found": pa.array(found, pa.list_(pa.int32()))})


def _found(cells: DataFrame, windows: bool) -> DataFrame:
    """__llm_id, __llm_hash, found: the places of a document's runs that are answered with yes."""
    answers = cells.groupBy("bucket").applyInArrow(_answer(windows), ANSWER)
    found = answers.groupBy("batch").applyInArrow(_by_document, "__llm_id long, __llm_hash long, found array<int>")
    # Rows with equal id and text are answered alike.
    return found.groupBy("__llm_id", "__llm_hash").agg(F.flatten(F.collect_set("found")).alias("found"))


def _buckets(docs: DataFrame) -> int:
    """As many as the text needs, so that a bucket does not grow with the data, and some for each task."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tasks = max(16, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return max(BUCKETS_PER_TASK * tasks, -(-size // BYTES_PER_BUCKET))


def removed_windows(docs: DataFrame) -> DataFrame:
    """The texts of ``docs`` by row key, with found: windows that start in a smaller document too.

    Both joins take the same columns of the texts, so that they share one shuffle of them. The key of a row
    without an id may be that of another row; such rows are known by __llm_null. Answers point at places in
    batches, so that a task that runs again has to cut the same batches: ``docs`` is a table as it is read (or
    gives its rows in the same order each time), and what the join gives is put in order by key, whichever kind of join it is.
    """
    buckets = _buckets(docs)
    keyed = docs.select("doc_id", text_or_empty().alias("text")).withColumns(row_key(docs, text_hash()))
    keyed = keyed.withColumn("__llm_id", F.col("__llm_id").cast("long"))
    keys = ["__llm_id", "__llm_hash"]
    shared = _found(by_batch(keyed, _ask_anchors(buckets), CELL), False)
    asked = by_batch(keyed.join(shared, keys).sortWithinPartitions(*keys), _ask_windows(buckets), CELL)
    return keyed.join(_found(asked, True), keys, "left")


def dedup_substrings(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row; optionally the kept words as text.

    A word goes if a window of ``WINDOW`` words covers it that also starts in a
    document with a smaller doc_id, judged on the input. Null and empty texts have no
    words; a shorter text than a window loses nothing. Rows with the same id are no
    earlier documents to each other, and a row without an id is none to any other and
    loses nothing. Repeated rows have equal results; other columns are not looked at.
    """
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b = _Batch(batch)
            found = b.found(batch.column("found"))
            starts = _expand(b, found, *b.runs(WINDOW, 0)) if any(found) else np.zeros(int(b.first[-1]), bool)
            # Covered: one of the WINDOW places up to here starts a window that goes.
            sums = np.concatenate([[0], np.cumsum(starts)])
            here = np.arange(len(starts))
            gone = sums[here + 1] > sums[np.maximum(here - WINDOW + 1, 0)]
            removed, texts = [], []
            for begin, words in b.parts:
                for i in range(len(words.first) - 1):
                    first, n = int(words.first[i]), int(words.counts[i])
                    at = int(b.first[begin + i])
                    out = gone[at:at + n]
                    removed.append(int(out.sum()))
                    pairs = zip(words.starts[first:first + n][~out].tolist(), words.ends[first:first + n][~out].tolist())
                    texts.append(b" ".join(words.data[s:e] for s, e in pairs))
            columns = {"doc_id": batch.column("doc_id"), "n_words": pa.array(b.counts, pa.int64()),
                       "n_removed": pa.array(removed, pa.int64()),
                       "kept_sha256": pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string())}
            if with_text:
                columns["kept_text"] = pa.array(texts, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_pydict(columns)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
    return by_batch(removed_windows(docs), work, schema)
