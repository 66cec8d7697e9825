"""Benchmark decontamination by winnowing.

Of every window of ``WINDOW`` words the smallest hash of its ``GRAM``-word grams is
its fingerprint. Equal windows have equal fingerprints, so a document that shares a
window with an item shares that window's fingerprint. Fingerprints of documents and
items are joined, and a hit counts where the words of the whole window agree. Items
shorter than a window are one window, fingerprinted by the hash of all their words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardbook.llm.common import by_batch, row_key, settle, text_hash, texts_of
from wardbook.llm.words import ALNUM, Words, grams, groups, mix, split_words

WINDOW = 10
GRAM = 5
BITMAP_BITS = 24  # a filter of 2 MB before the join, whatever the size of the benchmark; 32 at most

_HIT = pa.struct([("fp", pa.int64()), ("start", pa.int32()), ("length", pa.int32()), ("words", pa.string())])


def winnow(words: Words, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """First words of all windows within one text, and the windows' fingerprints."""
    found = grams(words.hashes(), gram)
    steps = window - gram + 1
    size = max(0, len(words.starts) - window + 1)
    least = found[:size].copy()
    for i in range(1, steps):
        np.minimum(least, found[i:i + size], out=least)
    text = words.text_of()
    inside = np.flatnonzero(text[:size] == text[window - 1:window - 1 + size])
    return inside, mix(least[inside])  # small numbers are as likely as others again


def whole(words: Words, length: int) -> tuple[np.ndarray, np.ndarray]:
    """First words of all runs of ``length`` words within one text, and their hashes."""
    found = grams(words.hashes(), length)
    text = words.text_of()
    inside = np.flatnonzero(text[:len(found)] == text[length - 1:length - 1 + len(found)])
    return inside, found[inside]


def item_windows(items: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """item_id, fp, length, words of every window of every item."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("item_id")
            for begin, texts in groups([t.encode() for t in texts_of(batch)]):
                words = split_words(texts, ALNUM, lower=True)
                text, counts = words.text_of(), words.counts
                starts, fps = winnow(words, window, gram)
                lengths = np.full(len(starts), window)
                for length in np.unique(counts[(counts > 0) & (counts < window)]).tolist():
                    first, hashes = whole(words, length)
                    alone = counts[text[first]] == length
                    starts = np.concatenate([starts, first[alone]])
                    fps = np.concatenate([fps, hashes[alone]])
                    lengths = np.concatenate([lengths, np.full(int(alone.sum()), length)])
                lines = [words.line(s, n) for s, n in zip(starts.tolist(), lengths.tolist())]
                yield pa.RecordBatch.from_pydict({
                    "item_id": ids.take(pa.array(begin + text[starts])), "fp": pa.array(fps.view("i8")),
                    "length": pa.array(lengths, pa.int32()), "words": pa.array(lines, pa.string())})

    kind = items.schema["item_id"].dataType.simpleString()
    return by_batch(items.select("item_id", "text"), work, f"item_id {kind}, fp long, length int, words string")


def _bitmaps(windows: DataFrame, bits: int) -> dict[int, np.ndarray]:
    """By length of window, which numbers of ``bits`` bits occur at either of two places of fingerprints."""
    mask = F.lit((1 << bits) - 1)
    places = windows.select("length", F.explode(F.array(
        F.shiftrightunsigned("fp", 64 - bits), F.shiftrightunsigned("fp", 64 - 2 * bits).bitwiseAND(mask))).alias("place"))
    rows = places.groupBy("length", F.shiftright("place", 6).alias("slot")).agg(
        F.bit_or(F.expr("shiftleft(1L, int(place & 63))")).alias("bits"))
    found: dict[int, np.ndarray] = {}
    table = rows.toArrow()  # at most 2 ** (bits - 6) rows for each length
    for length, slot, word in zip(*(table[c].to_numpy() for c in ("length", "slot", "bits"))):
        found.setdefault(int(length), np.zeros(1 << (bits - 6), np.int64))[slot] = word
    return {length: words.view(np.uint8) for length, words in found.items()}


def _occurs(bitmap: np.ndarray, fps: np.ndarray, bits: int) -> np.ndarray:
    def has(place: np.ndarray) -> np.ndarray:
        return (bitmap[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 > 0

    found = has(fps >> np.uint64(64 - bits))
    found[found] = has((fps[found] >> np.uint64(64 - 2 * bits)) & np.uint64((1 << bits) - 1))
    return found


def _candidates(docs: DataFrame, bitmaps: dict[int, np.ndarray], window: int, gram: int, bits: int) -> DataFrame:
    """Every row's number of words, and its windows whose fingerprint the filter lets through."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, hits = [], [[] for _ in range(batch.num_rows)]
            for begin, texts in groups([t.encode() for t in texts_of(batch)]):
                words = split_words(texts, ALNUM, lower=True)
                counts.extend(words.counts.tolist())
                text, place = words.text_of(), words.places()
                for length, bitmap in bitmaps.items():
                    starts, fps = winnow(words, window, gram) if length == window else whole(words, length)
                    some = _occurs(bitmap, fps, bits)
                    for s, fp in zip(starts[some].tolist(), fps[some].view("i8").tolist()):
                        hits[begin + int(text[s])].append(
                            {"fp": fp, "start": int(place[s]), "length": length, "words": words.line(s, length)})
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "text_hash": batch.column("text_hash"),
                "n_words": pa.array(counts, pa.int64()), "hits": pa.array(hits, pa.list_(_HIT))})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return by_batch(
        docs.select("doc_id", "text", text_hash().alias("text_hash")), work,
        f"doc_id {kind}, text_hash long, n_words long, "
        "hits array<struct<fp: long, start: int, length: int, words: string>>")


def _known_windows(items: DataFrame, window: int, gram: int, bits: int) -> tuple[DataFrame, dict[int, np.ndarray]]:
    """The items' windows, and the filters of their fingerprints."""
    windows = settle(item_windows(items, window, gram).distinct(), "item_windows")
    return windows, _bitmaps(windows, bits)


def _matches(docs: DataFrame, windows: DataFrame, bitmaps: dict[int, np.ndarray], window: int, gram: int, bits: int):
    """Rows with their numbers of words, the columns of their key, and their windows that occur in items."""
    rows = settle(_candidates(docs, bitmaps, window, gram, bits), "window_candidates")
    rows = rows.withColumns(row_key(rows, F.col("text_hash")))
    keys = rows.columns[-3:]
    hits = rows.select(*keys, F.explode("hits").alias("h")).select(*keys, "h.*")
    known = settle(windows.select("fp", "words").distinct(), "known_windows")
    return rows, keys, settle(hits.join(known, ["fp", "words"], "left_semi"), "window_hits")


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, gram: int = GRAM,
                  bits: int = BITMAP_BITS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every row.

    A document's word is hit if it is in a window that occurs in an item. Null and
    empty texts have no words and are in nothing; an item without words has no
    window. An item without an id makes hits but is not counted or listed; ids that repeat
    count once. Repeated rows have equal results; other columns are not looked at.
    """
    windows, bitmaps = _known_windows(items, window, gram, bits)
    rows, keys, hits = _matches(docs, windows, bitmaps, window, gram, bits)
    end = F.col("start") + F.col("length")
    before = F.max(end).over(Window.partitionBy(*keys).orderBy("start", "length").rowsBetween(
        Window.unboundedPreceding, -1))
    # Repeated rows bring their windows twice; these add nothing to what is covered.
    covered = hits.select(*keys, F.greatest(
        F.lit(0), end - F.greatest(F.col("start"), F.coalesce(before, F.lit(0)))).cast("long").alias("new"))
    n_hit = covered.groupBy(*keys).agg(F.sum("new").alias("n_hit"))
    found = (
        hits.select(*keys, "fp", "words").distinct()
        .join(windows.where("item_id is not null").select("fp", "words", "item_id"), ["fp", "words"])
        .select(*keys, F.col("item_id").cast("string").alias("item")).distinct()
        .groupBy(*keys).agg(F.array_sort(F.collect_list("item")).alias("items"))
    )
    items_of = F.coalesce(F.col("items"), F.array().cast("array<string>"))
    return rows.join(n_hit, keys, "left").join(found, keys, "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.size(items_of).cast("long").alias("n_items"),
        F.sha2(F.array_join(items_of, ",").cast("binary"), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"))


def _with_candidates(docs: DataFrame, bitmaps: dict[int, np.ndarray], window: int, gram: int, bits: int,
                     wanted: bool) -> DataFrame:
    """The rows, with all their columns, that have a window which the filter lets through, or those without."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            has = np.zeros(batch.num_rows, bool)
            for begin, texts in groups([t.encode() for t in texts_of(batch)]):
                words = split_words(texts, ALNUM, lower=True)
                text = words.text_of()
                for length, bitmap in bitmaps.items():
                    starts, fps = winnow(words, window, gram) if length == window else whole(words, length)
                    has[begin + text[starts[_occurs(bitmap, fps, bits)]]] = True
            yield batch.filter(pa.array(has == wanted))

    return by_batch(docs, work, docs.schema)


def clean_documents(docs: DataFrame, items: DataFrame, window: int = WINDOW, gram: int = GRAM,
                    bits: int = BITMAP_BITS) -> DataFrame:
    """The rows of ``docs`` that share no window with an item, with all their columns.

    Rows without any candidate window are clean and stay where they are; only the others are
    joined with the hits, and shuffled for it.
    """
    windows, bitmaps = _known_windows(items, window, gram, bits)
    suspects = _with_candidates(docs, bitmaps, window, gram, bits, wanted=True)
    _, keys, hits = _matches(suspects, windows, bitmaps, window, gram, bits)
    suspects = suspects.withColumns(row_key(docs, text_hash()))
    cleared = suspects.join(hits.select(*keys).distinct(), keys, "left_anti").drop(*keys)
    return _with_candidates(docs, bitmaps, window, gram, bits, wanted=False).union(cleared)
