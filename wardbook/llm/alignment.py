"""Alignment of two tokenizers: which tokens of one meet which of the other, by sparse products.

The tokens of a text by tokenizer A and its bytes make an incidence matrix in compressed rows (CSR), those of B
another. A times B transposed, by Gustavson's row products, has an entry for each pair of tokens with
bytes in common, worth their number; those of them that end at the same byte are the links that the counts are about. Offsets
where tokens of both end cut the text into groups; tokens and groups make a second pair of incidence matrices, whose
product has the pairs that share a group. Many texts are worked on in one matrix, block by block.

How often an id pair is linked in the whole corpus is counted and handed back block by block: a block (the texts of
an Arrow batch) sends each of its pairs once and gets each answer once, as one row. Its documents by its pairs are a
CSR matrix again, whose products with the answers are the sums of the documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardbook.llm import bpe
from wardbook.llm.common import by_batch, settle, texts_of
from wardbook.llm.words import groups

PRODUCTS = 1 << 20  # of a row product that are held at once


@dataclass
class Csr:
    """A sparse matrix by rows: those of row i have columns ``columns[first[i]:first[i + 1]]``, worth ``values``."""

    first: np.ndarray
    columns: np.ndarray
    values: np.ndarray
    width: int

    @property
    def rows(self) -> int:
        return len(self.first) - 1

    def transposed(self) -> Csr:
        row = np.repeat(np.arange(self.rows), np.diff(self.first))
        order = np.arange(len(row)) if _ascends(self.columns) else np.argsort(self.columns, kind="stable")
        first = np.zeros(self.width + 1, np.int64)
        np.cumsum(np.bincount(self.columns, minlength=self.width), out=first[1:])
        return Csr(first, row[order], self.values[order], self.rows)

    def times(self, vector: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(self.values * vector[self.columns])])
        return sums[self.first[1:]] - sums[self.first[:-1]]


def _ascends(x: np.ndarray) -> bool:
    return bool((x[1:] >= x[:-1]).all())


def products(a: Csr, b: Csr, at_once: int = PRODUCTS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, column, value) of the entries of ``a`` times ``b``, some rows at a time.

    Row i of the product is the sum of the rows of ``b`` that row i of ``a`` names (Gustavson). As many rows are worked
    on as have ``at_once`` products of two values, one at least.
    """
    sizes = np.diff(b.first)
    work = np.concatenate([[0], np.cumsum(sizes[a.columns])])[a.first]
    begin = 0
    while begin < a.rows:
        end = max(begin + 1, int(np.searchsorted(work, work[begin] + at_once, "right")) - 1)
        lo, hi = a.first[begin], a.first[end]
        named = a.columns[lo:hi]
        many = sizes[named]
        row = np.repeat(np.repeat(np.arange(begin, end), np.diff(a.first[begin:end + 1])), many)
        where = np.arange(len(row)) + np.repeat(b.first[named] - np.concatenate([[0], np.cumsum(many)])[:-1], many)
        column, value = b.columns[where], np.repeat(a.values[lo:hi], many) * b.values[where]
        key = row * b.width + column
        if not _ascends(key):
            order = np.argsort(key, kind="stable")
            key, row, column, value = key[order], row[order], column[order], value[order]
        heads = np.flatnonzero(np.diff(key, prepend=-1))
        if len(heads):
            yield row[heads], column[heads], np.add.reduceat(value, heads)
        begin = end


def _by_bytes(lengths: np.ndarray) -> Csr:
    """Tokens by the bytes they cover, one after the other."""
    first = np.concatenate([[0], np.cumsum(lengths)])
    return Csr(first, np.arange(first[-1]), np.ones(first[-1], np.int64), int(first[-1]))


def _by_groups(group: np.ndarray, many: int) -> Csr:
    return Csr(np.arange(len(group) + 1), group, np.ones(len(group), np.int64), many)


def _with_strings(many: int, ends: str) -> list[str]:
    return [f"{i}{end}" for end in ends for i in range(many)]


def _by_rank(codec: bpe.BytePairCodec) -> tiktoken.Encoding | None:
    """A faster encoder with the same ids, which merges whatever pair makes the entry with the lowest id; None if there is none.

    It is the same where ids ascend in the order of the merges and each entry, encoded alone, is itself. Then the last
    merge that makes an entry is always its own one: in a longer text nothing else happens between its ends before.
    """
    entries = sorted(codec.vocab.values())
    if codec.merged != sorted(codec.merged) or any(codec.merge(codec.strings[i]) != [i] for i in entries):
        return None
    return tiktoken.Encoding("by_rank", pat_str=public_tokenizers.PATTERN, special_tokens={},
                             mergeable_ranks={codec.strings[i]: i for i in entries})


class Aligner:
    """Both tokenizers, and what is derived from their vocabularies."""

    def __init__(self, path_a: str, path_b: str):
        self.codec = bpe.codec(path_a)
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.bytes_a = self.codec.strings
        self.bytes_b = [self._piece(i) for i in range(self.pieces.get_piece_size())]
        self.length_a = np.array([len(b) for b in self.bytes_a])
        self.length_b = np.array([len(b) for b in self.bytes_b])
        # The text of a token of A within and at the end of a group, then those of B.
        self.texts = _with_strings(len(self.bytes_a), ",|") + _with_strings(len(self.bytes_b), ",;")
        self.by_rank = _by_rank(self.codec)

    def _piece(self, i: int) -> bytes:
        piece = self.pieces.id_to_piece(i)
        return bytes([int(piece[3:-1], 16)]) if self.pieces.is_byte(i) else piece.replace("▁", " ").encode()

    def _encode_a(self, text: str) -> list[int]:
        if self.by_rank is not None and (text.isascii() or not bpe.RARE.search(text)):
            return self.by_rank.encode_ordinary(text)
        return np.frombuffer(b"".join(map(self.codec.packed.__getitem__, self.codec.pieces(text))), "<u4").tolist()

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids by A and by B of each text; none for the empty text and where either does not give the text back.

        Both see a space before the text; literal strings of special tokens are ordinary text.
        """
        of_a, of_b = [], []
        for text, b in zip(texts, self.pieces.encode(texts, num_threads=1)):
            whole = (" " + text).encode()
            a = self._encode_a(" " + text)
            if not text or b"".join(map(self.bytes_b.__getitem__, b)) != whole \
                    or b"".join(map(self.bytes_a.__getitem__, a)) != whole:
                a, b = [], []
            of_a.append(np.array(a, np.int64))
            of_b.append(np.array(b, np.int64))
        return of_a, of_b

    def align(self, texts: list[str]) -> Alignment:
        of_a, of_b = self.encode(texts)
        return Alignment(self, of_a, of_b)


class Alignment:
    """The tokens of some texts, one text after the other, and their links."""

    def __init__(self, aligner: Aligner, of_a: list[np.ndarray], of_b: list[np.ndarray]):
        self.aligner = aligner
        self.first_a, self.first_b = (np.cumsum([0, *map(len, ids)]) for ids in (of_a, of_b))
        self.a, self.b = (np.concatenate([np.zeros(0, np.int64), *ids]) for ids in (of_a, of_b))
        self.lengths_a, self.lengths_b = aligner.length_a[self.a], aligner.length_b[self.b]
        ends_a, ends_b = np.cumsum(self.lengths_a), np.cumsum(self.lengths_b)
        linked_a, linked_b, overlaps = [], [], np.zeros(len(texts := of_a), np.int64)
        for i, j, _ in self.overlaps():
            overlaps += np.diff(np.searchsorted(i, self.first_a))
            together = ends_a[i] == ends_b[j]
            linked_a.append(i[together])
            linked_b.append(j[together])
        none = np.zeros(0, np.int64)
        self.linked_a, self.linked_b = np.concatenate([none, *linked_a]), np.concatenate([none, *linked_b])
        self.n_overlaps = overlaps
        # A group ends with a link; the texts end with one too.
        self.n_links = np.diff(np.searchsorted(self.linked_a, self.first_a))
        self.group_a, self.group_b = (
            np.searchsorted(linked, np.arange(many)) for linked, many in
            ((self.linked_a, len(self.a)), (self.linked_b, len(self.b))))

    def overlaps(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(token of A, token of B, bytes in common) of all tokens that overlap."""
        return products(_by_bytes(self.lengths_a), _by_bytes(self.lengths_b).transposed())

    def shared_groups(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(token of A, token of B, 1) of all tokens of one group."""
        many = len(self.linked_a)
        return products(_by_groups(self.group_a, many), _by_groups(self.group_b, many).transposed())

    def n_shared(self) -> np.ndarray:
        """How many pairs share a group, by text: the sizes of the rows of that product."""
        of_groups = _by_groups(self.group_b, len(self.linked_a)).transposed()
        sizes = np.concatenate([[0], np.cumsum(np.diff(of_groups.first)[self.group_a])])
        return sizes[self.first_a[1:]] - sizes[self.first_a[:-1]]

    def pair_codes(self) -> np.ndarray:
        """Of each link its two ids as one number."""
        return self.a[self.linked_a] << 32 | self.b[self.linked_b]

    def group_texts(self) -> list[str]:
        """By text the ids of its groups: ``a1,a2|b1;a3|b2,b3``."""
        many_a, many_b = len(self.aligner.bytes_a), len(self.aligner.bytes_b)
        last_a, last_b = np.zeros(len(self.a), bool), np.zeros(len(self.b), bool)
        last_a[self.linked_a], last_b[self.linked_b] = True, True
        after_a = np.concatenate([[0], self.linked_a + 1])  # tokens of A up to each group
        after_b = np.concatenate([[0], self.linked_b + 1])
        written = np.empty(len(self.a) + len(self.b), np.int64)
        written[np.arange(len(self.a)) + after_b[self.group_a]] = self.a + many_a * last_a
        written[np.arange(len(self.b)) + after_a[self.group_b + 1]] = 2 * many_a + self.b + many_b * last_b
        texts, bounds = self.aligner.texts, (self.first_a + self.first_b).tolist()
        return ["".join(map(texts.__getitem__, written[i:j].tolist()))[:-1] for i, j in zip(bounds, bounds[1:])]


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(path_a: str, path_b: str) -> Aligner:
    """One per worker and pair of vocabulary files."""
    if (path_a, path_b) not in _aligners:
        _aligners[path_a, path_b] = Aligner(path_a, path_b)
    return _aligners[path_a, path_b]


def _paths(path_a: str | None, path_b: str | None) -> tuple[str, str]:
    return path_a or public_tokenizers.path("byte_bpe_50k.json"), path_b or public_tokenizers.path("piece_bpe_32k.model")


# By document, in the order of the block.
_COUNTS = ("n_a", "n_b", "n_groups", "n_links", "n_overlaps", "n_shared")


def _pack(numbers: np.ndarray) -> bytes:
    """32-bit numbers by byte planes, which compress better than whole numbers."""
    return numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _unpack(packed: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(packed, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def _blocks(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """One row for each Arrow batch: its documents' counts and digests, its distinct id pairs, how often each is
    linked in the block, and the documents by pairs in CSR form."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = aligner(path_a, path_b)
        context = TaskContext.get()
        for k, batch in enumerate(batches):
            counts = {c: [] for c in _COUNTS}
            digests, codes, links = [], [], []
            for _, group in groups([t.encode() for t in texts_of(batch)]):
                found = both.align([t.decode() for t in group])
                for c, x in zip(_COUNTS, (np.diff(found.first_a), np.diff(found.first_b), found.n_links, found.n_links,
                                          found.n_overlaps, found.n_shared())):
                    counts[c].append(x)
                digests += [hashlib.sha256(t.encode()).hexdigest() if t else "" for t in found.group_texts()]
                codes.append(found.pair_codes())
                links.append(found.n_links)
            if not digests:
                continue
            pairs, slots = np.unique(np.concatenate(codes), return_inverse=True)
            owner = np.repeat(np.arange(len(digests)), np.concatenate(links))
            cells, times = np.unique(owner * max(1, len(pairs)) + slots, return_counts=True)
            owner, slots = np.divmod(cells, max(1, len(pairs)))
            first = np.searchsorted(owner, np.arange(len(digests) + 1))
            row = {"block": pa.array([context.partitionId() << 32 | k], pa.int64()),
                   "doc_ids": pa.ListArray.from_arrays([0, len(batch)], batch.column("doc_id"))}
            row |= {c: pa.array([_pack(np.concatenate(counts[c])) if c != "n_shared" else
                                 np.concatenate(counts[c]).astype("<i8").tobytes()], pa.binary()) for c in _COUNTS}
            row["digests"] = pa.array([digests], pa.list_(pa.string()))
            row |= {c: pa.array([x], pa.binary()) for c, x in (
                ("pairs_a", _pack(pairs >> 32)), ("pairs_b", _pack(pairs & 0xFFFFFFFF)),
                ("linked", _pack(np.bincount(slots, times, len(pairs)).astype(np.int64))),
                ("first", _pack(first)), ("slots", _pack(slots)), ("times", _pack(times)))}
            yield pa.RecordBatch.from_pydict(row)
        both.codec.packed.trim()

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"block long, doc_ids array<{kind}>, " + "".join(f"{c} binary, " for c in _COUNTS) + \
        "digests array<string>, pairs_a binary, pairs_b binary, linked binary, first binary, slots binary, times binary"
    return by_batch(docs.select("doc_id", "text"), work, schema)


def _pairs_of(blocks: DataFrame) -> DataFrame:
    """block, place, a, b, n: the distinct id pairs of each block and how often it links them."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                a = _unpack(row["pairs_a"])
                yield pa.RecordBatch.from_pydict({
                    "block": pa.array(np.full(len(a), row["block"])), "place": pa.array(np.arange(len(a), dtype="i4")),
                    "a": pa.array(a.astype("i4")), "b": pa.array(_unpack(row["pairs_b"]).astype("i4")),
                    "n": pa.array(_unpack(row["linked"]))})

    return by_batch(blocks.select("block", "pairs_a", "pairs_b", "linked"), work,
                    "block long, place int, a int, b int, n long")


def pair_counts(blocks: DataFrame) -> DataFrame:
    """a, b, n, best: how many links of the corpus hold each id pair, and whether no pair of its b has more."""
    counted = settle(_pairs_of(blocks).groupBy("a", "b").agg(F.sum("n").alias("n")), "alignment_counts")
    highest = counted.groupBy("b").agg(F.max("n").alias("highest"))
    return counted.join(highest, "b").select("a", "b", "n", (F.col("n") == F.col("highest")).alias("best"))


def _answers(asked: DataFrame) -> DataFrame:
    """block, counts, best: by block the counts of its pairs, and which are the best, in the order of its pairs."""
    def collect(group: pa.Table) -> pa.Table:
        order = np.argsort(group["place"].to_numpy())
        return pa.table({
            "block": group["block"][:1],
            "counts": pa.array([group["n"].to_numpy()[order].astype("<i8").tobytes()], pa.binary()),
            "best": pa.array([np.packbits(group["best"].to_numpy()[order]).tobytes()], pa.binary())})

    return asked.groupBy("block").applyInArrow(collect, "block long, counts binary, best binary")


def align_documents(docs: DataFrame, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """How the tokens of two vocabularies meet in every row: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum,
    groups_sha256, n_overlaps, n_shared.

    Links are pairs of tokens that end at the same byte; the count of an id pair is how many links of all rows hold
    it. n_best counts links whose count is the highest of their id of B, ties included; count_sum adds up the
    counts of the links. n_overlaps counts pairs with bytes in common, n_shared pairs of one group. Null, empty
    and such texts as a tokenizer does not give back have zeros and an empty digest. Repeated rows
    count as often as they occur, a null doc_id stays null, other columns are not looked at; the empty
    table gives the empty table. ``path_a`` is a byte-level vocabulary and ``path_b`` a
    sentencepiece model that every executor can open.
    """
    blocks = settle(_blocks(docs, *_paths(path_a, path_b)), "alignment_blocks")
    counts = settle(pair_counts(blocks), "alignment_pairs")
    asked = _pairs_of(blocks).select("block", "place", "a", "b").join(counts, ["a", "b"]).select("block", "place", "n", "best")
    # A block without links has no answer.
    answered = blocks.drop("pairs_a", "pairs_b", "linked").join(_answers(asked), "block", "left")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                row = batch.slice(i, 1)
                value = {c: row.column(c)[0].as_py() for c in row.schema.names if c not in ("doc_ids", "digests")}
                first = _unpack(value["first"])
                n = np.frombuffer(value["counts"] or b"", "<i8")
                best = np.unpackbits(np.frombuffer(value["best"] or b"", np.uint8), count=len(n)).astype(np.int64)
                pairs = Csr(first, _unpack(value["slots"]), _unpack(value["times"]), len(n))
                yield pa.RecordBatch.from_pydict({
                    "doc_id": row.column("doc_ids").flatten(),
                    **{c: pa.array(_unpack(value[c])) for c in ("n_a", "n_b", "n_groups", "n_links")},
                    "n_best": pa.array(pairs.times(best)), "count_sum": pa.array(pairs.times(n)),
                    "groups_sha256": row.column("digests").flatten(),
                    "n_overlaps": pa.array(_unpack(value["n_overlaps"])),
                    "n_shared": pa.array(np.frombuffer(value["n_shared"], "<i8"))})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return by_batch(answered, work, f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, "
                                    "count_sum long, groups_sha256 string, n_overlaps long, n_shared long")


def token_links(docs: DataFrame, kind: str = "ends", path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """doc_id, place_a, place_b, a, b, weight: the links themselves, a row for each.

    ``kind`` is ``ends`` (tokens that end together), ``overlaps`` (weighted by the bytes in common) or ``groups`` (tokens
    that share a group). Places count the tokens of a text from 0. Rows without tokens have no links.
    """
    if kind not in ("ends", "overlaps", "groups"):
        raise ValueError(f"no such links: {kind}")
    paths = _paths(path_a, path_b)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = aligner(*paths)
        for batch in batches:
            for begin, group in groups([t.encode() for t in texts_of(batch)]):
                found = both.align([t.decode() for t in group])
                ends = iter([(found.linked_a, found.linked_b, np.ones(len(found.linked_a), np.int64))])
                for i, j, weight in {"ends": lambda: ends, "overlaps": found.overlaps, "groups": found.shared_groups}[kind]():
                    text = np.searchsorted(found.first_a, i, "right") - 1
                    yield pa.RecordBatch.from_pydict({
                        "doc_id": batch.column("doc_id").take(pa.array(text + begin)),
                        "place_a": pa.array(i - found.first_a[text]), "place_b": pa.array(j - found.first_b[text]),
                        "a": pa.array(found.a[i]), "b": pa.array(found.b[j]), "weight": pa.array(weight)})
        both.codec.packed.trim()

    id_kind = docs.schema["doc_id"].dataType.simpleString()
    return by_batch(docs.select("doc_id", "text"), work,
                    f"doc_id {id_kind}, place_a long, place_b long, a long, b long, weight long")
