"""Byte-level BPE: encoding by a queue of merges over a linked symbol list, and decoding.

A text is cut at the literal strings of the added tokens, then into pieces by the
pattern of the pre-tokenizer; each piece is merged on its own. Pieces repeat, so a
worker keeps the ids of recent ones in two generations of bounded size.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import struct
from collections.abc import Iterator
from itertools import islice

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import pre_tokenizers

from wardbook.llm.common import by_batch, texts_of

CACHED_PIECES = 400_000  # per generation, while a task runs
KEPT_PIECES = 100_000  # between the tasks of a worker
LONGEST_CACHED = 64  # characters

# Scripts whose letters, numbers and spaces are settled. The pattern library and the
# pre-tokenizer follow different Unicode versions; texts beyond these go to the latter.
RARE = regex.compile(
    r"[^\x00-\u0377\u0400-\u052f\u200b-\u2064\u20a0-\u20bf\u2190-\u21ff"
    r"\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3\U0001f300-\U0001f5ff]")


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary file -> the byte."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    shifted = [b for b in range(256) if b not in plain]
    return {**{chr(b): b for b in plain}, **{chr(256 + i): b for i, b in enumerate(shifted)}}


class _Generations(dict):
    """Piece -> packed ids. A full generation becomes the old one; what is used again moves on."""

    def __init__(self, codec: BytePairCodec):
        super().__init__()
        self.codec, self.old = codec, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            found = self.codec.merge(piece.encode())
            ids = struct.pack(f"<{len(found)}I", *found)
            if len(piece) > LONGEST_CACHED:
                return ids
        if len(self) >= CACHED_PIECES:
            self.old = dict(self)
            self.clear()
        self[piece] = ids
        return ids


    def trim(self) -> None:
        """Keeps the pieces that came first, which are the frequent ones, for the worker's next task."""
        self.old = {}
        if len(self) > KEPT_PIECES:
            kept = dict(islice(self.items(), KEPT_PIECES))
            self.clear()
            self.update(kept)


class BytePairCodec:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.vocab: dict[str, int] = spec["model"]["vocab"]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        byte_of = byte_symbols()
        self.first = [0] * 256
        for symbol, byte in byte_of.items():
            self.first[byte] = self.vocab[symbol]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.ranks = {self.vocab[a] << 32 | self.vocab[b]: rank for rank, (a, b) in enumerate(pairs)}
        self.merged = [self.vocab[a + b] for a, b in pairs]
        self.strings = [b""] * (1 + max([*self.vocab.values(), *self.added.values()]))
        for symbols, i in self.vocab.items():
            self.strings[i] = bytes(byte_of[c] for c in symbols)
        for content, i in self.added.items():
            self.strings[i] = content.encode()
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.library = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
        longest_first = sorted(self.added, key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, longest_first)) + ")") if self.added else None
        self.packed = _Generations(self)

    def merge(self, piece: bytes) -> list[int]:
        """Merges the best ranked pair, leftmost first, until none is left.

        The queue holds rank and place of a pair as it was when it was pushed; an
        entry whose place has another pair by now is stale and skipped.
        """
        symbols = [self.first[b] for b in piece]
        n = len(symbols)
        rank_of, merged = self.ranks.get, self.merged
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = []
        for i in range(n - 1):
            rank = rank_of(symbols[i] << 32 | symbols[i + 1])
            if rank is not None:
                queue.append(rank << 32 | i)
        heapq.heapify(queue)
        while queue:
            entry = heapq.heappop(queue)
            i = entry & 0xFFFFFFFF
            left, j = symbols[i], after[i]
            if left < 0 or j == n or rank_of(left << 32 | symbols[j]) != entry >> 32:
                continue
            new = symbols[i] = merged[entry >> 32]
            symbols[j] = -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                rank = rank_of(new << 32 | symbols[k])
                if rank is not None:
                    heapq.heappush(queue, rank << 32 | i)
            h = before[i]
            if h >= 0:
                rank = rank_of(symbols[h] << 32 | new)
                if rank is not None:
                    heapq.heappush(queue, rank << 32 | h)
        return [s for s in symbols if s >= 0]

    def pieces(self, text: str) -> list[str]:
        if text.isascii() or not RARE.search(text):
            return self.pattern.findall(text)
        return [text[a:b] for _, (a, b) in self.library.pre_tokenize_str(text)]

    def encode_packed(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if self.cut is None or not self.cut.search(text):
            return b"".join(map(self.packed.__getitem__, self.pieces(text)))
        parts = []
        for part in self.cut.split(text):
            if part in self.added:
                parts.append(np.array([self.added[part]], "<u4").tobytes())
            elif part:
                parts.extend(map(self.packed.__getitem__, self.pieces(part)))
        return b"".join(parts)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_packed(text), "<u4").tolist()

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.strings.__getitem__, ids)).decode("utf-8", errors="replace")


_codecs: dict[str, BytePairCodec] = {}


def codec(path: str) -> BytePairCodec:
    """One codec per worker and vocabulary file."""
    if path not in _codecs:
        _codecs[path] = BytePairCodec(path)
    return _codecs[path]


def encode_documents(docs: DataFrame, path: str | None = None, with_ids: bool = False,
                     with_text: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row; optionally the ids and the decoded text.

    ``path`` is a vocabulary file that every executor can open. Null counts as the
    empty text, which has no tokens. Rows are independent: repeated ones give
    repeated results, a null doc_id stays null, other columns are not looked at.
    """
    path = path or public_tokenizers.path("byte_bpe_50k.json")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path)
        for batch in batches:
            n, ids_sha, text_sha, all_ids, decoded = [], [], [], [], []
            for text in texts_of(batch):
                packed = bpe.encode_packed(text)
                ids = np.frombuffer(packed, "<u4")
                back = bpe.decode(ids.tolist())
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(packed).hexdigest())
                text_sha.append(hashlib.sha256(back.encode()).hexdigest())
                if with_ids:
                    all_ids.append(ids.astype("i4"))
                if with_text:
                    decoded.append(back)
            columns = {"doc_id": batch.column("doc_id"), "n_tokens": pa.array(n, pa.int64()),
                       "ids_sha256": pa.array(ids_sha, pa.string()),
                       "decoded_sha256": pa.array(text_sha, pa.string())}
            if with_ids:
                columns["ids"] = pa.array(all_ids, pa.list_(pa.int32()))
            if with_text:
                columns["decoded"] = pa.array(decoded, pa.string())
            yield pa.RecordBatch.from_pydict(columns)
        bpe.packed.trim()

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, " \
             "decoded_sha256 string" + ", ids array<int>" * with_ids + ", decoded string" * with_text
    return by_batch(docs.select("doc_id", "text"), work, schema)
