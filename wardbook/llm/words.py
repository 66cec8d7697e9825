"""Words of many texts at once: places and 64-bit hashes, in numpy.

Equal words have equal hashes. Texts are joined by a line feed, which belongs to no
word, and worked on in pieces, so that memory follows the pieces and not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

SEGMENT = 1 << 20  # bytes that are hashed at once
GROUP = 2 << 20  # bytes of the texts that are worked on together; a longer text is alone

# Odd multipliers of the byte and word polynomials.
BYTE_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
WORD_BASES = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


def byte_class(is_word) -> np.ndarray:
    return np.array([is_word(b) for b in range(256)])


# What ASCII white space leaves.
SPACED = byte_class(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)
# Lower-case ASCII letters, digits and everything beyond ASCII.
ALNUM = byte_class(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80)

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_table(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64 and those of its inverse, ``n`` at least."""
    if base not in _powers or len(_powers[base][0]) < n:
        size = max(n, SEGMENT)
        tables = []
        for b in (base, pow(base, -1, 1 << 64)):
            steps = np.full(size, b, np.uint64)
            steps[0] = 1
            tables.append(np.cumprod(steps))
        if size > SEGMENT:  # for one very long word; not kept
            return tables[0], tables[1]
        _powers[base] = (tables[0], tables[1])
    return _powers[base]


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of a 64-bit number over all others."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    """Words of a group of texts; ``first[i]:first[i + 1]`` are those of text ``i``."""

    data: bytes
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of(self) -> np.ndarray:
        """For each word its text."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def places(self) -> np.ndarray:
        """For each word its place in its text."""
        return np.arange(len(self.starts)) - np.repeat(self.first[:-1], self.counts)

    def hashes(self, kind: int = 0) -> np.ndarray:
        base = BYTE_BASES[kind]
        data = np.frombuffer(self.data, np.uint8)
        found = np.empty(len(self.starts), np.uint64)
        i = 0
        while i < len(found):
            origin = self.starts[i]
            j = max(i + 1, int(np.searchsorted(self.ends, origin + SEGMENT, "right")))
            piece = data[origin:self.ends[j - 1]].astype(np.uint64)
            power, inverse = _power_table(base, len(piece) + 1)
            sums = np.zeros(len(piece) + 1, np.uint64)
            np.cumsum((piece + np.uint64(1)) * power[:len(piece)], out=sums[1:])
            s, e = self.starts[i:j] - origin, self.ends[i:j] - origin
            found[i:j] = mix((sums[e] - sums[s]) * inverse[s] + (e - s).astype(np.uint64))
            i = j
        return found

    def line(self, word: int, n: int) -> str:
        """``n`` words from ``word`` on, joined by one space."""
        return b" ".join(self.data[a:b] for a, b in zip(
            self.starts[word:word + n].tolist(), self.ends[word:word + n].tolist())).decode()


def grams(hashes: np.ndarray, n: int, kind: int = 0) -> np.ndarray:
    """Hashes of ``n`` consecutive words, by their first word; none where fewer follow. Texts are not minded."""
    size = max(0, len(hashes) - n + 1)
    total = np.zeros(size, np.uint64)
    base = np.uint64(WORD_BASES[kind])
    for i in range(n):
        total = total * base + hashes[i:i + size]
    return mix(total)


def split_words(texts: list[bytes], word_class: np.ndarray, lower: bool = False) -> Words:
    data = b"\n".join(texts)
    if lower:
        data = data.lower()  # of bytes: A-Z only
    mask = word_class[np.frombuffer(data, np.uint8)].view(np.int8)
    edges = np.diff(mask, prepend=np.int8(0), append=np.int8(0))
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    bounds = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    return Words(data, starts, ends, np.searchsorted(starts, bounds))


def groups(texts: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    """Consecutive texts of bounded total length, with the number of the first."""
    begin, size = 0, 0
    for i, text in enumerate(texts):
        if size and size + len(text) > GROUP:
            yield begin, texts[begin:i]
            begin, size = i, 0
        size += len(text) + 1
    if begin < len(texts):
        yield begin, texts[begin:]
