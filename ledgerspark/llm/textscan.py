"""Vectorised scans of whole texts: word spans, word hashes and shingles over UTF-8 bytes.

Texts of an Arrow batch are laid end to end (a newline between them) in blocks of about
``BLOCK_BYTES``; a longer text is a block of its own. Words are runs of bytes other than
``[\\x20\\x09-\\x0D]``, which in UTF-8 is the same as runs of such characters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: A worker's arrays are a few dozen times as large as a block and don't outlive it; only the power tables do.
BLOCK_BYTES = 256 << 10
_U = np.uint64
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = _U(0x9E3779B97F4A7C15)
_INVERSE = _U(pow(0x9E3779B97F4A7C15, -1, 2**64))
_powers: list[np.ndarray] = [np.ones(1, _U), np.ones(1, _U)]


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, a bijection of 64-bit words."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse; tables beyond a block's size serve one long text and are freed."""
    if len(_powers[0]) > n:
        return _powers[0], _powers[1]
    made = []
    for base in (_BASE, _INVERSE):
        p = np.full(max(n + 1, BLOCK_BYTES + (BLOCK_BYTES >> 1)), base, _U)
        p[0] = 1
        with np.errstate(over="ignore"):
            made.append(np.multiply.accumulate(p))
    if len(made[0]) <= 2 * BLOCK_BYTES:
        _powers[:] = made
    return made[0], made[1]


def blocks(texts: list[bytes | None]) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first text, texts) in runs of bounded size; a null text counts as empty."""
    first, run, size = 0, [], 0
    for i, t in enumerate(texts):
        t = t or b""
        if run and size + len(t) > BLOCK_BYTES:
            yield first, run
            first, run, size = i, [], 0
        run.append(t)
        size += len(t)
    if run:
        yield first, run


class Block:
    """Word spans and span hashes of several texts."""

    def __init__(self, texts: list[bytes], lower: bool):
        data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        self.data, self.n = data, len(texts)
        self.text_end = np.cumsum(sizes)
        self.text_start = self.text_end - sizes
        space = _SPACE[data]
        edge = np.flatnonzero(np.diff(np.concatenate(([True], space)).view(np.int8)))
        self.space, self.start, self.end = space, edge[0::2], edge[1::2]
        self.words_end = np.searchsorted(self.start, self.text_end)
        self.n_words = np.diff(self.words_end, prepend=0)
        self.doc = np.repeat(np.arange(self.n), self.n_words)
        up, self._down = _tables(len(data))
        with np.errstate(over="ignore"):
            h = _BYTE[_LOWER[data] if lower else data]
            h *= up[: len(data)]
            np.cumsum(h, out=h)
        self._sum = h

    def span_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A 64-bit hash of each byte span [start, end)."""
        with np.errstate(over="ignore"):
            h = np.where(end > 0, self._sum[np.maximum(end, 1) - 1], _U(0)) - np.where(start > 0, self._sum[np.maximum(start, 1) - 1], _U(0))
            return mix(h * self._down[start] ^ (end - start).astype(_U))

    def word_hash(self) -> np.ndarray:
        return self.span_hash(self.start, self.end)

    def windows(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(word index, hash) of each run of ``width`` words inside one text."""
        w = self.word_hash()
        n = len(w) - width + 1
        if n <= 0:
            return np.empty(0, np.int64), np.empty(0, _U)
        at = np.flatnonzero(self.doc[:n] == self.doc[width - 1 :])
        with np.errstate(over="ignore"):
            h = np.zeros(len(at), _U)
            for k in range(width):
                h = mix(h + w[at + k] * _U(2 * k + 1) + _U(k))
        return at, h

    def count_in(self, hit: np.ndarray) -> np.ndarray:
        """For each text, how many of its bytes are marked."""
        c = np.concatenate(([0], np.cumsum(hit, dtype=np.int64)))
        return c[self.text_end] - c[self.text_start]


def shingle_sets(block: Block, width: int) -> list[np.ndarray]:
    """For each text, its sorted distinct shingle hashes; a shorter text's whole word sequence is one shingle."""
    at, h = block.windows(width)
    owner = block.doc[at]
    order = np.lexsort((h, owner))
    owner, h = owner[order], h[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    owner, h = owner[first], h[first]
    out = np.split(h, np.searchsorted(owner, np.arange(1, block.n)))
    word = None
    for i in np.flatnonzero((block.n_words > 0) & (block.n_words < width)):
        word = block.word_hash() if word is None else word
        s = _U(block.n_words[i])
        with np.errstate(over="ignore"):
            for x in word[block.words_end[i] - block.n_words[i] : block.words_end[i]]:
                s = mix(np.array([s * _U(0x100000001B3) + x], _U))[0]
        out[i] = np.array([s], _U)
    return out
