"""PartEnum signatures of shingle sets: sets of Jaccard similarity 0.8 or more share at least one.

Let ``a`` and ``b`` be linked. Their sizes differ by a factor of 1/0.8 at most and their symmetric
difference has h = (|a| + |b|) / 9 elements at most, which is no more than floor(|a| / 4) or
floor(|b| / 4). Each size band has its own partitioning of the hash domain: blocks of three
partitions, of which subsets of two are enumerated (``tolerance`` 1), or, in the bands of large sets,
blocks of one (``tolerance`` 0). A block whose partitions differ in no more than ``tolerance`` places
gives a common subset; h differences spoil floor(h / (tolerance + 1)) blocks at most.

A set walks the blocks in order and enumerates the non-empty subsets of each, until it has met
1 + ``spare`` usable blocks more than its own h can spoil; usable means that every subset is
non-empty. Of two linked sets let ``a`` be the one that stops first: among the usable blocks it met
1 + spare(a) are not spoilt, ``b`` walked through those blocks too, and their common subsets are
non-empty. So a linked pair has 1 + min(spare) signatures in common at least, far more than sets
that share a passage. A set that runs out of blocks first walks a second partitioning as well (and a
third ...); a linked pair meets in the first partitioning where either of the two does not run out.

A set takes part in the band of its size and, if it is large enough for a partner there, in the next.
"""

from __future__ import annotations

import numpy as np

from ledgerspark.llm.textscan import mix

#: Band b holds the sizes from BANDS[b] to BANDS[b + 1] - 1.
BANDS = [1]
while BANDS[-1] < 2**40:
    BANDS.append(max(BANDS[-1] + 1, int(BANDS[-1] * 1.6) if BANDS[-1] >= 8 else BANDS[-1] * 2))
#: Bands of sets up to this size enumerate pairs of three partitions.
PAIRED_UP_TO = 48
#: A set walks one block more for so many elements.
SPARE_SHARE = 32
MAX_LEVELS = 24
_U = np.uint64
_BOUNDS = np.array(BANDS)


def spoilt(size: int, tolerance: int) -> int:
    return (size // 4) // (tolerance + 1)


def spare(size: int) -> int:
    """Usable blocks beyond the necessary ones: what linked pairs have in common beyond one signature."""
    return size // SPARE_SHARE


def shape(band: int) -> tuple[int, int, int]:
    """(tolerance, partitions in a block, blocks) of a band."""
    largest = BANDS[band + 1] - 1
    if largest < 4:
        return 0, 1, 1  # such sets are linked only if they are equal
    tolerance = 1 if largest <= PAIRED_UP_TO else 0
    need = spoilt(largest, tolerance) + 1 + spare(largest)
    return tolerance, 2 * tolerance + 1, int(need * 1.12) + 3


def _walk(elements: np.ndarray, size: int, band: int, level: int) -> tuple[np.ndarray, bool]:
    """(signatures, whether enough usable blocks were met)."""
    tolerance, wide, n_blocks = shape(band)
    salt = _U((band << 8) + level + 1)
    with np.errstate(over="ignore"):
        h = mix(elements ^ mix(np.array([salt], _U)))
        parts = n_blocks * wide
        part = ((h >> _U(33)) % _U(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        total = np.concatenate(([_U(0)], np.cumsum(mix(h + _U(1))[order])))
        held = np.bincount(part, minlength=parts)
        edge = np.concatenate(([0], np.cumsum(held)))
        digest = total[edge[1:]] - total[edge[:-1]]
        filled = (held > 0).reshape(n_blocks, wide).sum(1)
        usable = np.cumsum(filled >= tolerance + 1)
        need = spoilt(size, tolerance) + 1 + spare(size)
        done = usable[-1] >= need
        last = int(np.searchsorted(usable, need)) + 1 if done else n_blocks
        block = np.arange(last).astype(_U)
        if tolerance == 0:
            some = held[:last] > 0
            return mix(digest[:last][some] * _U(3) + mix(salt * _U(0x10001) + block[some])), done
        d, s = digest.reshape(n_blocks, 3)[:last], held.reshape(n_blocks, 3)[:last]
        out = []
        for k, (i, j) in enumerate(((0, 1), (0, 2), (1, 2))):
            some = (s[:, i] + s[:, j]) > 0
            out.append(mix(d[some, i] * _U(3) + mix(d[some, j] + _U(k)) + mix(salt * _U(0x10001) + block[some])))
        return np.concatenate(out), done


def least_elements(elements: np.ndarray, band: int) -> np.ndarray:
    """Signatures of a set's floor(n / 4) + 1 elements of the smallest hashes: of two linked sets both have one in common.

    Were there none, each of these elements of the set whose sample ends first would be missing from
    the other set, more than a linked set can lack.
    """
    with np.errstate(over="ignore"):
        h = np.sort(mix(elements ^ mix(np.array([band + 0x5EED], _U))))
        return mix(h[: len(h) // 4 + 1] + _U(0x1EA57))


def bands_of(size: int) -> list[int]:
    """The bands in which sets of this size look for partners."""
    band = int(np.searchsorted(_BOUNDS, size, side="right")) - 1
    return [band] if 5 * size < 4 * BANDS[band + 1] else [band, band + 1]


def signatures(elements: np.ndarray) -> np.ndarray:
    """The distinct 64-bit signatures of a set of distinct 64-bit elements; the empty set has none."""
    n = len(elements)
    if not n:
        return np.empty(0, _U)
    out = []
    for b in bands_of(n):
        for level in range(MAX_LEVELS):
            s, done = _walk(elements, n, b, level)
            out.append(s)
            if done:
                break
        else:
            # a pair of which both ran out everywhere still meets here: linked sets share an element in
            # any sample of floor(n / 4) + 1 least hashes, which are signatures of their own
            out.append(least_elements(elements, b))
    return np.unique(np.concatenate(out))


def rare_signatures(rare: np.ndarray, size: int) -> tuple[np.ndarray, bool]:
    """Signatures made of a set's rare elements alone, and whether they suffice.

    ``size`` is that of the whole set. Of two linked sets, one of which has enough rare elements for
    all its bands, both have a signature in common: their rare elements differ no more than they do.
    """
    walks = [_walk(rare, size, b, MAX_LEVELS) for b in bands_of(size)]
    return np.unique(np.concatenate([s for s, _ in walks])), all(done for _, done in walks)


def parity_sketch(elements: np.ndarray) -> bytes:
    """A bit for each of about 2 to 4 hash buckets an element: how often it is hit, odd or even.

    The sketches of two sets differ in no more bits than the sets have different elements.
    """
    bits = max(64, 1 << int(2 * len(elements)).bit_length())
    at = (mix(elements + _U(0x51ED2701)) & _U(bits - 1)).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=bits).astype(np.uint8) & 1).tobytes()


def sketch_distance(a: bytes, b: bytes) -> int:
    """At most the number of elements that only one of the two sets has; sketches fold to one width."""
    while len(a) != len(b):
        if len(a) < len(b):
            a, b = b, a
        # buckets i and i + half are one bucket of the narrower sketch
        half = len(a) // 2
        a = (int.from_bytes(a[:half]) ^ int.from_bytes(a[half:])).to_bytes(half)
    return (int.from_bytes(a) ^ int.from_bytes(b)).bit_count()
