"""Words, lines and shingles of many texts at once, as flat numpy arrays.

The per-row work of the text operators runs inside Spark tasks on Arrow
batches.  A batch is cut into chunks of about a quarter of a megabyte of UTF-8 (whole
texts, never prefixes; one very long text makes one long chunk) and each step
is a handful of array passes instead of a Python loop over words.

Words are the runs of ``[^\\x20\\x09-\\x0D]``; all six separators are single
bytes, so words can be found in the UTF-8 bytes.  Spans are hashed with a
polynomial over 64 bits, finished by an integer mixer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 18

_ODD = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0x2545F4914F6CDD1D)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def seeded(x: np.ndarray, seed: int) -> np.ndarray:
    return mix(x + np.uint64((int(_ODD) * (seed + 1)) & (2**64 - 1)))


def _power(base: np.uint64, n: int) -> np.ndarray:
    """``base`` to the powers 0..n-1 (kept while no longer text asks for more)."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        have = np.full(max(n, CHUNK_BYTES * 2), base, dtype=np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if n <= CHUNK_BYTES * 4:  # the powers of one very long text are not kept
            _powers[int(base)] = have
    return have[:n]


class Texts:
    """The texts of one chunk: UTF-8 bytes, and where each text begins and ends."""

    def __init__(self, column: pa.Array):
        column = column.cast(pa.large_string()).fill_null("")
        offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1]
        data = column.buffers()[2]
        whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
        self.bytes = whole[offsets[0]:offsets[-1]]
        self.offsets = offsets - offsets[0]
        self.n = len(column)
        self._sums: np.ndarray | None = None

    def text_of(self, positions: np.ndarray) -> np.ndarray:
        """The text that holds each byte position."""
        return np.searchsorted(self.offsets, positions, side="right") - 1

    def count(self, mask: np.ndarray) -> np.ndarray:
        """How many bytes of each text are marked."""
        sums = np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))
        return sums[self.offsets[1:]] - sums[self.offsets[:-1]]

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First byte, byte past the last, and text of every word."""
        solid = ~_SPACE[self.bytes]
        if not len(solid):
            none = np.zeros(0, np.int64)
            return none, none, none
        edge = np.zeros(len(solid) + 1, dtype=bool)
        edge[self.offsets] = True
        before = np.concatenate(([False], solid[:-1]))
        after = np.concatenate((solid[1:], [False]))
        begin = np.flatnonzero(solid & (~before | edge[:-1]))
        end = np.flatnonzero(solid & (~after | edge[1:])) + 1
        return begin, end, self.text_of(begin)

    def hash_spans(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A 64-bit hash of the bytes of each span; equal bytes, equal hash."""
        if self._sums is None:
            values = mix(self.bytes.astype(np.uint64) + _ODD) * _power(_BASE, len(self.bytes))
            self._sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)))
        if not len(begin):
            return np.zeros(0, np.uint64)
        raw = (self._sums[end] - self._sums[begin]) * _power(_BASE_INVERSE, int(begin.max()) + 1)[begin]
        return mix(raw ^ mix((end - begin).astype(np.uint64)))

    def code_points(self, positions: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """Byte positions as code points from the start of the text ``owner``."""
        heads = np.concatenate(([0], np.cumsum((self.bytes & 0xC0) != 0x80, dtype=np.int64)))
        return heads[positions] - heads[self.offsets[owner]]


def chunks(column: pa.Array) -> Iterator[tuple[int, int]]:
    """Row ranges of a column that hold about ``CHUNK_BYTES`` of text each."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(column), 0).cast(pa.int64()))
    if not len(sizes):
        return
    slot = (np.cumsum(sizes) - sizes) // CHUNK_BYTES
    cuts = np.flatnonzero(np.diff(slot)) + 1
    edges = [0, *cuts.tolist(), len(sizes)]
    yield from zip(edges[:-1], edges[1:])


def windows(words: np.ndarray, owner: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every ``width`` consecutive words with one owner, and the index of each window's first word."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = np.zeros(n, np.uint64)
    for k in range(width):
        total = (total * _BASE) + words[k:k + n]
    first = np.flatnonzero(owner[:n] == owner[width - 1:])
    return mix(total[first]), first


def shingles(words: np.ndarray, owner: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ``width``-word shingles as (owner, hash), sorted by both; fewer words than ``width`` make one shingle."""
    hashes, first = windows(words, owner, width)
    owners = owner[first]
    ids, begin, sizes = np.unique(owner, return_index=True, return_counts=True)
    short = sizes < width
    if short.any():
        total = np.zeros(int(short.sum()), np.uint64)
        for k in range(width - 1):
            has = sizes[short] > k
            total[has] = total[has] * _BASE + words[begin[short][has] + k]
        hashes = np.concatenate((hashes, mix(total ^ sizes[short].astype(np.uint64))))
        owners = np.concatenate((owners, ids[short]))
    order = np.argsort(hashes)  # much faster than lexsort, as is a stable sort of 16 bits; equal pairs may swap places
    small = np.uint16 if not len(owners) or owners.max() < 1 << 16 else np.int64
    order = order[np.argsort(owners[order].astype(small), kind="stable")]
    hashes, owners = hashes[order], owners[order]
    if len(hashes):
        new = np.concatenate(([True], (hashes[1:] != hashes[:-1]) | (owners[1:] != owners[:-1])))
        hashes, owners = hashes[new], owners[new]
    return owners, hashes


def set_prints(owners: np.ndarray, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Size and a 128-bit order-free fingerprint of each owner's set (owners 0..n-1)."""
    size = np.bincount(owners, minlength=n).astype(np.int64)
    high, low = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    np.add.at(high, owners, seeded(hashes, 101))
    np.add.at(low, owners, seeded(hashes, 202))
    return size, mix(high ^ size.astype(np.uint64)), mix(low + size.astype(np.uint64))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column whose rows hold ``counts`` consecutive values each."""
    ends = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, kind))
