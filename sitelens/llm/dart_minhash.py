"""DartMinHash signatures of weighted sets.

Each element owns a region of the plane (weight x time).  Darts fall on it as a
Poisson process fixed by hashes of the element alone, so two sets see the same
darts wherever their regions overlap.  Every dart names a coordinate; a set
keeps, per coordinate, the earliest dart within its weights.  Two sets agree in
a coordinate with the probability of their weighted Jaccard similarity.

Time is cut into bands that double in length.  A set of total weight W takes
bands until about k (ln k + 2) darts have fallen on it, then goes on only where
a coordinate is still empty, so the work is about k ln k darts a set, whatever
its weights, plus one draw per element and band.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from sitelens.llm import text_arrays as A

FIRST_BAND = 2.0 ** -4  # expected darts on a unit of weight within band 0
EMPTY = np.uint64(2**64 - 1)
MOST_BANDS = 64


@lru_cache(maxsize=64)
def _poisson_sums(mean: float) -> np.ndarray:
    """The distribution function of a Poisson variable, up to where doubles cannot tell it from 1."""
    top = int(mean + 12 * np.sqrt(mean) + 24)
    k = np.arange(1, top + 1)
    logs = np.concatenate(([0.0], np.cumsum(np.log(mean) - np.log(k)))) - mean
    return np.minimum(np.cumsum(np.exp(logs)), 1.0)


def _cells(hashes: np.ndarray, weights: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Weight bands [0,1), [1,2), [2,4), ... of every element: hash, width, part of it below the weight, owner."""
    if (weights == 1).all():
        return hashes, np.ones(len(hashes)), np.ones(len(hashes)), owner
    whole = []
    level, low, width = 0, 0.0, 1.0
    while True:
        has = np.flatnonzero(weights > low)
        if not len(has):
            break
        part = np.minimum((weights[has] - low) / width, 1.0)
        whole.append((A.seeded(hashes[has], 1000 + level) if level else hashes[has], np.full(len(has), width), part, owner[has]))
        low += width
        width = low
        level += 1
    if not whole:
        return hashes[:0], np.zeros(0), np.zeros(0), owner[:0]
    return tuple(np.concatenate(x) for x in zip(*whole))


def signatures(owner: np.ndarray, hashes: np.ndarray, weights: np.ndarray, n: int, k: int, seed: int = 0) -> np.ndarray:
    """``n x k`` dart ranks (64 bits: band, then place in it); all ``EMPTY`` for an owner without weight."""
    best = np.full(n * k, EMPTY, np.uint64)
    cell, width, part, own = _cells(hashes, np.asarray(weights, float), owner)
    mass = np.bincount(own, weights=width * part, minlength=n)
    cell = A.seeded(cell, seed)
    open_ = mass > 0
    with np.errstate(divide="ignore"):
        need = np.where(open_, np.ceil(np.log2(np.maximum(k * (np.log(k) + 2.0) / np.maximum(mass, 1e-300) / FIRST_BAND, 1.0))), -1)
    band = 0
    while open_.any():
        live = np.flatnonzero(open_[own])
        length = FIRST_BAND if band == 0 else FIRST_BAND * 2.0 ** (band - 1)
        for w in np.unique(width[live]):
            some = live if (width == 1).all() else live[width[live] == w]
            _throw(best, cell[some], own[some], part[some], float(w) * length, band, k)
        band += 1
        checked = np.flatnonzero(open_ & (need < band))
        if len(checked):
            open_[checked] = (best.reshape(n, k)[checked] == EMPTY).any(axis=1)
    return best.reshape(n, k)


def _throw(best: np.ndarray, cell: np.ndarray, own: np.ndarray, part: np.ndarray, mean: float, band: int, k: int) -> None:
    """All darts of one time band on the given cells."""
    base = A.seeded(cell, 10_000 + band)
    chance = (base >> np.uint64(11)).astype(np.float64) / float(1 << 53)
    counts = np.searchsorted(_poisson_sums(mean), chance, side="right")
    hit = np.flatnonzero(counts)
    counts = counts[hit]
    which = np.repeat(hit, counts)
    number = np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts)
    dart = A.mix(base[which] ^ A.seeded(number.astype(np.uint64), 31))
    partial = part[which] < 1.0
    if partial.any():  # a dart above the element's weight misses it
        height = (A.seeded(dart, 47) >> np.uint64(11)).astype(np.float64) / float(1 << 53)
        keep = ~partial | (height < part[which])
        dart, which = dart[keep], which[keep]
    coordinate = ((dart >> np.uint64(32)) * np.uint64(k)) >> np.uint64(32)
    rank = (np.uint64(band) << np.uint64(56)) | (A.seeded(dart, 53) >> np.uint64(8))
    np.minimum.at(best, own[which] * k + coordinate.astype(np.int64), rank)


def band_keys(ranks: np.ndarray, rows: int) -> np.ndarray:
    """One hash per band of ``rows`` coordinates, with the band's number in the low bits."""
    n, k = ranks.shape
    bands = k // rows
    if bands > MOST_BANDS:
        raise ValueError(f"at most {MOST_BANDS} bands")
    out = np.zeros((n, bands), np.uint64)
    for j in range(bands):
        key = np.full(n, np.uint64(j + 1))
        for c in range(j * rows, (j + 1) * rows):
            key = A.mix(key ^ A.seeded(ranks[:, c], 3))
        out[:, j] = (key & ~np.uint64(MOST_BANDS - 1)) | np.uint64(j)
    return out


def sketch(ranks: np.ndarray) -> np.ndarray:
    """One byte per coordinate, for a first estimate of similarity."""
    return (A.seeded(ranks, 71) >> np.uint64(56)).astype(np.uint8)
