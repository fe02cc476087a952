"""Words, shingles and min-wise signatures over blocks of UTF-8 text, in numpy."""

from __future__ import annotations

import numpy as np

from .common import mix64

_RANDOM = np.random.default_rng(20240607)
_BYTE = _RANDOM.integers(0, 2**64, 256, np.uint64)
_BYTE[ord("A") : ord("Z") + 1] = _BYTE[ord("a") : ord("z") + 1]
_GAP = np.zeros(256, bool)
_GAP[[0x20, *range(0x09, 0x0E)]] = True
_PLACE = _RANDOM.integers(0, 2**64, 64, np.uint64) | np.uint64(1)
_STEP = np.uint64(0x5851F42D4C957F2D)
_BACK = np.uint64(pow(0x5851F42D4C957F2D, -1, 2**64))
_POWERS: list[np.ndarray] = [np.zeros(0, np.uint64), np.zeros(0, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_STEP, _BACK)):
            p = np.full(n, base, np.uint64)
            p[:1] = 1
            _POWERS[k] = np.cumprod(p, dtype=np.uint64)
    return _POWERS[0][:n], _POWERS[1][:n]


def words(raw: np.ndarray, offsets: np.ndarray, letters: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts that lie one after another in raw: start and end of each word, and n + 1 offsets of texts into the words.

    Words are runs of [^\\x20\\x09-\\x0D], or of the bytes that letters marks.
    """
    if not len(raw):
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(len(offsets), np.int64)
    solid = ~_GAP[raw] if letters is None else letters[raw]
    begin = solid.copy()
    begin[1:] &= ~solid[:-1]
    inner = offsets[:-1][offsets[:-1] < len(raw)]
    begin[inner] = solid[inner]
    end = solid.copy()
    end[:-1] &= ~solid[1:]
    edge = inner[inner > 0] - 1
    end[edge] = solid[edge]
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offsets)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, most: int = 2 << 20) -> np.ndarray:
    """64-bit hashes of words, A-Z as a-z. Long input goes through in parts of about most bytes, cut between words."""
    out, at = [np.zeros(0, np.uint64)], 0
    while at < len(starts):
        base = int(starts[at])
        to = max(at + 1, int(np.searchsorted(ends, base + most, side="right")))
        part = raw[base : int(ends[to - 1])]
        up, down = _powers(len(part))
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_BYTE[part] * up, out=sums[1:])
        a, b = starts[at:to] - base, ends[at:to] - base
        out.append(mix64((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64)))
        at = to
    return np.concatenate(out)


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one after another, and n + 1 offsets.

    A text with fewer than width words has its whole word sequence as one shingle; without words, none.
    """
    starts, ends, at = words(raw, offsets)
    h = word_hashes(raw, starts, ends)
    n = max(0, len(h) - width + 1)
    grams = np.zeros(n, np.uint64)
    for k in range(width):
        grams += h[k : k + n] * _PLACE[k]
    grams = mix64(grams + np.uint64(width))
    sets, sizes = [], []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= width:
            s = np.unique(grams[a : b - width + 1])
        elif b > a:
            s = mix64(np.array([(h[a:b] * _PLACE[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)], np.uint64))
        else:
            s = np.zeros(0, np.uint64)
        sets.append(s)
        sizes.append(len(s))
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def signatures(sets: np.ndarray, offsets: np.ndarray, count: int, seed: int = 7) -> np.ndarray:
    """Min-wise labels (16 bits each), count a row for each set; an empty set has zeros."""
    full = np.flatnonzero(np.diff(offsets))
    out = np.zeros((len(offsets) - 1, count), np.uint16)
    if len(full):
        odd = np.random.default_rng(seed).integers(0, 2**64, count, np.uint64) | np.uint64(1)
        product = np.empty_like(sets)
        for i in range(count):
            np.multiply(sets, odd[i], out=product)
            least = np.minimum.reduceat(product, offsets[full])
            out[full, i] = (mix64(least) >> np.uint64(48)).astype(np.uint16)
    return out


def set_ids(sets: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each set that doesn't depend on order."""
    sums = np.zeros(len(sets) + 1, np.uint64)
    np.cumsum(mix64(sets ^ np.uint64(0xA5A5A5A5A5A5A5A5)), out=sums[1:])
    sizes = np.diff(offsets).astype(np.uint64)
    return mix64(sums[offsets[1:]] - sums[offsets[:-1]] + sizes * _PLACE[63]).view(np.int64)
