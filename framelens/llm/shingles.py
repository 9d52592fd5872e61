"""Word shingle sets, MinHash values and odd sketches of whole texts, vectorised over Arrow buffers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SHINGLE = 5
#: Bytes of text that are hashed at a time; a longer text is cut at white space.
PIECE = 1 << 20

BANDS, ROWS = 48, 4
SAMPLES = BANDS * ROWS
SKETCH_BITS = 512

_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A"):ord("Z") + 1] += 32
_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**64, 256, dtype=np.uint64)[_FOLD]
_BASE = _RNG.integers(1, 2**64, dtype=np.uint64) | _U(1)
_BACK = _U(pow(int(_BASE), -1, 2**64))
_STEP = _RNG.integers(1, 2**64, dtype=np.uint64) | _U(1)
_FLIP = _RNG.integers(0, 2**32, SAMPLES, dtype=np.uint32)
_TURN = _RNG.integers(0, 2**32, SAMPLES, dtype=np.uint32) | np.uint32(1)
_POWERS: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits in which every bit depends on every other."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS["up"]) < n:
        for name, base in (("up", _BASE), ("down", _BACK)):
            steps = np.full(max(n, PIECE + 4096), base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps)
    return _POWERS["up"], _POWERS["down"]


def words(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of every word in the byte ranges, the range that each stands in, and its first byte."""
    base = int(first[0])
    data = data[base:int(last[-1])]
    solid = ~_SPACE[data]
    gap = np.zeros(len(data) + 1, bool)
    gap[first - base] = True
    gap[last - base] = True
    before = np.empty(len(data), bool)
    before[:1], before[1:] = True, ~solid[:-1]
    after = np.empty(len(data), bool)
    after[-1:], after[:-1] = True, ~solid[1:]
    begin = np.flatnonzero(solid & (before | gap[:-1]))
    end = np.flatnonzero(solid & (after | gap[1:])) + 1
    up, down = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[:len(data)], out=total[1:])
    return mix((total[end] - total[begin]) * down[begin]), np.searchsorted(first - base, begin, "right") - 1, begin + base


def _ranges(data: np.ndarray, a: int, b: int):
    """The text's bytes in ranges of about PIECE, cut at white space."""
    while b - a > PIECE:
        stop = a + PIECE
        while True:
            white = np.flatnonzero(_SPACE[data[stop:min(stop + PIECE, b)]])
            if len(white) or stop + PIECE >= b:
                break
            stop += PIECE
        if not len(white):
            break
        yield a, stop + int(white[0])
        a = stop + int(white[0])
    yield a, b


def run_words(data: np.ndarray, offsets: np.ndarray, at: int, to: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``words`` of the texts from ``at`` to ``to``, counted from ``at``: several short ones or a long one alone."""
    if offsets[to] - offsets[at] > PIECE and to == at + 1:
        parts = [words(data, np.array([a]), np.array([b])) for a, b in _ranges(data, int(offsets[at]), int(offsets[to]))]
        return tuple(np.concatenate([p[k] for p in parts]) for k in range(3))
    full = np.flatnonzero(offsets[at + 1:to + 1] > offsets[at:to])
    if not len(full):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    found, owner, begin = words(data, offsets[at:to][full], offsets[at + 1:to + 1][full])
    return found, full[owner], begin


def sets(texts: pa.Array):
    """For consecutive runs of texts: (index of the first, sorted distinct shingle hashes of all, bounds by text).

    Null and empty texts and texts without words have empty sets; one to four words make a single shingle.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + n + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + PIECE, "right")) - 1)
        to = min(to, n)
        found, owner, _ = run_words(data, offsets, at, to)
        yield at, *_shingles(found, owner, to - at)
        at = to


def _shingles(found: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    count = np.bincount(owner, minlength=n)
    start = np.concatenate([[0], np.cumsum(count)])
    out = np.zeros(len(found), np.uint64)
    for k in range(1, SHINGLE + 1):
        at = start[:-1][count == k] if k < SHINGLE else np.flatnonzero(owner[SHINGLE - 1:] == owner[:len(owner) - SHINGLE + 1]) if len(owner) >= SHINGLE else np.zeros(0, np.int64)
        h = np.full(len(at), k, np.uint64)
        for j in range(k):
            h = h * _STEP + found[at + j]
        out[at] = mix(h)
    size = np.where(count >= SHINGLE, count - SHINGLE + 1, np.minimum(count, 1))
    kept = np.zeros(len(found), bool)
    for a, s in zip(start[:-1][size > 0].tolist(), size[size > 0].tolist()):
        part = out[a:a + s]
        part.sort()
        kept[a] = True
        kept[a + 1:a + s] = part[1:] != part[:-1]
    bounds = np.concatenate([[0], np.cumsum(kept)])[start]
    return out[kept], bounds


def signatures(shingles: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
    """For every set: size, two sums that identify it, band hashes (n, BANDS) and odd sketch (n, SKETCH_BITS / 8 bytes)."""
    n = len(bounds) - 1
    size = np.diff(bounds)
    full = np.flatnonzero(size)
    fp = np.zeros((n, 2), np.uint64)
    low = np.zeros((n, SAMPLES), np.uint32)
    if len(full):
        start = bounds[:-1][full]
        fp[full, 0] = np.add.reduceat(mix(shingles + _U(1)), start)
        fp[full, 1] = np.add.reduceat(mix(shingles ^ _STEP), start)
        h = (shingles >> _U(32)).astype(np.uint32)
        for k in range(SAMPLES):
            low[full, k] = np.minimum.reduceat((h ^ _FLIP[k]) * _TURN[k], start)
    place = np.arange(SAMPLES, dtype=np.uint64)
    value = mix(low.astype(np.uint64) | (place[None, :] << _U(32)))
    bands = np.zeros((n, BANDS), np.uint64)
    for j in range(ROWS):
        bands = bands * _STEP + value[:, j::ROWS]
    bit = (value >> _U(17)) % _U(SKETCH_BITS)
    flips = np.zeros(n * SKETCH_BITS, np.uint8)
    np.add.at(flips, (np.arange(n)[:, None] * SKETCH_BITS + bit.astype(np.int64)).ravel(), 1)
    sketch = np.packbits((flips & 1).reshape(n, SKETCH_BITS), axis=1)
    return size, fp, mix(bands), sketch
