"""Terms of whole texts, vectorised over Arrow buffers.

A term is a maximal run of ASCII letters and digits and of characters beyond ASCII; A-Z are lower-cased. In UTF-8 such a
run is one of bytes, as every byte of a character beyond ASCII is 0x80 at least.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are cut into terms at a time; a longer text alone, in ranges.
PIECE = 1 << 22

_SOLID = np.ones(256, bool)
_SOLID[:128] = False
for _low, _high in ("09", "AZ", "az"):
    _SOLID[ord(_low):ord(_high) + 1] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A"):ord("Z") + 1] += 32


class Terms(NamedTuple):
    """Distinct terms of each text in a run of texts: text, number in ``values`` and count of each, by text and number;
    and the number of terms of each text, repeats counted."""

    values: pa.Array
    text: np.ndarray
    code: np.ndarray
    count: np.ndarray
    total: np.ndarray


def _cut(data: np.ndarray, first: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Terms in ``data``, in which a text starts at each of ``first`` (rising), and the text that each stands in."""
    solid = _SOLID[data]
    starts = np.zeros(len(data) + 1, bool)
    starts[first] = True
    starts = starts[:-1]
    begin = solid.copy()
    begin[1:] &= ~solid[:-1] | starts[1:]
    begin = np.flatnonzero(begin)
    before = np.concatenate([[0], np.cumsum(solid)])  # solid bytes before each place
    offsets = np.append(before[begin], before[-1]).astype(np.int64)
    kept = _FOLD[data[solid]]
    found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(offsets), pa.py_buffer(kept)])
    return found, np.searchsorted(first, begin, "right") - 1


def _ranges(data: np.ndarray, a: int, b: int):
    """The text's bytes in ranges of about PIECE that end between terms."""
    while b - a > PIECE:
        stop = a + PIECE
        while stop < b and _SOLID[data[stop]]:
            gap = np.flatnonzero(~_SOLID[data[stop:min(stop + PIECE, b)]])
            stop = stop + int(gap[0]) if len(gap) else min(stop + PIECE, b)
        yield a, stop
        a = stop
    if a < b:
        yield a, b


def counted(texts: pa.Array):
    """For consecutive runs of texts: (index of the first, their ``Terms``). Null texts and those without terms have none."""
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
        to = min(n, max(at + 1, int(np.searchsorted(offsets, offsets[at] + PIECE, "right")) - 1))
        a, b = int(offsets[at]), int(offsets[to])
        if to == at + 1:
            parts = [_cut(data[x:y], np.zeros(1, np.int64))[0] for x, y in _ranges(data, a, b)]
            found = pa.chunked_array(parts, pa.large_binary()).combine_chunks()
            owner = np.zeros(len(found), np.int64)
        else:
            full = np.flatnonzero(np.diff(offsets[at:to + 1]))
            found, owner = _cut(data[a:b], offsets[at:to][full] - a) if len(full) else (pa.array([], pa.large_binary()), np.zeros(0, np.int64))
            owner = full[owner]
        coded = found.dictionary_encode()
        coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
        values, code = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        size = max(1, len(values))
        pair, count = np.unique(owner * size + code, return_counts=True)
        yield at, Terms(values, pair // size, pair % size, count, np.bincount(owner, minlength=to - at))
        at = to


def as_strings(values: pa.Array) -> pa.Array:
    return pc.cast(values, pa.large_string())
