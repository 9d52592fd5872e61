"""Whole groups out of a sorted stream of Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def runs(table: pa.Table, keys: list[str]) -> np.ndarray:
    """First row of every run of equal keys."""
    n = table.num_rows
    new = np.zeros(n, bool)
    new[:1] = True
    for k in keys:
        v = table[k].to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(new)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int, bytes_: int = 64 << 20) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups of rows that are sorted by ``keys``, with the first row of each group. A table has about
    ``rows`` rows or ``bytes_`` bytes, or one group if that is larger."""
    held: list[pa.RecordBatch] = []
    n = size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n, size = n + batch.num_rows, size + batch.nbytes
        if n >= rows or size >= bytes_:
            table = pa.Table.from_batches(held)
            first = runs(table, keys)
            last = int(first[-1])
            if last:
                yield table.slice(0, last).combine_chunks(), first[:-1]
                table = table.slice(last)
            held, n, size = table.to_batches(), table.num_rows, table.nbytes
    if n:
        table = pa.Table.from_batches(held).combine_chunks()
        yield table, runs(table, keys)


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n places the smallest one that links (a, b) reach from it."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while True:
            further = label[label]
            if np.array_equal(further, label):
                break
            label = further
        live = label[a] != label[b]
        a, b = a[live], b[live]
    return label
