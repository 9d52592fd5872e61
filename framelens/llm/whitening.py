"""Embedding whitening by incremental eigendecomposition.

Every task keeps the mean and the eigendecomposition of the scatter of the vectors it has seen. A further vector adds a
centred rank-one term, whose eigenvalues are the roots of a secular equation and whose eigenvectors follow from them. Spectra
of tasks are combined by further rank-one terms: one for each component of the other spectrum, and one for the distance of the
means. A Rayleigh-Ritz step over all vectors in the basis so found removes what rounding has left.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, ship_package

#: x = floor(SCALE * c) + SHIFT for an entry c. An x beyond LIMIT in absolute value is taken as LIMIT.
SCALE, SHIFT, LIMIT = 64, 1_000_000, 2**40
#: Components that are returned at most, rows of a part, and spectra that one task combines.
COMPONENTS, PART_ROWS, FAN_IN = 32, 4096, 32
#: Share of the largest eigenvalue below which there is no component; what a vector's share must exceed to take part in an
#: update; and gaps of eigenvalues, as a share of the largest, that count as none.
NONE, SMALL = 1e-13, 1e-16

sound = f"embedding IS NOT NULL AND forall(embedding, c -> c IS NOT NULL AND NOT isnan(c) AND abs(c) < double('Infinity'))"


class Spectrum(NamedTuple):
    """Of some vectors: number, mean, eigenvalues of the scatter about it (rising), and eigenvectors in columns."""

    n: float
    mean: np.ndarray
    values: np.ndarray
    vectors: np.ndarray


def secular_roots(d: np.ndarray, z2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Roots of 1 + sum(z2 / (d - t)) = 0 for rising distinct d and positive z2: for each root the nearest pole's number and
    the distance from it, so that differences to poles stay exact. The i-th root lies between d[i] and d[i+1], the last one
    at most sum(z2) above d[-1].

    Each step fits the poles on both sides of a root by two fractions and solves for their sum's root; a step that leaves the
    bracket halves it instead."""
    n = len(d)
    total = z2.sum()
    gap = np.append(np.diff(d), total)
    at = np.arange(n)
    delta = d[None, :] - d[:, None]
    # The sign in the middle of the gap tells the nearer pole, which becomes the origin.
    middle = 1 + (z2 / (delta - gap[:, None] / 2)).sum(axis=1)
    upper = (middle < 0) & (at < n - 1)
    pole = at + upper
    delta = d[None, :] - d[pole][:, None]
    low = np.where(upper, -gap / 2, np.where(middle < 0, gap / 2, 0.0))
    high = np.where(upper, 0.0, np.where(middle < 0, gap, gap / 2))
    t = (low + high) / 2
    left = np.tri(n)
    open_ = at
    for _ in range(100):
        own = delta[open_] - t[open_, None]
        part = z2 / own
        slope = part / own
        below = left[open_] if len(open_) < n else left
        sink = np.einsum("ij,ij->i", part, below)  # parts of poles below are negative, those of poles above are not
        swell = part.sum(axis=1) - sink
        f = 1 + sink + swell
        rise = np.einsum("ij,ij->i", slope, below)
        fall = slope.sum(axis=1) - rise
        good = np.abs(f) <= 4e-16 * n * (1 + swell - sink)
        low[open_] = np.where(f < 0, t[open_], low[open_])
        high[open_] = np.where(f < 0, high[open_], t[open_])
        if good.all():
            break
        keep = ~good
        open_, f, rise, fall, own = open_[keep], f[keep], rise[keep], fall[keep], own[keep]
        rows = np.arange(len(open_))
        one = own[rows, open_]
        two = np.where(open_ < n - 1, own[rows, np.minimum(open_ + 1, n - 1)], gap[open_] - t[open_])
        c = f - one * rise - two * fall
        a = (one + two) * f - one * two * (rise + fall)
        b = one * two * f
        root = np.sqrt(np.maximum(0, a * a - 4 * b * c))
        with np.errstate(divide="ignore", invalid="ignore"):
            move = np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
        new = t[open_] + move
        wrong = ~np.isfinite(new) | (new <= low[open_]) | (new >= high[open_])
        new = np.where(wrong, (low[open_] + high[open_]) / 2, new)
        still = np.abs(new - t[open_]) <= 2e-16 * np.abs(new)
        t[open_] = new
        open_ = open_[~still]
        if not len(open_):
            break
    return pole, t


def rank_one(values: np.ndarray, vectors: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigendecomposition of vectors diag(values) vectors' + v v', values rising.

    Deflation: components that v does not touch stay; of equal eigenvalues one takes v's whole share by a rotation of their
    eigenvectors. The others' eigenvectors come from shares worked out anew from the roots, which keeps them orthogonal."""
    z = v @ vectors
    scale = max(float(values[-1]), float(z @ z))
    if scale <= 0:
        return values, vectors
    least = SMALL * scale / np.sqrt(z @ z) if z.any() else np.inf  # a smaller share changes no entry of the matrix
    live = np.flatnonzero(np.abs(z) > least)
    near = np.flatnonzero(np.diff(values[live]) <= 8 * SMALL * scale)
    if len(near):  # groups of equal eigenvalues: a reflection turns v's share in them to the last one
        vectors, z = vectors.copy(), z.copy()
        first = 0
        cuts = np.flatnonzero(np.diff(values[live]) > 8 * SMALL * scale) + 1
        for own in np.split(live, cuts):
            if len(own) < 2:
                continue
            share = z[own]
            length = np.sqrt(share @ share)
            u = share.copy()
            u[-1] += length if share[-1] >= 0 else -length
            u /= np.sqrt(u @ u)
            vectors[:, own] -= 2 * np.outer(vectors[:, own] @ u, u)
            z[own[:-1]] = 0
            z[own[-1]] = -length if share[-1] >= 0 else length
        live = live[np.abs(z[live]) > least]
    if not len(live):
        return values, vectors
    d, own = values[live], z[live]
    pole, t = secular_roots(d, own * own)
    differ = (d[None, :] - d[pole][:, None]) - t[:, None]  # d[j] - root[i]
    n = len(live)
    if n > 1:
        # Products over roots and other poles, paired so that each factor is near 1.
        between = d[:, None] - d[None, :]  # d[j] - d[i]
        np.fill_diagonal(between, 1.0)
        share = np.abs(differ.T)  # |d[j] - root[i]|, rows j
        last = share[:, -1].copy()
        ratio = np.ones((n, n))
        lower = np.tri(n, k=-1, dtype=bool)
        ratio[lower] = (share / np.abs(between))[lower]  # i < j: |d[j] - root[i]| over |d[j] - d[i]|
        shifted = np.zeros((n, n))
        shifted[:, 1:] = share[:, :-1]  # column i: root i - 1
        higher = lower.T
        ratio[higher] = (shifted / np.abs(between))[higher]  # i > j: |d[j] - root[i-1]| over |d[j] - d[i]|
        exact = np.sqrt(np.prod(ratio, axis=1) * last) * np.sign(own)
    else:
        exact = own
    turn = exact[:, None] / differ.T  # column i: eigenvector of root i
    turn /= np.sqrt((turn * turn).sum(axis=0))
    values, vectors = values.copy(), vectors.copy()
    values[live] = d[pole] + t
    vectors[:, live] = vectors[:, live] @ turn
    order = np.argsort(values, kind="stable")
    return values[order], vectors[:, order]


def empty(size: int) -> Spectrum:
    return Spectrum(0.0, np.zeros(size), np.zeros(size), np.eye(size))


def add(s: Spectrum, x: np.ndarray, count: float = 1.0) -> Spectrum:
    """With ``count`` more vectors equal to ``x``."""
    n = s.n + count
    away = x - s.mean
    if s.n:
        values, vectors = rank_one(s.values, s.vectors, away * np.sqrt(s.n * count / n))
    else:
        values, vectors = s.values, s.vectors
    return Spectrum(n, s.mean + away * (count / n), values, vectors)


def combine(a: Spectrum, b: Spectrum) -> Spectrum:
    """Of the vectors of both."""
    if not a.n or not b.n:
        return a if a.n else b
    values, vectors = a.values, a.vectors
    for e, u in zip(b.values, b.vectors.T):
        if e > 0:
            values, vectors = rank_one(values, vectors, np.sqrt(e) * u)
    n = a.n + b.n
    away = b.mean - a.mean
    values, vectors = rank_one(values, vectors, away * np.sqrt(a.n * b.n / n))
    return Spectrum(n, a.mean + away * (b.n / n), values, vectors)


def entries(vectors: pa.Array) -> np.ndarray:
    """x of each vector, a row each."""
    c = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)
    return np.clip(np.floor(SCALE * c), -LIMIT, LIMIT).astype(np.int64) + SHIFT


def _stored(s: Spectrum) -> dict:
    return {"n": s.n, "mean": s.mean.tolist(), "values": s.values.tolist(), "vectors": s.vectors.ravel().tolist()}


def _read(r: dict) -> Spectrum:
    values = np.array(r["values"])
    return Spectrum(r["n"], np.array(r["mean"]), values, np.array(r["vectors"]).reshape(len(values), -1))


_SPECTRUM = "part int, n double, mean array<double>, values array<double>, vectors array<double>"
_KIND = pa.schema([("part", pa.int32()), ("n", pa.float64()), *((c, pa.list_(pa.float64())) for c in ("mean", "values", "vectors"))])


def sums(rows: DataFrame, terms, names: list[str]) -> dict[str, np.ndarray]:
    """Sums over all rows of the arrays that ``terms`` makes of a batch's x, by name; numbers in the result do not depend on
    the rows. A task passes one row on for each place of the arrays."""
    def run(batches):
        total = None
        for batch in batches:
            made = terms(entries(batch.column("embedding")))
            total = made if total is None else [a + b for a, b in zip(total, made)]
        if total is not None:
            for name, a in zip(names, total):
                whole = a.dtype.kind == "i"
                flat = pa.array(a.ravel())
                none = pa.nulls(a.size, pa.float64() if whole else pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([name] * a.size), pa.array(np.arange(a.size, dtype=np.int32)), *([flat, none] if whole else [none, flat])], names=["name", "place", "whole", "real"])

    found = rows.select("embedding").mapInArrow(run, "name string, place int, whole long, real double").groupBy("name", "place").agg(F.sum("whole").alias("whole"), F.sum("real").alias("real"))
    out: dict[str, list] = {n: [] for n in names}
    for r in found.orderBy("name", "place").collect():  # as many rows as places
        out[r["name"]].append(r["whole"] if r["whole"] is not None else r["real"])
    return {n: np.array(v) for n, v in out.items()}


def spectrum(rows: DataFrame, n: int, centred) -> Spectrum:
    """Of what ``centred`` makes of all ``rows`` (embedding): parts one by one, then FAN_IN spectra at a time."""
    def run(batches):
        s, part = None, None
        for batch in batches:
            x, count = np.unique(entries(batch.column("embedding")), axis=0, return_counts=True)
            part = batch.column("part")[0].as_py()
            s = s or empty(x.shape[1])
            for row, m in zip(centred(x), count):
                s = add(s, row, m)
        if s is not None:
            yield pa.RecordBatch.from_pylist([{"part": part} | _stored(s)], _KIND)

    parts = max(1, -(-n // PART_ROWS))
    live = materialize(rows.select("embedding").repartition(parts).select("embedding", F.spark_partition_id().alias("part")).mapInArrow(run, _SPECTRUM))

    def joined(group: pa.Table) -> pa.Table:
        every = sorted(group.to_pylist(), key=lambda r: (r["part"], r["mean"]))
        s = _read(every[0])
        for r in every[1:]:
            s = combine(s, _read(r))
        return pa.Table.from_pylist([{"part": every[0]["part"] // FAN_IN} | _stored(s)], _KIND)

    while live.count() > 1:
        before, live = live, materialize(live.groupBy(F.floor(F.col("part") / FAN_IN)).applyInArrow(joined, _SPECTRUM))
        discard(before)
    s = _read(live.first().asDict())
    discard(live)
    return s


def refined(rows: DataFrame, n: int, centred, basis: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Eigenvalues (falling) and unit eigenvectors of the covariance by Rayleigh-Ritz in the span of ``basis``, and the trace."""
    basis, _ = np.linalg.qr(basis)
    found = sums(rows, lambda x: (lambda c: [(c @ basis).T @ (c @ basis), np.array([(c * c).sum()])])(centred(x)), ["inner", "trace"])
    inner = found["inner"].reshape(basis.shape[1], -1) / n
    values, turn = np.linalg.eigh((inner + inner.T) / 2)
    return values[::-1], (basis @ turn)[:, ::-1], float(found["trace"][0]) / n


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error), a row for each vector of ``vectors`` (vec_id,
    embedding) and component, at most ``components`` of them by falling eigenvalue.

    Vectors that are null or hold null or non-finite entries are left out, and so are those whose length is not the commonest
    one (of equally common ones the greatest) and empty ones. Directions without variance (an eigenvalue of less than NONE
    of the largest) are no components, so fewer than two different vectors give an empty table, as an empty table does.
    Repeated rows count as often as they stand there; null ids stay; extra columns are left out. A deviation that no long
    holds is null. Numbers come from all vectors; the driver holds sums, a spectrum and the basis, whose sizes are fixed by
    the vectors' length."""
    spark = vectors.sparkSession
    ship_package(spark)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(sound).where(F.size("embedding") > 0)
    sizes = rows.groupBy(F.size("embedding").alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("size")).first()
    out = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if sizes is None:
        return spark.createDataFrame([], out)
    rows = rows.where(F.size("embedding") == sizes["size"])
    n = sizes["n"]
    first = sums(rows, lambda x: [x.sum(axis=0)], ["sum"])["sum"].astype(object)
    low = first // n  # the mean is low + rest / n, so that x - mean is worked out from small numbers
    rest = (first - low * n).astype(np.float64) / n
    low = low.astype(np.int64)
    centred = lambda x: (x - low) - rest
    values, basis, trace = refined(rows, n, centred, spectrum(rows, n, centred).vectors[:, ::-1])
    k = int(min(components, (values > NONE * max(values[0], 0)).sum())) if values[0] > 0 else 0
    if not k:
        return spark.createDataFrame([], out)
    to_white = basis[:, :k] / np.sqrt(values[:k])
    explained = values[:k] / trace
    seen = sums(rows, lambda x: (lambda w: [w.T @ w, w.sum(axis=0)])(centred(x) @ to_white), ["inner", "sum"])
    mean = seen["sum"] / n
    error = float(np.abs(seen["inner"].reshape(k, k) / n - np.outer(mean, mean) - np.eye(k)).max())
    total = [int(v) for v in first]

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                x = entries(part.column("embedding"))
                white = centred(x) @ to_white
                far = np.abs(x - low).max() * float(n) + n
                away = x.astype(object) * n - np.array(total, object) if far * far * len(total) >= 2.0**62 else x * n - np.array(total, np.int64)
                away = (away * away).sum(axis=1)
                deviation = pa.array([int(v) if v < 2**63 else None for v in away], pa.int64())
                each = np.repeat(np.arange(len(x)), k)
                yield pa.RecordBatch.from_arrays(
                    [part.column("vec_id").take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(each), n)), deviation.take(pa.array(each)),
                     pa.array(white.ravel()), pa.array(np.tile(explained, len(x))), pa.array(np.full(len(each), error))], names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, out)
