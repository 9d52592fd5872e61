"""Embedding near-dedup by a subspace pigeonhole join."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow_groups import roots, whole_groups
from .common import connected_components, discard, materialize, ship_package, spread_join

#: Dimensions of a subspace.
WIDTH = 16
#: Vectors in a cell on average; a cell of more than twice as many is compared in blocks.
CELL = 32_768
#: Vectors whose medians place the cuts between cells, in all, and most cells of a subspace. They decide on balance alone.
SAMPLE = 65_536
MOST_CELLS = 4096
#: Rows of a product of two blocks, pairs that are verified at a time, and links that are held before they are joined.
TILE = 256
VERIFIED = 1 << 16
LINKS_HELD = 1 << 20
#: Added to squared-distance budgets against rounding in the single-precision search.
SLACK = 1e-4

usable = "embedding IS NOT NULL AND size(embedding) > 0 AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity')) AND exists(embedding, x -> x <> 0)"


def rotation(dim: int) -> np.ndarray:
    """A fixed random rotation: it spreads any difference of two vectors evenly over the subspaces."""
    q, r = np.linalg.qr(np.random.default_rng(dim).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def subspaces(dim: int, threshold: float) -> list[tuple[slice, float]]:
    """Blocks of rotated dimensions and their squared-distance budgets, in proportion to their dimensions. Unit vectors
    of a cosine of at least the threshold differ by 2 - 2 * threshold at most, so one block is within its budget."""
    n = max(1, dim // WIDTH)
    cuts = [dim * k // n for k in range(n + 1)]
    return [(slice(a, b), (2 - 2 * threshold) * (b - a) / dim) for a, b in zip(cuts, cuts[1:])]


def by_length(column: pa.ListArray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) for each length of vector in the column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    size = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    start = np.concatenate([[0], np.cumsum(size)])
    return [(at, flat[start[at][:, None] + np.arange(d)]) for d in np.unique(size).tolist() for at in [np.flatnonzero(size == d)]]


def rotated(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow in the norm
    return (x / np.linalg.norm(x, axis=1, keepdims=True)) @ rotation(x.shape[1])


class Cells:
    """Cells of one subspace for vectors of one length: boxes from median cuts of its widest coordinates, over all 16, made
    tight by the vectors in them. Two cells are joined only where their boxes lie within the subspace's budget."""

    def __init__(self, sample: np.ndarray, depth: int):
        """``sample``: some vectors of the subspace; ``depth``: halvings."""
        self.depth = depth
        self.axis, self.cut = np.zeros(2**depth - 1, np.int64), np.zeros(2**depth - 1)
        held = [sample]
        for node in range(2**depth - 1):
            own = held[node]
            if len(own):
                self.axis[node] = np.argmax(own.max(axis=0) - own.min(axis=0))
                self.cut[node] = np.median(own[:, self.axis[node]])
            above = own[:, self.axis[node]] >= self.cut[node]
            held += [own[~above], own[above]]
        self.low = self.high = self.blocks = None

    def of(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + (x[np.arange(len(x)), self.axis[node]] >= self.cut[node])
        return node - (2**self.depth - 1)

    def bound(self, low: np.ndarray, high: np.ndarray, count: np.ndarray) -> None:
        """Tight boxes and numbers of vectors of the cells; those without any have no blocks."""
        self.low, self.high, self.blocks = low, high, np.ceil(count / (2 * CELL)).astype(np.int64)

    def near(self, cell: int, budget: float) -> np.ndarray:
        """Cells whose boxes lie within the budget of the cell's box, itself included."""
        gap = np.maximum(0, np.maximum(self.low - self.high[cell], self.low[cell] - self.high))
        return np.flatnonzero(((gap**2).sum(axis=1) <= budget + SLACK) & (self.blocks > 0))


def cells_of(one: DataFrame, threshold: float) -> dict[tuple[int, int], Cells]:
    """The cells by (length of vector, subspace). Cuts come from at most SAMPLE vectors of each length; boxes and numbers
    from all vectors, in one pass. At most MOST_CELLS boxes a subspace reach the driver."""
    lengths = {r["dim"]: r["n"] for r in one.groupBy(F.size("embedding").alias("dim")).agg(F.count("*").alias("n")).collect()}
    cells: dict[tuple[int, int], Cells] = {}
    for dim, n in lengths.items():
        depth = int(np.ceil(np.log2(min(MOST_CELLS, max(1.0, n / CELL)))))
        held = one.where(F.size("embedding") == dim).select("embedding").orderBy(F.xxhash64("rep")).limit(SAMPLE).collect() if depth else []
        sample = rotated(np.array([r["embedding"] for r in held])) if held else np.zeros((0, dim))
        for b, (part, _) in enumerate(subspaces(dim, threshold)):
            cells[dim, b] = Cells(sample[:, part], depth)

    def measure(batches):
        for batch in batches:
            for at, x in by_length(batch.column("embedding")):
                x = rotated(x)
                for b, (part, _) in enumerate(subspaces(x.shape[1], threshold)):
                    sub = x[:, part]
                    cell = cells[x.shape[1], b].of(sub)
                    order = np.argsort(cell, kind="stable")
                    first = np.flatnonzero(np.diff(cell[order], prepend=-1))
                    low, high = np.minimum.reduceat(sub[order], first), np.maximum.reduceat(sub[order], first)
                    n, d = low.shape
                    rep = lambda v: pa.array(np.repeat(v, d).astype(np.int64))
                    yield pa.RecordBatch.from_arrays(
                        [rep(np.full(n, x.shape[1])), rep(np.full(n, b)), rep(cell[order][first]), pa.array(np.tile(np.arange(d), n)), pa.array(low.ravel()), pa.array(high.ravel()),
                         rep(np.diff(np.append(first, len(order))))], names=["dim", "b", "cell", "axis", "low", "high", "n"])

    measured = one.select("embedding").mapInArrow(measure, "dim long, b long, cell long, axis long, low double, high double, n long")
    boxes = measured.groupBy("dim", "b", "cell", "axis").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n")).toPandas()
    for (dim, b), own in boxes.groupby(["dim", "b"]):
        c = cells[dim, b]
        low, high, count = (np.zeros((2**c.depth, own["axis"].max() + 1)) for _ in range(3))
        for out, name in ((low, "low"), (high, "high"), (count, "n")):
            out[own["cell"], own["axis"]] = own[name]
        c.bound(low, high, count[:, 0])
    return cells


def near_vectors(vectors: DataFrame, threshold: float = 0.9) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``vectors`` (vec_id, embedding).

    Vectors link where their cosine in double precision is at least ``threshold``. n_links: other rows linked directly;
    component_id: smallest vec_id reachable; kept: it is one's own. Vectors that are null, empty or zero or hold null or
    non-finite components, and null vec_ids, link with nothing (a null vec_id has a null component and is kept);
    vectors of different lengths do not link. Repeated rows stay and count each; extra columns are left out; an empty
    table gives an empty one. ``threshold`` must lie in (0, 1).

    Equal vectors collapse to one with a weight. The others are rotated and split into subspaces of 16 dimensions; each
    subspace is range-joined under its share of the squared distance, over cells (see ``Cells``), large cells block by
    block. A pair is verified on whole vectors and counted in the first subspace that finds it. Blocks return counts and
    joining links only, never all pairs. Every subspace carries one copy of a vector for each near cell's block.
    """
    if not 0 < threshold < 1:
        raise ValueError("threshold must lie in (0, 1)")
    ship_package(vectors.sparkSession)
    kind = "array<float>" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("embedding"))
    sound = rows.where("vec_id IS NOT NULL").where(usable)
    one = materialize(sound.groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight")))
    cells = cells_of(one, threshold)

    def deal(batches):
        """A copy of each vector for every pair of blocks that it takes part in: left in (i, j) if it is of block i."""
        for batch in batches:
            ids = batch.column("rep").to_numpy()
            hashed = (ids.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            for at, x in by_length(batch.column("embedding")):
                x = rotated(x)
                for b, (part, budget) in enumerate(subspaces(x.shape[1], threshold)):
                    c = cells[x.shape[1], b]
                    first = np.concatenate([[0], np.cumsum(c.blocks)])  # number of each cell's first block
                    cell = c.of(x[:, part])
                    for own_cell in np.unique(cell).tolist():
                        own = np.flatnonzero(cell == own_cell)
                        mine = first[own_cell] + (hashed[at[own]] % np.uint64(c.blocks[own_cell])).astype(np.int64)
                        rows_ = batch.take(pa.array(at[own]))
                        for other in np.concatenate([np.arange(first[o], first[o + 1]) for o in c.near(own_cell, budget)]).tolist():
                            low, high = np.minimum(mine, other), np.maximum(mine, other)
                            yield pa.RecordBatch.from_arrays(
                                [pa.array(np.full(len(own), x.shape[1] * 1024 + b, np.int64)), pa.array(low), pa.array(high), pa.array((mine > other).astype(np.int32)),
                                 rows_.column("rep"), rows_.column("weight"), rows_.column("embedding")],
                                names=["unit", "i", "j", "side", "rep", "weight", "embedding"])

    def compare(batches):
        for table, first in whole_groups(batches, ["unit", "i", "j"], CELL):
            for x, y in zip(first.tolist(), [*first[1:].tolist(), table.num_rows]):
                group = table.slice(x, y - x)
                side, b = group["side"].to_numpy(), group["unit"][0].as_py() % 1024
                whole = group["i"][0].as_py() == group["j"][0].as_py()
                left, right = (np.arange(y - x),) * 2 if whole else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
                if not len(left) or not len(right):
                    continue
                exact = by_length(group["embedding"])[0][1].astype(np.float64)
                exact /= np.abs(exact).max(axis=1, keepdims=True)  # no overflow in the norm
                norm = np.sqrt((exact * exact).sum(axis=1))
                rot = rotated(exact)
                parts = subspaces(rot.shape[1], threshold)
                ids, weight = group["rep"].to_numpy(), group["weight"].to_numpy()
                order = np.argsort(ids, kind="stable")
                back = np.empty_like(order)
                back[order] = np.arange(len(order))  # places by id, so that the smallest place is the smallest id
                root, a, c, held = np.arange(y - x), [], [], 0
                n_links = np.zeros(y - x, np.int64)
                part, budget = parts[b]
                sub = rot[:, part].astype(np.float32)
                square = (sub * sub).sum(axis=1)
                for t in range(0, len(left), TILE):
                    rows_, cols = left[t:t + TILE], right[t:] if whole else right
                    dist = sub[rows_] @ sub[cols].T
                    dist *= -2
                    dist += square[rows_][:, None]
                    dist += square[cols][None, :]
                    p, q = np.nonzero(dist <= budget + SLACK)
                    p, q = rows_[p], cols[q]
                    if whole:
                        p, q = p[p < q], q[p < q]
                    for s in range(0, len(p), VERIFIED):
                        u, v = p[s:s + VERIFIED], q[s:s + VERIFIED]
                        linked = np.einsum("ij,ij->i", exact[u], exact[v]) >= threshold * (norm[u] * norm[v])
                        u, v = u[linked], v[linked]
                        diff = (rot[u] - rot[v]) ** 2
                        inside = np.stack([diff[:, o].sum(axis=1) <= most + SLACK / 2 for o, most in parts], axis=1)
                        mine = inside.argmax(axis=1) == b
                        u, v = u[mine], v[mine]
                        np.add.at(n_links, u, weight[v])
                        np.add.at(n_links, v, weight[u])
                        a.append(back[u])
                        c.append(back[v])
                        held += len(u)
                        if held > LINKS_HELD:
                            root, a, c, held = roots(y - x, np.concatenate([np.arange(y - x), *a]), np.concatenate([root, *c])), [], [], 0
                hit = np.flatnonzero(n_links)
                if len(hit):
                    root = roots(y - x, np.concatenate([np.arange(y - x), *a]), np.concatenate([root, *c]))
                    yield pa.RecordBatch.from_arrays([pa.array(ids[hit]), pa.array(ids[order][root[back[hit]]]), pa.array(n_links[hit])], names=["a", "b", "n"])

    dealt = one.mapInArrow(deal, f"unit long, i long, j long, side int, rep long, weight long, embedding {kind}")
    dealt = dealt.repartition("unit", "i", "j").sortWithinPartitions("unit", "i", "j")
    found = materialize(dealt.mapInArrow(compare, "a long, b long, n long"))
    linked = connected_components(found.select("a", "b")).select(F.col("id").alias("rep"), "component_id")
    counts = found.groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    named = materialize(one.join(counts, "rep", "left").join(linked, "rep", "left").select(
        F.col("embedding").alias("same"), "weight", (F.col("weight") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"),
        F.coalesce("component_id", "rep").alias("component")))
    discard(found, one)
    out = rows.select("vec_id", F.when(F.expr(f"vec_id IS NOT NULL AND {usable}"), F.col("embedding")).alias("same"))
    out = spread_join(out, named, ["same"], F.col("vec_id"))
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                      F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
