"""MinHash near-dedup: banded candidates, odd sketches, and links confirmed on full shingle sets."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import shingles
from .arrow_groups import roots, whole_groups
from .common import connected_components, discard, documents_of, materialize, ship_package, spread_join

#: Links: 100 * intersection >= SHARE * union.
SHARE = 75
#: Most odd bits in the difference of two sketches of candidates. At similarity 0.75 their number has mean 80 and
#: standard deviation 9.6, so a true link is above this bound with a chance of about 1e-8; at 0.5 half the pairs are.
ODD_BITS = 136
#: Documents in a block of a band's bucket; larger buckets are compared block by block.
BUCKET_BLOCK = 2048
#: Shingles in a block of a family of candidates; a document counts as LEAST_COST at least.
FAMILY_BLOCK = 1 << 16
LEAST_COST = 64
#: Pairs that a task holds before it joins them.
PAIRS_HELD = 1 << 20

_SIGNED = "doc_id long, n_shingles long, fp1 long, fp2 long, bands array<long>, sketch binary"


def _sign(batches):
    for batch in batches:
        ids = batch.column("doc_id")
        for at, found, bounds in shingles.sets(batch.column("text")):
            size, fp, bands, sketch = shingles.signatures(found, bounds)
            n = len(size)
            flat = pa.array(np.where(size[:, None] > 0, bands, 0).ravel().view(np.int64))
            yield pa.RecordBatch.from_arrays([
                ids.slice(at, n), pa.array(size.astype(np.int64)), pa.array(fp[:, 0].copy().view(np.int64)), pa.array(fp[:, 1].copy().view(np.int64)),
                pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * shingles.BANDS), flat),
                pa.array([x.tobytes() for x in sketch], pa.binary())],
                names=["doc_id", "n_shingles", "fp1", "fp2", "bands", "sketch"])


def _edges(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _candidates(batches):
    """Sketch every pair that shares a cell of a bucket; link what may reach the threshold with its smallest relative."""
    for table, first in whole_groups(batches, ["key", "lo", "hi"], 20_000):
        n = table.num_rows
        ids, size = table["doc_id"].to_numpy(), table["n_shingles"].to_numpy()
        side, cross = table["side"].to_numpy(), table["lo"].to_numpy() != table["hi"].to_numpy()
        sketch = np.frombuffer(b"".join(table["sketch"].to_pylist()), np.uint64).reshape(n, -1)
        group = np.repeat(np.arange(len(first)), np.diff(np.append(first, n)))
        left, a, b, held = np.arange(n), [], [], 0
        unique, back = np.unique(ids, return_inverse=True)
        for d in range(1, n):
            left = left[left + d < n]
            left = left[group[left] == group[left + d]]
            if not len(left):
                break
            i, j = left, left + d
            near = (4 * np.minimum(size[i], size[j]) >= 3 * np.maximum(size[i], size[j])) & (~cross[i] | (side[i] != side[j]))
            i, j = i[near], j[near]
            close = np.bitwise_count(sketch[i] ^ sketch[j]).sum(axis=1) <= ODD_BITS
            a.append(back[i[close]])
            b.append(back[j[close]])
            held += len(a[-1])
            if held > PAIRS_HELD:
                root = roots(len(unique), np.concatenate(a), np.concatenate(b))
                a, b, held = [np.arange(len(root))], [root], 0
        if a:
            root = roots(len(unique), np.concatenate(a), np.concatenate(b))
            moved = np.flatnonzero(root != np.arange(len(root)))
            yield _edges(unique[moved], unique[root[moved]])


def shared_counts(found: np.ndarray, bounds: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the sets ``left`` with the sets ``right``, by products of 0/1 blocks."""
    n = len(bounds) - 1
    owner = np.repeat(np.arange(n), np.diff(bounds))
    order = np.argsort(found, kind="stable")
    found, owner = found[order], owner[order]
    new = np.ones(len(found), bool)
    new[1:] = found[1:] != found[:-1]
    place = np.cumsum(new) - 1
    often = np.bincount(place) > 1
    keep = often[place]
    place, owner = (np.cumsum(often) - 1)[place[keep]], owner[keep]
    out = np.zeros((len(left), len(right)), np.float32)
    columns = max(256, min(8192, (1 << 21) // max(1, n)))
    cuts = np.searchsorted(place, np.arange(0, (place[-1] + 1 if len(place) else 0) + columns, columns))
    for k, (x, y) in enumerate(zip(cuts[:-1], cuts[1:])):
        if x < y:
            block = np.zeros((n, columns), np.float32)
            block[owner[x:y], place[x:y] - k * columns] = 1
            out += block[left] @ block[right].T
    return out.astype(np.int64)


def _confirm(batches):
    """Links on full sets inside each cell of a family, as edges to the smallest relative in the cell."""
    for table, first in whole_groups(batches, ["family", "lo", "hi"], 4_000, 16 << 20):
        parts = list(shingles.sets(table["text"].combine_chunks()))
        found = np.concatenate([x[1] for x in parts])
        sizes = np.concatenate([np.diff(x[2]) for x in parts])
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        ids, side = table["doc_id"].to_numpy(), table["side"].to_numpy()
        cross = table["lo"].to_numpy() != table["hi"].to_numpy()
        a, b = [], []
        for x, y in zip(first.tolist(), [*first[1:].tolist(), table.num_rows]):
            own = bounds[x:y + 1] - bounds[x]
            left = np.flatnonzero(side[x:y] == 0) if cross[x] else np.arange(y - x)
            right = np.flatnonzero(side[x:y] == 1) if cross[x] else left
            if y - x < 2 or not len(left) or not len(right):
                continue
            both = shared_counts(found[bounds[x]:bounds[y]], own, left, right)
            size = np.diff(own)
            i, j = np.nonzero((100 * both >= SHARE * (size[left][:, None] + size[right][None, :] - both)) & (both > 0))
            root = roots(y - x, left[i], right[j])
            moved = np.flatnonzero(root != np.arange(y - x))
            a.append(ids[x:y][moved])
            b.append(ids[x:y][root[moved]])
        if a:
            yield _edges(np.concatenate(a), np.concatenate(b))


def _cells(members: DataFrame, key: str, blocks) -> DataFrame:
    """One row for each member and each pair of blocks of its group that it takes part in: lo, hi and its side."""
    members = members.withColumns({"__n": blocks.cast("int")})
    members = members.withColumn("__own", F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.col("__n")).cast("int"))
    members = members.withColumn("__other", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)))
    return members.withColumns({
        "lo": F.least("__own", "__other"), "hi": F.greatest("__own", "__other"),
        "side": (F.col("__own") > F.col("__other")).cast("int")}).drop("__n", "__own", "__other")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs`` (doc_id, text).

    A text's set: distinct shingles of five words (A-Z lower-cased); one to four words make one shingle; null and
    empty texts and white space alone have the empty set and link with nothing. Documents link where
    100 * intersection >= 75 * union of the full sets. component_id: smallest doc_id reachable; kept: it is one's own.
    Repeated rows stay; rows that share a doc_id are one document for linking; null doc_ids link with nothing, have a
    null component and are kept; extra columns are left out; an empty table gives an empty one.

    Equal sets collapse to their smallest doc_id first. MinHash bands (48 of 4) bring candidates together: at the
    threshold a pair is missed with a chance of 1.2e-8. Buckets, whatever their size, are compared block by block on
    odd sketches, and candidates gather to families; families are confirmed block by block on full sets read again
    from the texts. Only links that join are written, so rows stay linear in the documents, and no cap drops any. Sets
    that very many documents share, and the empty one, are dealt in parts when components are joined back.
    """
    docs = documents_of(docs)
    ship_package(docs.sparkSession)
    signed = materialize(docs.mapInArrow(_sign, _SIGNED))
    filled = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    prints = ["fp1", "fp2", "n_shingles"]
    classes = materialize(filled.groupBy(*prints).agg(F.min("doc_id").alias("rep"), F.count("*").alias("weight")))
    heads = materialize(filled.join(classes.withColumnRenamed("rep", "doc_id"), ["doc_id", *prints], "left_semi")
                        .select("doc_id", "n_shingles", "bands", "sketch").dropDuplicates(["doc_id", "n_shingles"]))

    members = heads.select("doc_id", F.explode("bands").alias("key")).repartition("key")
    # Buckets with the same documents are compared once.
    buckets = members.groupBy("key").agg(
        F.count("*").alias("n"), F.bit_xor(F.xxhash64(F.lit(1), "doc_id")).alias("x"), F.bit_xor(F.xxhash64(F.lit(2), "doc_id")).alias("y"))
    buckets = materialize(buckets.where("n > 1").groupBy("n", "x", "y").agg(F.min("key").alias("key")).select("key", "n"))
    cells = _cells(members.join(buckets, "key"), "key", F.ceil(F.col("n") / BUCKET_BLOCK))
    cells = cells.join(heads.select("doc_id", "n_shingles", "sketch"), "doc_id")
    cells = cells.select("key", "lo", "hi", "side", "doc_id", "n_shingles", "sketch").repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
    near = connected_components(cells.mapInArrow(_candidates, "a long, b long"))

    cost = F.greatest("n_shingles", F.lit(LEAST_COST))
    family = materialize(near.select(F.col("id").alias("doc_id"), F.col("component_id").alias("family"))
                         .join(heads.select("doc_id", cost.alias("cost")), "doc_id"))
    blocks = materialize(family.groupBy("family").agg(F.ceil(F.sum("cost") / FAMILY_BLOCK).alias("blocks")))
    cells = _cells(family.join(blocks, "family"), "family", F.col("blocks")).drop("cost", "blocks")
    cells = cells.join(docs.where("text IS NOT NULL"), "doc_id").repartition("family", "lo", "hi").sortWithinPartitions("family", "lo", "hi")
    linked = connected_components(cells.mapInArrow(_confirm, "a long, b long"))

    named = materialize(classes.join(linked.withColumnRenamed("id", "rep"), "rep", "left").select(*prints, "weight", F.coalesce("component_id", "rep").alias("of_component")))
    discard(heads, buckets, family, blocks, classes)
    linking = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    out = signed.select("doc_id", F.col("n_shingles").alias("size"), *[F.when(linking, F.col(c)).alias(c) for c in prints])
    out = spread_join(out, named, prints, F.col("doc_id"))
    component = F.coalesce("of_component", "doc_id")
    return out.select("doc_id", F.col("size").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all their columns, that stay: the smallest doc_id of every component, and one row of each
    doc_id. Rows without a doc_id stay."""
    kept = materialize(near_duplicates(docs).where("kept AND doc_id IS NOT NULL").select("doc_id").distinct())
    first = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"))
    one = docs.join(kept, "doc_id", "left_semi").withColumn("__turn", F.row_number().over(first)).where("__turn = 1")
    return one.select(*docs.columns).unionByName(docs.where("doc_id IS NULL"))
