"""Sharding by best-fit-decreasing bin packing of indivisible groups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, documents_of, materialize, spread_join

#: Groups are packed by size; sizes that agree in so many leading bits are one class, packed as the largest of them. So
#: there are fewer than 2**BITS classes for each power of two, whatever the corpus.
BITS = 10
#: Copies of a row that get their slots together.
COPIES = 1 << 16
#: Rows get their slots in parts of a shard: PARTS at least, and as many as keep a part at about PART_ROWS.
PARTS = 64
PART_ROWS = 1 << 16


class Rooms:
    """Open bins by (room, bin) in a balanced tree: an AA tree, of height 2 log2(n) at most."""

    def __init__(self):
        self.root = None

    def add(self, key: tuple[int, int]) -> None:
        self.root = self._add(self.root, key)

    def take_tightest(self, size: int) -> tuple[int, int] | None:
        """Remove and return the bin with the least room that is at least ``size``; None if there is none."""
        node, found = self.root, None
        while node:
            if node[0][0] >= size:
                node, found = node[2], node[0]
            else:
                node = node[3]
        if found is not None:
            self.root = self._remove(self.root, found)
        return found

    # A node: [key, level, left, right]. Left children stand a level below, right ones at most one level in a row beside.

    @staticmethod
    def _skew(t):
        if t and t[2] and t[2][1] == t[1]:
            left = t[2]
            t[2], left[3] = left[3], t
            return left
        return t

    @staticmethod
    def _split(t):
        if t and t[3] and t[3][3] and t[1] == t[3][3][1]:
            right = t[3]
            t[3], right[2] = right[2], t
            right[1] += 1
            return right
        return t

    def _add(self, t, key):
        if t is None:
            return [key, 1, None, None]
        side = 2 if key < t[0] else 3
        t[side] = self._add(t[side], key)
        return self._split(self._skew(t))

    def _remove(self, t, key):
        if key == t[0]:
            if t[2] is None and t[3] is None:
                return None
            side, other = (3, 2) if t[2] is None else (2, 3)  # the neighbour in order takes this place
            node = t[side]
            while node[other]:
                node = node[other]
            t[0] = node[0]
            t[side] = self._remove(t[side], node[0])
        else:
            side = 2 if key < t[0] else 3
            t[side] = self._remove(t[side], key)
        level = min(n[1] if n else 0 for n in t[2:]) + 1
        if level < t[1]:
            t[1] = level
            if t[3] and t[3][1] > level:
                t[3][1] = level
        t = self._skew(t)
        t[3] = self._skew(t[3])
        if t[3]:
            t[3][3] = self._skew(t[3][3])
        t = self._split(t)
        t[3] = self._split(t[3])
        return t


Classes = list[tuple[int, int]]
Bins = list[dict[int, int]]


def best_fit_counts(classes: Classes, capacity: int) -> Bins:
    """Best fit of ``classes`` (size, number of items), largest first, into as few bins of ``capacity`` as it needs: for each
    bin how many items of each class. Each item enters the bin with the least room that still holds it, found in a balanced
    tree; as the next of its class then fits there best too while there is room, a bin takes several at once. An item above
    the capacity has a bin of its own."""
    bins: Bins = []
    rooms = Rooms()
    for c, (size, left) in enumerate(classes):
        while left:
            room, k = rooms.take_tightest(size) or (capacity, len(bins))
            if k == len(bins):
                bins.append({})
            n = min(left, max(1, room // size))
            bins[k][c] = n
            left -= n
            if room > n * size:
                rooms.add((room - n * size, k))
    return bins


def level(classes: Classes, bins: Bins) -> None:
    """Moves between bins, which best fit fills in turn: into the emptiest, from the fullest bin that has one, the largest
    item that fits into half of what the two differ by, or else the smallest that is below all of it; until no move helps."""
    loads = [sum(classes[c][0] * n for c, n in held.items()) for held in bins]
    for _ in range(64 * len(bins)):
        low = min(range(len(bins)), key=loads.__getitem__)
        for high in sorted(range(len(bins)), key=lambda k: -loads[k]):
            differ = loads[high] - loads[low]
            sizes = [(classes[c][0], c) for c in bins[high] if classes[c][0] < differ]
            if sizes:
                break
        else:
            return
        size, c = max((x for x in sizes if 2 * x[0] <= differ), default=min(sizes))
        n = min(bins[high][c], max(1, differ // 2 // size))
        for k, m in ((high, -n), (low, n)):
            bins[k][c] = bins[k].get(c, 0) + m
            loads[k] += m * size
        if not bins[high][c]:
            del bins[high][c]


def pack_counts(classes: Classes, shards: int) -> Bins:
    """``classes`` (size, number of items), largest first, into ``shards`` bins. An item above the fair share of what is left
    gets a bin of its own, largest first. The others go by best fit into the remaining bins, at the smallest capacity,
    found by halving to a thousandth, that needs no more of them; ``level`` then evens what the last bins lack."""
    total = sum(s * n for s, n in classes)
    own: Bins = []
    left = [n for _, n in classes]
    for c, (size, _) in enumerate(classes):
        while left[c] and size * (shards - len(own)) > total:
            own.append({c: 1})
            left[c] -= 1
            total -= size
    rest, at = [(s, n) for (s, _), n in zip(classes, left) if n], [c for c, n in enumerate(left) if n]
    if not rest:
        return own + [{} for _ in range(shards - len(own))]
    free = shards - len(own)
    low = max(-(-total // free), rest[0][0])
    high = 2 * low
    bins = best_fit_counts(rest, high)
    while high - low > total // (1000 * free):
        mid = (low + high) // 2
        tried = best_fit_counts(rest, mid)
        if len(tried) <= free:
            bins, high = tried, mid
        else:
            low = mid + 1
    bins += [{} for _ in range(free - len(bins))]
    level(rest, bins)
    return own + [{at[c]: n for c, n in held.items()} for held in bins]


def _each(items: list[tuple[int, int]], packing: Callable[[Classes], Bins]) -> list[list]:
    """``packing`` of single (size, item): the items of each bin, those of a size in their order."""
    queues: dict[int, list] = {}
    for size, item in sorted(items, key=lambda x: (-x[0], x[1])):
        queues.setdefault(size, []).append(item)
    classes = [(size, len(held)) for size, held in queues.items()]
    taken = {size: iter(held) for size, held in queues.items()}
    return [[next(taken[classes[c][0]]) for c, n in held.items() for _ in range(n)] for held in packing(classes)]


def best_fit(items: list[tuple[int, int]], capacity: int) -> list[list]:
    """``best_fit_counts`` of single (size, item)."""
    return _each(items, lambda classes: best_fit_counts(classes, capacity))


def pack(items: list[tuple[int, int]], shards: int) -> dict[int, int]:
    """``pack_counts`` of single (size, item): item to shard."""
    return {item: k for k, held in enumerate(_each(items, lambda classes: pack_counts(classes, shards))) for item in held}


def fixed_capacity(docs: DataFrame, capacity: int) -> DataFrame:
    """The rows of ``shard`` for shards of ``capacity`` bytes each, of which best-fit-decreasing opens as few as it needs.
    A group above the capacity fills a shard alone. Input is handled as by ``shard``."""
    return _packed(docs, lambda classes: best_fit_counts(classes, capacity))


def shard(docs: DataFrame, shards: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot for every row of ``docs`` (doc_id, text); shards near equal in bytes.

    size: UTF-8 bytes of the text plus 1 (null: 1). Rows with equal texts share a shard; null counts as empty. slot
    numbers a shard's rows from 0 without gaps. Repeated rows stay; null doc_ids are ordinary values; texts of any length
    are one item; an empty table gives an empty one; extra columns are left out; fewer groups than shards leave shards
    empty; a group above a fair share fills a shard alone, and the other shards are near equal among themselves. Groups of
    one class of sizes (see BITS) are packed in the order of their hashes, so reruns agree.

    Every group is an item of the packing. What is ordered in one place is the classes of sizes with their counts; which
    groups of a class a shard gets is told by their places in it, which are counted in parts.
    """
    return _packed(docs, lambda classes: pack_counts(classes, shards))


def _class(size):
    """The greatest size with the same leading bits."""
    unit = F.pow(F.lit(2.0), F.greatest(F.lit(0), F.floor(F.log2(size.cast("double"))) + 1 - BITS)).cast("long")
    return (F.floor(size / unit) + 1) * unit - 1


def _packed(docs: DataFrame, packing: Callable[[Classes], Bins]) -> DataFrame:
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    rows = materialize(documents_of(docs).select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        F.xxhash64(text).alias("family")))
    groups = materialize(rows.groupBy("family").agg(F.sum("size").alias("bytes"), F.count("*").alias("weight")).withColumn("class", _class(F.col("bytes"))))
    counted = sorted(((r["class"], r["n"]) for r in groups.groupBy("class").agg(F.count("*").alias("n")).collect()), reverse=True)  # one row for each class
    bins = packing(counted)
    before, table = {}, []
    for k, held in enumerate(bins):
        for c, n in held.items():
            first = before.get(c, 0)
            table.append((counted[c][0], first, first + n, k))
            before[c] = first + n
    ranges = spark.createDataFrame(table, "class long, low long, high long, shard int")  # one row for each class and shard
    n_groups = sum(n for _, n in counted)
    parts = max(PARTS, n_groups // PART_ROWS)
    placed = number(groups.select("family", "weight", "class", F.pmod(F.xxhash64(F.lit(3), "family"), F.lit(parts)).cast("int").alias("part")), ["class"], ["family"], "place")
    placed = placed.join(F.broadcast(ranges), "class").where("place >= low AND place < high").select("family", "weight", "shard")
    placed = materialize(placed)
    rows = spread_join(rows, placed, ["family"], F.xxhash64("doc_id", "size", F.monotonically_increasing_id()))
    # Equal rows are counted first, so that many copies of one are not sorted in one task.
    rows = rows.groupBy("shard", "doc_id", "size", "text_crc32").agg(F.count("*").alias("copies"))
    rows = rows.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / COPIES))))
    rows = rows.withColumn("copies", F.least(F.col("copies") - F.col("chunk") * COPIES, F.lit(COPIES)))
    total = placed.agg(F.coalesce(F.sum("weight"), F.lit(0))).first()[0]
    parts = max(PARTS, total // (PART_ROWS * max(1, len(bins))))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("doc_id", "size", "text_crc32", "chunk"), F.lit(parts)).cast("int"))
    rows = materialize(number(rows, ["shard"], ["doc_id", "size", "text_crc32", "chunk"], "first", "copies"))
    discard(groups, placed)
    return rows.select("doc_id", "size", "text_crc32", "shard", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("copies") - 1)).alias("slot"))


def number(rows: DataFrame, within: list[str], order: list[str], name: str, weight: str | None = None) -> DataFrame:
    """``rows`` with ``name``: the sum of ``weight`` (or number) of the rows before each inside ``within``, by part and then
    ``order``. Parts are summed first, so that a task sorts one part of a group."""
    each = F.col(weight) if weight else F.lit(1).cast("long")
    counts = rows.groupBy(*within, "part").agg(F.sum(each).alias("n"))
    before = Window.partitionBy(*within).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select(*within, "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first_of_part"))
    inside = Window.partitionBy(*within, "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn(name, F.sum(each).over(inside) - each)
    return rows.join(first, [*within, "part"]).withColumn(name, (F.col(name) + F.col("first_of_part")).cast("long")).drop("first_of_part", "part")
