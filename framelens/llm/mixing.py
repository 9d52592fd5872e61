"""Mixing sources to target weights by Sainte-Lague quotas of equal-token blocks (built-in functions only)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialize

#: Words in a block.
BLOCK_WORDS = 32
#: Words in a shard of a source, on average.
SHARD_WORDS = 1 << 17
#: Most shards, or groups of shards, that blocks are dealt over at a time.
FAN = 4096
#: ``draw``: a text of more than 1/LONG of its shard's words is long.
LONG = 16
#: A prime above any number of blocks in a shard: multiples of it permute the blocks.
PRIME = 2_147_483_647


def targets(sources: DataFrame, weights: list[float], cap: float) -> DataFrame:
    """(source, source_size) to (source, source_size, target): all words shared by weight, none above ``cap`` times
    its source's size, the excess reshared by weight until none is above.

    Sources by code point, nulls last, weigh ``weights`` repeating. The fixed point is a water level: in the order of
    size over weight, the first sources stand at their cap and the rest share what is left. One row per source.
    """
    ordered = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    sources = sources.withColumn("w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]),
                                                   (F.pmod(F.row_number().over(ordered) - 1, F.lit(len(weights))) + 1).cast("int")))
    every = Window.partitionBy(F.lit(0))
    fill = Window.partitionBy(F.lit(0)).orderBy(F.col("source_size") / F.col("w"), F.col("source").isNull(), F.col("source").cast("binary"))
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum(cap * F.col("source_size")).over(before), F.lit(0.0))) \
        / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    sources = sources.withColumn("level", level)
    # A source is capped while the level that the others would reach lies above its own cap.
    sources = sources.withColumn("above", F.col("level") * F.col("w") > cap * F.col("source_size"))
    sources = sources.withColumn("final", F.max(F.when(~F.col("above"), F.col("level"))).over(every))
    return sources.select("source", "source_size", F.when(F.col("above"), cap * F.col("source_size"))
                          .otherwise(F.col("final") * F.col("w")).cast("double").alias("target"))


def apportion(cells: DataFrame, group: list[str], order: list[str], share: str, seats: str, out: str, most: str | None = None) -> DataFrame:
    """Sainte-Lague: within ``group``, give ``seats`` to the highest quotients share / (2k - 1); ties by ``order``.

    With S cells sharing T, the divisors T / (seats - S/2) and T / (seats + S/2) bracket the final one, so every cell
    surely holds what the first grants and never more than what the second grants: only about 2S quotients are ranked.
    ``most``: a column of seats that a cell can take at most, not below the whole part of its proportional seats; it binds
    by rounding alone then, by less than one seat in each cell, and the second divisor becomes T / (seats + 3S/2).
    """
    all_ = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    total, n = F.sum(share).over(all_), F.count("*").over(all_)
    granted = lambda parts: F.when(parts > 0, F.floor(F.col(share) * parts / F.nullif(F.col("__t"), F.lit(0.0)) + 0.5)).otherwise(F.lit(0))
    cells = cells.withColumns({"__t": total.cast("double"), "__n": n})
    low = F.coalesce(F.greatest(granted(F.col(seats) - F.col("__n") / 2 - 1e-6), F.lit(0)), F.lit(0))
    high = F.coalesce(granted(F.col(seats) + F.col("__n") * (1.5 if most else 0.5) + 1e-6) + 1, F.lit(0))
    cells = cells.withColumns({"__low": F.least(low, F.col(most)) if most else low, "__high": F.least(high, F.col(most)) if most else high})
    cells = cells.withColumn("__sure", F.sum("__low").over(all_))
    open_ = cells.withColumn("__k", F.explode(F.sequence(F.col("__low") + 1, F.greatest("__high", F.col("__low") + 1))))
    open_ = open_.withColumn("__q", F.when(F.col("__k") <= F.col("__high"), F.col(share) / (2 * F.col("__k") - 1)).otherwise(F.lit(0.0)))
    best = Window.partitionBy(*(group or [F.lit(0)])).orderBy(F.desc("__q"), *[F.col(c) for c in order], "__k")
    open_ = open_.withColumn("__won", (F.row_number().over(best) <= F.col(seats) - F.col("__sure")) & (F.col("__q") > 0))
    keys = [c for c in cells.columns if not c.startswith("__")]
    return open_.groupBy(*keys).agg((F.first("__low") + F.sum(F.col("__won").cast("long"))).alias(out))


def quotas(cells: DataFrame, weights: list[float], cap: float) -> DataFrame:
    """(source, shard, cell_size) to the same with source_size, target and quota, a number of blocks, by Sainte-Lague.

    Blocks are dealt over sources first, then over groups of at most FAN shards, then over groups inside these, down to
    shards, so no window holds more than FAN cells or all sources. A shard takes at most the blocks of ``cap`` passes over
    it, of which the last may be partial; a source at its cap takes just these in every shard."""
    sizes = cells.groupBy("source").agg(F.sum("cell_size").alias("source_size"), F.max("shard").alias("last"))
    levels, last = [], sizes.agg(F.max("last")).first()[0] or 0  # 0: no rows
    cells = cells.withColumn("g0", F.col("shard"))
    while not levels or last >= FAN:
        if levels:
            last //= FAN
            cells = cells.withColumn(f"g{len(levels)}", F.floor(F.col(f"g{len(levels) - 1}") / FAN).cast("int"))
        levels.insert(0, f"g{len(levels)}")
    cells = cells.withColumn("room", F.ceil(cap * F.col("cell_size") / BLOCK_WORDS))
    goal = targets(sizes.drop("last"), weights, cap)
    # The blocks of all words, shared in proportion to the targets, which add up to the words that are taken.
    goal = goal.withColumn("all_blocks", F.ceil(F.sum("target").over(Window.partitionBy(F.lit(0))) / BLOCK_WORDS))
    goal = apportion(goal, [], ["source"], "target", "all_blocks", "blocks").drop("all_blocks")
    for k, level in enumerate(levels):
        path = ["source", *levels[:k + 1]]
        part = cells.groupBy(*path).agg(F.sum("cell_size").alias("part_size"), F.sum("room").alias("part_room"))
        above = goal.select(*[F.col(c).alias(f"of_{c}") for c in path[:-1]], "source_size", "target", "blocks")
        same = F.col("source").eqNullSafe(F.col("of_source"))
        for c in path[1:-1]:
            same &= F.col(c) == F.col(f"of_{c}")
        part = part.join(above, same).drop(*[f"of_{c}" for c in path[:-1]])
        # A source at its cap takes all the room of each shard, in which the last block is partial.
        full = F.col("target") >= cap * F.col("source_size") * (1 - 1e-9)
        part = part.withColumn("seats", F.when(full, F.sum("part_room").over(Window.partitionBy(*path[:-1]))).otherwise(F.col("blocks"))).drop("blocks")
        part = part.withColumn("part_share", F.col("part_size").cast("double"))
        goal = apportion(part, path[:-1], [level], "part_share", "seats", "blocks", "part_room")
        goal = materialize(goal.select(*path, "source_size", "target", "blocks", "part_size"))
    return goal.select(F.col("source").alias("of"), F.col("g0").alias("at"), "source_size", "target", F.col("part_size").alias("cell_size"), F.col("blocks").alias("quota"))


def placed(docs: DataFrame, columns: list, weights: list[float], cap: float, seed: int) -> DataFrame:
    """``columns`` of every row of ``docs`` with __size, its place __start in the run of its shard's words, and what the
    mix takes of the shard: __passes whole ones and __rest words of one more, of __cell words in __parts blocks."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    mark = F.xxhash64(F.lit(seed), F.col("doc_id").cast("long"), "text")
    marked = docs.select(*columns, F.col("source").cast("string").alias("__source"), mark.alias("__mark"), size.alias("__size"))
    narrow = materialize(docs.select(F.col("source").cast("string").alias("source"), mark.alias("mark"), size.alias("size")))
    total = narrow.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("words")).first()["words"]
    shard = lambda mark: F.pmod(F.col(mark), F.lit(max(1, -(-total // SHARD_WORDS)))).cast("int")
    cells = materialize(narrow.groupBy("source", shard("mark").alias("shard")).agg(F.sum("size").alias("cell_size")))
    quota = quotas(cells, weights, cap)
    most = (F.lit(cap) * F.col("cell_size")).cast("long")
    quota = quota.withColumn("words", F.least(F.col("quota") * BLOCK_WORDS, most))
    passes = F.when(F.col("cell_size") > 0, F.floor(F.col("words") / F.col("cell_size"))).otherwise(F.lit(0))
    quota = quota.select("of", "at", F.col("source_size").alias("__source_size"), F.col("target").alias("__target"), F.col("cell_size").alias("__cell"),
                         passes.alias("__passes"), (F.col("words") - passes * F.col("cell_size")).alias("__rest"),
                         F.ceil(F.col("cell_size") / BLOCK_WORDS).alias("__parts"), F.pmod(F.xxhash64(F.lit(seed), F.lit("turn"), "of", "at"), F.lit(1_000_003)).alias("__turn"))
    marked = marked.withColumn("__shard", shard("__mark"))
    place = Window.partitionBy("__source", "__shard").orderBy(F.xxhash64(F.lit(seed), F.lit("order"), "__mark"), "__size")
    marked = marked.withColumn("__start", F.sum("__size").over(place.rowsBetween(Window.unboundedPreceding, 0)) - F.col("__size"))
    return marked.join(quota, F.col("__source").eqNullSafe(F.col("of")) & (F.col("__shard") == F.col("at"))).drop("of", "at")


def mix(docs: DataFrame, weights: list[float] = (1, 2, 3), cap: float = 3.0, seed: int = 17) -> DataFrame:
    """doc_id, source, size, source_size, target, taken for every row of ``docs`` (doc_id, text, source).

    size: words of the text (null and empty texts: 0); source_size and target: of the row's source; taken: words that
    the mix takes from the row, repeats counted, at most ``cap`` times its size.

    Each source's words are dealt over shards by hashed doc_id and text; shard quotas are integer numbers of equal-token
    blocks (BLOCK_WORDS), by Sainte-Lague first over sources, then over a source's shards. In a shard the rows stand in a
    seeded order as one run of words; the quota takes whole passes over it, then whole blocks in a seeded permutation, the
    last one in part. Null sources are one source, the last; texts of any length are counted whole and lie in one shard;
    repeated rows count each; a corpus without words takes 0 everywhere; an empty table gives an empty one; reruns agree;
    extra columns are left out.
    """
    rows = placed(docs, [F.col("doc_id").cast("long").alias("doc_id")], list(weights), cap, seed)
    block, start, size = F.lit(BLOCK_WORDS), F.col("__start"), F.col("__size")
    tail = F.col("__cell") - (F.col("__parts") - 1) * block
    rank = lambda i: F.pmod((i + F.col("__turn")) * F.lit(PRIME), F.col("__parts"))
    length = lambda i: F.when(i == F.col("__parts") - 1, tail).otherwise(block)
    taken_before = lambda i: rank(i) * block - F.when(rank(i) > rank(F.col("__parts") - 1), block - tail).otherwise(F.lit(0))

    def overlap(i):
        """Words that the row shares with what is taken of block i."""
        chosen = F.greatest(F.least(F.col("__rest") - taken_before(i), length(i)), F.lit(0))
        return F.greatest(F.least(start + size, i * block + chosen) - F.greatest(start, i * block), F.lit(0))

    touched = F.sequence(F.floor(start / block), F.floor((start + size - 1) / block))
    part = F.when((size > 0) & (F.col("__rest") > 0),
                  F.aggregate(F.transform(touched, overlap), F.lit(0).cast("long"), lambda a, x: a + x)).otherwise(F.lit(0))
    return rows.select("doc_id", F.col("__source").alias("source"), size.alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"),
                       (F.col("__passes") * size + part).cast("long").alias("taken"))


def draw(docs: DataFrame, weights: list[float] = (1, 2, 3), cap: float = 3.0, seed: int = 17) -> DataFrame:
    """The mixed corpus: rows of ``docs``, all their columns, each as often as the quotas of ``mix`` say for whole texts:
    every row once for each whole pass over its shard, and for the quota's rest some rows once more. Long texts (above
    1/LONG of the shard) come in at the rate of the rest, evenly over their order of size; short ones fill what these leave,
    in the shard's seeded order. So a shard misses its quota by half a short text; only texts longer than the rest count
    by their mean, so that over many shards they neither add nor lack. No text is taken more than ``cap`` times. Rows without words, of which nothing can be taken, stay once."""
    rows = placed(docs, [F.struct(*docs.columns).alias("__row")], list(weights), cap, seed)  # no clash of names
    size, rate = F.col("__size"), F.coalesce(F.try_divide("__rest", "__cell"), F.lit(0.0))
    shard = Window.partitionBy("__source", "__shard")
    rows = rows.withColumn("__long", size * LONG > F.col("__cell"))
    rows = rows.withColumn("__rank", F.row_number().over(shard.orderBy(F.desc("__long"), F.desc("__size"), "__mark")))
    shift = F.col("__turn") / 1_000_003
    rows = rows.withColumn("__picked", F.col("__long") & (F.floor(F.col("__rank") * rate + shift) > F.floor((F.col("__rank") - 1) * rate + shift)))
    order = shard.orderBy("__long", F.xxhash64(F.lit(seed), F.lit("order"), "__mark"), "__size").rowsBetween(Window.unboundedPreceding, 0)
    used = F.when(size > F.col("__rest"), rate * size).when(F.col("__picked"), size).otherwise(F.lit(0))
    left = F.col("__rest") - F.sum(F.when(F.col("__long"), used).otherwise(F.lit(0.0))).over(shard)
    fits = ~F.col("__long") & (F.sum(size).over(order) - size / 2 <= left)
    rows = rows.withColumn("__times", F.when(size > 0, F.col("__passes") + (F.col("__picked") | fits).cast("int")).otherwise(F.lit(1)).cast("int"))
    return rows.where("__times > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__times")))).select("__row.*")
