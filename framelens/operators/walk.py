"""Greedy walks over the sorted rows of each group, in a stream."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


class Walk:
    """What a walk keeps of one group. ``done`` says that no further row of the group is wanted."""

    done = False

    def step(self, row: dict) -> dict | None:
        """What the next row gives, if anything."""
        raise NotImplementedError

    def finish(self) -> Iterable[dict]:
        """Rows that are known only after the group's last one."""
        return ()


def _starts(batch: pa.RecordBatch, group: list[str]) -> list[int]:
    """First row of each run of equal values of ``group``; nulls are equal."""
    n = batch.num_rows
    if not n:
        return []
    new = pa.array([False] * (n - 1), pa.bool_())
    for c in group:
        before, after = batch.column(c).slice(0, n - 1), batch.column(c).slice(1)
        new = pc.or_(new, pc.or_(pc.fill_null(pc.not_equal(before, after), False), pc.xor(pc.is_null(before), pc.is_null(after))))
    return [0, *(i + 1 for i, x in enumerate(new.to_pylist()) if x)]


def walk(rows: DataFrame, group: list[str], order: list, start: Callable[[], Walk], out: str) -> DataFrame:
    """For each group its rows in ``order`` through a ``Walk`` of its own. A task holds one walk and a batch of rows, never a
    group, and rows behind the last one that a walk wants are not looked at."""
    arrow = to_arrow_schema(StructType.fromDDL(out))

    def run(batches):
        last, state = None, None
        for batch in batches:
            made = []
            starts = _starts(batch, group)
            for a, b in zip(starts, [*starts[1:], batch.num_rows]):
                key = tuple(batch.column(c)[a].as_py() for c in group)
                if state is None or key != last:
                    if state is not None:
                        made += state.finish()
                    last, state = key, start()
                at = a
                while at < b and not state.done:
                    for row in batch.slice(at, min(256, b - at)).to_pylist():
                        got = state.step(row)
                        if got is not None:
                            made.append(got)
                        if state.done:
                            break
                    at += 256
            yield pa.RecordBatch.from_pylist(made, arrow)
        if state is not None:
            yield pa.RecordBatch.from_pylist(list(state.finish()), arrow)

    return rows.repartition(*group).sortWithinPartitions(*group, *order).mapInArrow(run, out)
