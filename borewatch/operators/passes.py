"""Python passes over rows that stand in their order.

After a window, the rows of a group follow each other in one task.  What a group's rows say of each other is worked out
on the way there, a group at a time: no row is shuffled or stored again to meet its result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import types as T

# Rows of whole groups that a pass takes at a time; a larger group is taken alone.
ROWS_AT_ONCE = 10_000

Batches = Iterator[pa.RecordBatch]


@dataclass(frozen=True)
class Pass:
    """Adds `fields` behind the columns of each batch; `needed` names columns that nothing after it reads."""

    fields: list[T.StructField]
    needed: list[str]
    run: Callable[[Batches], Batches]


def group_starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Rows that begin a group: the first one, and those whose keys are not those of the row before; nulls are equal."""
    begins = np.zeros(table.num_rows, dtype=bool)
    begins[:1] = True
    for key in keys:
        codes = table.column(key).combine_chunks().dictionary_encode()
        place = pc.fill_null(codes.indices, -1).to_numpy(zero_copy_only=False)
        begins[1:] |= place[1:] != place[:-1]
    return np.flatnonzero(begins)


def whole_groups(batches: Batches, keys: list[str]) -> Iterator[tuple[pa.Table, list[tuple[int, int]]]]:
    """Tables of whole groups, each with the first row of its groups and the row behind their last."""
    def cut(table: pa.Table, starts: np.ndarray) -> tuple[pa.Table, list[tuple[int, int]]]:
        return table.combine_chunks(), list(zip(starts.tolist(), [*starts[1:].tolist(), table.num_rows]))

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(b.num_rows for b in held) < ROWS_AT_ONCE:
            continue
        table = pa.Table.from_batches(held)
        starts = group_starts(table, keys)
        last = int(starts[-1])
        if last:
            yield cut(table.slice(0, last), starts[:-1])
            held = table.slice(last).to_batches()
    if held:
        table = pa.Table.from_batches(held)
        yield cut(table, group_starts(table, keys))


def doubles(table: pa.Table, names: list[str]) -> np.ndarray:
    """Columns side by side as doubles, NaN where there is none."""
    return np.column_stack([table.column(n).cast(pa.float64()).to_numpy() for n in names])
