"""Connected components of gates, each grid in one task of its own."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..functions.grid import EIGHT, FOUR, components

#: A component's label is the row and column of its first gate in row order: row * LABEL_ROW + column.
LABEL_ROW = 1_000_000


def component_labels(cell: np.ndarray, near: list[tuple[int, int]]) -> np.ndarray:
    """The label of each of the cells, which may repeat."""
    cells, at = np.unique(cell, return_inverse=True)
    return cells[components(cells // LABEL_ROW, cells % LABEL_ROW, near)][at] if len(cells) else cell


def label_gates(gates: DataFrame, grid: list[str], diagonal: bool, name: str = "label") -> DataFrame:
    """gates (with az_idx, rng_idx) of the grids that the columns `grid` tell apart, with the label of their component.

    Labels sort like the components' first gates. A group is one grid, so its size is that of a radar sweep. Rows of
    the same gate share its label."""
    schema = T.StructType([*gates.schema.fields, T.StructField(name, T.LongType())])
    near = EIGHT if diagonal else FOUR

    def run(table: pa.Table) -> pa.Table:
        cell = table.column("az_idx").to_numpy().astype(np.int64) * LABEL_ROW + table.column("rng_idx").to_numpy()
        return table.append_column(name, pa.array(component_labels(cell, near)))

    return gates.groupBy(*grid).applyInArrow(run, schema)
