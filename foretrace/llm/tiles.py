"""Dealing of two sides of rows to cells of a grid, and their work in the cells.

A group's rows fall to blocks and its askers to slices by a hash of their row, each of about a fixed size; every block
meets every slice in a cell of its own. A cell holds one block, and its slice passes in batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dealt(rows: DataFrame, askers: DataFrame, keys: list[str], block: int, many: int) -> DataFrame:
    """Both sides with ``keys``, _block, _slice and _side (0 rows, 1 askers), a copy for each cell. Rows have ``row``."""
    blocks = rows.groupBy(*keys).agg(F.ceil(F.count("*") / block).cast("int").alias("_blocks"))
    sizes = blocks.join(askers.groupBy(*keys).agg(F.ceil(F.count("*") / many).cast("int").alias("_slices")), keys)
    own = lambda n: F.array(F.pmod(F.xxhash64("row"), F.col(n)).cast("int"))
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    spread = lambda df, b, s, side: df.join(sizes, keys).withColumn("_block", F.explode(b)).withColumn("_slice", F.explode(s)).withColumn("_side", F.lit(side)).drop("_blocks", "_slices")
    both = spread(rows, own("_blocks"), every("_slices"), 0).unionByName(spread(askers, every("_blocks"), own("_slices"), 1), allowMissingColumns=True)
    cell = [*keys, "_block", "_slice"]
    return both.repartition(*cell).sortWithinPartitions(*cell, "_side")


def in_cells(both: DataFrame, keys: list[str], build: Callable, search: Callable, schema: str, batch_rows: int) -> DataFrame:
    """``search(build(rows of a block), askers)`` for each batch of askers of a cell; both get Arrow tables."""
    cell = [*keys, "_block", "_slice", "_side"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, block, asked = None, [], None, []

        def answers() -> Iterator[pa.RecordBatch]:
            nonlocal block, held, asked
            if asked and (block is not None or held):
                if block is None:
                    block, held = build(pa.Table.from_batches(held).combine_chunks()), []
                yield from search(block, pa.Table.from_batches(asked).combine_chunks())
            asked = []

        for batch in batches:
            codes = [batch.column(c).to_numpy(zero_copy_only=False) for c in cell]
            cuts = np.flatnonzero(np.any([c[1:] != c[:-1] for c in codes], axis=0)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
                if a == b:
                    continue
                if (here := tuple(c[a] for c in codes[:-1])) != key:
                    yield from answers()
                    key, held, block = here, [], None
                if codes[-1][a] == 0:
                    held.append(batch.slice(a, b - a))
                    continue
                for k in range(a, b, batch_rows):
                    asked.append(batch.slice(k, min(batch_rows, b - k)))
                    if sum(x.num_rows for x in asked) >= batch_rows:
                        yield from answers()
        yield from answers()

    return both.mapInArrow(run, schema)


def matrix(table: pa.Table, name: str) -> np.ndarray:
    """A column of lists of equal length as rows of a matrix."""
    lists = table.column(name).combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    return lists.flatten().to_numpy().reshape(len(lists), -1)
