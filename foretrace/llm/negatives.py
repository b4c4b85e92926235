"""Hard negatives for anchors: the best rows of other labels whose score lies in a band below that of a positive.

Components become integers floor(scale * x). Exact scores of an anchor with a block of rows come from packed products:
components of both sides are shifted to be non-negative, several rows' components of one dimension go to fields of one
wide integer, wide enough for the largest sum that the block and the anchors can give, so that one multiplication by
the anchor's component and one addition work on all of them without a carry between fields. Unpacked sums less the
shifts are the scores. Words of 64 bits hold two or three rows; where one field needs more, Python's integers take over.

1. Positives: an anchor meets the rows of its own label, in cells of a block of rows and a slice of anchors; the best of
   the cells are merged. A label of any size is many cells.
2. Negatives: an anchor meets all rows likewise, with the bands of its positives. A block's scores within the bands are
   sorted once, each band takes its first ones, and the cells' are merged.

Every row meets every anchor, in blocks: the work is their product, the copies shipped are rows times slices and
anchors times blocks. Nothing is cut by a bound that could miss a row.

Edge cases: rows without id, label or vector, or with null or non-finite components take no part; rows of other vector
lengths do not meet; ties go to the smaller id; a positive without a negative in its band gives no rows, nor does one of
negative score (its band is empty); repeated rows are rows of their own (and positives of each other). Labels are
integers. Scores are exact below 2^56.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foretrace.llm.common import column, stored
from foretrace.llm.tiles import dealt, in_cells, matrix
from foretrace.llm.topk import integers

BLOCK, SLICE = 8192, 2048
#: Anchors for which a block is packed at once, and those multiplied at once.
BATCH, STEP = 256, 16
#: Rows in one of Python's integers, where a field needs more than a word.
WIDE_FIELDS = 8


class PackedBlock:
    """A block's vectors; ``scores`` packs them for the anchors at hand."""

    def __init__(self, table: pa.Table):
        ids, rows = table.column("vec_id").to_numpy(), table.column("row").to_numpy()
        order = np.lexsort((rows, ids))  # places follow the order of ties
        self.ids, self.rows, self.labels = ids[order], rows[order], table.column("label").to_numpy()[order]
        vectors = matrix(table, "v")[order]
        self.low = vectors.min(axis=0)
        self.shifted = vectors - self.low
        self.high = self.shifted.max(axis=0)

    def scores(self, anchors: np.ndarray) -> np.ndarray:
        """Exact inner products, a row an anchor."""
        n, d = self.shifted.shape
        least = anchors.min(axis=0)
        raised = anchors - least
        width = max(1, sum(int(a) * int(b) for a, b in zip(raised.max(axis=0), self.high, strict=True)).bit_length())
        kind = np.uint64 if width <= 64 else object
        fields = 64 // width if width <= 64 else WIDE_FIELDS
        words = -(-n // fields)
        parts = np.zeros((fields * words, d), np.int64)
        parts[:n] = self.shifted
        parts = parts.reshape(fields, words, d).astype(kind)
        # Python's own integers as shifts where the words are such.
        shift = [kind(width * f) if kind is np.uint64 else width * f for f in range(fields)]
        mask = kind((1 << width) - 1) if kind is np.uint64 else (1 << width) - 1
        packed = np.ascontiguousarray(sum(parts[f] << shift[f] for f in range(fields)).T)
        out = np.empty((len(anchors), n), np.int64)
        for a in range(0, len(anchors), STEP):
            some = raised[a : a + STEP].astype(kind)
            total = some[:, :1] * packed[0]
            spare = np.empty_like(total)
            for i in range(1, d):
                total += np.multiply(some[:, i : i + 1], packed[i], out=spare)
            for f in range(fields):
                stop = min(n, (f + 1) * words)
                if stop > f * words:
                    out[a : a + STEP, f * words : stop] = (total >> shift[f] & mask)[:, : stop - f * words]
        return out + (anchors @ self.low)[:, None] + (self.shifted @ least)[None, :]


def _batch(cells: list[tuple], names: list[str]) -> Iterator[pa.RecordBatch]:
    if cells:
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*cells, strict=True)], names)


def _positives(rows: DataFrame, anchors: DataFrame, k: int) -> DataFrame:
    """(anchor, anchor_id, place, positive, positive_id, score): an anchor's best k rows of its label."""
    names = ["anchor", "anchor_id", "positive", "positive_id", "score"]

    def search(block: PackedBlock, asked: pa.Table) -> Iterator[pa.RecordBatch]:
        own, ids = asked.column("row").to_numpy(), asked.column("vec_id").to_numpy()
        scores, found = block.scores(matrix(asked, "v")), []
        n = scores.shape[1]
        for q in range(len(own)):
            least = np.partition(scores[q], n - k - 1)[n - k - 1] if n > k + 1 else None  # one more, for the own row
            at = np.arange(n) if least is None else np.flatnonzero(scores[q] >= least)
            at = at[block.rows[at] != own[q]]
            at = at[np.argsort(-scores[q, at], kind="stable")[:k]]
            found += [(int(own[q]), int(ids[q]), int(block.rows[i]), int(block.ids[i]), int(scores[q, i])) for i in at]
        yield from _batch(found, names)

    keys = ["d", "label"]
    found = in_cells(dealt(rows, anchors, keys, BLOCK, SLICE), keys, PackedBlock, search, ", ".join(f"{c} bigint" for c in names), BATCH)
    best = Window.partitionBy("anchor").orderBy(F.desc("score"), "positive_id", "positive")
    return found.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= k)


def hard_negatives(vectors: DataFrame, is_anchor: Column, scale: float = 256, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each anchor and each of its best
    ``positives`` rows of equal label the first ``negatives`` rows of other labels that score between ``low`` and
    ``high`` hundredths of the positive."""
    rows = vectors.select(column(vec_id).cast("bigint").alias("vec_id"), column(label).cast("bigint").alias("label"), integers(column(vector), scale).alias("v"), F.coalesce(is_anchor, F.lit(False)).alias("asks"))
    rows = rows.filter("vec_id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL").withColumns({"d": F.size("v"), "row": F.monotonically_increasing_id()})
    rows = stored(rows.filter("d > 0"), "vectors")
    anchors, rows = rows.filter("asks").drop("asks"), rows.drop("asks")
    first = stored(_positives(rows, anchors, positives), "positives")
    bands = first.groupBy(F.col("anchor").alias("row")).agg(F.array_sort(F.collect_list(F.struct("place", "score"))).alias("p"))
    asking = anchors.join(bands, "row").select(*anchors.columns, F.transform("p", lambda p: p["score"]).alias("known"))
    names = ["anchor", "place", "negative", "negative_id", "negative_score"]

    def search(block: PackedBlock, asked: pa.Table) -> Iterator[pa.RecordBatch]:
        own, labels = asked.column("row").to_numpy(), asked.column("label").to_numpy()
        scores, known, found = block.scores(matrix(asked, "v")), asked.column("known").to_pylist(), []
        for q in range(len(own)):
            bounds = [(-(-low * s // 100), high * s // 100) for s in known[q]]
            bounds = [(k, a, b) for k, (a, b) in enumerate(bounds, 1) if a <= b]
            if not bounds:
                continue
            row = scores[q]
            at = np.flatnonzero((row >= min(a for _, a, _ in bounds)) & (row <= max(b for *_, b in bounds)) & (block.labels != labels[q]))
            at = at[np.argsort(-row[at], kind="stable")]
            falling = -row[at]
            for k, a, b in bounds:
                begin = int(np.searchsorted(falling, -b))
                stop = min(begin + negatives, int(np.searchsorted(falling, -a, "right")))
                found += [(int(own[q]), k, int(block.rows[i]), int(block.ids[i]), int(row[i])) for i in at[begin:stop]]
        yield from _batch(found, names)

    found = in_cells(dealt(rows, asking, ["d"], BLOCK, SLICE), ["d"], PackedBlock, search, ", ".join(f"{c} bigint" for c in names), BATCH)
    best = Window.partitionBy("anchor", "place").orderBy(F.desc("negative_score"), "negative_id", "negative")
    found = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= negatives)
    out = found.join(first.withColumn("place", F.col("place").cast("bigint")), ["anchor", "place"])
    return out.select("anchor_id", "positive_id", "rank", "negative_id", F.col("score").alias("positive_score"), "negative_score")
