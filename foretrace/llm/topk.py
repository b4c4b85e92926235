"""Exact top-k inner-product search over an impact-ordered, score-at-a-time index.

Components become integers floor(scale * x). Candidates are dealt into blocks of about ``BLOCK`` vectors in
descending order of impact, the sum of their squared components. A block's index holds posting segments: for each
dimension and sign the places of the vectors whose component has a quantised impact, in multiples of a step; what a
quantised impact leaves of its component is the vector's rest.

1. A query first searches its home block, the one that holds its own vector; its k-th best score there is its first
   threshold. Queries are so spread over blocks as vectors are.
2. The other blocks are first asked by their bounds, from the least and greatest component of each dimension and from
   the lengths of query and vectors, in a small table of blocks: where no vector can reach the threshold, the query is
   not shipped. The others meet the block in slices of queries.
3. In a block, segments go in descending order of impact and add to the accumulators of a batch of queries. After
   a level, no score can be further from its accumulator than the length of the query times that of the vector's rest
   (components not yet reached and remainders). Upper bounds are held against the threshold and the k-th best lower
   bound; when few enough vectors can still be members, which is a proof for the rest, processing stops and the possible
   members are scored exactly. Segments of small impact, most of the postings' noise, are so left out. Without such a
   proof all segments are processed, and all that are possible then are scored exactly.
4. The blocks' best k that reach the threshold are merged per query.

A block's index has a fixed size, and queries pass in batches, so no task holds a set that grows. The work is
queries times candidates, less what is proven out; a group of any number of equal vectors is spread over blocks.
Rows are numbered once, in a stored table. Scores are exact while they stay below 2^53.

Edge cases: vectors that are null, hold nulls or non-finite values, or have no id, take no part; queries meet only
candidates of their own dimension; the query's own row never is its result, but another row of its id may
be; ties go to smaller vec_id; fewer candidates than k give all; empty tables give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foretrace.llm.common import column, stored
from foretrace.llm.tiles import in_cells, matrix

BLOCK, SLICE, BATCH = 8192, 4096, 128
#: Steps up to the greatest component of a block, each a level of impact.
LEVELS = 32
#: A block is rescored when at most this share of its vectors, or 4 k, can still be members; proofs are tried once the
#: rests are below this share of the vectors' lengths.
FEW, NEAR = 0.1, 0.5
#: Quantiles of the impact by which blocks are formed; a run of more blocks than that shares a quantile.
BANDS = 64
BROADCAST_ROWS = 20_000
#: Room for rounding in bounds; single precision holds the sums exactly up to EXACT.
_ROUNDED, EXACT = 1 + 1e-6, 1 << 23


class ImpactIndex:
    """The posting segments of one block; vectors are the rows of an integer matrix."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, vectors: np.ndarray):
        order = np.lexsort((rows, ids))  # places in the block follow the order of ties
        self.ids, self.rows, self.vectors = ids[order], rows[order], vectors[order]
        self.low, self.high = self.vectors.min(axis=0), self.vectors.max(axis=0)
        square = (self.vectors.astype(float) ** 2).sum(axis=1)
        self.longest = math.sqrt(float(square.max()))
        step = max(1, int(np.abs(self.vectors).max(initial=0)) // LEVELS)
        level = np.abs(self.vectors) // step
        impact = np.sign(self.vectors) * (level * step + (step - 1) // 2)
        place, dimension = np.nonzero(level)
        by = np.lexsort((place, self.vectors[place, dimension] < 0, dimension, -level[place, dimension]))
        place, dimension = place[by], dimension[by]
        value = impact[place, dimension]
        cuts = np.flatnonzero((np.diff(value) != 0) | (np.diff(dimension) != 0)) + 1
        #: By descending level: (dimension, impact, places) of its segments, and the rests' lengths after it.
        self.levels: list[tuple[list[tuple[int, float, np.ndarray]], np.ndarray]] = []
        here, rest = [], square.copy()
        starts = np.r_[0, cuts, len(value)] if len(value) else np.zeros(1, int)
        for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            of, at, d = float(value[a]), place[a:b], int(dimension[a])
            here.append((d, of, at))
            whole = self.vectors[at, d].astype(float)
            rest[at] += (whole - of) ** 2 - whole**2
            if b == len(value) or level[place[b], dimension[b]] != level[place[a], d]:
                self.levels.append((here, np.sqrt(np.maximum(rest, 0)) * _ROUNDED + 1e-6))
                here = []
        self.norm = np.sqrt(square)
        self.postings = len(value)
        #: (processed, all) postings times queries so far.
        self.work = np.zeros(2)

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """The most that any vector of the block can score with each query."""
        by_dimension = np.maximum(queries * self.low, queries * self.high).sum(axis=1)
        return np.minimum(by_dimension, np.floor(np.sqrt((queries**2).sum(axis=1)) * self.longest * _ROUNDED))

    def search(self, queries: np.ndarray, own: np.ndarray, k: int, least: np.ndarray) -> tuple[list[tuple[int, int, int, int]], int]:
        """(query, vec_id, row, score) of each query's best k of at least its threshold, and how many queries stopped
        on a proof before the last level. own: each query's row."""
        n, out, proven, few = len(self.ids), [], 0, max(4 * k, FEW * len(self.ids))
        pending, length = np.arange(len(queries)), np.sqrt((queries**2).sum(axis=1)) * _ROUNDED
        kind = np.float32 if 2 * self.longest * length.max(initial=0) < EXACT else np.float64
        total, given = np.zeros((n, len(queries)), kind), np.ascontiguousarray(queries.T, kind)
        levels = self.levels or [([], self.norm * _ROUNDED)]
        self.work[1] += self.postings * len(queries)
        for done, (segments, far) in enumerate(levels, 1):
            for d, impact, places in segments:
                total[places] += kind(impact) * given[d]
                self.work[0] += len(places) * len(pending)
            final = done == len(levels)
            if not final and far.sum() > NEAR * self.norm.sum():
                continue
            slack = (far[:, None] * length[pending] + 1).astype(kind)  # 1: more than a sum's last place
            upper = total + slack
            possible = upper >= least[pending]
            many = np.flatnonzero(possible.sum(axis=0) > (few if not final else k))
            if len(many) and n > k + 1:  # one more than k, for the own row
                lower = total[:, many] - slack[:, many]
                kth = np.partition(lower, n - k - 1, axis=0)[n - k - 1]
                possible[:, many] &= upper[:, many] >= kth
            sure = np.full(len(pending), final) | (possible.sum(axis=0) <= few)
            for q in np.flatnonzero(sure).tolist():
                query = int(pending[q])
                at = np.flatnonzero(possible[:, q])
                at = at[self.rows[at] != own[query]]
                scores = self.vectors[at] @ queries[query].astype(np.int64)
                best = np.argsort(-scores, kind="stable")[:k]
                best = best[scores[best] >= least[query]]
                out += [(query, *hit) for hit in zip(self.ids[at[best]].tolist(), self.rows[at[best]].tolist(), scores[best].tolist(), strict=True)]
            proven += 0 if final else int(sure.sum())
            if sure.all():
                break
            if sure.any():
                total, given, pending = total[:, ~sure], np.ascontiguousarray(given[:, ~sure]), pending[~sure]
        return out, proven


def integers(vector: Column, scale: float) -> Column:
    """floor(scale * x) of each component; null if a component is null or not finite."""
    good = ~vector.isNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(good, F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))))


_FOUND = "asker bigint, query_id bigint, vec_id bigint, row bigint, score bigint"
_NONE = -(1 << 62)


def _searched(both: DataFrame, k: int) -> DataFrame:
    """Each cell's best: rows with dim, _block, _slice, _side, vec_id, row, v, and least (the threshold) on side 1."""

    def build(table: pa.Table) -> ImpactIndex:
        return ImpactIndex(table.column("vec_id").to_numpy(), table.column("row").to_numpy(), matrix(table, "v"))

    def search(index: ImpactIndex, asked: pa.Table) -> Iterator[pa.RecordBatch]:
        ids, rows, least, queries = (*(asked.column(c).to_numpy() for c in ("vec_id", "row", "least")), matrix(asked, "v").astype(float))
        reach = np.flatnonzero(index.bounds(queries) >= least)
        if len(reach):
            hits, _ = index.search(queries[reach], rows[reach], k, least[reach].astype(float))
            if hits:
                q, vec, row, score = (np.array(c, np.int64) for c in zip(*hits, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (rows[reach][q], ids[reach][q], vec, row, score)], ["asker", "query_id", "vec_id", "row", "score"])

    cell = ["dim", "_block", "_slice"]
    dealt = both.select(*cell, "_side", "vec_id", "row", "least", "v").repartition(*cell).sortWithinPartitions(*cell, "_side")
    return in_cells(dealt, ["dim"], build, search, _FOUND, BATCH)


def top_k(vectors: DataFrame, is_query: Column, k: int, scale: float = 64, vec_id: str = "vec_id", vector: str = "embedding", block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best candidates of every row that ``is_query`` holds for."""
    rows = vectors.select(column(vec_id).cast("bigint").alias("vec_id"), integers(column(vector), scale).alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = rows.filter("vec_id IS NOT NULL AND size(v) > 0")
    impact = F.aggregate("v", F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double"))
    rows = stored(rows.withColumns({"dim": F.size("v"), "impact": impact, "row": F.monotonically_increasing_id()}), "vectors")
    sizes = rows.groupBy("dim").agg(F.count("*").alias("n"), F.percentile_approx("impact", F.array(*[F.lit(i / BANDS) for i in range(1, BANDS)]), F.lit(1000)).alias("cuts"))
    sizes = stored(sizes.withColumn("blocks", F.ceil(F.col("n") / block).cast("int")), "sizes")
    sizes_few = sizes.count() <= BROADCAST_ROWS
    sizes = F.broadcast(sizes) if sizes_few else sizes
    # Bands in descending order of impact fall to runs of blocks; a hash decides within a band, and within all bands
    # of one impact that many vectors share.
    below, equal = F.size(F.filter("cuts", lambda c: c < F.col("impact"))), F.size(F.filter("cuts", lambda c: c == F.col("impact")))
    spot = 1 - (below + (equal + 1) * F.pmod(F.xxhash64("row"), F.lit(1 << 20)) / (1 << 20)) / BANDS
    placed = rows.join(sizes, "dim").withColumn("_block", F.least(F.floor(spot * F.col("blocks")).cast("int"), F.col("blocks") - 1))
    placed = stored(placed.select("dim", "_block", "blocks", "impact", "vec_id", "row", "asks", "v"), "placed")
    names = ("dim", "_block", "_slice", "_side", "vec_id", "row", "least", "v")
    side = lambda df, number: df.withColumn("_side", F.lit(number))
    home = placed.withColumns({"_slice": F.lit(0), "least": F.lit(_NONE)})
    first = stored(_searched(side(home, 0).select(*names).unionByName(side(home.filter("asks"), 1).select(*names)), k), "first")
    threshold = first.groupBy("asker").agg(F.count("*").alias("found"), F.min("score").alias("worst"))
    asking = placed.filter("asks AND blocks > 1").join(threshold, F.col("row") == F.col("asker"), "left").withColumn("least", F.when(F.col("found") >= k, F.col("worst")).otherwise(_NONE))
    slices = placed.filter("asks").groupBy("dim").agg(F.ceil(F.count("*") / SLICE).cast("int").alias("slices"))
    slices = F.broadcast(slices) if sizes_few else slices
    # What every vector of a block is bounded by, a row a block.
    extremes = placed.select("dim", "_block", "impact", F.posexplode("v").alias("i", "x")).groupBy("dim", "_block", "i").agg(F.min("x").alias("low"), F.max("x").alias("high"), F.max("impact").alias("longest"))
    extremes = stored(extremes.groupBy("dim", "_block").agg(F.array_sort(F.collect_list(F.struct("i", "low", "high"))).alias("ends"), F.sqrt(F.max("longest")).alias("longest")), "extremes")
    asking = asking.withColumnRenamed("_block", "home")
    if extremes.count() <= BROADCAST_ROWS:
        most = F.aggregate(F.zip_with("ends", "v", lambda e, q: F.greatest(e["low"] * q, e["high"] * q)), F.lit(0).cast("bigint"), lambda total, x: total + x)
        pairs = asking.join(F.broadcast(extremes), "dim").filter((F.col("_block") != F.col("home")) & (F.sqrt("impact") * F.col("longest") * _ROUNDED >= F.col("least"))).filter(most >= F.col("least"))
    else:  # blocks too many to send to all: their bounds are tried in the cells
        pairs = asking.withColumn("_block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).filter("_block <> home")
    asked = pairs.join(slices, "dim").withColumn("_slice", F.pmod(F.xxhash64("row"), F.col("slices")).cast("int"))
    met = placed.filter("blocks > 1").join(slices, "dim").withColumn("_slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).withColumn("least", F.lit(_NONE))
    found = first.union(_searched(side(met, 0).select(*names).unionByName(side(asked, 1).select(*names)), k))
    best = Window.partitionBy("asker").orderBy(F.desc("score"), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
