"""Exact order statistics and first rows in an order, without a task that sees all rows.

The rows' order key is narrowed by rounds of histograms: each round counts equal parts of the ranges that still hold a
wanted rank, in one pass with map-side sums, and keeps the part with the rank. When a range holds few rows or one
value, its distinct values are counted and the rank is read off. What the driver gets is bounded by the parts.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PARTS = 1024
#: A range of up to so many rows is read off from its distinct values.
FEW = 2048


@dataclass(frozen=True)
class Spread:
    """Non-null values of a column: how many, and the least and greatest finite ones."""

    n: int
    below: int  # -infinity
    finite: int
    above: int  # infinity, then nan
    low: float | int | None
    high: float | int | None


def spread(rows: DataFrame, value: Column) -> Spread:
    """One pass over the rows."""
    real = rows.select(value.alias("v"))
    floating = dict(real.dtypes)["v"] in ("double", "float")
    finite = ~F.isnan("v") & (F.abs("v") < math.inf) if floating else F.col("v").isNotNull()
    count = lambda c: F.coalesce(F.sum(c.cast("bigint")), F.lit(0))
    r = real.agg(F.count("v").alias("n"), count(F.col("v") == -math.inf if floating else F.lit(False)).alias("below"), count(finite).alias("finite"), count(F.col("v") == math.inf if floating else F.lit(False)).alias("above"), F.min(F.when(finite, F.col("v"))).alias("low"), F.max(F.when(finite, F.col("v"))).alias("high")).first()
    return Spread(*r)


def order_statistics(rows: DataFrame, value: Column, ranks: list[int], known: Spread | None = None) -> dict[int, float | int | None]:
    """The non-null values of these ranks (from 0, ascending; nan last); None for a rank beyond them.

    ``rows`` is scanned once a round, so it should be stored or cheap; each round divides a range by ``PARTS``.
    """
    return {rank: found and found[0] for rank, found in borders(rows, value, ranks, known).items()}


def borders(rows: DataFrame, value: Column, ranks: list[int], known: Spread | None = None) -> dict[int, tuple | None]:
    """(value, rows below it, rows of it) for each rank."""
    s = known or spread(rows, value)
    out: dict[int, tuple | None] = {}
    open_ranges: dict[tuple, list[int]] = {}
    for rank in set(ranks):
        if not 0 <= rank < s.n:
            out[rank] = None
        elif rank < s.below:
            out[rank] = (-math.inf, 0, s.below)
        elif rank < s.below + s.finite:
            open_ranges.setdefault((s.low, s.high, s.below, s.finite), []).append(rank)
        else:
            most = s.below + s.finite + s.above
            out[rank] = (math.inf, s.below + s.finite, s.above) if rank < most else (math.nan, most, s.n - most)
    while open_ranges:
        narrow = {r: w for r, w in open_ranges.items() if r[0] != r[1]}
        for (low, _, before, n), wanted in ((r, w) for r, w in open_ranges.items() if r not in narrow):
            out |= dict.fromkeys(wanted, (low, before, n))
        open_ranges = {}
        if not narrow:
            break
        named = list(narrow)
        cells = F.lit(None).cast("array<bigint>")
        v = F.col("v")
        for i, (low, high, _, n) in enumerate(named):
            if n <= FEW:
                part = F.lit(-1)  # by value
            elif isinstance(low, float):
                part = F.least(F.floor((v / 2 - low / 2) / (high / 2 - low / 2) * PARTS), F.lit(PARTS - 1))
            else:  # as decimals, where differences of integers neither overflow nor lose digits
                offset = (v.cast("decimal(20,0)") - F.lit(low).cast("decimal(20,0)")).cast("double")
                part = F.least(F.floor(offset / float(high - low) * PARTS), F.lit(PARTS - 1))
            cells = F.when(v.between(low, high), F.array(F.lit(i).cast("bigint"), part.cast("bigint"))).otherwise(cells)
        keyed = rows.select(value.alias("v")).withColumn("cell", cells).filter("cell IS NOT NULL")
        single = F.when(F.col("cell")[1] == -1, v)
        counted = keyed.groupBy(F.col("cell")[0].alias("i"), F.col("cell")[1].alias("part"), single.alias("single")).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
        found: dict[int, list] = {}
        for r in counted.collect():
            found.setdefault(r.i, []).append(r)
        for i, (_, _, before, _) in enumerate(named):
            for r in sorted(found[i], key=lambda r: r.low):
                here = [w for w in narrow[named[i]] if before <= w < before + r.n]
                if here:
                    open_ranges.setdefault((r.low, r.high, before, r.n), []).extend(here)
                before += r.n
    return out


def percentiles(rows: DataFrame, column: str, shares: list[float], known: Spread | None = None) -> list[float | None]:
    """Exact percentiles, interpolated as the ``percentile`` function does; None without values."""
    value = F.col(column).cast("double")
    known = known or spread(rows, value)
    if not known.n:
        return [None] * len(shares)
    at = [share * (known.n - 1) for share in shares]
    found = order_statistics(rows, value, [r for p in at for r in (math.floor(p), math.ceil(p))], known)
    mixed = lambda p, low, high: low if math.floor(p) == math.ceil(p) or low == high else (math.ceil(p) - p) * low + (p - math.floor(p)) * high
    return [mixed(p, found[math.floor(p)], found[math.ceil(p)]) for p in at]


def cut_at(rows: DataFrame, places: list[int], *order: Column) -> list[DataFrame]:
    """``rows`` cut after the first places[0], places[1], ... by ``order``, nulls first: one part more than places.

    The first column is an integer; the ranks of all cuts are found in the same rounds. Only rows that share its value
    at a cut are sorted by the other columns; rows equal in all of them go in an order of their content.
    """
    key = F.coalesce(order[0].cast("bigint"), F.lit(-(1 << 63)))
    known = spread(rows, key)
    found = borders(rows, key, [p - 1 for p in places if 0 < p < known.n], known)
    # A cut takes keys below a value and so many rows of it.
    cuts: list[tuple[float, float]] = [(-math.inf, 0)]
    for p in places:
        value, below, tied = found.get(p - 1) or (math.inf if p > 0 else -math.inf, 0, 0)
        cuts.append(max(cuts[-1], (value, math.inf if p - below == tied else p - below)))
    cuts.append((math.inf, 0))
    shared = {value: _placed(rows.filter(key == value), list(order[1:])) for value, n in cuts if abs(value) < math.inf and n < math.inf}
    single = rows.filter(~key.isin(list(shared))) if shared else rows

    def under(value: float, n: float) -> Column:
        if abs(value) == math.inf:
            return F.lit(value > 0)
        return key <= value if n == math.inf else key < value

    def taken(cut: tuple[float, float], value: int) -> float:
        return cut[1] if cut[0] == value else math.inf if cut[0] > value else 0

    out = []
    for low, high in zip(cuts, cuts[1:]):
        part = single.filter(~under(*low) & under(*high))
        for value, ties in shared.items():
            first, last = taken(low, value), taken(high, value)
            if first < last:
                within = F.col("_place") > first if last == math.inf else F.col("_place").between(first + 1, last)
                part = part.unionByName(ties.filter(within).drop("_place"))
        out.append(part)
    return out


def split_at(rows: DataFrame, n: int, *order: Column) -> tuple[DataFrame, DataFrame]:
    """The first n rows by ``order`` and the rest, as ``cut_at``."""
    first, rest = cut_at(rows, [n], *order)
    return first, rest


def _placed(ties: DataFrame, order: list[Column]) -> DataFrame:
    """Rows of one key with _place (from 1) by the other columns and their content; one task sorts them."""
    content = F.xxhash64(*[c for c, t in ties.dtypes if not t.startswith(("map", "variant"))])
    return ties.withColumn("_place", F.row_number().over(Window.orderBy(*order, content)))


def hash_key(text: Column) -> Column:
    """The first 60 bits of an md5 text as an integer of the same order."""
    return F.conv(F.substring(text, 1, 15), 16, 10).cast("bigint")
