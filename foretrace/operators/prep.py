"""Cleaning, limits, de-duplication, sampling and column statistics of sample tables."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foretrace.functions.parsing import END_TOKENS
from foretrace.operators import ranks
from foretrace.sources.scratch import stored

DROP, KEEP_NAN = "drop", "keep_nan"


def drop_end_labels(rows: DataFrame, label: str = "next", null_label: str = DROP) -> DataFrame:
    """Without rows labelled by an end token; null labels are dropped, or kept as the text nan."""
    value = F.col(label).cast("string")
    if null_label == KEEP_NAN:
        return rows.withColumn(label, F.coalesce(F.when(value.isin("", "None"), "nan").otherwise(value), F.lit("nan"))).filter(~F.col(label).isin(*END_TOKENS))
    return rows.withColumn(label, value).filter(value.isNotNull() & ~value.isin(*END_TOKENS))


def drop_invalid_sets(rows: DataFrame, activities: str = "unique_activities") -> DataFrame:
    """Without rows whose activities hold None."""
    return rows.filter(~F.exists(activities, lambda a: a.isNull() | (a == "None")))


def with_activities(rows: DataFrame, least: int, activities: str = "unique_activities") -> DataFrame:
    return rows.filter(F.size(activities) >= least)


def has_columns(rows: DataFrame, columns: Iterable[str]) -> bool:
    return set(columns) <= set(rows.columns)


def column_values(rows: DataFrame, column: str) -> DataFrame:
    if column not in rows.columns:
        raise ValueError(f"no column {column!r}")
    return rows.select(column)


def inverted(label: Column) -> Column:
    """0 for 1, 1 for anything else."""
    return F.when(label.cast("int") == 1, 0).otherwise(1)


#: A cut to so many rows is one ordered limit, whose last task holds them; beyond, the border's rank is selected.
SMALL_CUT = 10_000


def head(rows: DataFrame, n: int | None, order: str = "row_ord") -> DataFrame:
    """The first n rows by an integer order column; all for None."""
    if n is None:
        return rows
    return rows.orderBy(order).limit(n) if n <= SMALL_CUT else ranks.split_at(rows, n, F.col(order))[0]


def positional_split(rows: DataFrame, ratio: float = 0.8, order: str = "row_ord") -> tuple[DataFrame, DataFrame]:
    """The first int(n * ratio) rows by an integer order column, and the rest."""
    return ranks.split_at(rows, int(rows.count() * ratio), F.col(order))


def dedup_first(rows: DataFrame, columns: list[str], order: str = "row_ord") -> DataFrame:
    """The first row by the order column of each combination; minima are combined before the shuffle."""
    others = [c for c in rows.columns if c not in columns]
    first = F.min(F.struct(order, *[c for c in others if c != order])).alias("_first")
    return rows.groupBy(*columns).agg(first).select(*[F.col(c) if c in columns else F.col(f"_first.{c}") for c in rows.columns])


def oversampled(rows: DataFrame, label: str = "ds_labels", target: str = "False", factor: int = 2) -> DataFrame:
    """All rows and ``factor`` more copies of those with the target label."""
    copies = rows.filter(F.col(label) == target).crossJoin(F.broadcast(rows.sparkSession.range(factor).withColumnRenamed("id", "_copy"))).drop("_copy")
    return rows.unionByName(copies)


def sampled(rows: DataFrame, n: int, key: str, seed: int = 42, label: str | None = None, target: str = "True") -> DataFrame:
    """n rows (of the target label) in an order fixed by seed and key; all if there are fewer."""
    rows = rows if label is None else rows.filter(F.col(label) == target)
    order = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")))
    return rows.orderBy(order, key).limit(n) if n <= SMALL_CUT else ranks.split_at(rows, n, ranks.hash_key(order), order, F.col(key))[0]


def synthetic(rows: DataFrame, change: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Rows made from rows by a DataFrame function."""
    return rows.transform(change)


def reversed_prefix(rows: DataFrame, prefix: str = "prefix") -> DataFrame:
    return rows.withColumn(prefix, F.reverse(prefix)) if prefix in rows.columns else rows


def column_stats(rows: DataFrame, column: str) -> DataFrame:
    """(mean, median, min, max, std) of a numeric column; the median by selection of its rank."""
    held, c = stored(rows.select(F.col(column).alias("v")), "column"), F.col("v")
    median = ranks.percentiles(held, "v", [0.5])[0]
    return held.agg(F.avg(c).alias("mean"), F.lit(median).cast("double").alias("median"), F.min(c).alias("min"), F.max(c).alias("max"), F.stddev_samp(c).alias("std"))


def standardized(rows: DataFrame) -> DataFrame:
    """Distinct activities; a missing prefix or trace is an empty list."""
    empty = F.array().cast("array<string>")
    out = rows
    if "unique_activities" in rows.columns:
        out = out.withColumn("unique_activities", F.array_distinct("unique_activities"))
    for name in ("prefix", "trace"):
        out = out.withColumn(name, F.coalesce(F.col(name), empty) if name in rows.columns else empty)
    return out
