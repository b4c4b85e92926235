"""Activity and pair priors, and mixing them into ranked candidates."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foretrace.functions.parsing import col, last, strip
from foretrace.operators import joins
from foretrace.operators.sequence import CANDIDATES, reranked
from foretrace.sources.scratch import stored


@dataclass(frozen=True)
class PriorConfig:
    mode: str = "pair"
    default_weight: float = 1.0
    floor: float = 0.7
    ceil: float = 1.3
    lambda_mix: float = 0.2
    enabled: bool = True

    @property
    def share(self) -> float:
        return min(max(self.lambda_mix, 0.0), 1.0)

    @property
    def top(self) -> float:
        return max(self.ceil, self.floor)


def activity_prior(rows: DataFrame) -> DataFrame:
    """(activity, w): relative frequency of the trimmed, non-blank ``next``."""
    counted = rows.select(strip("next").alias("activity")).filter("activity <> ''").groupBy("activity").agg(F.count("*").alias("c"))
    return counted.crossJoin(F.broadcast(counted.agg(F.sum("c").alias("_n")))).select("activity", (F.col("c") / F.col("_n")).alias("w"))


def pair_prior(rows: DataFrame, min_pair_count: int = 1) -> DataFrame:
    """(prev, next, c, w): w is normalised per prev after pairs under min_pair_count are dropped."""
    named = rows.select(strip(last(F.filter("prefix", lambda t: t.isNotNull() & (F.length(strip(t)) > 0)))).alias("prev"), strip("next").alias("next"))
    counted = named.filter("prev <> '' AND next <> ''").groupBy("prev", "next").agg(F.count("*").alias("c")).filter(F.col("c") >= min_pair_count)
    return counted.withColumn("w", F.col("c") / F.sum("c").over(Window.partitionBy("prev")))


def packed_pairs(prior: DataFrame) -> DataFrame:
    """(prev, dests map<string,double>)."""
    return prior.groupBy("prev").agg(F.map_from_entries(F.collect_list(F.struct("next", "w"))).alias("dests"))


def with_pairs(cases: DataFrame, packed: DataFrame, prev: str = "prev") -> DataFrame:
    return joins.lookup(cases, packed, {prev: "prev"})


def with_activity_map(cases: DataFrame, prior: DataFrame, broadcast_bytes: int | None = None) -> DataFrame:
    """``cases`` with ``acts``: the activity prior as one map if it is small enough to be broadcast, else a map of the
    row's own candidates (``cands``), looked up one by one."""
    held = stored(prior.select("activity", "w"), "activity-prior")
    if joins.stored_bytes(held) <= (joins.BROADCAST_BYTES if broadcast_bytes is None else broadcast_bytes):
        return cases.crossJoin(F.broadcast(held.agg(F.map_from_entries(F.collect_list(F.struct("activity", "w"))).alias("acts"))))
    rows = stored(cases.withColumn("_row", F.monotonically_increasing_id()), "cases")
    labels = F.array_distinct(F.transform("cands", lambda c: c["activity"]))
    weights = joins.lookup(rows.select("_row", F.explode(labels).alias("_label")), held, {"_label": "activity"}, 0).filter("w IS NOT NULL")
    maps = weights.groupBy("_row").agg(F.map_from_entries(F.collect_list(F.struct("_label", "w"))).alias("acts"))
    return rows.join(maps, "_row", "left").drop("_row")


def _clamped(weight: Column, config: PriorConfig) -> Column:
    return F.least(F.greatest(weight, F.lit(config.floor)), F.lit(config.top))


def _shares(weights: Column) -> Column:
    total = F.aggregate(weights, F.lit(0.0), lambda s, w: s + w)
    return F.transform(weights, lambda w: w / F.when(total == 0, 1.0).otherwise(total))


def softmax(scores: Column) -> Column:
    raised = F.transform(scores, lambda s: F.exp(s - F.array_max(scores)))
    return _shares(raised)


def _weights(labels: Column, table: Column, config: PriorConfig) -> Column:
    table = F.coalesce(table, F.create_map().cast("map<string,double>"))
    return _shares(F.transform(labels, lambda a: _clamped(F.coalesce(F.element_at(table, a), F.lit(config.default_weight)), config)))


def mix(cands: Column | str, config: PriorConfig = PriorConfig(), pairs: Column | str | None = None, activities: Column | str | None = None, provided: Column | str | None = None) -> Column:
    """Candidates of (1 - lambda) * softmax(score) + lambda * prior, ranked again.

    pairs: weights of the last activity's followers; activities: weights by name; provided: weights of a
    caller's own (a map column or an Arrow UDF's result), used unclamped where they hold anything.
    """
    cands = col(cands)
    if not config.enabled:
        return cands
    none = F.lit(None).cast("map<string,double>")
    labels = F.transform(cands, lambda c: c["activity"])
    pair = _weights(labels, none if pairs is None else col(pairs), config)
    act = _weights(labels, none if activities is None else col(activities), config)
    prior = {"pair": pair, "hybrid": F.zip_with(pair, act, lambda p, a: 0.5 * p + 0.5 * a)}.get(config.mode, act)
    if provided is not None:
        given = _shares(F.transform(labels, lambda a: F.coalesce(F.element_at(col(provided), a), F.lit(config.default_weight))))
        prior = F.when(F.coalesce(F.size(col(provided)), F.lit(0)) > 0, given).otherwise(prior)
    seq = softmax(F.transform(cands, lambda c: c["score"]))
    final = F.zip_with(seq, prior, lambda s, p: (1 - config.share) * s + config.share * p)
    moved = F.zip_with(labels, final, lambda a, s: F.struct(a.alias("activity"), s.alias("score")))
    return F.when(F.size(cands) > 0, reranked(moved)).otherwise(cands).cast(CANDIDATES)


def provider(weights: Callable[[list[str]], dict | None]) -> Callable:
    """A column function of prefixes from a user's plain function of one prefix: Arrow batches, and a row whose call
    raises, or gives no mapping of texts to finite numbers, is null, so that the configured prior counts there."""

    def safe(prefix) -> dict | None:
        try:
            found = weights([str(a) for a in prefix])
            out = {str(a): float(w) for a, w in found.items()} if found else {}
        except Exception:  # the user's own code: anything may go wrong in one row
            return None
        return out if out and all(math.isfinite(w) for w in out.values()) else None

    @F.pandas_udf("map<string,double>")
    def run(prefix: pd.Series) -> pd.Series:
        return pd.Series([None if p is None else safe(p) for p in prefix], dtype=object)

    return run


def write_json(prior: DataFrame, path: str) -> None:
    """One JSON object {prev: {next: w}}; for priors of activity pairs, which are small."""
    one = prior.groupBy("prev").agg(F.map_from_entries(F.collect_list(F.struct("next", "w"))).alias("d")).agg(F.map_from_entries(F.collect_list(F.struct("prev", "d"))).alias("m"))
    one.select(F.to_json("m").alias("value")).coalesce(1).write.mode("overwrite").text(path)


def read_json(spark, path: str) -> DataFrame:
    """(prev, next, w) of a file of ``write_json``."""
    parsed = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,map<string,double>>")).alias("prev", "d"))
    return parsed.select("prev", F.explode("d").alias("next", "w"))
