"""Guards that learn valid activity pairs and penalise or drop candidates outside them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foretrace.functions.parsing import col, parse_list
from foretrace.operators import joins
from foretrace.operators.sequence import CANDIDATES, reranked


@dataclass(frozen=True)
class GuardConfig:
    mode: str = "soft"
    penalty_factor: float = 0.5
    min_prefix_len: int = 1
    keep_unseen: bool = True
    min_count: int = 1
    min_ratio: float = 0.0
    threshold: float = 0.5
    enabled: bool = True


def truth(label: Column | str, kind: str = "string") -> Column:
    """1 for 1, true or yes in any case (text), or for a true or non-zero value."""
    label = col(label)
    yes = F.lower(label).isin("1", "true", "yes") if kind == "string" else label.cast("boolean")
    return F.coalesce(yes, F.lit(False)).cast("int")


def labelled_pairs(rows: DataFrame) -> DataFrame:
    """(prev, next, tot, pos) from rows of prev, next, label."""
    y = truth("label", dict(rows.dtypes)["label"])
    return rows.select(F.col("prev").cast("string").alias("prev"), F.col("next").cast("string").alias("next"), y.alias("y")).groupBy("prev", "next").agg(F.count("*").alias("tot"), F.sum("y").alias("pos"))


def invariant_pairs(rows: DataFrame) -> DataFrame:
    """(prev, next, tot, pos) from rows of eventually_follows (a literal), instruction_type, is_valid."""
    valid = F.coalesce(F.col("is_valid").cast("boolean"), F.lit(True)) if "is_valid" in rows.columns else F.lit(True)
    literal = F.col("eventually_follows").rlike(r"^\s*[\[(]")
    kept = rows.filter(F.col("instruction_type").isin("pos_inv", "neg_inv") & valid & literal)
    pairs = kept.select(parse_list("eventually_follows").alias("p"), (F.col("instruction_type") == "pos_inv").cast("int").alias("y")).filter(F.size("p") >= 2)
    return pairs.select(F.col("p")[0].alias("prev"), F.col("p")[1].alias("next"), "y").groupBy("prev", "next").agg(F.count("*").alias("tot"), F.sum("y").alias("pos"))


def pairs_of(rows: DataFrame) -> DataFrame | None:
    """Pair counts by the columns present; None where they fit neither form."""
    if {"prev", "next", "label"} <= set(rows.columns):
        return labelled_pairs(rows)
    return invariant_pairs(rows) if "eventually_follows" in rows.columns else None


def allowed(pairs: DataFrame, config: GuardConfig = GuardConfig()) -> DataFrame:
    """(prev, next, score, prev_total): pairs frequent enough of which enough are positive."""
    counted = pairs.withColumn("prev_total", F.sum("tot").over(Window.partitionBy("prev"))).withColumn("score", F.col("pos") / F.col("tot"))
    good = (F.col("tot") >= config.min_count) & (F.col("tot") / F.col("prev_total") >= config.min_ratio) & (F.col("score") >= config.threshold)
    return counted.filter(good).select("prev", "next", "score", "prev_total")


def packed(pairs: DataFrame) -> DataFrame:
    """(prev, followers array<string>)."""
    return pairs.groupBy("prev").agg(F.array_sort(F.collect_set("next")).alias("followers"))


def with_followers(cases: DataFrame, packed_pairs: DataFrame, prev: str = "prev") -> DataFrame:
    return joins.lookup(cases, packed_pairs, {prev: "prev"})


def check(pairs: DataFrame, valid: DataFrame, keep_unseen: bool = True) -> DataFrame:
    """``pairs`` (prev, cand) with ok: no prev, an allowed pair, or keep_unseen."""
    out = joins.lookup(pairs, valid.select("prev", "next", F.lit(True).alias("_ok")), {"prev": "prev", "cand": "next"})
    return out.withColumn("ok", F.col("prev").isNull() | F.coalesce("_ok", F.lit(keep_unseen))).drop("_ok")


def apply(cands: Column | str, followers: Column | str, prefix: Column | str, config: GuardConfig = GuardConfig()) -> tuple[Column, Column]:
    """(candidates, blocked activities): soft scales blocked scores, hard drops them, other modes change nothing."""
    cands, prefix = col(cands), col(prefix)
    none = F.array().cast("array<string>")
    followers = F.coalesce(col(followers), none)
    if not config.enabled:
        return cands, none
    used = (F.size(prefix) >= config.min_prefix_len) & (F.size(cands) > 0)
    barred = lambda c: (F.size(prefix) > 0) & ~F.array_contains(followers, c["activity"]) & F.lit(not config.keep_unseen)
    blocked = F.transform(F.filter(cands, barred), lambda c: c["activity"])
    moved = cands
    if config.mode == "hard":
        moved = F.filter(cands, lambda c: ~barred(c))
    elif config.mode == "soft":
        moved = F.transform(cands, lambda c: F.struct(c["activity"].alias("activity"), (c["score"] * F.when(barred(c), config.penalty_factor).otherwise(1.0)).alias("score")))
    return F.when(used, reranked(moved)).otherwise(cands).cast(CANDIDATES), F.when(used, blocked).otherwise(none)
