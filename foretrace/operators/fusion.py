"""Fusing candidates' log-probabilities of an outside model into the ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foretrace.functions.parsing import col


def logprob_maps(logprobs: DataFrame) -> DataFrame:
    """(case_id, norm map, best): log-probabilities scaled to [0, 1] per case, and the candidate of the highest."""
    case = Window.partitionBy("case_id")
    low, high = F.min("logprob").over(case), F.max("logprob").over(case)
    scaled = logprobs.withColumn("norm", F.when(high > low, (F.col("logprob") - low) / (high - low)).otherwise(0.0))
    return scaled.groupBy("case_id").agg(F.map_from_entries(F.collect_list(F.struct("candidate", "norm"))).alias("norm"), F.max_by("candidate", F.struct("logprob", -F.col("rank"))).alias("best"))


def fused(cands: Column | str, norm: Column | str, share: float) -> tuple[Column, Column]:
    """(prediction, fused scores in rank order): the first of the highest score + share * norm.

    Without log-probabilities or with a share of 0, the first candidate.
    """
    cands, norm = col(cands), col(norm)
    table = F.coalesce(norm, F.create_map().cast("map<string,double>"))
    scores = F.transform(cands, lambda c: c["score"] + share * F.coalesce(F.element_at(table, c["activity"]), F.lit(0.0)))
    best = F.get(cands, (F.array_position(scores, F.array_max(scores)) - 1).cast("int"))["activity"]
    first = F.get(cands, F.lit(0))["activity"]
    return F.when(F.lit(share > 0) & (F.size(table) > 0), best).otherwise(first), scores
