"""Directly-follows graphs, and re-ranking of candidates by their edges."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foretrace.functions.parsing import col
from foretrace.operators import joins
from foretrace.operators.sequence import CANDIDATES, reranked


@dataclass(frozen=True)
class RerankConfig:
    """The defaults of the evaluation run; a class default of a hard mask and boost 1.0 is RerankConfig(True, 1.0)."""

    hard_mask: bool = False
    boost_factor: float = 0.5
    min_prob_keep: float = 0.0
    enabled: bool = True


def edges(weighted: DataFrame, min_count: int = 1, min_ratio: float = 0.0) -> DataFrame:
    """(src, dst, cnt, prob): prob is over the source's unpruned total; weighted: trace, w."""
    n = F.size("trace")
    pairs = F.zip_with(F.slice("trace", 1, n - 1), F.slice("trace", 2, n - 1), lambda a, b: F.struct(a.alias("src"), b.alias("dst")))
    counted = weighted.filter(n > 1).select("w", F.inline(pairs)).groupBy("src", "dst").agg(F.sum("w").alias("cnt"))
    prob = F.col("cnt") / F.sum("cnt").over(Window.partitionBy("src"))
    return counted.withColumn("prob", prob).filter((F.col("cnt") >= min_count) & (F.col("prob") >= min_ratio))


def outgoing(graph: DataFrame) -> DataFrame:
    """(src, out map<string,double>)."""
    return graph.groupBy("src").agg(F.map_from_entries(F.collect_list(F.struct("dst", "prob"))).alias("out"))


def edge_lookup(pairs: DataFrame, graph: DataFrame) -> DataFrame:
    """``pairs`` (a, b) with prob (0 for no edge) and allowed (an edge, or a is null)."""
    out = joins.lookup(pairs, graph.select("src", "dst", F.col("prob").alias("_p")), {"a": "src", "b": "dst"})
    return out.withColumn("prob", F.coalesce("_p", F.lit(0.0))).withColumn("allowed", F.col("_p").isNotNull() | F.col("a").isNull()).drop("_p")


def with_outgoing(cases: DataFrame, packed_graph: DataFrame, prev: str = "prev") -> DataFrame:
    """``cases`` with ``out`` of their last activity; the graph has at most a row per activity."""
    return joins.lookup(cases, packed_graph, {prev: "src"})


def _prob(out: Column, activity: Column) -> Column:
    return F.coalesce(F.element_at(out, activity), F.lit(0.0))


def rerank(cands: Column | str, out: Column | str, config: RerankConfig = RerankConfig()) -> tuple[Column, Column, Column]:
    """(candidates, dropped activities, boosted map): adds boost * prob; a hard mask drops weak edges first."""
    cands = col(cands)
    out = F.coalesce(col(out), F.create_map().cast("map<string,double>"))
    none = F.array().cast("array<string>")
    if not config.enabled:
        return cands, none, F.create_map().cast("map<string,double>")
    kept, dropped = cands, none
    if config.hard_mask:
        weak = lambda c: _prob(out, c["activity"]) < config.min_prob_keep
        kept = F.filter(cands, lambda c: ~weak(c))
        dropped = F.transform(F.filter(cands, weak), lambda c: c["activity"])
    gain = lambda c: config.boost_factor * _prob(out, c["activity"])
    moved = F.transform(kept, lambda c: F.struct(c["activity"].alias("activity"), (c["score"] + gain(c)).alias("score")))
    raised = F.filter(kept, lambda c: gain(c) != 0)
    boosted = F.map_from_entries(F.transform(raised, lambda c: F.struct(c["activity"], gain(c))))
    return reranked(moved).cast(CANDIDATES), dropped, boosted


def prior_reweight(cands: Column | str, out: Column | str, prev: Column | str, hard_mask: bool = True, boost: float = 0.3) -> tuple[Column, Column, Column]:
    """(candidates, dropped, hard_mask_triggered): the mask needs an edge; with none left the input stays."""
    cands, prev = col(cands), col(prev)
    out = F.coalesce(col(out), F.create_map().cast("map<string,double>"))
    barred = lambda c: F.lit(hard_mask) & prev.isNotNull() & ~F.map_contains_key(out, c["activity"])
    kept = F.filter(cands, lambda c: ~barred(c))
    dropped = F.transform(F.filter(cands, barred), lambda c: c["activity"])
    moved = F.transform(kept, lambda c: F.struct(c["activity"].alias("activity"), (c["score"] + boost * _prob(out, c["activity"])).alias("score")))
    empty = F.size(kept) == 0
    return F.when(empty, cands).otherwise(reranked(moved)).cast(CANDIDATES), dropped, empty
