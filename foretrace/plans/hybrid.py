"""The full next-activity pipeline: sequence ensemble, graph, prior, guard and log-probability fusion.

Models are fitted on packed keys; each distinct prefix is scored once, and everything that depends on the
last activity arrives in one measured lookup, without a shuffle of the cases while the models are small.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foretrace.functions.parsing import last
from foretrace.operators import fusion, graph, guard, joins, priors, sequence
from foretrace.operators.graph import RerankConfig
from foretrace.operators.guard import GuardConfig
from foretrace.operators.priors import PriorConfig
from foretrace.operators.sequence import EnsembleConfig


@dataclass(frozen=True)
class HybridConfig:
    sequence: EnsembleConfig = field(default_factory=EnsembleConfig)
    graph: RerankConfig = field(default_factory=RerankConfig)
    prior: PriorConfig = field(default_factory=PriorConfig)
    guard: GuardConfig = field(default_factory=GuardConfig)
    logprob_share: float = 0.0


@dataclass(frozen=True)
class HybridModel:
    config: HybridConfig
    sequence: sequence.SequenceModel
    by_prev: DataFrame  # _prev, out, dests, followers

    def score(self, prefixes: DataFrame, logprobs: DataFrame | None = None) -> DataFrame:
        """``prefixes`` (prefix; case_id with logprobs) with y_pred, cands, graph_dropped and guard_blocked."""
        c = self.config
        out = self.sequence.candidates(prefixes).withColumn("_last", last("prefix"))
        out = joins.lookup(out, self.by_prev, {"_last": "_prev"})
        moved, dropped, _ = graph.rerank("cands", "out", c.graph)
        out = out.withColumns({"cands": moved, "graph_dropped": dropped})
        out = out.withColumn("cands", priors.mix("cands", c.prior, pairs="dests"))
        moved, blocked = guard.apply("cands", "followers", "prefix", c.guard)
        out = out.withColumns({"cands": moved, "guard_blocked": blocked}).drop("_last", "out", "dests", "followers")
        if logprobs is None:
            return out.withColumn("y_pred", F.get("cands", F.lit(0))["activity"])
        maps = fusion.logprob_maps(logprobs)
        label, scores = fusion.fused("cands", "norm", c.logprob_share)
        return out.join(maps, "case_id", "left").withColumns({"y_pred": label, "fused_scores": scores}).drop("norm", "best")

    def predict(self, cases: DataFrame) -> DataFrame:
        """``cases`` with the prediction of their prefix, each distinct prefix scored once."""
        scored = self.score(cases.select("prefix").distinct())
        return cases.join(scored, "prefix").withColumn("ranked", F.transform("cands", lambda x: x["activity"]))


def fit(traced: DataFrame, pair_rows: DataFrame, guard_pairs: DataFrame | None = None, config: HybridConfig = HybridConfig(), wanted: DataFrame | None = None) -> HybridModel:
    """From traces, (prefix, next) rows for the prior, and counted guard pairs."""
    weighted = sequence.variants(traced)
    model = sequence.fit(traced, config.sequence, wanted)
    side = graph.outgoing(graph.edges(weighted)).withColumnRenamed("src", "_prev")
    side = side.join(priors.packed_pairs(priors.pair_prior(pair_rows)).withColumnRenamed("prev", "_prev"), "_prev", "full")
    if guard_pairs is None:
        side = side.withColumn("followers", F.lit(None).cast("array<string>"))
    else:
        side = side.join(guard.packed(guard.allowed(guard_pairs, config.guard)).withColumnRenamed("prev", "_prev"), "_prev", "full")
    return HybridModel(config, model, side)
