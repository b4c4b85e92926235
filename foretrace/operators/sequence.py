"""Next-activity models from traces: n-gram Markov with back-off, prefix continuations and their ensemble.

Models have a long form (a row per context and next activity) and a packed form (a row per context with a
map), which is the side that lookups join. Equal traces are collapsed to weighted variants before they are
exploded, so repeated traces cost one row. Prefixes are counted and looked up by the names of their trie nodes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foretrace.functions.parsing import col
from foretrace.operators import joins, trie
from foretrace.sources.scratch import stored

CANDIDATES = "array<struct<activity:string,score:double>>"
_NO_MAP = "map<string,double>"


@dataclass(frozen=True)
class EnsembleConfig:
    alpha: float = 0.5
    markov_order: int = 2
    min_count: int = 1
    top_k: int = 5

    def __post_init__(self):
        if not 0.0 <= self.alpha <= 1.0:
            raise ValueError("alpha must lie in [0, 1]")
        if self.markov_order < 1:
            raise ValueError("markov_order must be at least 1")


def variants(traced: DataFrame, trace: str = "trace") -> DataFrame:
    """(trace, w): distinct non-empty traces with their frequency."""
    return traced.filter(F.size(trace) > 0).groupBy(F.col(trace).alias("trace")).agg(F.count("*").alias("w"))


def vocabulary(traced: DataFrame) -> DataFrame:
    """(activity), sorted."""
    return traced.select(F.explode("trace").alias("activity")).distinct().orderBy("activity")


def markov_counts(weighted: DataFrame, order: int = 2) -> DataFrame:
    """(context, next, c) for contexts of 1 .. order activities; weighted: trace, w."""
    places = weighted.select("trace", "w", F.posexplode("trace").alias("i", "next"))
    sizes = F.filter(F.sequence(F.lit(1), F.lit(order)), lambda o: o <= F.col("i"))
    grams = places.select("trace", "w", "i", "next", F.explode(sizes).alias("o"))
    grams = grams.select(F.slice("trace", F.col("i") - F.col("o") + 1, F.col("o")).alias("context"), "next", "w")
    return grams.groupBy("context", "next").agg(F.sum("w").alias("c"))


def markov_model(weighted: DataFrame, order: int = 2, min_count: int = 1) -> DataFrame:
    """(context, next, c, prob): prob is over the context's unpruned total; counts under min_count are dropped."""
    total = F.sum("c").over(Window.partitionBy("context"))
    return markov_counts(weighted, order).withColumn("prob", F.col("c") / total).filter(F.col("c") >= min_count)


def packed(model: DataFrame, key: str, value: str = "prob") -> DataFrame:
    """(key, dist map<string,double>) of a long model."""
    return model.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct(F.col("next"), F.col(value).cast("double")))).alias("dist"))


def markov_backoff(prefixes: DataFrame, model: DataFrame, order: int = 2, broadcast_bytes: int | None = None) -> DataFrame:
    """``prefixes`` with ``markov``: the distribution of the longest known suffix of ``prefix``, null for none.

    A model under the bound is broadcast: a lookup for each suffix length, without a shuffle. Above it, all suffixes of
    a distinct prefix are dealt out at once by (suffix, length), short hot ones by salt, and folded back under the name
    of the prefix; what is shuffled are names, and the prefixes themselves once.
    """
    limit = joins.BROADCAST_BYTES if broadcast_bytes is None else broadcast_bytes
    model = stored(model.select(trie.node("context").alias("_suffix"), F.size("context").alias("_size"), F.col("dist").alias("_dist")).filter(F.col("_size") <= order), "contexts")
    lengths = range(order, 0, -1)
    if joins.stored_bytes(model) <= limit:
        out = prefixes
        for size in lengths:
            side = F.broadcast(model.filter(F.col("_size") == size).select("_suffix", F.col("_dist").alias(f"_m{size}")))
            out = out.withColumn("_own", F.when(F.size("prefix") >= size, trie.node(F.slice("prefix", -size, size)))).join(side, F.col("_own") == F.col("_suffix"), "left").drop("_own", "_suffix")
        found = [f"_m{size}" for size in lengths]
        return out.withColumn("markov", F.coalesce(*found)).drop(*found)
    sizes = F.filter(F.sequence(F.lit(1), F.lit(order)), lambda o: o <= F.size("prefix"))
    suffixes = prefixes.select(trie.node("prefix").alias("_node"), F.explode(F.transform(sizes, lambda o: F.struct(o.alias("_length"), trie.node(F.slice("prefix", -o, o)).alias("_own")))).alias("s")).select("_node", "s.*")
    met = joins.lookup(suffixes, model, {"_own": "_suffix", "_length": "_size"}, limit)
    folded = met.filter("_dist IS NOT NULL").groupBy("_node").agg(F.max_by("_dist", "_length").alias("markov"))
    return prefixes.withColumn("_own", trie.node("prefix")).join(folded, F.col("_own") == F.col("_node"), "left").drop("_own", "_node")


def prefix_nodes(weighted: DataFrame, wanted: DataFrame | None = None, longest: int | None = None) -> DataFrame:
    """(node, next, depth, c, trace_id): continuations of the nodes of the prefix trie, the root included; only of
    prefixes in ``wanted`` if given."""
    nodes = trie.continuations(weighted, longest)
    return nodes if wanted is None else nodes.join(wanted.select(trie.node("prefix").alias("node")).distinct(), "node", "left_semi")


def prefix_counts(weighted: DataFrame, wanted: DataFrame | None = None, longest: int | None = None) -> DataFrame:
    """(prefix, next, c) of ``prefix_nodes``."""
    return trie.named(prefix_nodes(weighted, wanted, longest).select("node", "next", "c", "depth", "trace_id"), weighted).select("prefix", "next", "c")


def prefix_topk(counts: DataFrame, k: int, min_count: int = 1, key: str = "node") -> DataFrame:
    """``counts`` (key, next, c) with prob: the k most frequent continuations; prob is within them."""
    best = Window.partitionBy(key).orderBy(F.desc("c"), "next")
    top = counts.filter(F.col("c") >= min_count).withColumn("place", F.row_number().over(best)).filter(F.col("place") <= k)
    return top.withColumn("prob", F.col("c") / F.sum("c").over(Window.partitionBy(key))).drop("place")


def prefix_lookup(prefixes: DataFrame, tops: DataFrame) -> DataFrame:
    """``prefixes`` with ``tree``: the packed continuations (node, dist) of exactly this prefix, null for none."""
    side = tops.select(F.col("node").alias("_node"), F.col("dist").alias("tree"))
    return prefixes.withColumn("_own", trie.node("prefix")).join(side, F.col("_own") == F.col("_node"), "left").drop("_node", "_own")


def by_score(candidates: Column) -> Column:
    """Sorted by score descending, then activity."""
    keyed = F.transform(candidates, lambda c: F.struct((-c["score"]).alias("k"), c["activity"].alias("activity"), c["score"].alias("score")))
    return F.transform(F.array_sort(keyed), lambda c: F.struct(c["activity"].alias("activity"), c["score"].alias("score")))


def reranked(candidates: Column) -> Column:
    """Sorted by score descending, keeping the previous order on ties."""
    keyed = F.transform(candidates, lambda c, i: F.struct((-c["score"]).alias("k"), i.alias("i"), c["activity"].alias("activity"), c["score"].alias("score")))
    return F.transform(F.array_sort(keyed), lambda c: F.struct(c["activity"].alias("activity"), c["score"].alias("score")))


def total_score(candidates: Column) -> Column:
    return F.aggregate(candidates, F.lit(0.0), lambda s, c: s + c["score"])


def _entries(dist: Column) -> Column:
    return F.transform(F.map_entries(dist), lambda e: F.struct(e["key"].alias("activity"), e["value"].alias("score")))


def _cut(candidates: Column, k: int) -> Column:
    """The best k, scaled to sum to 1 (left as they are if they sum to 0)."""
    top = F.slice(by_score(candidates), 1, k)
    total = total_score(top)
    return F.when(total > 0, F.transform(top, lambda c: F.struct(c["activity"].alias("activity"), (c["score"] / total).alias("score")))).otherwise(top)


def ensemble(markov: Column | str, tree: Column | str, alpha: float = 0.5, k: int = 5) -> Column:
    """Ranked candidates of alpha * markov + (1 - alpha) * tree, cut to k and scaled to 1.

    The tree side is already cut to k; if the sum is 0, markov alone counts, else the tree alone.
    """
    empty = F.create_map().cast(_NO_MAP)
    markov, tree = F.coalesce(col(markov), empty), F.coalesce(col(tree), empty)
    mixed = F.map_zip_with(markov, tree, lambda _, m, t: alpha * F.coalesce(m, F.lit(0.0)) + (1 - alpha) * F.coalesce(t, F.lit(0.0)))
    both = _entries(mixed)
    source = F.when(total_score(both) > 0, both).when(F.size(markov) > 0, _entries(markov)).otherwise(_entries(tree))
    return F.coalesce(_cut(source, k), F.array()).cast(CANDIDATES) if k > 0 else F.array().cast(CANDIDATES)


@dataclass(frozen=True)
class SequenceModel:
    """Packed Markov distributions and prefix continuations."""

    config: EnsembleConfig
    markov: DataFrame
    tree: DataFrame

    def candidates(self, prefixes: DataFrame) -> DataFrame:
        """``prefixes`` with ``cands``; looked up once per distinct prefix by the caller's choice of rows."""
        out = markov_backoff(prefixes, self.markov, self.config.markov_order)
        out = prefix_lookup(out, self.tree)
        return out.withColumn("cands", ensemble("markov", "tree", self.config.alpha, self.config.top_k)).drop("markov", "tree")


def fit(traced: DataFrame, config: EnsembleConfig = EnsembleConfig(), wanted: DataFrame | None = None) -> SequenceModel:
    """Both models from (trace); with ``wanted`` (prefix) only continuations of those prefixes are counted."""
    weighted = variants(traced)
    markov = packed(markov_model(weighted, config.markov_order, config.min_count), "context")
    tree = packed(prefix_topk(prefix_nodes(weighted, wanted), config.top_k, config.min_count), "node")
    return SequenceModel(config, markov, tree)
