"""Ranking, classification, explanation and latency metrics as one-row aggregates.

predictions: case_id, y_true, y_pred, ranked array<string>, latency_ms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foretrace.functions.text import tokens
from foretrace.operators import ranks
from foretrace.sources.scratch import stored


def place(ranked: str = "ranked", truth: str = "y_true") -> Column:
    """The truth's place from 1; 0 for a miss."""
    return F.coalesce(F.array_position(ranked, F.col(truth)), F.lit(0))


def _mean(value: Column) -> Column:
    return F.coalesce(F.avg(value.cast("double")), F.lit(0.0))


def _reciprocal(at: Column | None = None) -> Column:
    at = F.col("place") if at is None else at
    return F.when(at > 0, 1 / at).otherwise(0.0)


def _gain(k: int, at: Column | None = None) -> Column:
    at = F.col("place") if at is None else at
    return F.when(at.between(1, k), 1 / F.log2(at + 1)).otherwise(0.0)


def _within(k: int, at: Column | None = None) -> Column:
    return (F.col("place") if at is None else at).between(1, k)


def accuracy() -> Column:
    return _mean(F.col("y_true").eqNullSafe(F.col("y_pred")))


def mrr() -> Column:
    return _mean(_reciprocal(place()))


def ndcg(k: int) -> Column:
    return _mean(_gain(k, place()))


def accuracy_at(k: int) -> Column:
    return _mean(_within(k, place()))


def f1_by_label(predictions: DataFrame) -> DataFrame:
    """(label, tp, fp, fn, precision, recall, f1) over the labels of truth and prediction; a null prediction is
    a miss of its truth and no label. Pairs are counted first, so at most labels squared rows are exploded."""
    return _by_label(predictions.groupBy("y_true", "y_pred").agg(F.count("*").alias("n")))


def _by_label(counted: DataFrame) -> DataFrame:
    """The same from counts n of (y_true, y_pred)."""
    hit = F.col("y_true").eqNullSafe(F.col("y_pred"))
    cells = F.array(
        F.struct(F.col("y_true").alias("label"), F.when(hit, F.col("n")).otherwise(0).alias("tp"), F.lit(0).cast("bigint").alias("fp"), F.when(hit, 0).otherwise(F.col("n")).alias("fn")),
        F.struct(F.col("y_pred").alias("label"), F.lit(0).cast("bigint").alias("tp"), F.when(hit, 0).otherwise(F.col("n")).alias("fp"), F.lit(0).cast("bigint").alias("fn")),
    )
    summed = counted.select(F.inline(cells)).filter("label IS NOT NULL").groupBy("label").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    out = summed.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    return out.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def _macro(counted: DataFrame) -> DataFrame:
    return _by_label(counted).agg(F.coalesce(F.avg("f1"), F.lit(0.0)).alias("macro_f1"))


def macro_f1(predictions: DataFrame) -> DataFrame:
    return _macro(predictions.groupBy("y_true", "y_pred").agg(F.count("*").alias("n")))


def _cells(predictions: DataFrame) -> DataFrame:
    """(y_true, y_pred, place, n): all that the ranking and classification metrics depend on, counted."""
    return predictions.groupBy("y_true", "y_pred", (place() if "place" not in predictions.columns else F.col("place")).alias("place")).agg(F.count("*").alias("n"))


def _shared(value: Column) -> Column:
    """The mean of a value of the cells over the rows they count."""
    return F.coalesce(F.sum(value.cast("double") * F.col("n")) / F.sum("n"), F.lit(0.0))


def at_k(predictions: DataFrame, ks: tuple[int, ...] = (1, 5)) -> DataFrame:
    """Accuracy and NDCG at each k, MRR and macro-F1 in one row."""
    cells = stored(_cells(predictions), "cells")
    totals = {name: c for k in ks for name, c in ((f"acc_at_{k}", _shared(_within(k))), (f"ndcg_at_{k}", _shared(_gain(k))))}
    return cells.agg(*[c.alias(name) for name, c in totals.items()], _shared(_reciprocal()).alias("mrr")).crossJoin(_macro(cells))


LATENCY_SHARES = {"p50_ms": 0.5, "p90_ms": 0.9, "p95_ms": 0.95}


def latency_columns(latency: str = "latency_ms", accuracy: int | None = None) -> list[Column]:
    """Aggregates of a group: exact percentiles keep the group's distinct values in a buffer; with an accuracy
    they are approximate, of a rank within n / accuracy, and the buffer is bounded by it."""
    shares = F.array(*[F.lit(p) for p in LATENCY_SHARES.values()])
    spread = F.percentile(F.col(latency), shares) if accuracy is None else F.percentile_approx(F.col(latency), shares, F.lit(accuracy))
    return [F.avg(latency).alias("avg_ms"), *[spread[i].alias(name) for i, name in enumerate(LATENCY_SHARES)]]


def latency_stats(rows: DataFrame, latency: str = "latency_ms", accuracy: int | None = None) -> DataFrame:
    """Mean and percentiles of all rows in one row; exact ones by selection of their ranks, without a buffer that grows."""
    if accuracy is not None:
        return rows.agg(*latency_columns(latency, accuracy))
    held = stored(rows.select(F.col(latency).alias("v")), "latency")
    found = dict(zip(LATENCY_SHARES, ranks.percentiles(held, "v", list(LATENCY_SHARES.values())), strict=True))
    return held.agg(F.avg("v").alias("avg_ms"), *[F.lit(v).cast("double").alias(name) for name, v in found.items()])


def cost_performance(metric: Column, average_ms: Column) -> Column:
    """Metric per average second; null without a latency."""
    return F.when(average_ms > 0, metric / (average_ms / 1000))


def cpr_by_model(costs: DataFrame, metrics: DataFrame) -> DataFrame:
    """(model, cpr): performance (0 if missing) over latency + memory."""
    return costs.join(metrics, "model", "left").select("model", (F.coalesce("performance", F.lit(0.0)) / (F.col("latency") + F.col("memory"))).alias("cpr"))


def overlap(text: str = "explanation_text", gold: str = "gold_explanation") -> Column:
    """struct<precision, recall, f1> of the token sets; null where the gold is blank or a side has no tokens."""
    said, meant = F.array_distinct(tokens(text)), F.array_distinct(tokens(gold))
    common = F.size(F.array_intersect(said, meant))
    p, r = common / F.size(said), common / F.size(meant)
    f1 = F.when(common > 0, 2 * p * r / (p + r)).otherwise(0.0)
    fits = F.col(gold).isNotNull() & (F.size(said) > 0) & (F.size(meant) > 0)
    return F.when(fits, F.struct(p.alias("precision"), r.alias("recall"), f1.alias("f1")))


def token_overlap(records: DataFrame) -> DataFrame:
    scored = records.select(overlap().alias("o"))
    return scored.agg(*[F.coalesce(F.avg(f"o.{c}"), F.lit(0.0)).alias(f"overlap_{c}") for c in ("precision", "recall", "f1")])


def consistency(pairs: DataFrame, a: str = "y_pred_no_explain", b: str = "y_pred_with_explain") -> DataFrame:
    return pairs.agg(_mean(F.col(a).eqNullSafe(F.col(b))).alias("consistency"))


def explain_summary(records: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """All explanation metrics in one row; consistency only with pairs."""
    out = records.withColumn("o", overlap()).agg(
        _mean(F.coalesce(F.col("reason_pass_local"), F.lit(False))).alias("reason_pass_rate"),
        _mean(F.coalesce(F.length("explanation_text"), F.lit(0))).alias("avg_length"),
        F.coalesce(F.avg("human_score"), F.lit(0.0)).alias("usefulness"),
        *[F.coalesce(F.avg(f"o.{c}"), F.lit(0.0)).alias(f"overlap_{c}") for c in ("precision", "recall", "f1")],
    )
    return out if pairs is None else out.crossJoin(consistency(pairs))


def report(predictions: DataFrame, ndcg_k: int = 5) -> DataFrame:
    """The run's record: accuracy, macro-F1, MRR, NDCG, latency and cost-performance.

    Predictions are made once and kept by truth, prediction, place and latency; metrics come from the counts of their
    cells, latency from its own aggregate.
    """
    kept = stored(predictions.select("y_true", "y_pred", place().cast("int").alias("place"), "latency_ms"), "predictions")
    cells = _cells(kept)
    hit = F.col("y_true").eqNullSafe(F.col("y_pred"))
    totals = cells.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_samples"), _shared(hit).alias("accuracy"), _shared(_reciprocal()).alias("mrr"), _shared(_gain(ndcg_k)).alias("ndcg"))
    out = totals.crossJoin(latency_stats(kept)).crossJoin(_macro(cells))
    return out.withColumn("cpr", cost_performance(F.col("macro_f1"), F.col("avg_ms")))
