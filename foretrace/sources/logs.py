"""Event logs, traces and next-activity samples from tables of timed rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_log(rows: DataFrame, case: Column, activity: Column, order: list[str]) -> DataFrame:
    """(case_id, activity, at): at is the order key of an event within its case."""
    return rows.select(case.cast("string").alias("case_id"), activity.cast("string").alias("activity"), F.struct(*order).alias("at")).filter("case_id IS NOT NULL AND activity IS NOT NULL")


def traces(log: DataFrame) -> DataFrame:
    """(case_id, trace); one shuffle by case."""
    ordered = F.array_sort(F.collect_list(F.struct("at", "activity")))
    return log.groupBy("case_id").agg(F.transform(ordered, lambda e: e["activity"]).alias("trace"))


def samples(traced: DataFrame, shortest: int = 2) -> DataFrame:
    """(case_id, pos, prefix, next, unique_activities) for every position from ``shortest`` on."""
    places = F.sequence(F.lit(shortest), F.size("trace"))
    longer = traced.filter(F.size("trace") >= shortest).withColumn("unique_activities", F.array_sort(F.array_distinct("trace")))
    exploded = longer.select("case_id", "trace", "unique_activities", F.explode(places).alias("pos"))
    return exploded.select("case_id", "pos", F.slice("trace", 1, F.col("pos") - 1).alias("prefix"), F.element_at("trace", F.col("pos")).alias("next"), "unique_activities")


def orders_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return event_log(orders, F.col("o_custkey"), F.col("o_orderpriority"), ["o_orderdate", "o_orderkey"])


def events_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases are a user's days; with model_id (user) and revision_id (day)."""
    events = table(spark, sf_dir, "events")
    case = F.concat_ws("_", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd"))
    return event_log(events, case, F.col("event_type"), ["ts", "event_id"])


def events_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_log(table(spark, sf_dir, "events"), F.col("user_id"), F.col("event_type"), ["ts", "event_id"])
