"""Reading and writing of sample, instruction, evaluation and split tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foretrace.functions.parsing import parse_prefix, resolve_columns, strip, with_lists
from foretrace.operators import prep
from foretrace.sources.scratch import stored

SNAP, INSTRUCTIONS = "S-NAP", "S-NAP_instructions"
NEXT_ACTIVITY = "next_activity"


def spans_lines(spark: SparkSession, path: str) -> bool:
    """Whether a quoted cell may hold a line break: some line then has an odd number of quotes."""
    quotes = F.length(F.regexp_replace("value", '[^"]', ""))
    return not spark.read.text(path).filter(quotes % 2 == 1).isEmpty()


def read_csv(spark: SparkSession, path: str, multi_line: bool | None = None) -> DataFrame:
    """All columns as text, with a row_ord column: the file's own, or else the rows' place by file name and position.

    Files are read in splits unless a quoted cell holds a line break, which one pass over the lines tells
    (``multi_line`` says it beforehand); then each file is one task's. Rows that are numbered here are stored once.
    """
    multi_line = spans_lines(spark, path) if multi_line is None else multi_line
    rows = spark.read.csv(path, header=True, inferSchema=False, multiLine=multi_line, quote='"', escape='"', enforceSchema=False)
    if "row_ord" in rows.columns:
        return rows.withColumn("row_ord", F.col("row_ord").cast("bigint"))
    spot = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start")]
    rows = stored(rows.select("*", *spot, F.monotonically_increasing_id().alias("_at")), "csv")
    # A split is read by one task in its order; there are as many rows here as splits of files.
    parts = rows.groupBy("_file", "_start").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = Window.orderBy("_file", "_start").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    return rows.join(parts, ["_file", "_start"]).withColumn("row_ord", F.col("_before") + F.col("_at") - F.col("_first")).drop("_file", "_start", "_at", "_n", "_first", "_before")


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.csv(path, header=True, quote='"', escape='"', mode="overwrite")


def load_snap(spark: SparkSession, path: str, limit: int | None = None, drop_end: bool = True, null_label: str = prep.DROP) -> DataFrame:
    """Parsed rows without end labels and invalid sets; the first ``limit`` of those."""
    rows = resolve_columns(read_csv(spark, path), "unique_activities", "prefix", "next", "model_id", "revision_id")
    rows = with_lists(rows, "unique_activities", "prefix")
    if drop_end:
        rows = prep.drop_end_labels(rows, null_label=null_label)
    return prep.head(prep.drop_invalid_sets(rows), limit)


def load_instructions(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Rows with parsed activities and text instruction and output; the first ``limit``."""
    rows = resolve_columns(read_csv(spark, path), "unique_activities", "prefix", "next", "model_id", "revision_id")
    return prep.head(with_lists(rows, "unique_activities"), limit)


def load_data(spark: SparkSession, path: str, data_type: str = SNAP, limit: int | None = None, drop_end: bool = True) -> DataFrame:
    if data_type == SNAP:
        return load_snap(spark, path, limit, drop_end)
    if data_type == INSTRUCTIONS:
        return load_instructions(spark, path, limit)
    raise ValueError(f"data_type must be {SNAP!r} or {INSTRUCTIONS!r}")


def load_task(spark: SparkSession, task: str, path: str, limit: int | None = None, drop_end: bool = True, invert_labels: bool = False, min_activities: int = 1, split_path: str | None = None) -> DataFrame:
    """Rows for a task; the limit comes before the least number of activities. With ``split_path`` (a saved split
    table) only rows of a group in it, with their split."""
    from foretrace.functions.parsing import group_id
    from foretrace.operators import splits

    if task != NEXT_ACTIVITY:
        raise ValueError(f"only {NEXT_ACTIVITY!r} is supported")
    rows = prep.with_activities(load_snap(spark, path, limit, drop_end), min_activities)
    if invert_labels and "label" in rows.columns:
        rows = rows.withColumn("label", prep.inverted(F.col("label")))
    if split_path is None:
        return rows
    return splits.split_rows(rows.withColumn("group_id", group_id(rows)), splits.load(spark, split_path))


def preprocess(rows: DataFrame, data_type: str = SNAP, drop_end: bool = True) -> DataFrame:
    """Clean already parsed rows."""
    if data_type == INSTRUCTIONS:
        return prep.standardized(rows.withColumns({c: F.col(c).cast("string") for c in ("instruction", "output")}))
    rows = prep.drop_end_labels(rows) if drop_end else rows
    return prep.standardized(prep.drop_invalid_sets(rows))


def load_eval_samples(spark: SparkSession, path: str, case_id: str, prefix: str, label: str, separator: str = ";") -> DataFrame:
    rows = read_csv(spark, path)
    return rows.select(F.col(case_id).cast("string").alias("case_id"), parse_prefix(prefix, separator).alias("prefix"), F.col(label).cast("string").alias("y_true"))


def gold_explanation(output: Column | str) -> Column:
    """The trimmed text; null for a blank or nan."""
    text = strip(output)
    return F.when(~F.lower(text).isin("", "nan"), text)


def write_record(record: DataFrame, path: str) -> None:
    """A run's one-row metric record as JSON."""
    record.coalesce(1).write.mode("overwrite").json(path)
