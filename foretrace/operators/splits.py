"""Leak-free splits by group, and bucket reports of their rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foretrace.functions.parsing import PREFIX_LENGTH, PROCESS_SIZE, TRACE_LENGTH, bucket
from foretrace.operators import ranks
from foretrace.sources import files
from foretrace.sources.scratch import stored

SPLITS = ("train", "val", "test")


def split_ids(rows: DataFrame, val_ratio: float = 0.10, test_ratio: float = 0.20, seed: int = 42, group: str = "group_id") -> DataFrame:
    """(group_id, split): in md5 order the first half-even round(test * n) ids are test, the next val, the rest train.

    The borders are selected by their ranks; no sort meets all ids.
    """
    ids = rows.select(F.col(group).cast("string").alias("group_id")).distinct().withColumn("_md5", F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("group_id"))))
    ids = stored(ids, "group-ids")
    n = ids.count()
    test, val = round(test_ratio * n), round(val_ratio * n)
    parts = ranks.cut_at(ids, [test, test + val], ranks.hash_key(F.col("_md5")), F.col("_md5"), F.col("group_id"))
    named = [x.select("group_id", F.lit(name).alias("split")) for x, name in zip(parts, ("test", "val", "train"), strict=True)]
    return named[0].unionByName(named[1]).unionByName(named[2])


def split_rows(rows: DataFrame, ids: DataFrame, group: str = "group_id") -> DataFrame:
    """``rows`` with the split of their group."""
    return rows.join(ids.withColumnRenamed("group_id", "_group"), F.col(group).cast("string") == F.col("_group")).drop("_group")


def subset(rows: DataFrame, ids: DataFrame, split: str, group: str = "group_id") -> DataFrame:
    """The rows of one split."""
    chosen = ids.filter(F.col("split") == split).select(F.col("group_id").alias("_group"))
    return rows.join(chosen, F.col(group).cast("string") == F.col("_group"), "left_semi")


def save(ids: DataFrame, path: str, overwrite: bool = False) -> None:
    """Write a split table that readers of ``load`` see whole or not at all.

    Rows go to a folder of their own under ``path``; then the pointer file is exchanged in one rename. A failed write
    leaves pointer and rows as they were. The version before stays for jobs that are reading it; older ones go.
    """
    spark = ids.sparkSession
    before = files.pointed(spark, path)
    if not overwrite and (before is not None or files.exists(spark, path)):
        raise FileExistsError(f"{path} holds a split table")
    version = f"version-{uuid.uuid4().hex}"
    ids.write.parquet(f"{path}/{version}")
    files.point(spark, path, version)
    files.keep(spark, path, {version, before})


def load(spark: SparkSession, path: str) -> DataFrame:
    """The split table last saved at ``path``, or a plain Parquet table there."""
    version = files.pointed(spark, path)
    return spark.read.parquet(path if version is None else f"{path}/{version}")


def bucket_report(rows: DataFrame, task: str = "next_activity") -> DataFrame:
    """(split, dimension, bucket, n) of split rows, with a 0 for every empty bucket."""
    dimensions = [("process_size", "unique_activities", PROCESS_SIZE)]
    if task == "next_activity" and "prefix" in rows.columns:
        dimensions.append(("prefix_len", "prefix", PREFIX_LENGTH))
    if task == "trace_anomaly" and "trace" in rows.columns:
        dimensions.append(("trace_len", "trace", TRACE_LENGTH))
    cells = F.array(*[F.struct(F.lit(name).alias("dimension"), bucket(F.size(column), buckets).alias("bucket")) for name, column, buckets in dimensions])
    counted = rows.select("split", F.inline(cells)).groupBy("split", "dimension", "bucket").agg(F.count("*").alias("n"))
    every = F.array(*[F.struct(F.lit(name).alias("dimension"), F.lit(b).alias("bucket")) for name, _, buckets in dimensions for _, b in buckets])
    frame = rows.sparkSession.createDataFrame([(s,) for s in SPLITS], "split string").select("split", F.inline(every))
    return frame.join(counted, ["split", "dimension", "bucket"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
