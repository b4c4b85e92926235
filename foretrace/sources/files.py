"""Pointer files: which of a folder's versions is the current one, exchanged in one rename."""

from __future__ import annotations

from pyspark.sql import SparkSession

POINTER = "_CURRENT"


def _system(spark: SparkSession, path: str):
    spot = spark._jvm.org.apache.hadoop.fs.Path(path)
    return spot.getFileSystem(spark._jsc.hadoopConfiguration()), spot


def exists(spark: SparkSession, path: str) -> bool:
    system, spot = _system(spark, path)
    return system.exists(spot)


def pointed(spark: SparkSession, path: str) -> str | None:
    """The name in the pointer file, None where there is none."""
    system, pointer = _system(spark, f"{path}/{POINTER}")
    if not system.exists(pointer):
        return None
    stream = system.open(pointer)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").strip()
    finally:
        stream.close()


def point(spark: SparkSession, path: str, name: str) -> None:
    """Write the pointer beside the old one and rename it over that."""
    jvm, hadoop = spark._jvm, spark._jvm.org.apache.hadoop.fs
    system, fresh = _system(spark, f"{path}/.{name}.pointer")
    out = system.create(fresh, True)
    out.write(bytearray(name, "utf-8"))
    out.close()
    rename = getattr(hadoop, "Options$Rename")
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    target = system.makeQualified(hadoop.Path(f"{path}/{POINTER}"))
    fresh = system.makeQualified(fresh)
    hadoop.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration()).rename(fresh, target, options)


def keep(spark: SparkSession, path: str, names: set[str | None]) -> None:
    """Delete versions of other names."""
    system, spot = _system(spark, path)
    for status in system.listStatus(spot):
        name = status.getPath().getName()
        if name.startswith("version-") and name not in names:
            system.delete(status.getPath(), True)
