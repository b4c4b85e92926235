"""Tries as tables: the nodes of a prefix by name, so that what is shuffled is linear in a trace's length.

A node's name is the md5 of its parent's name and the activity. Names of one length make the text under the hash
unambiguous. Null activities count as an activity of their own.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foretrace.functions.parsing import col

ROOT = hashlib.md5(b"").hexdigest()
_NO_ACTIVITY = "\x00null"
#: Names are chained in blocks of so many, as a growing array is copied at each step.
BLOCK = 64


def _child(parent: Column, activity: Column) -> Column:
    return F.md5(F.concat(parent, F.coalesce(activity, F.lit(_NO_ACTIVITY))).cast("binary"))


def path(prefix: Column | str, root: Column | str = ROOT) -> Column:
    """The names of all nodes on the way to a prefix, from the root to its own."""
    prefix, root = col(prefix), F.lit(root) if isinstance(root, str) else root
    blocks = F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.size(prefix) - 1, F.lit(0)) / BLOCK)), lambda b: F.slice(prefix, (b * BLOCK + 1).cast("int"), F.lit(BLOCK)))
    last = lambda names: F.element_at(names, -1)
    chained = lambda start, block: F.aggregate(block, F.array(start), lambda names, a: F.concat(names, F.array(_child(last(names), a))))
    # Each block's names but its first, the last of the block before.
    rest = lambda names: F.slice(names, F.lit(2), F.greatest(F.size(names) - 1, F.lit(0)))
    nested = F.aggregate(blocks, F.array(F.array(root)), lambda done, block: F.when(F.size(block) > 0, F.concat(done, F.array(rest(chained(last(last(done)), block))))).otherwise(done))
    return F.flatten(nested)


def node(prefix: Column | str, root: Column | str = ROOT) -> Column:
    """The name of a prefix's own node."""
    root = F.lit(root) if isinstance(root, str) else root
    return F.aggregate(col(prefix), root, _child)


def continuations(weighted: DataFrame, longest: int | None = None) -> DataFrame:
    """(node, next, depth, c, trace_id): how often ``next`` follows a node, of up to ``longest`` activities; weighted:
    trace, w. trace_id names one of the traces that have both, so that a prefix can be shown again."""
    rows = weighted.select("w", "trace", path("trace").alias("p"))
    steps = F.arrays_zip(F.col("p").alias("node"), F.col("trace").alias("next"))
    flat = rows.select("w", F.element_at("p", -1).alias("trace_id"), F.posexplode_outer(steps).alias("depth", "s")).filter(F.col("s.next").isNotNull())
    if longest is not None:
        flat = flat.filter(F.col("depth") <= longest)
    return flat.groupBy(F.col("s.node").alias("node"), F.col("s.next").alias("next")).agg(F.first("depth").alias("depth"), F.sum("w").alias("c"), F.min("trace_id").alias("trace_id"))


def named(nodes: DataFrame, weighted: DataFrame) -> DataFrame:
    """``nodes`` (depth, trace_id, ...) with the prefix itself; each trace is shipped once, whatever nodes it has."""
    traces = weighted.select(node("trace").alias("trace_id"), "trace").dropDuplicates(["trace_id"])
    return nodes.join(traces, "trace_id").withColumn("prefix", F.slice("trace", F.lit(1), F.col("depth"))).drop("trace", "trace_id", "depth")
