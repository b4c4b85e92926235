"""Lookups of packed models: joined by a measured broadcast, or with the hot keys of the rows split by salt."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foretrace.sources.scratch import stored

#: A model of up to so many bytes (as JSON text) is sent to every executor.
BROADCAST_BYTES = 32 << 20
#: Above that, keys of more rows than this are dealt out to as many tasks as hold so many each.
HOT_ROWS = 200_000


def stored_bytes(side: DataFrame) -> int:
    return side.agg(F.coalesce(F.sum(F.length(F.to_json(F.struct(*side.columns)))), F.lit(0))).first()[0]


def lookup(rows: DataFrame, side: DataFrame, keys: dict[str, str], broadcast_bytes: int | None = None, hot_rows: int | None = None) -> DataFrame:
    """``rows`` left-joined with ``side``, of at most one row a key; keys: columns of rows by those of side, which go.

    The side is computed once, stored and measured. Under the bound the rows are not shuffled. Above it, the rows of
    each key are counted (combined before the shuffle), a hot key's rows get one of its salts by their other content,
    and its row of the side is copied to each salt. Rows with a null key find nothing.
    """
    limit, many = BROADCAST_BYTES if broadcast_bytes is None else broadcast_bytes, HOT_ROWS if hot_rows is None else hot_rows
    held = stored(side, "lookup").withColumnsRenamed({s: f"_key_{i}" for i, s in enumerate(keys.values())})
    own = [f"_key_{i}" for i in range(len(keys))]
    same = [F.col(r) == F.col(k) for r, k in zip(keys, own, strict=True)]
    if stored_bytes(held) <= limit:
        return rows.join(F.broadcast(held), same, "left").drop(*own)
    hot = rows.groupBy(*[F.col(r).alias(f"_hot_{i}") for i, r in enumerate(keys)]).agg(F.count("*").alias("_n")).filter(F.col("_n") > many)
    hot = stored(hot.select(*[f"_hot_{i}" for i in range(len(keys))], F.ceil(F.col("_n") / many).cast("int").alias("_salts")), "hot-keys")
    # At most a row for each ``many`` rows, and broadcast only if that is few.
    hinted = F.broadcast(hot) if stored_bytes(hot) <= limit or hot.count() <= 10_000 else hot
    match = lambda names: [F.col(n).eqNullSafe(F.col(f"_hot_{i}")) for i, n in enumerate(names)]
    kinds = dict(rows.dtypes)
    content = [c for c in rows.columns if c not in keys and not kinds[c].startswith(("map", "variant"))]
    salt = F.pmod(F.xxhash64(*content) if content else F.monotonically_increasing_id(), F.col("_salts")).cast("int")
    salted = rows.join(hinted, match(keys), "left").withColumn("_salt", F.coalesce(salt, F.lit(0)))
    copies = held.join(hinted, match(own), "left").withColumn("_copy", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1)))
    gone = [f"_hot_{i}" for i in range(len(keys))] + ["_salts"]
    return salted.drop(*gone).join(copies.drop(*gone), [*same, F.col("_salt") == F.col("_copy")], "left").drop(*own, "_salt", "_copy")
