"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot when it holds more than this share of the rows; so at most 1 / SHARE keys are hot, however large the data.
SHARE = 1 / 512


def hot_aware_join(rows: DataFrame, lookup: DataFrame, keys: list[str], weight: str, hot_at_least: int = 100_000) -> DataFrame:
    """Inner equi-join of ``rows`` with ``lookup``, which has one row per key and, in ``weight``, the number of ``rows``
    of that key.

    Keys with at least ``hot_at_least`` rows and more than the share SHARE of all rows are at most 512 by counting;
    they are broadcast, so their rows need no shuffle.  All other keys are joined by a shuffle in which none dominates.
    NULL keys join nothing.  ``weight`` is not part of the result.
    """
    total = lookup.agg(F.sum(weight)).first()[0] or 0
    limit = max(hot_at_least, int(total * SHARE) + 1)
    hot, cold = lookup.where(F.col(weight) >= limit).drop(weight), lookup.where(F.col(weight) < limit).drop(weight)
    if total < limit:
        return rows.join(cold, keys)
    hot_keys = F.broadcast(hot.select(*keys))
    return rows.join(F.broadcast(hot), keys).unionByName(rows.join(hot_keys, keys, "left_anti").join(cold, keys))


def salted_join(rows: DataFrame, lookup: DataFrame, keys: list[str], salts: int = 16, hot_at_least: int = 100_000) -> DataFrame:
    """Inner equi-join of ``rows`` with a ``lookup`` that may have several rows per key.

    Keys with at least ``hot_at_least`` rows and more than the share SHARE of all rows (at most 512 by counting) are
    salted: their rows spread over ``salts`` parts by a hash of the whole row, their lookup rows are repeated for each."""
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n")).first()[0] or 0
    limit = max(hot_at_least, int(total * SHARE) + 1)
    if total < limit:
        return rows.join(lookup, keys)
    hot = F.broadcast(counts.where(F.col("_n") >= limit).select(*keys).withColumn("_hot", F.lit(True)))
    spread = F.pmod(F.xxhash64(*(F.col(f"`{c}`") for c in rows.columns)), F.lit(salts)).cast("int")
    left = rows.join(hot, keys, "left").withColumn("_salt", F.when(F.col("_hot"), spread).otherwise(0)).drop("_hot")
    every = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    right = lookup.join(hot, keys, "left").withColumn("_salt", F.explode(every)).drop("_hot")
    return left.join(right, [*keys, "_salt"]).drop("_salt")
