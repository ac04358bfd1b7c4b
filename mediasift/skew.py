"""Joins that survive a key holding a large part of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: At most this many keys can each hold more than 1/MAX_HOT_KEYS of the rows,
#: which bounds what is broadcast below whatever the size of the data.
MAX_HOT_KEYS = 1000


def join_on_hot_key(rows: DataFrame, unique: DataFrame, on: list[str], count: str, total: int, spread: str, salts: int = 64, least: int = 50_000) -> DataFrame:
    """Inner join of ``rows`` with ``unique`` (one row for each key, ``count`` = rows of that key).

    Keys with more than ``max(least, total / MAX_HOT_KEYS)`` rows are salted:
    their rows are spread over ``salts`` partitions by a hash of ``spread`` and
    their one row of ``unique`` is repeated for each salt. The list of those
    keys has at most ``MAX_HOT_KEYS`` entries, so it is safe to broadcast.
    Null keys match nothing.
    """
    limit = max(least, total // MAX_HOT_KEYS)
    if total <= limit:
        return rows.join(unique, on)
    hot = unique.where(F.col(count) > limit).select(*on, F.lit(True).alias("_hot"))
    salted = rows.join(F.broadcast(hot), on, "left").withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int")).otherwise(0)).drop("_hot")
    copies = unique.withColumn("_salt", F.explode(F.when(F.col(count) > limit, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))
    return salted.join(copies, [*on, "_salt"]).drop("_salt")
