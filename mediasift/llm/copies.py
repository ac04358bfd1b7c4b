"""Duplicates hidden by formatting differences.

Every record becomes a multiset of normalized ``(field name, value)`` pairs.
Each pair is hashed, the hashes are added modulo a prime (a multiset hash: the
order of the pairs does not matter, repeated pairs do), and records are grouped by
the two sums. Fingerprints only propose: each record is compared pair by pair, unsorted,
with the first record of its fingerprint, and records that differ although
their fingerprints agree are hashed again under another seed until none is left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import alnum
from ..scratch import Scratch
from ..skew import join_on_hot_key

#: 2^61 - 1; sums of two residues stay below 2^63, so nothing overflows.
MODULUS = (1 << 61) - 1


def record_pairs(fields: list[str], split: dict[str, str]) -> Column:
    """The record as an array of ``name=value`` strings of letters and digits.

    ``fields`` give one pair each, null as empty; ``split`` fields are divided
    by the given pattern and give one pair for each part with a letter or digit.
    """
    whole = [F.array(F.concat(F.lit(f"{f}="), F.coalesce(alnum(F.col(f)), F.lit("")))) for f in fields]
    parts = [
        F.transform(F.filter(F.transform(F.split(F.coalesce(F.col(f), F.lit("")), by), alnum), lambda x: x != ""), lambda x, f=f: F.concat(F.lit(f"{f}="), x)) for f, by in split.items()
    ]
    return F.concat(*whole, *parts)


def multiset_hash(pairs: Column, seed: int) -> Column:
    """Sum of the pairs' hashes modulo ``MODULUS``."""
    return F.aggregate(pairs, F.lit(0).cast("bigint"), lambda acc, x: F.pmod(acc + F.pmod(F.xxhash64(F.lit(seed), x), F.lit(MODULUS)), F.lit(MODULUS)))


def same_multiset(a: Column, b: Column) -> Column:
    """Equality without sorting: each distinct pair occurs as often in ``a`` as in ``b``."""
    times = lambda xs, x: F.size(F.filter(xs, lambda y: y == x))
    counted = F.forall(F.array_distinct(a), lambda x: times(a, x) == times(b, x))
    distinct = (F.size(F.array_distinct(a)) == F.size(a)) & (F.size(F.array_distinct(b)) == F.size(b))
    return F.when(a == b, True).when(F.size(a) != F.size(b), False).when(distinct, F.size(F.array_except(a, b)) == 0).otherwise(counted)


def link_copies(df: DataFrame, id_col: str, fields: list[str], split: dict[str, str], hash_bits: int = 61) -> DataFrame:
    """``(first_id, id)`` for every record that has an earlier copy.

    Records agree if their fields do when only letters and digits count, in
    lower case, digits of all scripts folded; the parts of a ``split`` field may
    stand in any order. Records none of whose split fields has a letter or
    digit are left out. ``first_id`` is the smallest identifier of the copies;
    rows with a null identifier are left out, a repeated identifier counts once. Other columns are
    ignored, an empty table gives no rows. ``hash_bits`` narrows the hash (tests of collisions).
    """
    scratch = Scratch(df.sparkSession, "copies")
    pairs = df.select(F.col(id_col).alias("id"), record_pairs(fields, split).alias("pairs")).where(F.col("id").isNotNull() & (F.size("pairs") > len(fields)))
    out: DataFrame | None = None
    seed = 0
    narrow = lambda c: F.shiftright(c, 61 - hash_bits)
    while True:
        rows = pairs.select("id", narrow(multiset_hash(F.col("pairs"), seed)).alias("h1"), narrow(multiset_hash(F.col("pairs"), seed + 1)).alias("h2"), "pairs")
        first = rows.groupBy("h1", "h2").agg(F.min("id").alias("first_id"), F.count("*").alias("n"), F.min_by("pairs", "id").alias("first_pairs"))
        repeated = scratch.write(first.where("n > 1"))
        total = repeated.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        if not total:
            break
        met = join_on_hot_key(rows, repeated, ["h1", "h2"], "n", total, "id")
        checked = scratch.write(met.withColumn("same", same_multiset(F.col("pairs"), F.col("first_pairs"))).select("first_id", "id", "same", F.when(~F.col("same"), F.col("pairs")).alias("pairs")))
        found = checked.where("same AND id <> first_id").select("first_id", "id")
        out = found if out is None else out.unionByName(found)
        pairs = checked.where("NOT same").select("id", "pairs")
        if pairs.isEmpty():
            break
        seed += 2
    if out is None:
        return df.select(F.col(id_col).alias("first_id"), F.col(id_col).alias("id")).where(F.lit(False))
    return out.distinct()


def collapse_copies(df: DataFrame, id_col: str, fields: list[str], split: dict[str, str]) -> DataFrame:
    """One row for each record that is left: its identifier and ``copies``, the number it stands for.

    The same rows as :func:`link_copies` sees: records without a letter or
    digit in a split field and null identifiers are left out.
    """
    links = link_copies(df, id_col, fields, split)
    has = F.size(record_pairs(fields, split)) > len(fields)
    rows = df.where(has).select(F.col(id_col).alias("id")).where("id IS NOT NULL").distinct()
    counts = links.groupBy("first_id").agg((F.count("*") + 1).alias("copies"))
    kept = rows.join(links.select("id"), "id", "left_anti")
    return kept.join(counts.withColumnRenamed("first_id", "id"), "id", "left").select(F.col("id").alias(id_col), F.coalesce("copies", F.lit(1)).cast("bigint").alias("copies"))
