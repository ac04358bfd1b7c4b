"""Near-duplicate records with small edits, as a vertically partitioned set-similarity join.

The tokens of all records are put into one global order and the order is cut
into fragments. Each fragment holds one segment of every record. Records meet
inside fragments, partial overlaps are counted fragment by fragment, each count
a row of its own, and summed for the pair.

Two kinds of records:

* bit patterns (``near_patterns``): the tokens are the 64 (position, bit) pairs, ordered by how
  evenly the bit is spread over the collection. Patterns at most ``d``
  positions apart agree in at least ``agree`` of ``d + agree`` whole fragments, so they
  meet in the partition of some combination of ``agree`` segments; the overlap with the
  leading half of the order filters what meets.
* n-gram sets (``near_sets``): tokens ordered by document frequency, rare ones first. Sets
  that are similar enough share a token in their prefixes, and meet there.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations
from math import comb

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import Scratch
from .buckets import Accept, pairs_in_buckets

BITS = 64
#: A bucket with more patterns than this is cut further, again and again: one with p open positions has at most 2^p patterns.
BUCKET_ROWS = 4096
#: Relative cost of one key written and one pair met; only the choice of fragments depends on them.
KEY_COST, PAIR_COST = 300, 1


def signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def agree_for(n: int, max_distance: int) -> int:
    """How many whole fragments make a key, with the least work for ``n`` patterns: keys written plus pairs met.

    Every choice gives the same pairs; only the cost differs.
    """
    def cost(agree: int) -> float:
        k = max_distance + agree
        ways, bits = comb(k, agree), BITS * agree / k
        return ways * n * KEY_COST + ways * n * n / 2 / 2**bits * PAIR_COST

    return min(range(1, 5), key=cost)


def global_order(ones: list[int], total: int) -> list[int]:
    """Positions by imbalance of their bit, the most telling first."""
    return sorted(range(BITS), key=lambda i: (abs(2 * ones[i] - total), i))


def cut_order(order: list[int], fragments: int) -> list[int]:
    """Masks of the fragments: the order dealt round, so that each gets its share of telling positions."""
    return [sum(1 << p for p in order[f::fragments]) for f in range(fragments)]


def sum_overlaps(pairs: DataFrame, a: str, b: str, counted: Column) -> DataFrame:
    """``(a, b, overlap)``: one row ``(pair, fragment, partial overlap)`` for each entry of the array ``counted``, summed for the pair."""
    parts = pairs.select(a, b, F.explode(counted).alias("part"))
    return parts.groupBy(a, b).agg(F.sum("part.overlap").alias("overlap"))


def _segment_overlaps(masks: list[int]) -> Column:
    """Tokens in common in each fragment: positions of the segment where both patterns have the same bit."""
    segment = lambda c, m: F.col(c).bitwiseAND(F.lit(signed(m)))
    return F.array(*[F.struct(F.lit(f).alias("fragment"), (F.lit(m.bit_count()) - F.bit_count(segment("bits_a", m).bitwiseXOR(segment("bits_b", m)))).alias("overlap")) for f, m in enumerate(masks)])


def near_patterns(patterns: DataFrame, max_distance: int = 6, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``(bits_a, bits_b)``, ``bits_a < bits_b``: all pairs of different patterns at most ``max_distance`` bits apart.

    ``patterns`` has one column ``bits`` (bigint); nulls are left out and
    repeated patterns count once. Exact: no pair within the distance is lost, whatever the size of a bucket.
    """
    spark = patterns.sparkSession
    scratch = Scratch(spark, "hamming")
    classes = scratch.write(patterns.select("bits").where("bits IS NOT NULL").distinct())
    row = classes.agg(F.count("*").alias("n"), *[F.coalesce(F.sum(F.shiftrightunsigned("bits", i).bitwiseAND(F.lit(1))), F.lit(0)).alias(f"b{i}") for i in range(BITS)]).first()
    n, order = row[0], global_order(list(row)[1:], row[0])
    agree = agree_for(max(n, 1), max_distance)
    masks = cut_order(order, max_distance + agree)
    ways = [sum(c) for c in combinations(masks, agree)]
    rows = classes.select("bits", F.explode(F.array(*[F.lit(signed(m)) for m in ways])).alias("mask"))
    met: DataFrame | None = None
    while True:
        keyed = rows.withColumn("bucket", F.xxhash64("mask", F.col("bits").bitwiseAND(F.col("mask"))))
        if n <= bucket_rows:
            hot = None
        else:  # written, so its real size decides between a broadcast and a shuffled join
            hot = scratch.write(keyed.groupBy("bucket").count().where(F.col("count") > bucket_rows).select("bucket"))
            hot = None if hot.isEmpty() else hot
        calm = keyed if hot is None else keyed.join(hot, "bucket", "left_anti")
        here = pairs_in_buckets(calm.select("bucket", F.col("bits").alias("item")), _within(max_distance), "bits_a", "bits_b", _leading(order))
        met = here if met is None else met.unionByName(here)
        if hot is None:
            break
        crowded = scratch.write(keyed.join(hot, "bucket", "left_semi").select("bits", "mask"))
        # The masks of a level are those of the level before, each cut into max_distance + 1 pieces: their number does not depend on the data.
        finer = [(r["mask"], signed((r["mask"] & (2**BITS - 1)) | piece)) for r in crowded.select("mask").distinct().collect() for piece in _pieces(r["mask"], order, max_distance)]
        rows = crowded.join(F.broadcast(spark.createDataFrame(finer, "mask bigint, finer bigint")), "mask").select("bits", F.col("finer").alias("mask"))
    met = scratch.write(met.distinct())
    overlaps = sum_overlaps(met, "bits_a", "bits_b", _segment_overlaps(masks))
    return overlaps.where(F.col("overlap") >= BITS - max_distance).select("bits_a", "bits_b")


def _pieces(mask: int, order: list[int], max_distance: int) -> list[int]:
    """The positions outside ``mask`` in ``max_distance + 1`` pieces, one of which near patterns must share."""
    rest = [p for p in order if not (mask >> p) & 1]
    return [sum(1 << p for p in rest[i :: max_distance + 1]) for i in range(max_distance + 1)]


def _leading(order: list[int]) -> Callable[[np.ndarray], np.ndarray]:
    """The leading half of the order as 32-bit numbers."""
    lead = order[: BITS // 2]

    def pack(bits: np.ndarray) -> np.ndarray:
        out = np.zeros(len(bits), dtype=np.uint32)
        for i, p in enumerate(lead):
            out |= ((bits >> np.uint64(p)) & np.uint64(1)).astype(np.uint32) << np.uint32(i)
        return out

    return pack


def _within(max_distance: int) -> Accept:
    return lambda x, y: np.bitwise_count(x ^ y) <= max_distance


def near_assets(entries: DataFrame, asset: str = "asset_id", bits: str = "bits", max_distance: int = 6) -> DataFrame:
    """``(asset_a, asset_b)``, ``asset_a < asset_b``: different assets with patterns at most ``max_distance`` bits apart in any of their rows.

    Null assets and null patterns are left out, repeated rows count once, an
    empty table gives no rows. Patterns are compared once however many assets
    have them; only pairs that are part of the result are expanded.
    """
    members = entries.select(F.col(asset).alias("asset"), F.col(bits).alias("bits")).where("asset IS NOT NULL AND bits IS NOT NULL").distinct()
    pairs = near_patterns(members.select("bits"), max_distance)
    a = members.select(F.col("asset").alias("x"), F.col("bits").alias("bits_a"))
    b = members.select(F.col("asset").alias("y"), F.col("bits").alias("bits_b"))
    apart = pairs.join(a, "bits_a").join(b, "bits_b").where("x <> y").select(F.least("x", "y").alias("asset_a"), F.greatest("x", "y").alias("asset_b"))
    same = a.join(b.withColumnRenamed("bits_b", "bits_a"), "bits_a").where("x < y").select(F.col("x").alias("asset_a"), F.col("y").alias("asset_b"))
    return apart.unionByName(same).distinct()


def near_classes(entries: DataFrame, asset: str = "asset_id", bits: str = "bits", max_distance: int = 6) -> DataFrame:
    """``(asset, class_bits, n_links)``: each asset and pattern with the number of other patterns near it.

    The compact form for groups of exact copies: linear in the input, whatever the size of a group.
    """
    members = entries.select(F.col(asset).alias("asset"), F.col(bits).alias("class_bits")).where("asset IS NOT NULL AND class_bits IS NOT NULL").distinct()
    pairs = near_patterns(members.select(F.col("class_bits").alias("bits")), max_distance)
    links = pairs.select(F.explode(F.array("bits_a", "bits_b")).alias("class_bits")).groupBy("class_bits").agg(F.count("*").alias("n_links"))
    return members.join(links, "class_bits", "left").select("asset", "class_bits", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))


def words_of(text: Column) -> Column:
    """Runs of letters, marks and digits, lower case; null gives none."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{M}\p{Nd}]+"), lambda w: w != "")


def shingles(words: Column, n: int = 5) -> Column:
    """64-bit hashes of the different runs of ``n`` words, sorted; fewer words are one run. ``words`` must be a stored column: it is looked up for every run."""
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - n + 1, F.lit(1))), lambda i: F.xxhash64(F.array_join(F.slice(words, i, n), " ")))
    return F.array_sort(F.array_distinct(runs))


def near_sets(sets: DataFrame, similarity: float = 0.8, fragments: int = 8) -> DataFrame:
    """``(a, b, overlap, similarity)``, ``a < b``: all pairs of sets with a Jaccard similarity of at least ``similarity``.

    ``sets`` has ``rec`` (one row a set) and ``tokens`` (array). Exact. The order of all tokens by document
    frequency is cut into ``fragments`` with equal numbers of occurrences; every record has a segment in each. Records
    whose sizes allow it meet on a token of both prefixes (two sets this similar share one), and the
    overlaps of their segments are counted by fragment and summed. Empty sets and null records are near nothing.
    """
    scratch = Scratch(sets.sparkSession, "sets")
    # Stored, so that what is made of a whole set is not made again for each of its tokens.
    whole = scratch.write(sets.where("rec IS NOT NULL").select("rec", F.array_distinct(F.array_compact("tokens")).alias("tokens")).withColumn("size", F.size("tokens")))
    flat = whole.select("rec", "size", F.explode("tokens").alias("token"))
    frequency = flat.groupBy("token").agg(F.count("*").alias("df"))
    # Ties of the frequency are broken by a hash, as a fraction, so the order is one number.
    place = F.col("df") + F.pmod(F.xxhash64("token"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    placed = scratch.write(flat.join(frequency, "token").select("rec", "size", "token", "df", place.alias("place")))
    cuts = placed.agg(F.percentile_approx("place", [i / fragments for i in range(1, fragments)], 10_000).alias("cuts")).first()["cuts"] or []
    fragment = sum((F.col("place") > F.lit(c)).cast("int") for c in cuts) if cuts else F.lit(0)
    ranked = placed.withColumn("at", F.row_number().over(Window.partitionBy("rec").orderBy("place", "token")))
    length = F.col("size") - F.ceil(F.col("size") * F.lit(similarity) - F.lit(1e-9)) + 1
    # A token of one record only lets nobody meet.
    prefix = scratch.write(ranked.where((F.col("at") <= length) & (F.col("df") > 1)).select("rec", "size", "token", "at"))
    side = lambda r: prefix.select("token", F.col("rec").alias(r), F.col("size").alias(f"size_{r}"), F.col("at").alias(f"at_{r}"))
    least = F.lit(similarity / (1 + similarity)) * (F.col("size_a") + F.col("size_b")) - F.lit(1e-9)
    # What can still be shared from this token on, in either set.
    open_ = F.least(F.col("size_a") - F.col("at_a"), F.col("size_b") - F.col("at_b")) + F.least("at_a", "at_b")
    met = side("a").hint("merge").join(side("b"), "token").where((F.col("a") < F.col("b")) & (F.least("size_a", "size_b") >= F.greatest("size_a", "size_b") * F.lit(similarity) - F.lit(1e-9)) & (open_ >= least))
    pairs = scratch.write(met.select("a", "b", "size_a", "size_b").distinct())
    segments = scratch.write(placed.withColumn("fragment", fragment).groupBy("rec", "fragment").agg(F.collect_list("token").alias("segment")))  # a part of one record
    seg = lambda r: segments.select(F.col("rec").alias(r), "fragment", F.col("segment").alias(f"segment_{r}"))
    both = pairs.join(seg("a"), "a").join(seg("b"), ["b", "fragment"])
    counted = F.array(F.struct("fragment", F.size(F.array_intersect("segment_a", "segment_b")).alias("overlap")))
    overlaps = sum_overlaps(both, "a", "b", counted).join(pairs, ["a", "b"])
    jaccard = F.col("overlap") / (F.col("size_a") + F.col("size_b") - F.col("overlap"))
    return overlaps.withColumn("similarity", jaccard).where(F.col("similarity") >= F.lit(similarity) - F.lit(1e-12)).select("a", "b", "overlap", "similarity")


def near_texts(documents: DataFrame, id_col: str = "doc_id", text: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """``(id_col, class_id, n_links)``: each document with the smallest document of the same set of ``words``-word runs, and how many other classes are near its class.

    Copies are compared once. Runs are compared by 64-bit hashes. Documents without words have no row; null identifiers are left out, a
    repeated row counts once, and of different texts under one identifier each has a row.
    """
    scratch = Scratch(documents.sparkSession, "texts")
    stated = scratch.write(documents.select(F.col(id_col).alias("doc"), words_of(F.col(text)).alias("words")).where("doc IS NOT NULL"))
    made = scratch.write(stated.where("size(words) > 0").select("doc", shingles(F.col("words"), words).alias("tokens")))
    sets = scratch.write(made.withColumn("key", F.sha2(F.array_join(F.col("tokens").cast("array<string>"), ","), 256)))
    classes = scratch.write(sets.groupBy("key").agg(F.min("doc").alias("class_id"), F.any_value("tokens").alias("tokens")))
    pairs = near_sets(classes.select(F.col("key").alias("rec"), "tokens"), similarity)
    links = pairs.select(F.explode(F.array("a", "b")).alias("key")).groupBy("key").agg(F.count("*").alias("n_links"))
    named = classes.select("key", "class_id").join(links, "key", "left")
    return sets.select("doc", "key").distinct().join(named, "key").select(F.col("doc").alias(id_col), "class_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))
