"""Similar pairs within buckets, complete-linkage groups, exact groups."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Similarity
from ..scratch import Scratch
from ..ship import ship
from ..skew import join_on_hot_key
from .bucketing import buckets
from .catalog import best_order, first_rows


def hamming(a: Column, b: Column) -> Column:
    """MTH-01: positions in which two 64-bit patterns differ."""
    return F.bit_count(a.bitwiseXOR(b))


def euclidean(a: Column, b: Column) -> Column:
    """MTH-02: distance of two vectors; null where either is empty or their lengths differ."""
    squares = F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda acc, x: acc + x)
    return F.when((F.size(a) > 0) & (F.size(a) == F.size(b)), F.sqrt(squares))


def bucket_pairs(rows: DataFrame, columns: list[str], bucket: str = "bucket_id", id_col: str = "id") -> DataFrame:
    """JOI-01: ``bucket, a, b`` and ``columns`` of both sides, ``a < b``, for the pairs of each bucket. Buckets are small by construction."""
    side = lambda x: rows.select(bucket, F.col(id_col).alias(x), *[F.col(c).alias(f"{c}_{x}") for c in columns])
    return side("a").join(side("b"), bucket).where("a < b")


def block_pairs(rows: DataFrame, columns: list[str], bucket: str = "bucket_id", id_col: str = "id", block: int = 640) -> DataFrame:
    """JOI-12: the rows of ``bucket_pairs`` for buckets of any size.

    The ids of a bucket are dealt into blocks of about ``block`` rows, and every block meets every block (itself
    too) under a key of its own: each pair is compared once, and a hot bucket is spread over as many keys as its pairs need.
    """
    sizes = rows.groupBy(bucket).agg(F.count("*").alias("_n"))
    dealt = join_on_hot_key(rows, sizes, [bucket], "_n", rows.count(), id_col).withColumn("_blocks", F.ceil(F.col("_n") / block)).withColumn("_own", F.pmod(F.xxhash64(id_col), F.col("_blocks")))
    every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_blocks") - 1))
    side = lambda x, own, other: dealt.select(bucket, F.col(id_col).alias(x), *[F.col(c).alias(f"{c}_{x}") for c in columns], F.col("_own").alias(own), every.alias(other))
    return side("a", "_i", "_j").join(side("b", "_j", "_i"), [bucket, "_i", "_j"]).where("a < b").drop("_i", "_j")


def _link(pdf: pd.DataFrame) -> pd.DataFrame:
    """Greedy complete linkage over the relations of one bucket, closest first."""
    near = {frozenset((a, b)): d for a, b, d in zip(pdf["a"], pdf["b"], pdf["distance"], strict=True)}
    home: dict[str, set[str]] = {}
    for _, a, b in sorted((d, a, b) for a, b, d in zip(pdf["a"], pdf["b"], pdf["distance"], strict=True)):
        x, y = home.get(a, {a}), home.get(b, {b})
        if x is not y and all(frozenset((p, q)) in near for p in x for q in y):
            joined = x | y
            for m in joined:
                home[m] = joined
    out = []
    for members in {id(s): s for s in home.values()}.values():
        ms = sorted(members)
        ds = [near[frozenset((p, q))] for i, p in enumerate(ms) for q in ms[i + 1 :]]
        out.append((pdf["bucket_id"].iloc[0], ms, min(ds), max(ds)))
    return pd.DataFrame(out, columns=["bucket_id", "member_ids", "min_distance", "max_distance"])


def link_groups(relations: DataFrame, id_type: str = "string") -> DataFrame:
    """GRF-04: ``bucket_id, member_ids, min_distance, max_distance`` from ``bucket_id, a, b, distance``.

    Relations stay within buckets, so linking each bucket alone gives the same groups as linking all at once; a
    group holds only members that are all related to each other.
    """
    ship(relations.sparkSession)
    return relations.select("bucket_id", "a", "b", "distance").groupBy("bucket_id").applyInPandas(_link, f"bucket_id string, member_ids array<{id_type}>, min_distance double, max_distance double")


def exact_groups(rows: DataFrame, key: list[str], id_col: str = "id") -> DataFrame:
    """AGG-05: ``key..., members`` (count) and ``first_id`` of contents that occur more than once. Null keys never match."""
    some = rows.where(F.forall(F.array(*[F.col(k).isNotNull() for k in key]), lambda x: x))
    return some.groupBy(*key).agg(F.count_distinct(id_col).alias("members"), F.min(id_col).alias("first_id")).where("members > 1")


def colliding(rows: DataFrame, key: list[str]) -> DataFrame:
    """AGG-06: rows that share a cheap key with another, which alone need the dear one."""
    shared = rows.groupBy(*key).agg(F.count("*").alias("_n")).where("_n > 1").drop("_n")
    return rows.join(shared, key, "left_semi")


def with_best(groups: DataFrame, assets: DataFrame) -> DataFrame:
    """GRF-05: groups (``group_id, member_ids``) with ``best_id``; a group with a member that has no asset row is dropped."""
    members = groups.select("group_id", F.explode("member_ids").alias("id"))
    known = members.join(first_rows(assets), "id", "left").withColumn("missing", F.col("media_type").isNull() & F.col("width").isNull())
    best = known.groupBy("group_id").agg(F.max("missing").alias("missing"), F.min(best_order()).alias("o")).where("NOT missing").select("group_id", F.col("o.o6").alias("best_id"))
    return groups.join(best, "group_id")


def near_enough(a: str = "a", b: str = "b", config: Similarity = Similarity()) -> Column:
    """FLT-13, MTH-07: distance of two descriptors (``kind``, ``vector``) within the threshold of their kind, else null.

    Descriptors of different kinds or lengths, empty or missing ones tell nothing: null.
    """
    kind = F.col(f"kind_{a}")
    limit = F.when(kind == "vision", config.vision_threshold).when(kind == "cpuGrid", config.grid_threshold)
    distance = euclidean(F.col(f"vector_{a}"), F.col(f"vector_{b}"))
    return F.when((kind == F.col(f"kind_{b}")) & (distance <= limit), distance)


def confirmed_copies(pairs: DataFrame, contents: DataFrame) -> DataFrame:
    """GRF-06: the rows of ``pairs`` (``a, b``) whose contents are equal, with their ``digest``: equal lengths first, and only for those the SHA-256.

    ``contents`` has ``id, content`` (binary). Content that cannot be read (no row, null) confirms nothing.
    """
    length = contents.where("content IS NOT NULL").select("id", F.length("content").alias("n"))
    side = lambda rows, x, c: rows.select(F.col("id").alias(x), F.col(c).alias(f"{c}_{x}"))
    same_length = pairs.join(side(length, "a", "n"), "a").join(side(length, "b", "n"), "b").where("n_a = n_b").drop("n_a", "n_b")
    needed = same_length.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    digests = contents.join(needed, "id", "left_semi").select("id", F.sha2("content", 256).alias("digest"))
    return same_length.join(side(digests, "a", "digest"), "a").join(side(digests, "b", "digest"), "b").where("digest_a = digest_b").withColumnRenamed("digest_a", "digest").drop("digest_b")


def similar_assets(assets: DataFrame, hashes: DataFrame, descriptors: DataFrame, contents: DataFrame, config: Similarity = Similarity()) -> DataFrame:
    """GRF-07: groups of exact and near duplicates with the asset to keep.

    ``group_id, kind, member_ids, best_id, min_distance, max_distance``. Pairs of a bucket at most ``max_hamming`` positions
    apart go on. Exact: contents of equal length and digest, collected over all buckets. Near: photos, exact copies
    aside, whose descriptors (``id, kind, vector``) are within the threshold of their kind; every two members of a group are. Videos have
    exact groups only. Assets hashed more than once count with their latest pattern; those without one are in no group.
    """
    scratch = Scratch(assets.sparkSession, "similar")
    latest = hashes.where("asset_id IS NOT NULL AND bits IS NOT NULL").groupBy(F.col("asset_id").alias("id")).agg(F.max(F.struct("modified", "bits")).alias("h")).select("id", F.col("h.bits").alias("bits"))
    bucketed = scratch.write(buckets(assets, scratch).join(latest, "id").select("bucket_id", "route", "id", "bits"))
    close = scratch.write(bucket_pairs(bucketed, ["route", "bits"]).where(hamming(F.col("bits_a"), F.col("bits_b")) <= config.max_hamming).select("bucket_id", "a", "b", F.col("route_a").alias("route")))
    same = scratch.write(confirmed_copies(close, contents))
    exact = same.select("digest", F.explode(F.array("a", "b")).alias("id")).groupBy("digest").agg(F.array_sort(F.collect_set("id")).alias("member_ids"))
    exact = exact.select(F.concat(F.lit("exact:"), "digest").alias("group_id"), F.lit("exact").alias("kind"), "member_ids", F.lit(0.0).alias("min_distance"), F.lit(0.0).alias("max_distance"))
    one = descriptors.where("id IS NOT NULL").groupBy("id").agg(F.max(F.struct("kind", "vector")).alias("d")).select("id", "d.*")
    side = lambda x: one.select(F.col("id").alias(x), F.col("kind").alias(f"kind_{x}"), F.col("vector").alias(f"vector_{x}"))
    candidates = close.where("route = 'image'").join(same.select("a", "b"), ["a", "b"], "left_anti")
    relations = candidates.join(side("a"), "a").join(side("b"), "b").select("bucket_id", "a", "b", near_enough(config=config).alias("distance")).where("distance IS NOT NULL")
    near = link_groups(relations).select(F.concat(F.lit("near:"), F.array_join("member_ids", ",")).alias("group_id"), F.lit("near").alias("kind"), "member_ids", "min_distance", "max_distance")
    return with_best(exact.unionByName(near), assets)
