"""Selections over groups as set algebra, deletion plans, freed space."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .catalog import best_of, first_rows, without


def group_members(groups: DataFrame, assets: DataFrame) -> DataFrame:
    """``group_id, kind, id, best_id`` from ``group_id, kind, id``; members without an asset row are left out."""
    known = groups.distinct().join(first_rows(assets), "id")
    return known.select("group_id", "kind", "id").join(best_of(known, ["group_id"]), "group_id")


def default_selection(members: DataFrame) -> DataFrame:
    """SET-01: ``id`` of every member that no group recommends; one recommended anywhere is protected everywhere."""
    return without(members.select("id").distinct(), members.select(F.col("best_id").alias("id")))


def kept_selection(previous: DataFrame, removed: DataFrame, members: DataFrame, admitted: DataFrame) -> DataFrame:
    """SET-02: what of a selection survives new results: (previous - removed) within members and admitted rows."""
    allowed = members.select("id").union(admitted.select("id"))
    return without(previous.select("id").distinct(), removed).join(allowed, "id", "left_semi")


def toggled(selection: DataFrame, touched: DataFrame) -> DataFrame:
    """SET-03: symmetric difference: touched identifiers change sides. A null identifier is in neither."""
    both = selection.select("id").distinct().withColumn("s", F.lit(1)).unionByName(touched.select("id").distinct().withColumn("s", F.lit(2)))
    return both.where("id IS NOT NULL").groupBy("id").agg(F.sum("s").alias("s")).where("s < 3").select("id")


def group_states(members: DataFrame, selection: DataFrame) -> DataFrame:
    """SET-04: ``group_id, selected, total, state``: none, some or all of a group."""
    chosen = selection.select("id").distinct().withColumn("on", F.lit(1))
    counts = members.join(chosen, "id", "left").groupBy("group_id").agg(F.count("on").alias("selected"), F.count("*").alias("total"))
    return counts.withColumn("state", F.when(F.col("selected") == 0, "none").when(F.col("selected") == F.col("total"), "all").otherwise("some"))


def categories(members: DataFrame) -> DataFrame:
    """SET-07: ``id, category``: exact before near."""
    return members.groupBy("id").agg(F.min("kind").alias("category"))


def removing_members(members: DataFrame, removed: DataFrame, assets: DataFrame) -> DataFrame:
    """JOI-07: ``group_id, kind, id, best_id`` after members were removed: groups of fewer than two go, the best is chosen again."""
    left = without(members.select("group_id", "kind", "id"), removed)
    alive = left.groupBy("group_id").agg(F.count("*").alias("n")).where("n > 1").select("group_id")
    return group_members(left.join(alive, "group_id", "left_semi"), assets)


def deletion_plan(selection: DataFrame, assets: DataFrame, members: DataFrame) -> DataFrame:
    """PLN-02: ``id, media_type, size_bytes, category`` of the selected assets, by identifier. Sizes that are not known stay null."""
    return selection.select("id").distinct().join(first_rows(assets).select("id", "media_type", "size_bytes"), "id").join(categories(members), "id", "left").orderBy("id")


def missing(selection: DataFrame, assets: DataFrame) -> DataFrame:
    """FLT-18: selected identifiers without an asset; a plan is only made when there is none."""
    return selection.select("id").where("id IS NOT NULL").distinct().join(assets.select("id"), "id", "left_anti")


def freed(plan: DataFrame, surviving: DataFrame) -> DataFrame:
    """AGG-04: what a deletion freed; no row if nothing was removed. A video counts as video whatever its category."""
    rows = plan.groupBy("id").agg(F.min(F.struct("media_type", "size_bytes", "category")).alias("r")).select("id", "r.*")
    left = surviving.select("id").distinct().withColumn("survives", F.lit(True))
    marked = rows.join(left, "id", "left").withColumn("gone", F.col("survives").isNull())
    video = F.coalesce(F.col("media_type") == "video", F.lit(False))
    n = lambda c: F.count_if(F.col("gone") & c)
    out = marked.agg(
        n(F.lit(True)).alias("confirmed"), F.coalesce(F.sum(F.when(F.col("gone"), F.col("size_bytes"))), F.lit(0)).cast("bigint").alias("measured_bytes"), n(F.col("size_bytes").isNotNull()).alias("measured"), n(F.col("size_bytes").isNull()).alias("unresolved"),
        F.count_if(~F.col("gone")).alias("not_removed"), n(video).alias("videos"), n(~video & (F.coalesce("category", F.lit("")) == "exact")).alias("exact"), n(~video & (F.coalesce("category", F.lit("")) == "near")).alias("similar"), n(~video & F.col("category").isNull()).alias("photos"),
    )
    return out.where("confirmed > 0")
