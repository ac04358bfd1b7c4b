"""Queries over groups, selections and plans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import catalog as C
from ..operators import selection as S
from . import query

_ORDER = "(NOT coalesce(is_favorite, false), coalesce(represents_burst, false), -coalesce(width::BIGINT * height, 0), NOT coalesce(has_adjustments, false), -epoch_us(coalesce(created, TIMESTAMP '0001-01-01')), id)"
#: Groups: assets with one pattern (exact), assets of one burst (near).
_G = f"""
WITH one AS (SELECT DISTINCT * FROM assets WHERE id IS NOT NULL),
h AS (SELECT DISTINCT asset_id AS id, bits FROM phash_entries WHERE bits IS NOT NULL),
m0 AS (SELECT 'e' || bits AS group_id, 'exact' AS kind, id FROM h WHERE bits IN (SELECT bits FROM h GROUP BY bits HAVING count(*) > 1)
  UNION SELECT 'n' || burst_id, 'near', id FROM one WHERE burst_id IS NOT NULL),
m AS (SELECT group_id, kind, id, first_value(id) OVER (PARTITION BY group_id ORDER BY {_ORDER}) AS best_id FROM m0 JOIN one USING (id)),
sel AS (SELECT DISTINCT id FROM m WHERE id NOT IN (SELECT best_id FROM m)),
cat AS (SELECT id, min(kind) AS category FROM m GROUP BY id),
plan AS (SELECT id, media_type, size_bytes, category FROM sel JOIN one USING (id) LEFT JOIN cat USING (id))
"""
_VIDEO_IDS = "SELECT id FROM one WHERE media_type = 'video'"


def raw_groups(t) -> DataFrame:
    h = t.phash_entries.where("bits IS NOT NULL").select(F.col("asset_id").alias("id"), "bits").distinct()
    many = h.groupBy("bits").agg(F.count("*").alias("n")).where("n > 1").select("bits")
    exact = h.join(many, "bits").select(F.concat(F.lit("e"), F.col("bits").cast("string")).alias("group_id"), F.lit("exact").alias("kind"), "id")
    near = C.first_rows(t.assets).where("burst_id IS NOT NULL").select(F.concat(F.lit("n"), "burst_id").alias("group_id"), F.lit("near").alias("kind"), "id")
    return exact.unionByName(near)


def members(t) -> DataFrame:
    return S.group_members(raw_groups(t), t.assets)


def videos(t) -> DataFrame:
    return t.assets.where("media_type = 'video'").select("id").distinct()


def hidden(t) -> DataFrame:
    return t.assets.where("is_hidden").select("id").distinct()


@query("set_01", _G + "SELECT id FROM sel")
def set_01(t):
    return S.default_selection(members(t))


@query("set_02", _G + "SELECT id FROM sel WHERE id NOT IN (SELECT id FROM one WHERE is_hidden) AND (id IN (SELECT id FROM m WHERE kind = 'near') OR id IN (" + _VIDEO_IDS + "))")
def set_02(t):
    m = members(t)
    return S.kept_selection(S.default_selection(m), hidden(t), m.where("kind = 'near'"), videos(t))


@query("set_03", _G + "SELECT id FROM (SELECT id FROM sel UNION SELECT id FROM one WHERE media_type = 'video') WHERE NOT (id IN (SELECT id FROM sel) AND id IN (" + _VIDEO_IDS + "))")
def set_03(t):
    return S.toggled(S.default_selection(members(t)), videos(t))


@query("set_04", _G + "SELECT group_id, count(s.id) AS selected, count(*) AS total, CASE WHEN count(s.id) = 0 THEN 'none' WHEN count(s.id) = count(*) THEN 'all' ELSE 'some' END AS state FROM m LEFT JOIN sel s ON s.id = m.id GROUP BY group_id")
def set_04(t):
    m = members(t)
    return S.group_states(m, S.default_selection(m))


@query("set_05", _G + "SELECT id FROM sel INTERSECT SELECT id FROM one WHERE NOT coalesce(is_hidden, false)")
def set_05(t):
    """A selection reconciled with what the dataset holds now."""
    return S.default_selection(members(t)).intersect(C.visible(t.assets).select("id"))


@query("set_07", _G + "SELECT id, category FROM cat")
def set_07(t):
    return S.categories(members(t))


@query("set_08", _G + "SELECT kind, count(*) AS n FROM (SELECT * FROM m WHERE kind = 'exact' UNION ALL SELECT * FROM m WHERE kind = 'near') GROUP BY kind")
def set_08(t):
    m = members(t)
    return m.where("kind = 'exact'").unionByName(m.where("kind = 'near'")).groupBy("kind").agg(F.count("*").alias("n"))


@query("joi_07", _G + f", l AS (SELECT group_id, kind, id FROM m WHERE id NOT IN (SELECT id FROM one WHERE is_favorite)), l2 AS (SELECT * FROM l WHERE group_id IN (SELECT group_id FROM l GROUP BY group_id HAVING count(*) > 1)) SELECT group_id, kind, id, first_value(id) OVER (PARTITION BY group_id ORDER BY {_ORDER}) AS best_id FROM l2 JOIN one USING (id)")
def joi_07(t):
    return S.removing_members(members(t), t.assets.where("is_favorite").select("id"), t.assets).select("group_id", "kind", "id", "best_id")


@query("agg_08", _G + "SELECT sum(n)::BIGINT AS grouped FROM (SELECT kind, count(DISTINCT id) AS n FROM m GROUP BY kind)")
def agg_08(t):
    return members(t).groupBy("kind").agg(F.count_distinct("id").alias("n")).agg(F.sum("n").alias("grouped"))


@query("agg_04", _G + "SELECT count(*) FILTER (g) AS confirmed, coalesce(sum(size_bytes) FILTER (g), 0)::BIGINT AS measured_bytes, count(size_bytes) FILTER (g) AS measured, count(*) FILTER (g AND size_bytes IS NULL) AS unresolved, count(*) FILTER (NOT g) AS not_removed, count(*) FILTER (g AND media_type = 'video') AS videos, count(*) FILTER (g AND media_type <> 'video' AND category = 'exact') AS exact, count(*) FILTER (g AND media_type <> 'video' AND category = 'near') AS similar, count(*) FILTER (g AND media_type <> 'video' AND category IS NULL) AS photos FROM (SELECT *, id NOT IN (SELECT id FROM one WHERE is_hidden) AS g FROM plan) HAVING count(*) FILTER (g) > 0")
def agg_04(t):
    m = members(t)
    return S.freed(S.deletion_plan(S.default_selection(m), t.assets, m), hidden(t))


@query("agg_17", _G + "SELECT count(*) FILTER (category = 'exact') AS exact, count(*) FILTER (category = 'near') AS similar, count(*) FILTER (media_type = 'video') AS videos FROM plan")
def agg_17(t):
    m = members(t)
    plan = S.deletion_plan(S.default_selection(m), t.assets, m)
    return C.count_flags(plan, exact=F.col("category") == "exact", similar=F.col("category") == "near", videos=F.col("media_type") == "video")


@query("agg_23", _G + "SELECT count(DISTINCT group_id) FILTER (kind = 'exact') AS exact_groups, count(DISTINCT group_id) FILTER (kind = 'near') AS near_groups, (SELECT count(DISTINCT id) FROM m0 WHERE id NOT IN (SELECT id FROM one)) AS unavailable FROM m")
def agg_23(t):
    gone = raw_groups(t).select("id").distinct().join(t.assets.select("id"), "id", "left_anti").agg(F.count("*").alias("unavailable"))
    groups = members(t).select("group_id", "kind").distinct()
    return C.count_flags(groups, exact_groups=F.col("kind") == "exact", near_groups=F.col("kind") == "near").withColumn("k", F.lit(1)).join(gone.withColumn("k", F.lit(1)), "k").drop("k")


@query("pln_02", _G + "SELECT id, media_type, size_bytes, category FROM plan")
def pln_02(t):
    m = members(t)
    return S.deletion_plan(S.default_selection(m), t.assets, m)


@query("pln_03", _G + "SELECT CASE WHEN one.is_hidden THEN 'remaining' ELSE 'deleted' END AS outcome, count(*) AS n FROM plan JOIN one USING (id) GROUP BY 1")
def pln_03(t):
    """What happened to each planned item: planned and no longer there, or still there."""
    m = members(t)
    plan = S.deletion_plan(S.default_selection(m), t.assets, m)
    left = hidden(t).withColumn("left", F.lit(True))
    return plan.join(left, "id", "left").groupBy(F.when(F.col("left"), "remaining").otherwise("deleted").alias("outcome")).agg(F.count("*").alias("n"))


@query("stm_07", _G + "SELECT group_id, kind, id FROM m WHERE id NOT IN (SELECT id FROM one WHERE is_hidden)")
def stm_07(t):
    """Results less what was deleted while they were made."""
    return C.without(members(t), hidden(t)).select("group_id", "kind", "id")


def deck(t) -> DataFrame:
    """Review deck: each asset once, in the first group (by identifier) it is in. ``ord`` counts from 0 within a kind."""
    first = members(t).groupBy("id").agg(F.min(F.struct("kind", "group_id")).alias("g"))
    return first.select("id", "g.kind", "g.group_id")


_DECK = ", deck AS (SELECT id, min((kind, group_id)) AS g FROM m GROUP BY id)"


@query("win_07", _G + _DECK + "SELECT id, g[1] AS kind, g[2] AS group_id FROM deck")
def win_07(t):
    """Each asset once with the group it is first shown in."""
    return deck(t)


@query("joi_10", _G + _DECK + "SELECT count(*) AS items, count(*) FILTER (id < '8') AS cursor FROM deck WHERE id IN (SELECT id FROM one WHERE NOT coalesce(is_hidden, false))")
def joi_10(t):
    """A deck reconciled with what is there, and where its reader stands: the kept rows before the old place."""
    kept = deck(t).join(C.visible(t.assets).select("id"), "id", "left_semi")
    return kept.agg(F.count("*").alias("items"), F.count_if(F.col("id") < "8").alias("cursor"))


@query("joi_11", _G + _DECK + "SELECT id FROM deck WHERE id IN (SELECT id FROM sel) AND id IN (SELECT id FROM one WHERE size_bytes IS NOT NULL) AND id IN (SELECT id FROM h)")
def joi_11(t):
    m = members(t)
    out = deck(t).select("id")
    for side in (S.default_selection(m), t.assets.where("size_bytes IS NOT NULL"), t.phash_entries.where("bits IS NOT NULL").select(F.col("asset_id").alias("id"))):
        out = out.join(side.select("id"), "id", "left_semi")
    return out


@query("agg_22", "SELECT user_id, count(*) FILTER (event_type = 'error') AS deletes FROM (SELECT user_id, props, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id, props) GROUP BY user_id")
def agg_22(t):
    """Items whose last decision is to delete; an error event stands for one."""
    last = t.events.groupBy("user_id", "props").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("event_type"))
    return last.groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("deletes"))
