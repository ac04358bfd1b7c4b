"""Queries over checkpoints, evidence and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import catalog as C
from ..scratch import Scratch
from ..streaming import evidence as E
from . import query

_EVIDENCE = "SELECT asset_id AS id, modified, bits FROM phash_entries"


def evidence(t) -> DataFrame:
    return t.phash_entries.select(F.col("asset_id").alias("id"), "modified", "bits")


@query("joi_04", f"SELECT DISTINCT e.id, e.modified, e.bits FROM ({_EVIDENCE}) e JOIN assets a ON a.id = e.id AND a.modified IS NOT DISTINCT FROM e.modified")
def joi_04(t):
    return E.reconcile(evidence(t), t.assets).distinct()


@query("joi_05", f"SELECT DISTINCT e.id, e.bits % 4 AS verdict FROM ({_EVIDENCE}) e JOIN assets a ON a.id = e.id AND a.modified IS NOT DISTINCT FROM e.modified WHERE bits IS NOT NULL AND (bits % 4 NOT IN (1, -1) OR a.size_bytes IS NOT NULL)")
def joi_05(t):
    """Seeds of verdicts: candidates (remainder one) only with a score; the size stands for it."""
    scored = t.assets.where("size_bytes IS NOT NULL").select("id", "modified")
    seeds = E.reconcile(evidence(t).where("bits IS NOT NULL"), t.assets).withColumn("verdict", F.col("bits") % 4)
    plain = seeds.where("verdict NOT IN (1, -1)")
    return plain.unionByName(E.reconcile(seeds.where("verdict IN (1, -1)"), scored)).select("id", "verdict").distinct()


@query("prf_02", "SELECT lang, arg_min(source, (rank, doc_id)) AS worst FROM (SELECT *, CASE source WHEN 'support_tickets' THEN 0 WHEN 'forum_posts' THEN 1 WHEN 'store_reviews' THEN 2 ELSE 3 END AS rank FROM documents WHERE source IS NOT NULL) GROUP BY lang")
def prf_02(t):
    """The first of the worst by a fixed ranking."""
    rank = F.when(F.col("source") == "support_tickets", 0).when(F.col("source") == "forum_posts", 1).when(F.col("source") == "store_reviews", 2).otherwise(3)
    return t.documents.where("source IS NOT NULL").groupBy("lang").agg(F.min_by("source", F.struct(rank, "doc_id")).alias("worst"))


@query("prf_03", "WITH c AS (SELECT conflict_id, max(kept) AS kept FROM merge_conflicts WHERE conflict_id % 3 = 0 GROUP BY 1), o AS (SELECT conflict_id, max(coalesce(not_copied, '')) AS kept FROM merge_conflicts WHERE conflict_id > 40 AND conflict_id % 2 = 0 GROUP BY 1) SELECT conflict_id, CASE WHEN c.conflict_id IS NULL THEN o.kept WHEN o.conflict_id IS NULL THEN c.kept ELSE greatest(coalesce(c.kept, ''), o.kept) END AS kept FROM c FULL JOIN o USING (conflict_id)")
def prf_03(t):
    """The greater of stored and offered rows of each key; offered ones at or below the blocked sequence are refused."""
    stored = t.merge_conflicts.where("conflict_id % 3 = 0").select("conflict_id", F.col("conflict_id").alias("sequence"), "kept")
    offered = t.merge_conflicts.where("conflict_id % 2 = 0").select("conflict_id", F.col("conflict_id").alias("sequence"), F.coalesce("not_copied", F.lit("")).alias("kept"))
    return E.accept_newer(stored, offered, ["conflict_id"], ["sequence"], blocked=40).select("conflict_id", "kept")


@query("prf_04", "WITH d AS (SELECT DISTINCT id, created FROM assets WHERE media_type = 'image'), k AS (SELECT id, row_number() OVER (ORDER BY created NULLS FIRST, id) - 1 AS place FROM d) SELECT id, CASE WHEN place < 200 THEN place ELSE 200 + row_number() OVER (PARTITION BY place < 200 ORDER BY md5('7:' || id), id) - 1 END AS place FROM k")
def prf_04(t):
    """A deck whose rows from the cursor on are put into a seeded order; those before it keep their places."""
    deck = t.assets.where("media_type = 'image'").select("id", "created").distinct()
    return C.shuffle_tail(deck, [F.asc_nulls_first("created"), F.asc("id")], 200, 7, Scratch(t.spark, "deck"))


@query("stm_01", "SELECT media_type, count(*) AS n FROM assets GROUP BY media_type")
def stm_01(t):
    """A scan with an observed row count beside its result."""
    observed, _ = E.progress(t.assets, "scan")
    return observed.groupBy("media_type").agg(F.count("*").alias("n"))


@query("stm_02", "SELECT date_trunc('hour', ts) AS hour, max(event_id) AS progress FROM events GROUP BY 1")
def stm_02(t):
    """Progress thinned to one report an interval, the greatest value of each."""
    return t.events.groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")).agg(F.max("event_id").alias("progress"))


_LATEST = f"SELECT id, max(coalesce(epoch_us(modified), -1)) AS newest FROM ({_EVIDENCE}) WHERE id IS NOT NULL GROUP BY id"


@query("stm_03", _LATEST)
def stm_03(t):
    """A file stream of evidence folded into the latest row of each asset."""
    s = Scratch(t.spark, "stream")
    evidence(t).where("id IS NOT NULL").repartition(4).write.parquet(f"{s.root}/in")
    run = E.EvidenceStream(t.spark, f"{s.root}/in", f"{s.root}/out", f"{s.root}/checkpoint", evidence(t).schema, files_per_batch=2)
    return run.run().select("id", F.coalesce(F.unix_micros(F.col("modified").cast("timestamp")), F.lit(-1)).alias("newest"))


@query("stm_04", f"SELECT DISTINCT id FROM ({_EVIDENCE}) WHERE id IS NOT NULL")
def stm_04(t):
    """A run resumed: the second starts from the first one's checkpoint and reads only the new files."""
    s = Scratch(t.spark, "resume")
    rows = evidence(t).where("id IS NOT NULL")
    run = E.EvidenceStream(t.spark, f"{s.root}/in", f"{s.root}/out", f"{s.root}/checkpoint", rows.schema)
    rows.where("id < '8'").write.parquet(f"{s.root}/in")
    run.run()
    rows.where("id >= '8'").write.mode("append").parquet(f"{s.root}/in")
    return run.run().select("id").distinct()


@query("stm_05", "SELECT store_id, CASE WHEN min(trust_rank) <= 5 THEN 'similarity' WHEN min(trust_rank) <= 10 THEN 'blur' ELSE 'videoSizes' END AS resumed FROM stores GROUP BY store_id")
def stm_05(t):
    """Which of several unfinished kinds of work goes first, by a fixed priority."""
    kind = F.when(F.col("trust_rank") <= 5, "similarity").when(F.col("trust_rank") <= 10, "blur").otherwise("videoSizes")
    return t.stores.groupBy("store_id").agg(F.min_by(kind, F.col("trust_rank")).alias("resumed"))


@query("stm_06", "SELECT event_id, user_id FROM events WHERE event_type = (SELECT arg_max(event_type, (ts, event_id)) FROM events)")
def stm_06(t):
    """Rows of the current generation only; the type of the last event stands for it."""
    current = t.events.agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("event_type"))
    return t.events.join(F.broadcast(current), "event_type").select("event_id", "user_id")


@query("stm_08", "SELECT id, max(size_bytes) AS bytes FROM assets WHERE media_type = 'video' AND size_bytes IS NOT NULL AND id IS NOT NULL GROUP BY id")
def stm_08(t):
    """Sizes measured in small batches, the newest videos first, each batch published when done."""
    s = Scratch(t.spark, "sizes")
    videos = t.assets.where("media_type = 'video' AND size_bytes IS NOT NULL AND id IS NOT NULL").select("id", F.col("size_bytes").alias("bytes")).distinct()
    videos.repartition(4).write.parquet(f"{s.root}/in")
    run = E.EvidenceStream(t.spark, f"{s.root}/in", f"{s.root}/out", f"{s.root}/checkpoint", videos.schema, order=("bytes",), files_per_batch=2)
    return run.run()


@query("stm_09", "SELECT DISTINCT id, media_type FROM assets WHERE size_bytes IS NULL")
def stm_09(t):
    """The snapshot of the last completed run, as a new session restores it."""
    from ..sources import sinks

    folder = sinks.scratch_folder(t.spark, "restore")
    sinks.SnapshotStore(t.spark, folder, 1).save(t.assets.where("size_bytes IS NULL").select("id", "media_type").distinct())
    return sinks.SnapshotStore(t.spark, folder, 1).load_latest()


@query("stm_10", f"SELECT id, max(coalesce(epoch_us(modified), -1)) AS newest FROM ({_EVIDENCE}) WHERE id IS NOT NULL AND bits % 2 = 0 GROUP BY id")
def stm_10(t):
    """A run paused: what has come in is published at once. Evidence of another run (the odd patterns) is refused."""
    s = Scratch(t.spark, "pause")
    rows = evidence(t).where("id IS NOT NULL AND bits IS NOT NULL").withColumn("run_id", F.abs(F.col("bits") % 2).cast("int"))
    rows.repartition(4).write.parquet(f"{s.root}/in")
    run = E.EvidenceStream(t.spark, f"{s.root}/in", f"{s.root}/out", f"{s.root}/checkpoint", rows.schema, run_id=0, files_per_batch=2)
    run.pause(run.start("100 milliseconds"))
    return run.load().select("id", F.coalesce(F.unix_micros(F.col("modified").cast("timestamp")), F.lit(-1)).alias("newest"))


_ERRORS = ["timeout", "onlyInICloud", "permissionDenied", "assetNotFound", "unavailable", "backendUnavailable", "invalidImage", "other"]


@query("flt_19", "SELECT event_id, CASE event_id % 8 WHEN 0 THEN 'timedOut' WHEN 1 THEN 'contentOnlyInICloud' WHEN 2 THEN 'permissionUnavailable' WHEN 3 THEN 'assetNotFound' WHEN 5 THEN d WHEN 6 THEN d ELSE 'imageUnavailable' END AS reason FROM (SELECT event_id, CASE event_type WHEN 'error' THEN 'visionFailed' WHEN 'view' THEN 'cpuDescriptorFailed' ELSE 'imageUnavailable' END AS d FROM events)")
def flt_19(t):
    """Errors of all families, by number, with the kind of descriptor of the run, by event type."""
    error = F.element_at(F.array(*map(F.lit, _ERRORS)), (F.col("event_id") % 8 + 1).cast("int"))
    kind = F.when(F.col("event_type") == "error", "vision").when(F.col("event_type") == "view", "cpuGrid")
    return t.events.select("event_id", error.alias("error"), kind.alias("kind")).select("event_id", C.failure_reason().alias("reason"))


@query("snk_03", "SELECT count(*) AS assets, sum(size_bytes)::BIGINT AS bytes, count(*) = count(size_bytes) AS is_exact FROM assets")
def snk_03(t):
    """A one-row summary written and read back."""
    from ..sources import sinks

    store = sinks.SnapshotStore(t.spark, sinks.scratch_folder(t.spark, "summary"), 1)
    store.save(C.size_summary(t.assets).select((F.col("measured") + F.col("unresolved")).alias("assets"), F.col("measured_bytes").alias("bytes"), "is_exact"))
    return store.load_latest()


@query("snk_04", "SELECT DISTINCT user_id, props, arg_max(event_type, (ts, event_id)) OVER (PARTITION BY user_id, props) AS decision FROM events")
def snk_04(t):
    """Review sessions saved by key: writes that follow each other leave the last decision of each item."""
    from ..sources import sinks

    store = sinks.SnapshotStore(t.spark, sinks.scratch_folder(t.spark, "sessions"), 1)
    last = t.events.groupBy("user_id", "props").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("decision"))
    store.save(last)
    return store.load_latest()
