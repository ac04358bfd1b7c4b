"""Queries over the asset catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import catalog as C
from ..sources import sinks
from ..scratch import Scratch
from . import Tables, query

NOW = "2024-02-01 00:00:00"
_SHOT = "(coalesce(subtype_mask, 0) & 4) <> 0"
_VISIBLE = "NOT coalesce(is_hidden, false)"
_ONE = "SELECT DISTINCT * FROM assets WHERE id IS NOT NULL"
#: Bytes measured again for every asset with a size: what a later measurement would bring.
_MEASURED = "SELECT id, max(width::BIGINT * height) AS bytes FROM assets WHERE id IS NOT NULL AND width > 0 AND height > 0 GROUP BY id"
_NEWEST = "created DESC NULLS LAST, id"


def measured(t: Tables) -> DataFrame:
    return t.assets.where("width > 0 AND height > 0").groupBy("id").agg(F.max(F.col("width").cast("bigint") * F.col("height")).alias("bytes"))


@query("src_01", f"SELECT id, created FROM assets WHERE {_VISIBLE}")
def src_01(t):
    return C.visible(t.assets).orderBy(F.desc_nulls_last("created"), "id").select("id", "created")


@query("src_02", f"SELECT id, created FROM assets WHERE {_VISIBLE} ORDER BY {_NEWEST} LIMIT 100 OFFSET 100")
def src_02(t):
    return C.page(t.assets, 100, 200).select("id", "created")


@query("src_03", f"WITH v AS (SELECT row_number() OVER (ORDER BY {_NEWEST}) - 1 AS k, count(*) OVER () AS total FROM assets WHERE {_VISIBLE}) SELECT k // 512 AS chunk, count(*) AS rows, max(k) + 1 AS completed, max(total) AS total FROM v WHERE k // 512 < 30 GROUP BY 1")
def src_03(t):
    """Progress of a scan in chunks, newest first, cancelled after thirty of them."""
    order = [F.desc_nulls_last("created"), F.asc_nulls_last("id")]
    return C.chunks(C.visible(t.assets), order, Scratch(t.spark, "chunks"), cancelled_after=30)


@query("src_04", "SELECT id, given, family, organization, len(phones)::INT AS n_phones, len(emails)::INT AS n_emails FROM contacts")
def src_04(t):
    return t.contacts.select("id", "given", "family", "organization", F.size("phones").alias("n_phones"), F.size("emails").alias("n_emails")).orderBy("id")


@query("src_05", "SELECT CASE WHEN media_type IN ('image', 'video', 'audio') THEN media_type ELSE 'unknown' END AS media_type, count(*) AS n FROM assets GROUP BY 1")
def src_05(t):
    return C.known_media_type(t.assets).groupBy("media_type").agg(F.count("*").alias("n"))


@query("src_06", "SELECT 256000000000 AS total_bytes, 256000000000 - coalesce(sum(size_bytes), 0)::BIGINT AS available_bytes FROM assets")
def src_06(t):
    return t.assets.agg(F.lit(256_000_000_000).alias("total_bytes"), (F.lit(256_000_000_000) - F.coalesce(F.sum("size_bytes"), F.lit(0))).alias("available_bytes"))


@query("src_07", "SELECT id, CASE WHEN width % 3 = 0 AND size_bytes > 0 THEN size_bytes WHEN (source_mask & 2) <> 0 THEN NULL WHEN floor(duration * 1000) > 0 THEN floor(duration * 1000)::BIGINT WHEN is_hidden THEN NULL WHEN has_adjustments AND width::BIGINT * height > 0 THEN width::BIGINT * height WHEN width > 2000 THEN width WHEN height > 0 THEN height END::BIGINT AS bytes FROM assets")
def src_07(t):
    """Sizes by five probes, made from columns of the catalog; shared assets are remote, hidden ones have a remote original."""
    a = {c: F.col(c) for c in ("width", "height")}
    probes = [
        F.when(a["width"] % 3 == 0, F.col("size_bytes")), F.floor(F.col("duration") * 1000), C.has_bit(F.col("source_mask"), 1),
        F.when(F.col("has_adjustments"), a["width"].cast("bigint") * a["height"]), F.col("is_hidden"), F.when(a["width"] > 2000, a["width"]), a["height"],
    ]
    return t.assets.select("id", C.size_ladder(*probes).cast("bigint").alias("bytes"))


@query("src_08", "WITH s AS (SELECT id, max(size_bytes) AS bytes FROM assets GROUP BY id) SELECT r.asset_id AS id, CASE WHEN bytes IS NULL THEN 'unavailable' ELSE 'measured' END AS outcome, bytes FROM (SELECT DISTINCT asset_id FROM phash_entries) r LEFT JOIN s ON s.id = r.asset_id")
def src_08(t):
    return C.outcomes(t.phash_entries.select(F.col("asset_id").alias("id")), t.assets.select("id", F.col("size_bytes").alias("bytes")))


@query("src_09", "SELECT media_type, sum(size_bytes)::BIGINT AS bytes, count(*) AS n FROM assets WHERE media_type IN ('image', 'video') GROUP BY media_type")
def src_09(t):
    """Resources that count towards freed space: photos and videos, no sound or unknown payload."""
    return t.assets.where(F.col("media_type").isin("image", "video")).groupBy("media_type").agg(F.sum("size_bytes").alias("bytes"), F.count("*").alias("n"))


_RESOLVE = "CASE WHEN is_hidden THEN 'cancelled' WHEN (source_mask & 2) <> 0 THEN 'cloudOnly' WHEN media_type NOT IN ('image', 'video') THEN 'error' WHEN (subtype_mask & 8) <> 0 AND duration = 0 THEN 'missingMovie' WHEN size_bytes IS NULL THEN 'noContent' WHEN size_bytes = 0 THEN 'zeroBytes' END"


@query("src_10", f"SELECT id, CASE WHEN r IS NULL THEN size_bytes END AS bytes, r AS reason FROM (SELECT id, size_bytes, {_RESOLVE} AS r FROM assets)")
def src_10(t):
    """Content bytes or the first reason against them."""
    return t.assets.withColumn("reason", C.content_reason()).select("id", F.when(F.col("reason").isNull(), F.col("size_bytes")).alias("bytes"), "reason")


@query("src_12", "SELECT id, coalesce(CASE WHEN least(width, height) >= 2160 THEN 2160 END, CASE WHEN least(width, height) >= 1080 THEN 1080 END, CASE WHEN least(width, height) >= 480 THEN 480 END) AS rendition FROM assets")
def src_12(t):
    """The largest rendition an asset can be shown at, from a falling ladder."""
    short = F.least("width", "height")
    return t.assets.select("id", F.coalesce(*[F.when(short >= s, F.lit(s)) for s in (2160, 1080, 480)]).alias("rendition"))


@query("snk_01", "SELECT DISTINCT id, size_bytes FROM assets")
def snk_01(t):
    """A snapshot written twice and read back: the latest replaces the former."""
    store = sinks.SnapshotStore(t.spark, sinks.scratch_folder(t.spark, "snapshot"), schema_version=1)
    store.save(t.assets.select("id", "size_bytes").where("size_bytes IS NULL"))
    store.save(t.assets.select("id", "size_bytes").distinct())
    return store.load_latest()


@query("snk_02", "SELECT media_type AS kind, count(*) AS n FROM assets WHERE media_type IN ('image', 'video') GROUP BY 1")
def snk_02(t):
    """A checkpoint for each kind of evidence; one of another schema version reads as none."""
    folder = sinks.scratch_folder(t.spark, "checkpoints")
    store = sinks.CheckpointStore(t.spark, folder, schema_version=2)
    for kind in ("image", "video"):
        store.save(kind, t.assets.where(F.col("media_type") == kind).select("id", "modified"))
    sinks.CheckpointStore(t.spark, folder, schema_version=1).save("audio", t.assets.select("id", "modified"))
    found = [store.load(kind).select(F.lit(kind).alias("kind")) for kind in ("image", "video", "audio") if store.load(kind) is not None]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.groupBy("kind").agg(F.count("*").alias("n"))


@query("snk_05", "SELECT DISTINCT id FROM assets WHERE id NOT IN (SELECT asset_id FROM phash_entries WHERE asset_id IS NOT NULL)")
def snk_05(t):
    """The catalog after a deletion of all hashed assets."""
    return C.without(t.assets.select("id").distinct(), t.phash_entries.select(F.col("asset_id").alias("id")))


@query("prj_01", f"SELECT id, media_type = 'image' AS is_image, media_type = 'video' AS is_video, {_SHOT} AS is_screenshot, (subtype_mask & 8) <> 0 AS is_live_photo, width::BIGINT * height AS pixel_count, size_bytes IS NOT NULL AS is_size_known FROM assets")
def prj_01(t):
    return C.with_flags(t.assets).select("id", "is_image", "is_video", "is_screenshot", "is_live_photo", "pixel_count", "is_size_known")


@query("prj_03", f"SELECT a.id, coalesce(m.bytes, a.size_bytes) AS size_bytes FROM assets a LEFT JOIN ({_MEASURED}) m USING (id)")
def prj_03(t):
    return C.resolve_sizes(t.assets, measured(t)).select("id", "size_bytes")


@query("prj_02", "SELECT id, coalesce(nullif(width, 0)::BIGINT, size_bytes) AS size_bytes FROM assets")
def prj_02(t):
    """A size override: where one is known it replaces the recorded size."""
    return t.assets.select("id", F.coalesce(F.when(F.col("width") != 0, F.col("width").cast("bigint")), "size_bytes").alias("size_bytes"))


@query("prj_04", f"SELECT a.id, coalesce(a.size_bytes, m.bytes) AS size_bytes FROM assets a LEFT JOIN ({_MEASURED}) m USING (id)")
def prj_04(t):
    return C.resolve_sizes(t.assets, measured(t), only_unknown=True).select("id", "size_bytes")


@query("prj_05", "SELECT id, coalesce(is_favorite, false) AS favorite, coalesce(represents_burst, false) AS burst, coalesce(width::BIGINT * height, 0) AS pixels, coalesce(has_adjustments, false) AS adjusted FROM assets")
def prj_05(t):
    o = C.best_order()
    return t.assets.select("id", (~o["o1"]).alias("favorite"), o["o2"].alias("burst"), (-o["o3"]).alias("pixels"), (~o["o4"]).alias("adjusted"))


_ASPECT = "CASE WHEN least(width, height) > 0 THEN round(greatest(width, height) / least(width, height)::DOUBLE / 0.01)::BIGINT ELSE 9223372036854775807 END"


@query("prj_06", f"SELECT id, {_ASPECT} AS aspect FROM assets")
def prj_06(t):
    return t.assets.select("id", C.aspect_key().alias("aspect"))


@query("prj_07", "SELECT id, round(duration / 0.1)::BIGINT AS duration_key FROM assets")
def prj_07(t):
    return t.assets.select("id", C.duration_key().alias("duration_key"))


@query("prj_08", "SELECT doc_id, sha256(text) || '/' || coalesce(sha256(asset_id), '-') AS digest, strlen(text) + coalesce(strlen(asset_id), 0) AS total_bytes FROM documents WHERE text IS NOT NULL")
def prj_08(t):
    """Digest and bytes of a two-part content; a missing part shows as a dash."""
    text, other = F.col("text"), F.col("asset_id")
    sha = lambda c: F.sha2(F.encode(c, "UTF-8"), 256)
    return t.documents.where("text IS NOT NULL").select("doc_id", F.concat_ws("/", sha(text), F.coalesce(sha(other), F.lit("-"))).alias("digest"), (F.octet_length(text) + F.coalesce(F.octet_length(other), F.lit(0))).cast("bigint").alias("total_bytes"))


@query("prj_11", "SELECT store_id, greatest(0, c - a) AS used, CASE WHEN c > 0 THEN round(greatest(0, c - a) / c::DOUBLE, 6) ELSE 0 END AS used_share FROM (SELECT store_id, 16 - trust_rank AS c, trust_rank - 1 AS a FROM stores)")
def prj_11(t):
    """Used part of a capacity, also for a capacity of zero."""
    c, a = 16 - F.col("trust_rank"), F.col("trust_rank") - 1
    used = F.greatest(F.lit(0), c - a)
    return t.stores.select("store_id", used.alias("used"), F.when(c > 0, F.round(used / c, 6)).otherwise(0.0).alias("used_share"))


@query("prj_12", "SELECT media_type, count(size_bytes) = count(*) AS is_complete, CASE WHEN count(*) > 0 THEN round(count(size_bytes) / count(*)::DOUBLE, 6) END AS fraction FROM assets GROUP BY media_type")
def prj_12(t):
    n, done = F.count("*"), F.count("size_bytes")
    return t.assets.groupBy("media_type").agg((done == n).alias("is_complete"), F.round(F.try_divide(done, n), 6).alias("fraction"))


_CLASS = "CASE WHEN (coalesce(source_mask, 0) & 4) <> 0 THEN 'downloaded' WHEN (coalesce(source_mask, 0) & 2) <> 0 THEN 'other' ELSE 'recorded' END"


@query("prj_13", f"SELECT id, {_CLASS} AS source_class FROM assets WHERE media_type = 'video'")
def prj_13(t):
    return t.assets.where("media_type = 'video'").select("id", C.video_class().alias("source_class"))


@query("prj_15", f"SELECT id, created FROM assets WHERE media_type = 'image' AND {_VISIBLE}")
def prj_15(t):
    return C.visible(t.assets).where("media_type = 'image'").select("id", "created")


@query("prj_16", "SELECT media_type, CASE WHEN count(size_bytes) > 0 THEN round(sum(size_bytes) / 256000000000.0::DOUBLE, 9) END AS fraction FROM assets GROUP BY media_type")
def prj_16(t):
    return t.assets.groupBy("media_type").agg(F.when(F.count("size_bytes") > 0, F.round(F.sum("size_bytes") / 256_000_000_000.0, 9)).alias("fraction"))


@query("flt_01", f"SELECT id, created FROM assets WHERE {_SHOT}")
def flt_01(t):
    return t.assets.where(C.is_screenshot()).select("id", "created")


@query("flt_02", "SELECT id, duration FROM assets WHERE media_type = 'video'")
def flt_02(t):
    return t.assets.where("media_type = 'video'").select("id", "duration")


@query("flt_03", "SELECT DISTINCT id, created FROM assets WHERE id IN (SELECT asset_id FROM phash_entries WHERE bits IS NULL)")
def flt_03(t):
    candidates = t.phash_entries.where("bits IS NULL").select(F.col("asset_id").alias("id"))
    return t.assets.select("id", "created").distinct().join(candidates, "id", "left_semi")


@query("flt_04", f"SELECT id, created FROM assets WHERE {_SHOT} AND created IS NOT NULL AND TIMESTAMP '{NOW}' - created >= INTERVAL 90 DAY")
def flt_04(t):
    return C.old_screenshots(t.assets, F.lit(NOW).cast("timestamp")).select("id", "created")


@query("flt_05", f"SELECT id FROM assets WHERE {_SHOT} AND created IS NULL")
def flt_05(t):
    return t.assets.where(C.is_screenshot() & F.col("created").isNull()).select("id")


_ELIGIBLE = "CASE WHEN media_type = 'video' THEN 'video' WHEN media_type = 'image' AND width >= 1 AND height >= 1 THEN 'image' WHEN media_type = 'image' THEN 'invalidDimensions' ELSE 'unsupportedMediaType' END"


@query("flt_06", f"SELECT id, {_ELIGIBLE} AS route FROM assets")
def flt_06(t):
    return t.assets.select("id", C.eligibility().alias("route"))


@query("flt_07", "SELECT id, 'unsupportedMediaType' AS reason FROM assets WHERE media_type IS NULL OR media_type NOT IN ('image', 'video')")
def flt_07(t):
    return t.assets.select("id", C.eligibility().alias("reason")).where("reason = 'unsupportedMediaType'")


@query("flt_08", "SELECT a.id, CASE WHEN p.asset_id IS NOT NULL THEN 'seeded' WHEN media_type <> 'image' THEN 'notImage' WHEN width <= 0 OR height <= 0 THEN 'invalidDimensions' ELSE 'work' END AS route FROM assets a LEFT JOIN (SELECT DISTINCT asset_id FROM phash_entries WHERE bits IS NOT NULL) p ON p.asset_id = a.id")
def flt_08(t):
    seeded = t.phash_entries.where("bits IS NOT NULL").select(F.col("asset_id").alias("id"), F.lit(True).alias("seeded")).distinct()
    route = F.when(F.col("seeded"), "seeded").when(F.col("media_type") != "image", "notImage").when((F.col("width") <= 0) | (F.col("height") <= 0), "invalidDimensions").otherwise("work")
    return t.assets.join(seeded, "id", "left").select("id", route.alias("route"))


@query("flt_11", f"SELECT {_CLASS} AS source_class, count(*) AS n, count(*) FILTER (size_bytes IS NOT NULL) AS known, count(*) FILTER (size_bytes IS NULL) AS unknown FROM assets WHERE media_type = 'video' GROUP BY 1")
def flt_11(t):
    return t.assets.where("media_type = 'video'").groupBy(C.video_class().alias("source_class")).agg(F.count("*").alias("n"), F.count_if(F.col("size_bytes").isNotNull()).alias("known"), F.count_if(F.col("size_bytes").isNull()).alias("unknown"))


@query("flt_15", f"SELECT id, TIMESTAMP '{NOW}' - modified > INTERVAL 7 DAY AS is_stale FROM assets WHERE modified IS NOT NULL")
def flt_15(t):
    age = F.unix_micros(F.lit(NOW).cast("timestamp")) - F.unix_micros(F.col("modified").cast("timestamp"))
    return t.assets.where("modified IS NOT NULL").select("id", (age > 7 * 86_400_000_000).alias("is_stale"))


@query("flt_18", "SELECT DISTINCT asset_id AS id FROM phash_entries WHERE asset_id NOT IN (SELECT id FROM assets WHERE id IS NOT NULL AND size_bytes IS NOT NULL)")
def flt_18(t):
    """Selected identifiers that are missing: a plan over them would be refused with this list."""
    return t.phash_entries.select(F.col("asset_id").alias("id")).where("id IS NOT NULL").distinct().join(t.assets.where("size_bytes IS NOT NULL").select("id"), "id", "left_anti")


@query("joi_02", f"SELECT count(*) AS n, sum(size_bytes)::BIGINT AS bytes FROM ({_ONE})")
def joi_02(t):
    return C.first_rows(t.assets).agg(F.count("*").alias("n"), F.sum("size_bytes").alias("bytes"))


@query("joi_03", "SELECT p.asset_id AS id, a.width, a.height FROM (SELECT DISTINCT asset_id FROM phash_entries) p JOIN (SELECT DISTINCT id, width, height FROM assets) a ON a.id = p.asset_id")
def joi_03(t):
    return t.phash_entries.select(F.col("asset_id").alias("id")).distinct().join(C.first_rows(t.assets.select("id", "width", "height")), "id")


@query("joi_06", "SELECT DISTINCT id, created FROM assets WHERE id NOT IN (SELECT asset_id FROM phash_entries WHERE bits IS NULL AND asset_id IS NOT NULL)")
def joi_06(t):
    gone = t.phash_entries.where("bits IS NULL").select(F.col("asset_id").alias("id"))
    return C.without(t.assets.select("id", "created").distinct(), gone)


@query("joi_15", f"SELECT a.id, a.modified, m.bytes FROM (SELECT DISTINCT id, modified FROM assets WHERE media_type = 'video') a JOIN ({_MEASURED}) m USING (id)")
def joi_15(t):
    return t.assets.where("media_type = 'video'").select("id", "modified").distinct().join(measured(t), "id").orderBy("id")


@query("agg_01", f"SELECT count(*) AS assets, count(*) FILTER (media_type = 'image') AS images, count(*) FILTER (media_type = 'video') AS videos, count(*) FILTER ({_SHOT}) AS screenshots, count(*) FILTER ((subtype_mask & 8) <> 0) AS live_photos, count(*) FILTER (has_adjustments) AS adjusted, (SELECT id FROM assets WHERE media_type = 'image' ORDER BY {_NEWEST} LIMIT 1) AS first_image FROM assets")
def agg_01(t):
    return C.summary(t.assets).drop("known_bytes")


@query("agg_02", "SELECT coalesce(sum(size_bytes), 0)::BIGINT AS known_bytes FROM assets")
def agg_02(t):
    return C.summary(t.assets).select("known_bytes")


@query("agg_03", "SELECT coalesce(sum(size_bytes), 0)::BIGINT AS measured_bytes, count(size_bytes) AS measured, count(*) - count(size_bytes) AS unresolved, count(*) = count(size_bytes) AS is_exact, count(size_bytes) = 0 AND count(*) > 0 AS is_unresolved FROM assets")
def agg_03(t):
    return C.size_summary(t.assets)


@query("agg_09", "SELECT media_type, greatest(count(*) - count(*) FILTER (size_bytes IS NULL), 0) AS analyzed FROM assets GROUP BY media_type")
def agg_09(t):
    return t.assets.groupBy("media_type").agg(F.greatest(F.count("*") - F.count_if(F.col("size_bytes").isNull()), F.lit(0)).alias("analyzed"))


@query("agg_10", f"SELECT greatest(count(*) - count(*) FILTER ({_ELIGIBLE} NOT IN ('image', 'video')) - count(*) FILTER (is_hidden), 0) AS analyzed FROM assets")
def agg_10(t):
    return t.assets.agg(F.greatest(F.count("*") - F.count_if(~C.eligibility().isin("image", "video")) - F.count_if("is_hidden"), F.lit(0)).alias("analyzed"))


@query("agg_16", "SELECT count(*) FILTER (size_bytes IS NOT NULL) AS measured, count(*) FILTER (size_bytes IS NULL AND (source_mask & 2) <> 0) AS unavailable, count(*) FILTER (size_bytes IS NOT NULL OR (source_mask & 2) <> 0) AS resolved FROM assets WHERE media_type = 'video'")
def agg_16(t):
    size, cloud = F.col("size_bytes"), C.has_bit(F.col("source_mask"), 1)
    return C.count_flags(t.assets.where("media_type = 'video'"), measured=size.isNotNull(), unavailable=size.isNull() & cloud, resolved=size.isNotNull() | cloud)


@query("agg_19", f"SELECT count(*) FILTER (media_type = 'video') AS videos, count(*) FILTER ({_SHOT}) AS screenshots, count(*) FILTER (media_type = 'video' OR {_SHOT}) = 0 AS is_empty FROM assets")
def agg_19(t):
    video = F.col("media_type") == "video"
    return C.count_flags(t.assets, videos=video, screenshots=C.is_screenshot(), either=video | C.is_screenshot()).withColumn("is_empty", F.col("either") == 0).drop("either")


@query("agg_20", f"SELECT reason, count(*) AS n FROM (SELECT {_RESOLVE} AS reason FROM assets) WHERE reason IS NOT NULL GROUP BY reason")
def agg_20(t):
    return t.assets.select(C.content_reason().alias("reason")).where("reason IS NOT NULL").groupBy("reason").agg(F.count("*").alias("n"))


@query("agg_21", f"SELECT media_type, reason, count(*) AS n, round(sum(duration), 3) AS duration FROM (SELECT *, coalesce({_RESOLVE}, 'ok') AS reason FROM assets) GROUP BY ALL")
def agg_21(t):
    """Run metrics: rows and duration sums by reason and media type."""
    return t.assets.withColumn("reason", F.coalesce(C.content_reason(), F.lit("ok"))).groupBy("media_type", "reason").agg(F.count("*").alias("n"), F.round(F.sum("duration"), 3).alias("duration"))


@query("srt_01", "SELECT id, size_bytes, created FROM assets WHERE media_type = 'video' ORDER BY size_bytes DESC NULLS LAST, created DESC NULLS LAST, id")
def srt_01(t):
    return t.assets.where("media_type = 'video'").select("id", "size_bytes", "created").orderBy(F.desc_nulls_last("size_bytes"), F.desc_nulls_last("created"), "id")


@query("srt_02", "SELECT id, created FROM assets ORDER BY created NULLS FIRST, id")
def srt_02(t):
    return t.assets.select("id", "created").orderBy(F.asc_nulls_first("created"), "id")


@query("srt_07", f"SELECT DISTINCT id, created FROM assets WHERE media_type = 'video' AND id NOT IN (SELECT id FROM ({_MEASURED}) WHERE bytes > 2000000)")
def srt_07(t):
    done = measured(t).where("bytes > 2000000")
    return C.without(t.assets.where("media_type = 'video'").select("id", "created").distinct(), done).orderBy(F.desc_nulls_last("created"), "id")


@query("prf_01", f"SELECT width, height, arg_min(id, (NOT coalesce(is_favorite, false), coalesce(represents_burst, false), NOT coalesce(has_adjustments, false), -epoch_us(coalesce(created, TIMESTAMP '0001-01-01')), id)) AS best_id FROM ({_ONE}) GROUP BY width, height")
def prf_01(t):
    return C.best_of(t.assets, ["width", "height"])


@query("hsh_06", "SELECT doc_id, sha256(text) AS sha FROM documents WHERE text IS NOT NULL")
def hsh_06(t):
    return t.documents.where("text IS NOT NULL").select("doc_id", F.sha2(F.encode("text", "UTF-8"), 256).alias("sha"))


@query("fmt_02", "SELECT id, CASE WHEN s >= 3600 THEN (s // 3600) || ':' || lpad(((s % 3600) // 60)::VARCHAR, 2, '0') || ':' || lpad((s % 60)::VARCHAR, 2, '0') ELSE (s // 60) || ':' || lpad((s % 60)::VARCHAR, 2, '0') END AS duration_text FROM (SELECT id, round(duration)::BIGINT AS s FROM assets WHERE media_type = 'video')")
def fmt_02(t):
    s = F.round("duration").cast("bigint")
    two = lambda c: F.lpad(c.cast("bigint").cast("string"), 2, "0")
    long = F.concat_ws(":", F.floor(s / 3600).cast("string"), two(F.floor((s % 3600) / 60)), two(s % 60))
    return t.assets.where("media_type = 'video'").select("id", F.when(s >= 3600, long).otherwise(F.concat_ws(":", F.floor(s / 60).cast("string"), two(s % 60))).alias("duration_text"))


@query("fmt_03", "SELECT id, CASE WHEN s IS NULL THEN NULL WHEN s <= 0 THEN '0 GB' WHEN s < 999950000 THEN regexp_replace(format('{:.1f}', round(s / 1e6, 1)), '\\.0$', '') || ' MB' ELSE regexp_replace(format('{:.2f}', round(s / 1e9, 2)), '\\.?0+$', '') || ' GB' END AS size_text FROM (SELECT DISTINCT id, size_bytes * (CASE WHEN width % 7 = 0 THEN 1000 ELSE 1 END) AS s FROM assets)")
def fmt_03(t):
    size = F.col("size_bytes") * F.when(F.col("width") % 7 == 0, 1000).otherwise(1)
    return t.assets.select("id", size.alias("s")).distinct().select("id", C.byte_text(F.col("s")).alias("size_text"))
