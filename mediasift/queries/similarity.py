"""Queries over buckets, pairs, groups and pixel measures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import bucketing as B
from ..operators import catalog as C
from ..operators import sharpness as S
from ..operators import similarity as M
from ..scratch import Scratch
from . import query
from .catalog import _ASPECT

_ONE = "SELECT DISTINCT * FROM assets WHERE id IS NOT NULL"
_ELIGIBLE_ROWS = f"SELECT id, created, duration, media_type AS route, {_ASPECT} AS aspect, CASE WHEN media_type = 'video' THEN coalesce(round(duration / 0.1)::BIGINT, 0) ELSE -1 END AS span FROM ({_ONE}) WHERE media_type = 'video' OR media_type = 'image' AND width >= 1 AND height >= 1"
_CHAINS = f"""
WITH e AS ({_ELIGIBLE_ROWS}), t AS (SELECT *, coalesce(epoch_us(created), -4611686018427387904) AS t FROM e),
g AS (SELECT *, lag(t) OVER (PARTITION BY route, aspect, span ORDER BY t, id) AS prev FROM t),
c AS (SELECT *, sum(CASE WHEN prev IS NULL THEN 0 WHEN prev = -4611686018427387904 THEN CASE WHEN t <> prev THEN 1 ELSE 0 END WHEN t - prev > 600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY route, aspect, span ORDER BY t, id ROWS UNBOUNDED PRECEDING) AS chain FROM g)
"""
_KEYS = ["route", "aspect", "span"]


def keyed(t) -> DataFrame:
    routed = C.first_rows(t.assets).withColumn("route", C.eligibility()).where("route IN ('image', 'video')")
    return routed.withColumn("aspect", C.aspect_key()).withColumn("span", F.when(F.col("route") == "video", F.coalesce(C.duration_key(), F.lit(0))).otherwise(F.lit(-1)))


def bucketed(t) -> DataFrame:
    s = Scratch(t.spark, "buckets")
    return s.write(B.buckets(t.assets, s))


@query("agg_07", f"SELECT route, aspect, span, count(*) AS n FROM ({_ELIGIBLE_ROWS}) GROUP BY ALL")
def agg_07(t):
    return keyed(t).groupBy(*_KEYS).agg(F.count("*").alias("n")).withColumn("span", F.col("span").cast("bigint"))


@query("win_01", _CHAINS + "SELECT id, route, aspect, chain::BIGINT AS chain FROM c")
def win_01(t):
    return B.chains(keyed(t), _KEYS, Scratch(t.spark, "chains")).select("id", "route", "aspect", "chain")


def _cut(cap: int, chains: str = _CHAINS) -> str:
    """Chains cut one piece at a time off the front; ``c2`` is ``c`` with ``piece``."""
    return chains.replace("WITH e", "WITH RECURSIVE e") + f"""
, whole AS (SELECT route, aspect, span, chain, list(t ORDER BY t, id) AS ts, list(id ORDER BY t, id) AS ids FROM c GROUP BY ALL)
, cut(route, aspect, span, chain, piece, head, ts, ids) AS (
  SELECT route, aspect, span, chain, -1, []::VARCHAR[], ts, ids FROM whole
  UNION ALL
  SELECT route, aspect, span, chain, piece + 1, array_slice(ids, 1, pos), array_slice(ts, pos + 1, n), array_slice(ids, pos + 1, n) FROM (
    SELECT *, CASE WHEN n <= {cap} THEN n WHEN widest <= 0 THEN least(greatest(n // 2, low), {cap})
      ELSE list_sort([abs(i - n // 2) * 1000000 + i FOR i IN range(low, {cap + 1}) IF ts[i + 1] - ts[i] = widest])[1] % 1000000 END AS pos
    FROM (SELECT *, list_max([ts[i + 1] - ts[i] FOR i IN range(low, {cap + 1})]) AS widest FROM (
      SELECT *, len(ids) AS n, CASE WHEN len(ids) > {2 * cap} THEN 1 ELSE greatest(len(ids) - {cap}, 1) END AS low FROM cut WHERE len(ids) > 0)))
)
, c2 AS (SELECT c.*, piece FROM c JOIN (SELECT route, aspect, span, chain, piece, unnest(head) AS id FROM cut WHERE piece >= 0) x USING (route, aspect, span, chain, id))
"""


_PIECES = _cut(4, _CHAINS.replace("600000000", "2592000000000")) + "SELECT route, aspect, span, chain::BIGINT AS chain, piece::INT AS piece, count(*) AS n, min(id) AS first_id FROM c2 GROUP BY ALL"
_CUT = _cut(64)


@query("win_02", _PIECES)
def win_02(t):
    """Chains cut into pieces of at most four."""
    s = Scratch(t.spark, "pieces")
    return B.split_chains(B.chains(keyed(t), _KEYS, s, 86_400.0 * 30), _KEYS, s, 4).groupBy(*_KEYS, "chain", "piece").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


_BUCKETS = _CUT + ", b AS (SELECT route, aspect, span, chain, piece, count(*) AS n, arg_min(id, (t, id)) AS first_id FROM c2 GROUP BY ALL)"


@query("win_03", _BUCKETS + "SELECT 'a' || aspect || '-' || n || '-' || first_id AS bucket_id, n FROM b WHERE route = 'image'")
def win_03(t):
    """Photo buckets, largest first."""
    return bucketed(t).where("route = 'image'").groupBy("bucket_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "bucket_id")


@query("win_04", _BUCKETS + "SELECT 'v' || aspect || '-d' || span || '-' || n || '-' || first_id AS bucket_id, n FROM b WHERE route = 'video'")
def win_04(t):
    return bucketed(t).where("route = 'video'").groupBy("bucket_id").agg(F.count("*").alias("n"))


@query("srt_03", _BUCKETS + "SELECT n, count(*) AS buckets FROM b GROUP BY n ORDER BY n DESC")
def srt_03(t):
    return bucketed(t).groupBy("bucket_id").agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias("buckets")).orderBy(F.desc("n"))


@query("agg_11", _BUCKETS + "SELECT sum(n * (n - 1) / 2)::BIGINT AS pairs, (sum(n) * (sum(n) - 1) / 2)::BIGINT AS all_pairs, count(*) AS buckets, max(n) AS largest FROM b")
def agg_11(t):
    return B.pair_bound(bucketed(t))


_HASHED = """, h AS (SELECT asset_id AS id, arg_max(bits, (coalesce(modified, TIMESTAMP '0001-01-01'), bits)) AS bits FROM phash_entries WHERE bits IS NOT NULL GROUP BY asset_id)
, hb AS (SELECT c.*, h.bits FROM c2 c JOIN h USING (id))
, p AS (SELECT x.route, x.aspect, x.span, x.chain, x.piece, x.id AS a, y.id AS b, bit_count(xor(x.bits, y.bits))::INT AS distance FROM hb x JOIN hb y ON x.route = y.route AND x.aspect = y.aspect AND x.span = y.span AND x.chain = y.chain AND x.piece = y.piece AND x.id < y.id)
"""


def patterns(t) -> DataFrame:
    """The latest pattern of each asset."""
    return t.phash_entries.where("bits IS NOT NULL AND asset_id IS NOT NULL").groupBy(F.col("asset_id").alias("id")).agg(F.max(F.struct("modified", "bits")).alias("h")).select("id", F.col("h.bits").alias("bits"))


def hashed(t) -> DataFrame:
    return bucketed(t).join(patterns(t), "id")


@query("joi_01", _CUT + _HASHED + "SELECT a, b FROM p")
def joi_01(t):
    return M.bucket_pairs(hashed(t), []).select("a", "b")


@query("mth_01", _CUT + _HASHED + "SELECT a, b, distance FROM p")
def mth_01(t):
    return M.bucket_pairs(hashed(t), ["bits"]).select("a", "b", M.hamming(F.col("bits_a"), F.col("bits_b")).alias("distance"))


@query("flt_12", _CUT + _HASHED + "SELECT a, b FROM p WHERE distance <= 16")
def flt_12(t):
    return M.bucket_pairs(hashed(t), ["bits"]).where(M.hamming(F.col("bits_a"), F.col("bits_b")) <= 16).select("a", "b")


@query("srt_04", _CUT + _HASHED + "SELECT a, b, distance FROM p WHERE distance <= 16 ORDER BY distance, a, b")
def srt_04(t):
    return M.bucket_pairs(hashed(t), ["bits"]).withColumn("distance", M.hamming(F.col("bits_a"), F.col("bits_b"))).where("distance <= 16").select("a", "b", "distance").orderBy("distance", "a", "b")


def _linked(relations: str) -> str:
    """Complete linkage by a fold over the relations ``r(bucket_id, a, b, distance)`` of each bucket, closest first."""
    return relations + """
, l AS (SELECT bucket_id, list({'d': distance, 'a': a, 'b': b} ORDER BY distance, a, b) AS rel, list(a || '|' || b) AS known FROM r GROUP BY bucket_id)
, fold(bucket_id, rel, known, k, homes) AS (
  SELECT bucket_id, rel, known, 0, []::VARCHAR[][] FROM l
  UNION ALL
  SELECT bucket_id, rel, known, k + 1, CASE
    WHEN x = y OR len([1 FOR p IN flatten([[least(m, o) || '|' || greatest(m, o) FOR o IN y] FOR m IN x]) IF NOT list_contains(known, p)]) > 0 THEN homes
    ELSE list_append([h FOR h IN homes IF NOT list_contains(h, one) AND NOT list_contains(h, two)], list_sort(list_concat(x, y))) END
  FROM (SELECT *, coalesce([h FOR h IN homes IF list_contains(h, one)][1], [one]) AS x, coalesce([h FOR h IN homes IF list_contains(h, two)][1], [two]) AS y
    FROM (SELECT *, rel[k + 1].a AS one, rel[k + 1].b AS two FROM fold WHERE k < len(rel)))
)
, homes AS (SELECT bucket_id, rel, unnest(homes) AS member_ids FROM fold WHERE k = len(rel))
, linked AS (SELECT bucket_id, member_ids, list_min(ds) AS min_distance, list_max(ds) AS max_distance FROM (
  SELECT *, [q.d FOR q IN rel IF list_contains(member_ids, q.a) AND list_contains(member_ids, q.b)] AS ds FROM homes))
"""


_NAMED = """, heads AS (SELECT route, aspect, span, chain, piece, count(*) AS rows, arg_min(id, (t, id)) AS first_id FROM c2 GROUP BY ALL)
, named AS (SELECT *, CASE WHEN route = 'video' THEN 'v' || aspect || '-d' || span ELSE 'a' || aspect END || '-' || rows || '-' || first_id AS bucket_id FROM heads)
"""
_RELATED = (_CUT + _HASHED + _NAMED) + ", r AS (SELECT bucket_id, a, b, distance / 64.0::DOUBLE AS distance FROM p JOIN named USING (route, aspect, span, chain, piece) WHERE distance <= 16)"


@query("grf_04", _linked(_RELATED) + "SELECT bucket_id, array_to_string(member_ids, ',') AS members, round(min_distance, 6) AS min_distance, round(max_distance, 6) AS max_distance FROM linked")
def grf_04(t):
    relations = M.bucket_pairs(hashed(t), ["bits"]).withColumn("distance", M.hamming(F.col("bits_a"), F.col("bits_b")) / 64.0).where("distance <= 0.25")
    return M.link_groups(relations).select("bucket_id", F.array_join("member_ids", ",").alias("members"), F.round("min_distance", 6).alias("min_distance"), F.round("max_distance", 6).alias("max_distance"))


_BLOCKS = "SELECT vec_id, embedding, label::VARCHAR AS bucket_id FROM embeddings"
_VECTORS = f"WITH e AS ({_BLOCKS}), p AS (SELECT x.bucket_id, x.vec_id AS a, y.vec_id AS b, round(list_distance(x.embedding::DOUBLE[], y.embedding::DOUBLE[]), 6) AS distance FROM e x JOIN e y ON x.bucket_id = y.bucket_id AND x.vec_id < y.vec_id)"


def vectors(t) -> DataFrame:
    """All pairs of one label."""
    rows = t.embeddings.select(F.col("vec_id").alias("id"), "embedding", F.col("label").cast("string").alias("bucket_id"))
    return M.block_pairs(rows, ["embedding"]).select("bucket_id", "a", "b", F.round(M.euclidean(F.col("embedding_a"), F.col("embedding_b")), 6).alias("distance"))


@query("mth_02", _VECTORS + "SELECT a, b, distance FROM p")
def mth_02(t):
    return vectors(t).select("a", "b", "distance")


@query("joi_12", _VECTORS + "SELECT bucket_id, a, b FROM p WHERE distance <= 1.2")
def joi_12(t):
    return vectors(t).where("distance <= 1.2").select("bucket_id", "a", "b")


@query("flt_13", _VECTORS + "SELECT a, b FROM p WHERE distance <= 1.3")
def flt_13(t):
    return vectors(t).where("distance <= 1.3").select("a", "b")


@query("agg_13", _VECTORS + "SELECT bucket_id, min(distance) AS min_distance, max(distance) AS max_distance FROM p WHERE distance <= 1.2 GROUP BY bucket_id")
def agg_13(t):
    return vectors(t).where("distance <= 1.2").groupBy("bucket_id").agg(F.min("distance").alias("min_distance"), F.max("distance").alias("max_distance"))


@query("agg_14", "SELECT vec_id, round(list_avg(embedding::DOUBLE[]), 6) AS mean, round(list_var_pop(embedding::DOUBLE[]), 6) AS variance FROM embeddings")
def agg_14(t):
    x = F.transform("embedding", lambda v: v.cast("double"))
    n = F.size("embedding")
    mean = F.aggregate(x, F.lit(0.0), lambda a, v: a + v) / n
    variance = F.aggregate(x, F.lit(0.0), lambda a, v: a + (v - mean) * (v - mean)) / n
    return t.embeddings.select("vec_id", F.round(mean, 6).alias("mean"), F.round(variance, 6).alias("variance"))


@query("agg_15", "SELECT vec_id, round(((s[n // 2] + s[n // 2 + 1]) / 2.0)::DOUBLE, 6) AS median, round(s[((n - 1) * 0.9)::DOUBLE::INT - CASE WHEN ((n - 1) * 0.9)::DOUBLE::INT > (n - 1) * 0.9 THEN 1 ELSE 0 END + 1]::DOUBLE, 6) AS p90 FROM (SELECT vec_id, list_sort(embedding::DOUBLE[]) AS s, len(embedding) AS n FROM embeddings)")
def agg_15(t):
    s = F.array_sort(F.transform("embedding", lambda v: v.cast("double")))
    n = F.size("embedding")
    at = lambda i: F.get(s, i.cast("int"))
    return t.embeddings.select("vec_id", F.round((at(F.floor(n / 2) - 1) + at(F.floor(n / 2))) / 2, 6).alias("median"), F.round(at(F.floor((n - 1) * 0.9)), 6).alias("p90"))


@query("mth_07", "SELECT label, CASE WHEN label % 2 = 0 THEN 0.2 ELSE 0.15 END::DOUBLE AS threshold, count(*) AS n FROM embeddings GROUP BY label")
def mth_07(t):
    """The threshold that belongs to a kind of vector; even labels stand for one kind, odd for the other."""
    from ..config import Similarity

    return t.embeddings.groupBy("label").agg(F.count("*").alias("n")).select("label", F.when(F.col("label") % 2 == 0, F.lit(Similarity.vision_threshold)).otherwise(F.lit(Similarity.grid_threshold)).alias("threshold"), "n")


def content(t) -> DataFrame:
    text = F.encode("text", "UTF-8")
    return t.documents.where("text IS NOT NULL").select(F.col("doc_id").alias("id"), F.octet_length("text").alias("bytes"), text.alias("content"), "source", "n_chars")


@query("agg_05", "SELECT sha256(text) AS digest, count(DISTINCT doc_id) AS members, min(doc_id) AS first_id FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(DISTINCT doc_id) > 1")
def agg_05(t):
    return M.exact_groups(M.colliding(content(t), ["bytes"]).withColumn("digest", F.sha2("content", 256)), ["digest"])


@query("agg_06", "SELECT doc_id AS id FROM documents WHERE strlen(text) IN (SELECT strlen(text) FROM documents GROUP BY 1 HAVING count(*) > 1)")
def agg_06(t):
    return M.colliding(content(t).select("id", "bytes"), ["bytes"]).select("id")


_NEAR = _CUT + _HASHED + ", z AS (SELECT p.*, x.size_bytes AS sa, y.size_bytes AS sb FROM p JOIN (" + _ONE + ") x ON x.id = a JOIN (" + _ONE + ") y ON y.id = b)"


#: The catalog has no pixels or files: pattern and size stand for the content, and the 64 bits, scaled, for the descriptor.
_CONTENT = "bits || ':' || coalesce(size_bytes::VARCHAR, '')"
SCALE = 0.048
_SIDES = """, f AS (SELECT hb.id, bits, """ + _CONTENT + """ AS content, CASE WHEN coalesce(s.has_adjustments, false) THEN 'cpuGrid' ELSE 'vision' END AS kind, [((bits >> i) & 1) * 0.048::DOUBLE FOR i IN range(64)] AS vector FROM hb JOIN (SELECT id, arg_min(size_bytes, id) AS size_bytes, bool_or(has_adjustments) AS has_adjustments FROM (""" + _ONE + """) GROUP BY id) s USING (id))
, close AS (SELECT bucket_id, p.route, p.a, p.b, x.content = y.content AS same, sha256(x.content) AS digest, x.kind, y.kind AS other, list_distance(x.vector, y.vector) AS far FROM p JOIN named USING (route, aspect, span, chain, piece) JOIN f x ON x.id = p.a JOIN f y ON y.id = p.b WHERE distance <= 16)
"""


def contents(t) -> DataFrame:
    """Binary content of each hashed asset."""
    size = C.first_rows(t.assets).select("id", "size_bytes")
    return patterns(t).join(size, "id").select("id", F.encode(F.concat_ws(":", F.col("bits").cast("string"), F.coalesce(F.col("size_bytes").cast("string"), F.lit(""))), "UTF-8").alias("content"))


def vectors_of_assets(t) -> DataFrame:
    """A descriptor for each hashed asset; edited ones went through the fallback."""
    kind = C.first_rows(t.assets).select("id", F.when(F.coalesce("has_adjustments", F.lit(False)), "cpuGrid").otherwise("vision").alias("kind"))
    vector = F.array(*[F.shiftrightunsigned("bits", i).bitwiseAND(F.lit(1)).cast("double") * SCALE for i in range(64)])
    return patterns(t).join(kind, "id").select("id", "kind", vector.alias("vector"))


@query("grf_06", (_CUT + _HASHED + _NAMED + _SIDES) + "SELECT a, b, digest FROM close WHERE same")
def grf_06(t):
    """Pairs of a bucket that are exact copies: near patterns, equal length, equal digest."""
    close = M.bucket_pairs(hashed(t), ["bits"]).where(M.hamming(F.col("bits_a"), F.col("bits_b")) <= 16).select("a", "b")
    return M.confirmed_copies(close, contents(t)).select("a", "b", "digest")


@query("grf_05", "WITH g AS (SELECT burst_id AS group_id, id FROM (" + _ONE + ") WHERE burst_id IS NOT NULL) SELECT group_id, string_agg(DISTINCT g.id, ',' ORDER BY g.id) AS members, arg_min(a.id, (NOT coalesce(is_favorite, false), coalesce(represents_burst, false), -coalesce(width::BIGINT * height, 0), NOT coalesce(has_adjustments, false), -epoch_us(coalesce(created, TIMESTAMP '0001-01-01')), a.id)) AS best_id FROM g JOIN (" + _ONE + ") a ON a.id = g.id GROUP BY group_id")
def grf_05(t):
    groups = t.assets.where("burst_id IS NOT NULL").groupBy(F.col("burst_id").alias("group_id")).agg(F.array_sort(F.collect_set("id")).alias("member_ids"))
    return M.with_best(groups, t.assets).select("group_id", F.array_join("member_ids", ",").alias("members"), "best_id")


_SIMILAR = _linked((_CUT + _HASHED + _NAMED) + _SIDES + ", r AS (SELECT bucket_id, a, b, far AS distance FROM close WHERE NOT same AND route = 'image' AND kind = other AND far <= CASE kind WHEN 'vision' THEN 0.2 ELSE 0.15 END)") + """
, copies AS (SELECT digest, list_sort(list_distinct(flatten(list([a, b])))) AS member_ids FROM close WHERE same GROUP BY digest)
, found AS (SELECT 'exact:' || digest AS group_id, 'exact' AS kind, member_ids, 0.0::DOUBLE AS min_distance, 0.0::DOUBLE AS max_distance FROM copies
  UNION ALL SELECT 'near:' || array_to_string(member_ids, ','), 'near', member_ids, min_distance, max_distance FROM linked)
, best AS (SELECT group_id, arg_min(a.id, (NOT coalesce(is_favorite, false), coalesce(represents_burst, false), -coalesce(width::BIGINT * height, 0), NOT coalesce(has_adjustments, false), -epoch_us(coalesce(created, TIMESTAMP '0001-01-01')), a.id)) AS best_id FROM (SELECT group_id, unnest(member_ids) AS id FROM found) m JOIN (""" + _ONE + """) a USING (id) GROUP BY group_id)
SELECT group_id, kind, array_to_string(member_ids, ',') AS members, best_id, round(min_distance, 6) AS min_distance, round(max_distance, 6) AS max_distance FROM found JOIN best USING (group_id)
"""


@query("grf_07", _SIMILAR)
def grf_07(t):
    return M.similar_assets(t.assets, t.phash_entries, vectors_of_assets(t), contents(t)).select("group_id", "kind", F.array_join("member_ids", ",").alias("members"), "best_id", F.round("min_distance", 6).alias("min_distance"), F.round("max_distance", 6).alias("max_distance"))


@query("prj_14", _NEAR + "SELECT DISTINCT 'near:' || a || ',' || b AS group_id FROM z WHERE distance BETWEEN 1 AND 16")
def prj_14(t):
    pairs = M.bucket_pairs(hashed(t), ["bits"]).withColumn("d", M.hamming(F.col("bits_a"), F.col("bits_b"))).where("d BETWEEN 1 AND 16")
    return pairs.select(F.concat(F.lit("near:"), F.array_join(F.array_sort(F.array("a", "b")), ",")).alias("group_id")).distinct()


@query("srt_05", "SELECT kind, members FROM (SELECT 'exact' AS kind, string_agg(DISTINCT asset_id, ',' ORDER BY asset_id) AS members FROM phash_entries WHERE bits IS NOT NULL GROUP BY bits HAVING count(DISTINCT asset_id) > 1) ORDER BY kind, members")
def srt_05(t):
    g = t.phash_entries.where("bits IS NOT NULL").groupBy("bits").agg(F.array_sort(F.collect_set("asset_id")).alias("m")).where(F.size("m") > 1)
    return g.select(F.lit("exact").alias("kind"), F.array_join("m", ",").alias("members")).orderBy("kind", "members")


_MEASURES = "SELECT id, (height % 100) / 5000.0::DOUBLE AS laplacian, (width % 1000) / 8000.0::DOUBLE AS tenengrad, (duration % 10) / 10.0 + 0.05 AS luma_mean, 0.02 AS luma_std FROM (" + _ONE + ")"
_VERDICT = "CASE WHEN luma_mean < 0.08 OR luma_std < 0.015 THEN 'insufficientInformation' WHEN laplacian >= 0.01 THEN 'sharp' WHEN laplacian <= 0.0005 AND tenengrad <= 0.05 THEN 'likelyBlurry' ELSE 'borderline' END"


def measures(t) -> DataFrame:
    """Stand-in focus measures made from the columns of the catalog, which has no pixels."""
    return C.first_rows(t.assets).select("id", ((F.col("height") % 100) / 5000.0).alias("laplacian"), ((F.col("width") % 1000) / 8000.0).alias("tenengrad"), (F.col("duration") % 10 / 10.0 + 0.05).alias("luma_mean"), F.lit(0.02).alias("luma_std"))


@query("mth_06", f"SELECT id, {_VERDICT} AS verdict FROM ({_MEASURES})")
def mth_06(t):
    return measures(t).select("id", S.verdict().alias("verdict"))


@query("agg_12", f"SELECT verdict, count(*) AS n FROM (SELECT {_VERDICT} AS verdict FROM ({_MEASURES})) GROUP BY verdict")
def agg_12(t):
    return measures(t).groupBy(S.verdict().alias("verdict")).agg(F.count("*").alias("n"))


@query("flt_09", f"SELECT id, verdict FROM (SELECT id, {_VERDICT} AS verdict FROM ({_MEASURES})) WHERE verdict IN ('likelyBlurry', 'borderline')")
def flt_09(t):
    return measures(t).select("id", S.verdict().alias("verdict")).where("verdict IN ('likelyBlurry', 'borderline')")


@query("joi_08", f"SELECT id, verdict FROM (SELECT id, {_VERDICT} AS verdict FROM ({_MEASURES})) WHERE verdict = 'borderline' AND id NOT IN (SELECT asset_id FROM phash_entries WHERE asset_id IS NOT NULL)")
def joi_08(t):
    found = measures(t).select("id", S.verdict().alias("verdict")).where("verdict = 'borderline'")
    return C.without(found, t.phash_entries.select(F.col("asset_id").alias("id")))


def vector_grids(t, side: int) -> DataFrame:
    """Square grids from the embedding values, repeated to the size asked for."""
    n = side * side
    return t.embeddings.select(F.col("vec_id").alias("id"), F.slice(F.flatten(F.array_repeat(F.transform("embedding", lambda v: (v + 1) / 2), n // 64 + 1)), 1, n).alias("luma"))


_GRID = "SELECT vec_id AS id, [(embedding[i % 64 + 1]::DOUBLE + 1) / 2 FOR i IN range(1024)] AS g FROM embeddings"
_AT = lambda dy, dx: f"g[least(greatest(i // 32 + {dy}, 0), 31) * 32 + least(greatest(i % 32 + {dx}, 0), 31) + 1]"
_LAP = f"{_AT(-1, 0)} + {_AT(1, 0)} + {_AT(0, -1)} + {_AT(0, 1)} - 4 * {_AT(0, 0)}"
_GX = f"(({_AT(-1, 1)} + 2 * {_AT(0, 1)} + {_AT(1, 1)}) - ({_AT(-1, -1)} + 2 * {_AT(0, -1)} + {_AT(1, -1)}))"
_GY = f"(({_AT(1, -1)} + 2 * {_AT(1, 0)} + {_AT(1, 1)}) - ({_AT(-1, -1)} + 2 * {_AT(-1, 0)} + {_AT(-1, 1)}))"
_FOCUS = f"""WITH grid AS ({_GRID}), cells AS (SELECT id, g, [{_LAP} FOR i IN range(1024)] AS lap, [{_GX} * {_GX} + {_GY} * {_GY} FOR i IN range(1024)] AS e FROM grid),
b AS (SELECT *, list_sort([(e[o + 1] + e[o + 2] + e[o + 33] + e[o + 34]) / 4 FOR o IN [(k // 16) * 64 + (k % 16) * 2 FOR k IN range(256)]]) AS m FROM cells),
f AS (SELECT id, list_var_pop(lap) AS laplacian, list_avg(e) AS tenengrad, m[230] AS energy_p90, (m[128] + m[129]) / 2 AS energy_median, list_avg(g) AS luma_mean, list_stddev_pop(g) AS luma_std FROM b)
"""
# Single precision here, double in SQL: moved off the halves, where the two would round apart.
_FOCUS_NAMES = ["laplacian", "tenengrad", "energy_p90", "energy_median", "luma_mean", "luma_std"]


@query("mth_05", _FOCUS + "SELECT id, " + ", ".join(f"round({c} + 0.0001, 3) AS {c}" for c in _FOCUS_NAMES) + " FROM f")
def mth_05(t):
    return S.sharpness(vector_grids(t, 32), side=32).select("id", *[F.round(F.col(c).cast("double") + 0.0001, 3).alias(c) for c in _FOCUS_NAMES])


@query("grf_08", _FOCUS + f"SELECT {_VERDICT} AS verdict, count(*) AS n FROM f GROUP BY 1")
def grf_08(t):
    """Sharpness pass: measures, verdicts, and their counts."""
    return S.sharpness(vector_grids(t, 32), side=32).groupBy(S.verdict().alias("verdict")).agg(F.count("*").alias("n"))


@query("mth_03", "SELECT vec_id, list_sum([CASE WHEN g[(i // 8) * 9 + i % 8 + 1] < g[(i // 8) * 9 + i % 8 + 2] THEN CASE WHEN i = 63 THEN -9223372036854775808::HUGEINT ELSE (1::HUGEINT << i) END ELSE 0::HUGEINT END FOR i IN range(64)])::BIGINT AS bits FROM (SELECT vec_id, list_concat(embedding, embedding)[:72] AS g FROM embeddings)")
def mth_03(t):
    gray = F.slice(F.concat("embedding", "embedding"), 1, 72)
    return t.embeddings.select("vec_id", S.difference_hash(gray).alias("bits"))


def _turned(y: str, x: str) -> str:
    cell = lambda n: f"embedding[({y}) * 16 + ({x}) * 2 + {n}]::DOUBLE"
    return f"[({cell(1)} + {cell(2)} + {cell(9)} + {cell(10)}) / 4 FOR k IN range(16)]"


@query("src_11", f"SELECT id, array_to_string([format('{{:.3f}}', round(v + 2.00003, 3)) FOR v IN luma], ',') AS luma, reason FROM (SELECT vec_id AS id, CASE vec_id % 5 WHEN 0 THEN {_turned('k // 4', 'k % 4')} WHEN 1 THEN {_turned('3 - k // 4', '3 - k % 4')} WHEN 2 THEN {_turned('3 - k % 4', 'k // 4')} WHEN 3 THEN {_turned('k // 4', '3 - k % 4')} END AS luma, CASE WHEN vec_id % 5 = 4 THEN 'thumbnailFailed' END AS reason FROM embeddings)")
def src_11(t):
    """Vectors as images of eight by eight, made upright (as they are, turned, turned right, mirrored, unknown) and brought to four by four."""
    turn = F.element_at(F.array(*map(F.lit, (1, 3, 6, 2, 9))), (F.col("vec_id") % 5 + 1).cast("int"))
    made = S.thumbnails(t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("luma"), F.lit(8).alias("width"), F.lit(8).alias("height"), turn.alias("orientation")), 4)
    return made.select("id", F.array_join(F.transform("luma", lambda v: F.format_string("%.3f", F.round(v.cast("double") + 2.00003, 3))), ",").alias("luma"), "reason")


_PARTS = [0, 1, 2, 385, 768, 769, 770]


@query("mth_04", """WITH g AS (SELECT vec_id AS id, [embedding[i % 64 + 1]::DOUBLE FOR i IN range(768)] AS x FROM embeddings),
m AS (SELECT *, [list_avg([x[k * 3 + c + 1] FOR k IN range(256)]) FOR c IN range(3)] AS means FROM g),
v AS (SELECT id, list_concat([x[i + 1] - means[i % 3 + 1] FOR i IN range(768)], [y * 0.5 FOR y IN means]) AS v FROM m),
n AS (SELECT id, v, sqrt(list_sum([y * y FOR y IN v])) AS size FROM v)
SELECT id, len(v)::INT AS n, """ + ", ".join(f"round(v[{i + 1}] / size, 4) + 0.0 AS v{i}" for i in _PARTS) + " FROM n")
def mth_04(t):
    grids = t.embeddings.select(F.col("vec_id").alias("id"), F.slice(F.flatten(F.array_repeat("embedding", 12)), 1, 768).alias("rgb"))
    v = S.descriptors(grids)
    return v.select("id", F.size("values").alias("n"), *[(F.round(F.get("values", F.lit(i)).cast("double"), 4) + 0.0).alias(f"v{i}") for i in _PARTS])


@query("mth_08", "SELECT vec_id, len(embedding)::INT AS n, label FROM embeddings")
def mth_08(t):
    """Feature vectors come as a column; this checks and passes them on."""
    return t.embeddings.select("vec_id", F.size("embedding").alias("n"), "label")
