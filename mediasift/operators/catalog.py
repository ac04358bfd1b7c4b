"""Asset catalog: scans, derived columns, filters, joins and aggregates.

Functions take and return DataFrames; only those that are given a scratch folder run anything. Null sizes
are unknown, never zero; null dates sort as the oldest.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import MEDIA_TYPES, SCREENSHOT_AGE_S, SOURCE_BITS, SUBTYPE_BITS, Bucketing
from ..scratch import Scratch


def has_bit(mask: Column, bit: int) -> Column:
    return F.coalesce(mask.bitwiseAND(F.lit(1 << bit)) != 0, F.lit(False))


def is_screenshot(mask: str = "subtype_mask") -> Column:
    return has_bit(F.col(mask), SUBTYPE_BITS["screenshot"])


def visible(assets: DataFrame) -> DataFrame:
    """SRC-01: assets that are not hidden (a null flag hides nothing)."""
    return assets.where(~F.coalesce("is_hidden", F.lit(False)))


def page(assets: DataFrame, start: int, stop: int) -> DataFrame:
    """SRC-02: rows ``start`` to ``stop`` of the newest-first order; bounds beyond the table give what is there."""
    start, stop = max(start, 0), max(stop, start, 0)
    return visible(assets).orderBy(F.desc_nulls_last("created"), "id").offset(start).limit(stop - start)


def known_media_type(assets: DataFrame) -> DataFrame:
    """SRC-05: media types outside the known ones read as ``unknown``."""
    return assets.withColumn("media_type", F.when(F.col("media_type").isin(MEDIA_TYPES), F.col("media_type")).otherwise("unknown"))


def size_ladder(resource: Column, current: Column, current_remote: Column, original: Column, original_remote: Column, editing: Column, data: Column) -> Column:
    """SRC-07: bytes of an asset by five probes, the first positive answer wins; zero is no size.

    Where the current or the original file is known to be remote, nothing further down can hold local bytes: null.
    """
    remote = lambda c: F.coalesce(c, F.lit(False))
    return (
        F.when(resource > 0, resource).when(remote(current_remote), None).when(current > 0, current).when(remote(original_remote), None)
        .when(original > 0, original).when(editing > 0, editing).when(data > 0, data)
    )


def outcomes(requested: DataFrame, sizes: DataFrame) -> DataFrame:
    """SRC-08: ``id, outcome, bytes`` for every requested ``id``; ``sizes`` has ``id, bytes``."""
    known = sizes.where("id IS NOT NULL").groupBy("id").agg(F.max("bytes").alias("bytes"))
    return requested.select("id").distinct().join(known, "id", "left").select("id", F.when(F.col("bytes").isNotNull(), "measured").otherwise("unavailable").alias("outcome"), "bytes")


def first_rows(assets: DataFrame) -> DataFrame:
    """JOI-02: one row an identifier. Of differing rows the one with the smallest content stays, whatever the order of input; null identifiers go."""
    cols = [c for c in assets.columns if c != "id"]
    return assets.where("id IS NOT NULL").groupBy("id").agg(F.min(F.struct(*cols)).alias("r")).select("id", "r.*").select(*assets.columns)


def with_flags(assets: DataFrame) -> DataFrame:
    """PRJ-01: ``is_image, is_video, is_screenshot, is_live_photo, pixel_count, is_size_known``."""
    mask = F.col("subtype_mask")
    return assets.withColumns(
        {
            "is_image": F.coalesce(F.col("media_type") == "image", F.lit(False)), "is_video": F.coalesce(F.col("media_type") == "video", F.lit(False)), "is_screenshot": has_bit(mask, SUBTYPE_BITS["screenshot"]), "is_live_photo": has_bit(mask, SUBTYPE_BITS["live_photo"]),
            "pixel_count": F.col("width").cast("bigint") * F.col("height"), "is_size_known": F.col("size_bytes").isNotNull(),
        }
    )


def resolve_sizes(assets: DataFrame, measured: DataFrame, only_unknown: bool = False) -> DataFrame:
    """PRJ-02/03/04: sizes from ``measured`` (``id, bytes``), else the ones recorded. ``only_unknown`` leaves known sizes alone."""
    known = measured.where("id IS NOT NULL").groupBy("id").agg(F.max("bytes").alias("_bytes"))
    joined = assets.join(known, "id", "left")
    size = F.coalesce("size_bytes", "_bytes") if only_unknown else F.coalesce("_bytes", "size_bytes")
    return joined.withColumn("size_bytes", size).drop("_bytes").select(*assets.columns)


def aspect_key(tolerance: float = Bucketing.aspect_tolerance) -> Column:
    """PRJ-06: long side by short side in steps of the tolerance, whatever the orientation; the largest bigint for an empty side."""
    low, high = F.least("width", "height"), F.greatest("width", "height")
    return F.when(low > 0, F.round(high / low / max(tolerance, 1e-9)).cast("bigint")).otherwise(F.lit((1 << 63) - 1))


def duration_key(tolerance: float = Bucketing.duration_tolerance) -> Column:
    """PRJ-07: duration in steps of the tolerance."""
    return F.round(F.col("duration") / max(tolerance, 1e-9)).cast("bigint")


def video_class(mask: str = "source_mask") -> Column:
    """PRJ-13: where a video comes from."""
    return F.when(has_bit(F.col(mask), SOURCE_BITS["itunes_synced"]), "downloaded").when(has_bit(F.col(mask), SOURCE_BITS["cloud_shared"]), "other").otherwise("recorded")


def old_screenshots(assets: DataFrame, now: Column, age_s: float = SCREENSHOT_AGE_S) -> DataFrame:
    """FLT-04: screenshots with a date that are at least ``age_s`` old, oldest first."""
    age = F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("created").cast("timestamp"))
    return assets.where(is_screenshot() & (age >= int(age_s * 1_000_000))).orderBy("created", "id")


def eligibility(config: Bucketing = Bucketing()) -> Column:
    """FLT-06/07: ``image``, ``video``, or why the asset takes no part in bucketing."""
    sized = F.coalesce((F.col("width") >= config.min_side) & (F.col("height") >= config.min_side), F.lit(False))
    return F.when(F.col("media_type") == "video", "video").when((F.col("media_type") == "image") & sized, "image").when(F.col("media_type") == "image", "invalidDimensions").otherwise("unsupportedMediaType")


def summary(assets: DataFrame) -> DataFrame:
    """AGG-01/02: counts in one pass, the newest image, and the known bytes."""
    flagged = with_flags(assets)
    image_order = F.struct(F.coalesce(-F.unix_micros(F.col("created").cast("timestamp")), F.lit((1 << 63) - 1)), "id")
    return flagged.agg(
        F.count("*").alias("assets"), F.count_if("is_image").alias("images"), F.count_if("is_video").alias("videos"), F.count_if("is_screenshot").alias("screenshots"), F.count_if("is_live_photo").alias("live_photos"),
        F.count_if(F.coalesce("has_adjustments", F.lit(False))).alias("adjusted"), F.min_by("id", F.when(F.col("is_image"), image_order)).alias("first_image"), F.coalesce(F.sum("size_bytes"), F.lit(0)).cast("bigint").alias("known_bytes"),
    )


def size_summary(assets: DataFrame) -> DataFrame:
    """AGG-03: measured bytes and counts; unknown sizes are counted, not summed."""
    return assets.agg(F.coalesce(F.sum("size_bytes"), F.lit(0)).cast("bigint").alias("measured_bytes"), F.count("size_bytes").alias("measured"), F.count_if(F.col("size_bytes").isNull()).alias("unresolved")).withColumns(
        {"is_exact": F.col("unresolved") == 0, "is_unresolved": (F.col("measured") == 0) & (F.col("unresolved") > 0)}
    )


def best_order(prefix: str = "") -> Column:
    """PRF-01: order in which assets of a group are kept; the smallest is the best.

    Favourite, then not from a burst, more pixels, edited, newer (null oldest), smaller identifier.
    """
    c = lambda n: F.col(f"{prefix}{n}")
    flag = lambda n: F.coalesce(c(n), F.lit(False))
    pixels = F.coalesce(c("width").cast("bigint") * c("height"), F.lit(0))
    return F.struct((~flag("is_favorite")).alias("o1"), flag("represents_burst").alias("o2"), (-pixels).alias("o3"), (~flag("has_adjustments")).alias("o4"), F.coalesce(-F.unix_micros(c("created").cast("timestamp")), F.lit((1 << 63) - 1)).alias("o5"), c("id").alias("o6"))


def best_of(members: DataFrame, group: list[str]) -> DataFrame:
    """PRF-01: ``group..., best_id`` by partial aggregation, no sort of a group."""
    return members.groupBy(*group).agg(F.min(best_order()).alias("o")).select(*group, F.col("o.o6").alias("best_id"))


def without(rows: DataFrame, removed: DataFrame, on: str = "id") -> DataFrame:
    """JOI-06/08, SNK-05: rows whose identifier was not removed."""
    return rows.join(removed.select(on).where(F.col(on).isNotNull()).distinct(), on, "left_anti")


def count_flags(df: DataFrame, **conditions: Column) -> DataFrame:
    """AGG-16/17: one row with the count of each condition."""
    return df.agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in conditions.items()])


def any_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def numbered(rows: DataFrame, order: list[Column], scratch: Scratch) -> DataFrame:
    """``rows`` with ``number``, counted from 0 in ``order``: a range partitioning, sorted in its parts; only one count a part comes together."""
    place = scratch.write(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    counts = place.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))  # one row for each part
    return place.withColumn("_part", part).join(F.broadcast(before), "_part").withColumn("number", F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_at", "_part", "_before")


def chunks(rows: DataFrame, order: list[Column], scratch: Scratch, size: int = 512, cancelled_after: int | None = None) -> DataFrame:
    """SRC-03: ``chunk, rows, completed, total`` of a scan in chunks of ``size``; a scan that is cancelled after so many chunks stops there."""
    counted = numbered(rows, order, scratch)
    total = counted.count()
    done = counted.groupBy(F.floor(F.col("number") / size).alias("chunk")).agg(F.count("*").alias("rows")).withColumn("completed", F.least((F.col("chunk") + 1) * size, F.lit(total))).withColumn("total", F.lit(total))
    return done if cancelled_after is None else done.where(F.col("chunk") < cancelled_after)


def shuffle_tail(deck: DataFrame, order: list[Column], cursor: int, seed: int, scratch: Scratch, id_col: str = "id") -> DataFrame:
    """PRF-04: ``id_col, place``: rows before ``cursor`` keep their place in ``order``, the others get a seeded one, the same on any cluster."""
    placed = numbered(deck, order, scratch).select(id_col, F.col("number").alias("place"))
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")).cast("binary"))
    tail = numbered(placed.where(F.col("place") >= cursor).select(id_col, key.alias("_key")), [F.asc("_key"), F.asc(id_col)], scratch)
    return placed.where(F.col("place") < cursor).unionByName(tail.select(id_col, (F.col("number") + cursor).alias("place")))


def content_reason() -> Column:
    """SRC-10: why the content of an asset cannot be read, the first reason that holds, null if none."""
    return (
        F.when(F.col("is_hidden"), "cancelled").when(has_bit(F.col("source_mask"), SOURCE_BITS["cloud_shared"]), "cloudOnly").when(~F.col("media_type").isin("image", "video"), "error")
        .when(has_bit(F.col("subtype_mask"), SUBTYPE_BITS["live_photo"]) & (F.col("duration") == 0), "missingMovie").when(F.col("size_bytes").isNull(), "noContent").when(F.col("size_bytes") == 0, "zeroBytes")
    )


def failure_reason(error: str = "error", kind: str = "kind") -> Column:
    """FLT-19: the reason that is shown for an error; failures of a descriptor go by the kind the run had latched."""
    e, extraction = F.col(error), F.col(error).isin("backendUnavailable", "invalidImage")
    content = {"onlyInICloud": "contentOnlyInICloud", "permissionDenied": "permissionUnavailable", "assetNotFound": "assetNotFound", "unavailable": "imageUnavailable"}
    out = F.when(e == "timeout", "timedOut")
    for name, reason in content.items():
        out = out.when(e == name, reason)
    return out.when(extraction & (F.col(kind) == "vision"), "visionFailed").when(extraction & (F.col(kind) == "cpuGrid"), "cpuDescriptorFailed").otherwise("imageUnavailable")


def byte_text(size: Column) -> Column:
    """FMT-03: decimal megabytes with one digit, from a gigabyte on gigabytes with two, no trailing zeros; nothing and less is ``0 GB``. Null stays null."""
    plain = lambda x: F.regexp_replace(x.cast("string"), r"\.?0+$", "")
    amount = lambda unit, digits: F.round(size.cast("decimal(38,0)") / F.lit(unit).cast("decimal(20,0)"), digits).cast(f"decimal(30,{digits})")
    return F.when(size <= 0, "0 GB").when(amount(10**6, 1) < 1000, F.concat(plain(amount(10**6, 1)), F.lit(" MB"))).when(size > 0, F.concat(plain(amount(10**9, 2)), F.lit(" GB")))
