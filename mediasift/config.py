"""Thresholds of the operators, as frozen parameters."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Bucketing:
    """How assets are cut into candidate buckets."""

    aspect_tolerance: float = 0.01
    max_gap_s: float = 600.0
    max_bucket: int = 64
    min_side: int = 1
    duration_tolerance: float = 0.1


@dataclass(frozen=True)
class Similarity:
    """When two assets are near duplicates."""

    max_hamming: int = 16
    vision_threshold: float = 0.2
    grid_threshold: float = 0.15


@dataclass(frozen=True)
class Sharpness:
    """Gates of the sharpness verdict, and the analysis size."""

    sharp: float = 0.01
    blurry_laplacian: float = 5e-4
    blurry_tenengrad: float = 5e-2
    dark: float = 0.08
    flat: float = 0.015
    side: int = 256
    blocks: int = 16


@dataclass(frozen=True)
class Throughput:
    """Smoothing of the progress rate."""

    alpha: float = 0.35
    min_interval_s: float = 1.0
    min_samples: int = 2
    finishing_s: float = 5.0


#: Bits of the media subtype and source masks.
SUBTYPE_BITS = {"panorama": 0, "hdr": 1, "screenshot": 2, "live_photo": 3, "depth_effect": 4, "animation": 6, "spatial": 10, "video_streamed": 16, "high_frame_rate": 17, "timelapse": 18, "screen_recording": 19, "cinematic": 21}
SOURCE_BITS = {"library": 0, "cloud_shared": 1, "itunes_synced": 2}
MEDIA_TYPES = ["image", "video", "audio"]
KEY_CAP = 50
SCREENSHOT_AGE_S = 90 * 86_400
