"""Thresholds of the catalogue engine, as one frozen value that plan builders take."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    """The defaults of the catalogue's gates, detectors and organiser."""

    phash_threshold: int = 8
    cosine_threshold: float = 0.92
    min_short_edge: int = 480
    min_long_edge: int = 640
    min_megapixels: float = 0.35
    min_image_bytes: int = 25_000
    min_web_bytes: int = 40_000
    min_video_bytes: int = 200_000
    min_video_short_edge: int = 360
    max_aspect_ratio: float = 3.5
    reject_animated_gif: bool = True
    reject_junk_paths: bool = True
    trivial_bytes: int = 2_048
    blur_threshold: float = 80.0
    event_gap_days: int = 3
    min_members: int = 2
    min_scene: int = 3
    min_tag: int = 3
    top_tags: int = 40
    queued_minutes: int = 10
    running_minutes: int = 15


DEFAULTS = Settings()
