"""Quality gates: what is kept out of the library, decided by ordered rules whose first failure names the code."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..config import DEFAULTS, Settings
from .names import VIDEOS, suffix

#: Blocked and web extensions, words of junk paths, names of junk folders.
BLOCKED = [
    ".svg", ".svgz", ".eps", ".ai", ".pdf", ".emf", ".wmf", ".ico", ".icns", ".cur", ".ani", ".xcf", ".psd", ".sketch", ".fig", ".cdr", ".swf", ".tga",
]
WEB = [".gif", ".webp", ".bmp", ".png"]
JUNK_WORDS = [
    "thumb(?:nail|s)?", "favicon", "icon(?:s)?", "emoji(?:s)?", "smiley", "emoticon(?:s)?", "avatar(?:s)?", "sprite(?:s)?", "logo(?:s)?", "banner(?:s)?", "watermark",
    "placeholder", "stock[_-]?preview", "web[_-]?thumb", "cache", "tmp", "temp", "download(?:s|ed)?", "reddit", "imgur", "twitter", "facebook", "instagram", "pinterest",
    "meme(?:s)?", "reaction(?:s)?", "sticker(?:s)?", "badge(?:s)?", "button(?:s)?", "widget(?:s)?", "skin(?:s)?", "theme(?:s)?", "wallpaper[_-]?thumb",
]
JUNK_PATH = r"(?i)(?:^|[/\\._\-])(?:" + "|".join(JUNK_WORDS) + r")(?:$|[/\\._\-])"
JUNK_FOLDERS = [
    "thumbs", "thumbnails", "icons", "icon", "favicons", "emojis", "emoji", "stickers", "sprites", "avatars", "reactions", "memes", "gifs", "web", "www", "http", "https",
    "downloads", "browser", "cache", "cached", "tmp", "temp", "__macosx", ".trash", "node_modules", "assets", "static", "public", "dist", "build",
]


def junk_path(path: Column) -> Column:
    return path.rlike(JUNK_PATH)


def junk_folder(path: Column) -> Column:
    return F.arrays_overlap(F.split(F.lower(path), "[/\\\\]"), F.array(*map(F.lit, JUNK_FOLDERS)))


def dimension_code(width: Column, height: Column, media_type: Column, s: Settings = DEFAULTS) -> Column:
    """Code of the first failing rule on the size in pixels, or null; unknown sizes pass."""
    low, high = F.least(width, height), F.greatest(width, height)
    known = width.isNotNull() & height.isNotNull() & (width > 0) & (height > 0)
    video = media_type == "video"
    small = (low < s.min_short_edge) | (high < s.min_long_edge) | (width.cast("double") * height / 1e6 < s.min_megapixels)
    return (
        F.when(~F.coalesce(known, F.lit(False)), F.lit(None))
        .when(video & (low < s.min_video_short_edge), "video_too_small")
        .when(video, F.lit(None))
        .when(small, "too_small")
        .when(high / low > s.max_aspect_ratio, "extreme_aspect")
    )


def path_code(
    path: Column, size: Column, width: Column, height: Column, is_file: Column | None = None, readable: Column | None = None, animated: Column | None = None, s: Settings = DEFAULTS
) -> Column:
    """Code of the first failing rule before a file is copied, or null if it is accepted."""
    ext, none = suffix(path), F.lit(None).cast("string")
    video, web = ext.isin(*VIDEOS), ext.isin(*WEB)
    dims = dimension_code(width, height, F.lit("image"), s)
    strong = F.coalesce(F.least(width, height) >= s.min_short_edge * 1.25, F.lit(False)) & width.isNotNull() & height.isNotNull()
    floor = F.when(web, s.min_web_bytes).otherwise(s.min_image_bytes)
    junk = F.lit(s.reject_junk_paths)
    return (
        F.when(ext.isin(*BLOCKED), "vector_or_blocked")
        .when(~(is_file if is_file is not None else F.lit(True)), "not_a_file")
        .when(~(readable if readable is not None else F.lit(True)), "unreadable")
        .when(size <= 0, "empty")
        .when(size < s.trivial_bytes, "file_too_small")
        .when(junk & junk_path(path), "junk_path")
        .when(junk & junk_folder(path), "junk_dir")
        .when(video & (size < s.min_video_bytes), "file_too_small")
        .when(video, none)
        .when(dims.isNotNull(), dims)
        .when((ext == ".gif") & (animated if animated is not None else F.lit(False)) & F.lit(s.reject_animated_gif), "animated_gif")
        .when(~strong & (size < floor), "file_too_small")
        .when(web & (size < max(8192, s.min_web_bytes // 4)), "web_format_too_small")
    )


def media_code(path: Column, media_type: Column, size: Column, width: Column, height: Column, s: Settings = DEFAULTS) -> Column:
    """Code of the first failing rule after metadata is known, or null: no floor for web formats, none where pixels are plenty."""
    video = media_type == "video"
    dims = dimension_code(width, height, media_type, s)
    plenty = F.coalesce(F.least(width, height) >= s.min_short_edge * 1.25, F.lit(False))
    return (
        F.when(suffix(path).isin(*BLOCKED), "vector_or_blocked")
        .when(F.lit(s.reject_junk_paths) & junk_path(path), "junk_path")
        .when(F.lit(s.reject_junk_paths) & junk_folder(path), "junk_dir")
        .when(dims.isNotNull(), dims)
        .when(video & (size < s.min_video_bytes), "file_too_small")
        .when(~video & ~plenty & (size < s.min_image_bytes), "file_too_small")
    )
