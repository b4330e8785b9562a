"""Names, titles and lists: scalar functions over text columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def slug(*parts: Column) -> Column:
    """Lower-case parts joined by dashes, other characters as single dashes, at most 200, else 'untitled'."""
    joined = F.concat_ws("-", *[F.when(F.trim(p) != "", F.lower(F.trim(p))) for p in parts])
    bare = F.regexp_replace(F.regexp_replace(joined, "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.coalesce(F.nullif(F.left(bare, F.lit(200)), F.lit("")), F.lit("untitled"))


def scene_title(raw: Column) -> Column:
    """Words of a scene label, capitalised; labels that say nothing give an empty title."""
    text = F.trim(F.regexp_replace(F.coalesce(raw, F.lit("")), "[_-]", " "))
    return F.when(F.lower(text).isin("", "unknown", "none", "n/a"), "").otherwise(F.initcap(F.lower(F.regexp_replace(text, r"\s+", " "))))


def month_name(ts: Column) -> Column:
    return F.date_format(ts, "MMMM yyyy")


def json_list(raw: Column) -> Column:
    """A JSON array of strings, trimmed, blanks dropped; null and malformed text give an empty list."""
    items = F.coalesce(F.from_json(raw, "array<string>"), F.array().cast("array<string>"))
    return F.filter(F.transform(items, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))


def event_title(first: Column, last: Column) -> Column:
    """The days, months or years that an event spans."""
    f = F.date_format
    same_year = F.year(first) == F.year(last)
    return (
        F.when(F.to_date(first) == F.to_date(last), F.concat(F.dayofmonth(first), F.lit(" "), f(first, "MMM yyyy")))
        .when(same_year & (F.month(first) == F.month(last)), F.concat(F.dayofmonth(first), F.lit("–"), F.dayofmonth(last), F.lit(" "), f(first, "MMM yyyy")))
        .when(same_year, F.concat(f(first, "MMM"), F.lit("–"), f(last, "MMM yyyy")))
        .otherwise(F.concat(F.year(first), F.lit("–"), F.year(last)))
    )


def event_key(first: Column, last: Column, n: Column) -> Column:
    return F.concat(F.lit("event:"), F.date_format(first, "yyyyMMdd"), F.lit("-"), F.date_format(last, "yyyyMMdd"), F.lit("-"), n)


def media_type(ext: Column) -> Column:
    """Image or video by extension; null for others."""
    return F.when(F.lower(ext).isin(*IMAGES), "image").when(F.lower(ext).isin(*VIDEOS), "video")


#: The catalogue's extensions.
IMAGES = [".jpg", ".jpeg", ".tif", ".tiff", ".png", ".heic", ".heif", ".raw", ".cr2", ".nef", ".arw", ".dng", ".gif", ".webp", ".bmp"]
VIDEOS = [".mp4", ".mov", ".avi", ".mkv", ".m4v", ".wmv", ".mpg", ".mpeg", ".3gp"]
ARCHIVES = [".tar.gz", ".tar.bz2", ".tar.xz", ".tgz", ".tbz2", ".txz", ".zip", ".tar", ".rar", ".7z"]


def suffix(path: Column) -> Column:
    """The file name's extension with its dot, lower case, or nothing."""
    return F.lower(F.regexp_extract(path, r"[^/.][^/]*?(\.[^./]+)$", 1))


def archive_suffix(path: Column) -> Column:
    """The archive extension, the longest compound first; null for others."""
    out = F.lit(None).cast("string")
    for s in reversed(ARCHIVES):
        out = F.when(F.lower(path).endswith(s), s).otherwise(out)
    return out


def safe_path(path: Column) -> Column:
    """A relative path with bad characters replaced and segments cut to 180; null where a segment is '..'."""
    parts = F.filter(F.split(F.regexp_replace(path, r"\\", "/"), "/"), lambda p: ~p.isin("", "."))
    clean = F.transform(parts, lambda p: F.left(F.regexp_replace(p, r'[<>:"|?*\x00-\x1f]', "_"), F.lit(180)))
    return F.when(~F.array_contains(parts, "..") & (F.size(parts) > 0), F.array_join(clean, "/"))


def asset_version(updated_s: Column, rotation: Column, sha256: Column) -> Column:
    """A token that changes whenever a shown picture does."""
    return F.concat_ws("-", (updated_s * 1000).cast("string"), F.coalesce(rotation, F.lit(0)).cast("string"), F.left(sha256, F.lit(8)))


def human_bytes(n: Column) -> Column:
    """Bytes in the largest unit below them, one decimal from KB on."""
    out = F.concat(F.format_string("%.1f", n / 1024.0**3), F.lit(" GB"))
    for power, unit in ((2, "MB"), (1, "KB")):
        out = F.when(n < 1024 ** (power + 1), F.concat(F.format_string("%.1f", n / 1024.0**power), F.lit(f" {unit}"))).otherwise(out)
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).otherwise(out)


def as_int(text: Column) -> Column:
    """A number in a text without its fraction; null where there is none that a long can hold."""
    return text.try_cast("double").try_cast("long")


def as_text(text: Column) -> Column:
    """The text without white space around it; null where nothing is left."""
    return F.nullif(F.regexp_replace(text.cast("string"), r"^\s+|\s+$", ""), F.lit(""))


def volume_slug(name: Column) -> Column:
    """A volume's name as a folder's: other characters than letters, digits, '-' and '_' as '_', at most 80."""
    clean = F.regexp_replace(F.regexp_replace(as_text(name), r"[^\p{L}\p{N}_-]", "_"), "^_+|_+$", "")
    return F.left(F.coalesce(F.nullif(clean, F.lit("")), F.lit("unknown_volume")), F.lit(80))


def provenance_name(volume: Column, at: Column) -> Column:
    """The slug of a volume and the time (UTC) of its import."""
    return F.concat(volume_slug(volume), F.lit("_"), F.date_format(at, "yyyyMMdd_HHmmss"))


#: Fixed values of JSON: characters that have escapes of their own.
ESCAPES = {"0022": '\\"', "005C": "\\\\", "0008": "\\b", "0009": "\\t", "000A": "\\n", "000C": "\\f", "000D": "\\r"}


def ascii_json(texts: Column) -> Column:
    """A list of texts as JSON in plain ASCII, a comma and a space between items; null for null, null items are null."""

    def quoted(text: Column) -> Column:
        unit = lambda u: F.coalesce(
            F.try_element_at(F.create_map(*[F.lit(x) for kv in ESCAPES.items() for x in kv]), u),
            F.when(u.between("0020", "007E"), F.char(F.conv(u, 16, 10).cast("int"))).otherwise(F.concat(F.lit("\\u"), F.lower(u))),
        )
        units = F.regexp_extract_all(F.hex(F.encode(text, "UTF-16BE")), F.lit("(.{4})"), F.lit(1))
        return F.coalesce(F.concat(F.lit('"'), F.array_join(F.transform(units, unit), ""), F.lit('"')), F.lit("null"))

    return F.concat(F.lit("["), F.array_join(F.transform(texts, quoted), ", "), F.lit("]"))
