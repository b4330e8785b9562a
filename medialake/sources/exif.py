"""Metadata from the bytes of pictures: a walk over the directories of a TIFF structure, alone or inside a JPEG."""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.functions import udtf

#: Bytes of a file that are looked at: directories stand at the beginning.
HEAD = 1 << 18
#: Fixed values of the format: tags by directory, directories that a tag points to, and sizes and codes of value types.
TAGS = {
    "EXIF": {
        0x0100: "ImageWidth", 0x0101: "ImageHeight", 0x010F: "Make", 0x0110: "Model", 0x0112: "Orientation", 0x0132: "ModifyDate", 0x9003: "DateTimeOriginal", 0x9004: "CreateDate",
        0xA002: "ExifImageWidth", 0xA003: "ExifImageHeight",
    },
    "GPS": {1: "GPSLatitudeRef", 2: "GPSLatitude", 3: "GPSLongitudeRef", 4: "GPSLongitude"},
}
POINTERS = {0x8769: "EXIF", 0x8825: "GPS"}
TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 7: "s", 8: "h", 9: "i", 10: "ii"}
#: Entries of a directory, and values of an entry, that are read at most.
MOST_ENTRIES, MOST_VALUES = 1_000, 10_000


def tiff_of(content: bytes) -> bytes | None:
    """The TIFF structure of a file: the file itself, or what the first Exif segment of a JPEG holds."""
    if content[:4] in (b"II*\0", b"MM\0*"):
        return content
    at = 2 if content[:2] == b"\xff\xd8" else len(content)
    while at + 4 <= len(content) and content[at] == 0xFF:
        kind, size = content[at + 1], struct.unpack_from(">H", content, at + 2)[0]
        if kind == 0xE1 and content[at + 4 : at + 10] == b"Exif\0\0":
            return content[at + 10 : at + 2 + size]
        if kind == 0xDA or size < 2:  # the picture itself begins, or this is no segment
            return None
        at += 2 + size
    return None


def _values(tiff: bytes, order: str, kind: int, many: int, at: int) -> list | str | None:
    """Values of an entry whose value field stands at `at`; None where they lie outside the file or make no sense."""
    code = TYPES.get(kind)
    if not code or not 0 < many <= MOST_VALUES:
        return None
    form = order + (f"{many}s" if code == "s" else code * many)
    size = struct.calcsize(form)
    if size > 4:
        at = struct.unpack_from(order + "I", tiff, at)[0]
    if at + size > len(tiff):
        return None
    found = struct.unpack_from(form, tiff, at)
    if code == "s":
        return found[0].split(b"\0")[0].decode("utf-8", "replace").strip()
    if len(code) == 2:
        return [a / b if b else None for a, b in zip(found[::2], found[1::2])]
    return list(found)


def _text(name: str, values: list | str) -> str | None:
    """A value as text: degrees of a position as one number, the first of others."""
    if isinstance(values, str):
        return values or None
    if name in ("GPSLatitude", "GPSLongitude"):
        return str(sum(v / 60**i for i, v in enumerate(values[:3]))) if None not in values[:3] else None
    return None if values[0] is None else str(values[0])


def tags(content: bytes | None) -> Iterator[tuple[str, str, str]]:
    """(group, name, value) of the known tags, of each the first one that has a value.

    Both byte orders. Directories are walked once each, so loops end; offsets and counts beyond the file, unknown types
    and cut-off directories are passed over, and what stands before them is kept.
    """
    tiff = tiff_of(bytes(content or b""))
    if tiff is None or len(tiff) < 8:
        return
    order = "<" if tiff[:2] == b"II" else ">"
    todo, walked, told = [("EXIF", struct.unpack_from(order + "I", tiff, 4)[0])], set(), set()
    while todo:
        group, at = todo.pop(0)
        if at in walked or not 8 <= at <= len(tiff) - 2:
            continue
        walked.add(at)
        entries = struct.unpack_from(order + "H", tiff, at)[0]
        for k in range(min(entries, MOST_ENTRIES)):
            entry = at + 2 + 12 * k
            if entry + 12 > len(tiff):
                break
            tag, kind, many = struct.unpack_from(order + "HHI", tiff, entry)
            values = _values(tiff, order, kind, many, entry + 8)
            if values is None:
                continue
            if tag in POINTERS and isinstance(values, list) and kind == 4:
                todo.append((POINTERS[tag], values[0]))
            elif name := TAGS[group].get(tag):
                value = _text(name, values)
                if value is not None and (group, name) not in told:
                    told.add((group, name))
                    yield group, name, value


@udtf(returnType=T.StructType([T.StructField(c, T.StringType()) for c in ("group", "name", "value")]))
class ExifTags:
    """The tags of one file's head: used with lateral joins over binary files."""

    def eval(self, content: bytes):
        yield from tags(content)


@F.pandas_udf(T.StringType())
def _json(contents: pd.Series) -> pd.Series:
    found = ({f"{group}:{name}": value for group, name, value in tags(c)} for c in contents)
    return pd.Series([json.dumps(f) if f else None for f in found], dtype=object)


def raw_metadata(content: Column) -> Column:
    """A file's tags as a metadata text, as files.metadata() reads it; null where there are none."""
    return _json(F.substring(content, 1, HEAD))


def tag_rows(files: DataFrame) -> DataFrame:
    """One row (path, group, name, value) for each tag of the files (path, content)."""
    heads = files.select("path", F.substring("content", 1, HEAD).alias("head"))
    return heads.lateralJoin(ExifTags(F.col("head").outer())).select("path", "group", "name", "value")
