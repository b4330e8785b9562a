"""Archives: their members, what is taken of them, and their bytes."""

from __future__ import annotations

import io
import tarfile
import zipfile
import zlib
from collections.abc import Callable, Iterator
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.functions import udtf

from ..batches import BATCH_BYTES, BATCH_ROWS
from ..functions.names import IMAGES, VIDEOS, media_type, suffix
from ..operators.ordered import numbered

#: How much of one archive is expanded.
MOST_FILES, MOST_BYTES = 50_000, 8 * 1024**3


def is_media_member(name: str) -> bool:
    """A media file by extension, and neither hidden nor an archiver's own."""
    parts = name.replace("\\", "/").split("/")
    last = parts[-1].lower()
    return "__MACOSX" not in parts and not last.startswith(".") and any(last.endswith(e) for e in IMAGES + VIDEOS)


def accepted_members(members: DataFrame, most_files: int = MOST_FILES, most_bytes: int = MOST_BYTES) -> DataFrame:
    """Rows (archive, pos, member, size) that an expansion takes: media, until a cap is first passed, then none."""
    hidden = F.col("member").rlike(r"(^|/)(__MACOSX(/|$)|\.[^/]*$)")
    kept = members.filter(media_type(suffix(F.col("member"))).isNotNull() & ~hidden)
    summed = numbered(kept, ["archive"], ["pos"], ["size"])
    return summed.filter((F.col("number") <= most_files) & (F.col("sum_size") <= most_bytes)).drop("number", "sum_size")


def _listed(content: bytes) -> Iterator[tuple[str, int, Callable[[], bytes]]]:
    """(path, size, reader) of the files of a zip or tar, by its directory or headers alone."""
    if zipfile.is_zipfile(io.BytesIO(content)):
        archive = zipfile.ZipFile(io.BytesIO(content))
        yield from ((i.filename, i.file_size, partial(archive.read, i)) for i in archive.infolist() if not i.is_dir())
    else:
        archive = tarfile.open(fileobj=io.BytesIO(content))
        yield from ((m.name, m.size, lambda m=m: archive.extractfile(m).read()) for m in archive if m.isfile())


def _media(content: bytes) -> Iterator[tuple[str, int, Callable[[], bytes]]]:
    """Media members that stay inside a folder."""
    for path, size, read in _listed(content):
        clean = path.replace("\\", "/")
        if is_media_member(path) and ".." not in clean.split("/"):
            yield clean.lstrip("/"), size, read


#: What reading a damaged archive can raise; zipfile says RuntimeError of encrypted members, NotImplementedError of odd methods.
DAMAGED = (tarfile.TarError, zipfile.BadZipFile, zlib.error, EOFError, OSError, RuntimeError, NotImplementedError)


def members_of(content: bytes, most_files: int = MOST_FILES, most_bytes: int = MOST_BYTES) -> Iterator[tuple[str, int, bytes]]:
    """Media members (path, size, bytes) of a zip or tar, until a cap is first passed; a damaged archive has those before the damage."""
    total = 0
    try:
        for files, (path, size, read) in enumerate(_media(content), 1):
            total += size
            if files > most_files or total > most_bytes:
                return
            yield path, size, read()
    except DAMAGED:
        return


@udtf(returnType=T.StructType([T.StructField("member", T.StringType()), T.StructField("size", T.LongType()), T.StructField("content", T.BinaryType())]))
class ArchiveMembers:
    """Media members of one archive: used with lateral joins over binary files."""

    def eval(self, content: bytes):
        yield from members_of(bytes(content or b""))


def _lists_media(content: bytes | None) -> bool:
    try:
        return next(_media(bytes(content or b"")), None) is not None
    except DAMAGED:
        return False


@F.pandas_udf(T.BooleanType())
def has_media(contents: pd.Series) -> pd.Series:
    """Whether an archive lists a media member, by its names; false for unreadable ones."""
    return pd.Series([_lists_media(c) for c in contents], dtype=bool)


def _members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (archive, member, size, content) of the archives (path, content), in batches of bounded bytes."""
    names = ["archive", "member", "size", "content"]
    for rows in batches:
        held, many = [], 0
        for path, content in zip(rows["path"], rows["content"]):
            for member, size, body in members_of(bytes(content or b"")):
                held.append((path, member, size, body))
                many += len(body)
                if len(held) >= BATCH_ROWS or many >= BATCH_BYTES:
                    yield pd.DataFrame(held, columns=names)
                    held, many = [], 0
        if held:
            yield pd.DataFrame(held, columns=names)


def expanded(files: DataFrame) -> DataFrame:
    """Members of the archives among binary files (path, content), with a path under archives/."""
    found = files.select("path", "content").mapInPandas(_members, "archive string, member string, size long, content binary")
    stem = F.regexp_extract("archive", r"([^/]+?)(\.tar)?\.[^./]+$", 1)
    return found.select("archive", "member", F.concat_ws("/", F.lit("archives"), stem, "member").alias("rel_path"), "size", "content")
