"""The copy stage of an import: tasks copy files in blocks, hash them, read them again, and rename at the end."""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, functions as F

BLOCK = 1 << 20
OUTCOMES = "source string, target string, outcome string, sha256 string, size long, reason string"


class Cancelled(Exception):
    """The copy was asked to stop."""


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and the path in it of a URI, or of a path on this machine."""
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri.removeprefix("file:"))


def hashed(files: fs.FileSystem, path: str) -> tuple[str, int]:
    """SHA-256 and size of a file, read in blocks."""
    digest, size = hashlib.sha256(), 0
    with files.open_input_stream(path) as stream:
        while block := stream.read(BLOCK):
            digest.update(block)
            size += len(block)
    return digest.hexdigest(), size


def _is_file(files: fs.FileSystem, path: str) -> bool:
    return files.get_file_info(path).type == fs.FileType.File


def copy(source: str, target: str, mark: str | None = None) -> tuple[str, str | None, int | None, str | None]:
    """Copies one file: (outcome, sha256, size, reason).

    Each attempt writes to a name of its own beside the target, and takes the target's name only when what was written
    reads back with the same hash; so attempts that die, are repeated, or run twice leave whole files or none. A target
    that is there already with the source's content is left alone. A file named by mark stops the copy between blocks.
    A local source's times go with it.
    """
    (from_fs, from_path), (to_fs, to_path) = opened(source), opened(target)
    part = f"{to_path}.{uuid.uuid4().hex}.part"
    stop = opened(mark) if mark else None
    try:
        if not _is_file(from_fs, from_path):
            return "failed", None, None, "no such file"
        if _is_file(to_fs, to_path):
            own, there = hashed(from_fs, from_path), hashed(to_fs, to_path)
            return ("present", *own, None) if own == there else ("failed", *own, "another file has the name")
        to_fs.create_dir(os.path.dirname(to_path), recursive=True)
        digest, size = hashlib.sha256(), 0
        with from_fs.open_input_stream(from_path) as read, to_fs.open_output_stream(part) as write:
            while True:
                if stop and _is_file(*stop):
                    raise Cancelled
                block = read.read(BLOCK)
                if not block:
                    break
                write.write(block)
                digest.update(block)
                size += len(block)
        if hashed(to_fs, part) != (digest.hexdigest(), size):
            raise OSError("what was written reads back otherwise")
        if isinstance(from_fs, fs.LocalFileSystem) and isinstance(to_fs, fs.LocalFileSystem):
            times = os.stat(from_path)
            os.utime(part, ns=(times.st_atime_ns, times.st_mtime_ns))
        to_fs.move(part, to_path)
        return "copied", digest.hexdigest(), size, None
    except Cancelled:
        return "cancelled", None, None, None
    except OSError as error:
        return "failed", None, None, str(error)[:200]
    finally:
        if _is_file(to_fs, part):
            to_fs.delete_file(part)


def copied(files: DataFrame, mark: str | None = None) -> DataFrame:
    """Copies files (source, target) in the tasks; one row of outcome each: copied, present, failed or cancelled.

    A failing file is a row, not a failing task. Two sources for one target: the first to end has it, the other is
    present if it is the same content and failed if not. Nulls are failed. Running it again copies what is missing.
    """

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [(s, t, *(copy(s, t, mark) if s and t else ("failed", None, None, "no name"))) for s, t in zip(batch["source"], batch["target"])]
            yield pd.DataFrame(out, columns=["source", "target", "outcome", "sha256", "size", "reason"]).astype({"size": "Int64"})

    return files.select("source", "target").mapInPandas(work, OUTCOMES)


def totals(outcomes: DataFrame) -> DataFrame:
    """Files and bytes by outcome."""
    return outcomes.groupBy("outcome").agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))
