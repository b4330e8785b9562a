"""Files as tables: folder scans, volumes, and metadata texts."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

from ..functions.dates import metadata_date
from ..functions.names import IMAGES, VIDEOS, media_type, suffix
from .copying import opened

MEDIA_GLOB = "*{" + ",".join(e + "," + e.upper() for e in IMAGES + VIDEOS) + "}"


def scan(spark: SparkSession, path: str, recursive: bool = True, glob: str = MEDIA_GLOB) -> DataFrame:
    """Media files below a folder: path, name, kind, size, modified, sha256. Unreadable ones are left out."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", str(recursive).lower())
        .option("pathGlobFilter", glob)
        .option("ignoreCorruptFiles", "true")
        .option("ignoreMissingFiles", "true")
        .load(path)
    )
    return files.select(
        "path",
        F.element_at(F.split("path", "/"), -1).alias("filename"),
        media_type(suffix(F.col("path"))).alias("media_type"),
        F.col("length").alias("file_size"),
        F.col("modificationTime").alias("modified"),
        F.sha2("content", 256).alias("sha256"),
    )


def flattened(raw: Column) -> Column:
    """Metadata in JSON with group names ('EXIF:Make') as a map by bare names; the first non-empty value stays."""
    pairs = F.map_entries(F.from_json(raw, "map<string,string>"))
    bare = F.filter(F.transform(pairs, lambda e: F.struct(F.element_at(F.split(e["key"], ":"), -1).alias("key"), F.trim(e["value"]).alias("value"))), lambda e: e["value"] != "")
    firsts = F.aggregate(bare, F.array().cast("array<struct<key:string,value:string>>"), lambda acc, e: F.when(F.exists(acc, lambda a: a["key"] == e["key"]), acc).otherwise(F.array_append(acc, e)))
    return F.map_from_entries(firsts)


def metadata(raw: Column) -> Column:
    """The catalogue's fields of a metadata text, each from the first key that has it."""
    m = flattened(raw)
    get = lambda *keys: F.coalesce(*[F.try_element_at(m, F.lit(k)) for k in keys])
    number = lambda *keys: F.coalesce(*[F.try_element_at(m, F.lit(k)).try_cast("double") for k in keys])
    signed = lambda value, ref, low: F.when(F.upper(F.left(get(ref), F.lit(1))) == low, -F.abs(value)).otherwise(value)
    seconds = number("Duration", "MediaDuration")
    return F.struct(
        number("ImageWidth", "ExifImageWidth").cast("int").alias("width"),
        number("ImageHeight", "ExifImageHeight").cast("int").alias("height"),
        get("Make").alias("camera_make"),
        get("Model").alias("camera_model"),
        number("Orientation").cast("int").alias("orientation"),
        signed(number("GPSLatitude"), "GPSLatitudeRef", "S").alias("gps_lat"),
        signed(number("GPSLongitude"), "GPSLongitudeRef", "W").alias("gps_lon"),
        F.when(seconds >= 1e6, seconds).otherwise(seconds * 1000).cast("long").alias("duration_ms"),
        metadata_date(get("DateTimeOriginal", "CreateDate")).alias("taken_at"),
    )


def volume_order(kind: Column) -> Column:
    """Optical before removable and ejectable volumes, these before the rest."""
    return F.when(kind == "optical", 0).when(kind.isin("removable", "ejectable"), 1).otherwise(2)


def stated_bytes(line: Column) -> Column:
    """The number in '(N Bytes)'."""
    return F.regexp_extract(line, r"\((\d+) Bytes\)", 1).try_cast("long")


#: Names of volumes that belong to the system.
SYSTEM = {"Macintosh HD", "Macintosh HD - Data", "Preboot", "Recovery", "VM", "Update", ".timemachine"}


class _Root(InputPartition):
    def __init__(self, path: str):
        self.path = path


def mounted_volumes(root: str) -> list[tuple[str, str, str]]:
    """(name, path, kind) of the volumes below a root, those of the system and hidden ones left out."""
    found = []
    for name in sorted(os.listdir(root)) if os.path.isdir(root) else []:
        path = os.path.join(root, name)
        if os.path.isdir(path) and name not in SYSTEM and not name.startswith("."):
            found.append((name, path, "optical" if name.upper().startswith(("CD", "DVD")) else "removable" if os.path.ismount(path) else "fixed"))
    return found


class VolumeReader(DataSourceReader):
    def __init__(self, root: str):
        self.root = root

    def partitions(self) -> list[InputPartition]:
        return [_Root(self.root)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        yield from mounted_volumes(partition.path)


class VolumeWatch(SimpleDataSourceStreamReader):
    """Volumes as they are mounted. An offset is what is mounted, and what of it is new since the offset before.

    So the state of the watch is in the query's checkpoint: after a restart nothing is told twice, a volume that was
    unmounted is forgotten and counts as new again, and a batch that is repeated has the rows it had.
    """

    def __init__(self, root: str, existing: bool, removable: bool):
        self.root, self.existing, self.removable = root, existing, removable

    def _now(self) -> list[list[str]]:
        return [list(v) for v in mounted_volumes(self.root)]

    def initialOffset(self) -> dict:
        return {"turn": 0, "mounted": [] if self.existing else self._now(), "new": []}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        now = self._now()
        if now == start["mounted"]:
            return iter(()), start
        new = [v for v in now if v not in start["mounted"] and (v[2] != "fixed" or not self.removable)]
        return iter([tuple(v) for v in new]), {"turn": start["turn"] + 1, "mounted": now, "new": new}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter([tuple(v) for v in end["new"]] if end["turn"] > start["turn"] else [])


class Volumes(DataSource):
    """Mounted volumes below a root, as spark.read.format('volumes').option('root', ...)."""

    @classmethod
    def name(cls) -> str:
        return "volumes"

    def schema(self) -> str:
        return "name string, path string, kind string"

    def reader(self, schema) -> DataSourceReader:
        return VolumeReader(self.options.get("root", "/media"))

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        told = lambda option: self.options.get(option, "false").lower() == "true"
        return VolumeWatch(self.options.get("root", "/media"), told("existing"), told("removable"))


def volumes(spark: SparkSession, root: str) -> DataFrame:
    spark.dataSource.register(Volumes)
    found = spark.read.format("volumes").option("root", root).load()
    return found.orderBy(volume_order(F.col("kind")), F.lower("name"))


def new_volumes(spark: SparkSession, root: str, existing: bool = False, removable: bool = False) -> DataFrame:
    """Stream of volumes (name, path, kind) mounted below root from now on, or also those there are; if asked, no fixed ones."""
    spark.dataSource.register(Volumes)
    return spark.readStream.format("volumes").option("root", root).option("existing", str(existing)).option("removable", str(removable)).load()


def probed(files: DataFrame) -> DataFrame:
    """Files (path) with whether a byte of each can be read, and why not: read in the tasks, one byte a file."""

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([(p, *_readable(p)) for p in batch["path"]], columns=["path", "readable", "reason"])

    return files.select("path").mapInPandas(probe, "path string, readable boolean, reason string")


def _readable(path: str | None) -> tuple[bool, str | None]:
    """Whether a byte of the file can be read, from whatever file system its URI names."""
    try:
        files, local = opened(path or "")
        if files.get_file_info(local).type != fs.FileType.File:
            return False, "not a regular file"
        with files.open_input_stream(local) as stream:
            stream.read(1)
    except PermissionError:
        return False, "permission denied"
    except (OSError, ValueError) as error:
        return False, str(error)[:200]
    return True, None
