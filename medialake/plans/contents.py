"""Files made of documents, opened again: archives with members, and pictures' heads with metadata."""

from __future__ import annotations

import io
import struct
import tarfile
import zipfile

import pandas as pd
from pyspark.sql import functions as F, types as T

from ..sources import archives, exif, files
from .surrogate import CTE, media

#: Documents in one archive.
TOGETHER = 50
MEMBER = "case when id % 23 = 0 then concat('../', original_path) when id % 29 = 0 then concat('__MACOSX/', original_path) else original_path end"


def _pack(rows: pd.DataFrame) -> pd.DataFrame:
    """One archive of at most TOGETHER documents: a zip, or a tar for odd numbers."""
    rows, number, out = rows.sort_values("id"), int(rows["number"].iloc[0]), io.BytesIO()
    if number % 2:
        with tarfile.open(fileobj=out, mode="w") as tar:
            for name, text in zip(rows["member"], rows["text"]):
                info = tarfile.TarInfo(name)
                info.size = len(text.encode())
                tar.addfile(info, io.BytesIO(text.encode()))
    else:
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for name, text in zip(rows["member"], rows["text"]):
                z.writestr(name, text)
    return pd.DataFrame({"path": [f"/in/pack{number}.{'tar' if number % 2 else 'zip'}"], "content": [out.getvalue()]})


def packed(s, d):
    """Archives of neighbouring documents, under the paths of the catalogue; some lead out of the folder, some are an archiver's own."""
    texts = s.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("id"), "text")
    rows = media(s, d).select("id", F.expr(MEMBER).alias("member")).join(texts, "id").withColumn("number", F.floor(F.col("id") / TOGETHER))
    return rows.groupBy("number").applyInPandas(_pack, "path string, content binary")


def _opened(s, d):
    found = archives.expanded(packed(s, d))
    return found.select("archive", "rel_path", "size", F.sha2("content", 256).alias("sha256"))


IS_MEDIA = "lower(regexp_extract(original_path, '(\\.[^./]+)$', 1)) in ('.jpg', '.jpeg', '.tif', '.tiff', '.png', '.heic', '.heif', '.raw', '.cr2', '.nef', '.arw', '.dng', '.gif', '.webp', '.bmp', '.mp4', '.mov', '.avi', '.mkv', '.m4v', '.wmv', '.mpg', '.mpeg', '.3gp')"
OPENED = f"""{CTE}, m as (select id, original_path, id // {TOGETHER} as k from media where {IS_MEDIA} and id % 23 <> 0 and id % 29 <> 0)
 select '/in/pack' || k || case when k % 2 = 1 then '.tar' else '.zip' end as archive, 'archives/pack' || k || '/' || original_path as rel_path, strlen(text) as size, sha256(text) as sha256 from m join documents on doc_id = id"""
LISTED = f"""{CTE} select '/in/pack' || id // {TOGETHER} || case when id // {TOGETHER} % 2 = 1 then '.tar' else '.zip' end as path, bool_or({IS_MEDIA} and id % 23 <> 0 and id % 29 <> 0) as has from media group by 1"""


def tiff(order: str, make: str, model: str, orientation: int, taken: str, lat: float) -> bytes:
    """A TIFF structure with an Exif and a GPS directory, in one byte order."""
    put = lambda form, *v: struct.pack(order + form, *v)
    heap, base = b"", 8 + 2 + 12 * 5 + 4 + 2 + 12 + 4 + 2 + 24 + 4

    def value(tag: int, kind: int, many: int, raw: bytes) -> bytes:
        nonlocal heap
        if len(raw) <= 4:
            return put("HHI", tag, kind, many) + raw.ljust(4, b"\0")
        at, heap = base + len(heap), heap + raw
        return put("HHII", tag, kind, many, at)

    text = lambda tag, x: value(tag, 2, len(x.encode()) + 1, x.encode() + b"\0")
    exif_at = 8 + 2 + 12 * 5 + 4
    gps_at = exif_at + 2 + 12 + 4
    degrees = int(abs(lat))
    first = text(0x010F, make) + text(0x0110, model) + value(0x0112, 3, 1, put("H", orientation)) + put("HHII", 0x8769, 4, 1, exif_at) + put("HHII", 0x8825, 4, 1, gps_at)
    second = text(0x9003, taken)
    third = text(1, "S" if lat < 0 else "N") + value(2, 5, 3, put("IIIIII", degrees, 1, 30, 1, 0, 1))
    head = (b"II*\0" if order == "<" else b"MM\0*") + put("I", 8)
    return head + put("H", 5) + first + put("I", 8) + put("H", 1) + second + put("I", 0) + put("H", 2) + third + put("I", 0) + heap  # the first directory points to itself


@F.pandas_udf(T.BinaryType())
def _heads(ids: pd.Series, makes: pd.Series, models: pd.Series, taken: pd.Series, lats: pd.Series) -> pd.Series:
    out = []
    for i, make, model, at, lat in zip(ids, makes, models, taken, lats):
        body = tiff("<" if i % 2 else ">", make, model, i % 8 + 1, at, lat)
        jpeg = b"\xff\xd8\xff\xe0\0\x04ab\xff\xe1" + struct.pack(">H", len(body) + 8) + b"Exif\0\0" + body + b"\xff\xda\0\x04ab"
        out.append(None if i % 31 == 0 else b"no picture" if i % 37 == 0 else body[: 8 + i % 60] if i % 41 == 0 else jpeg if i % 3 else body)
    return pd.Series(out)


def _read(s, d):
    """Heads of pictures in both byte orders, alone and inside JPEGs, some missing, foreign or cut off, read again."""
    m = media(s, d).filter("camera_make is not null and taken_at is not null and gps_lat is not null")
    heads = m.select("id", _heads("id", "camera_make", "camera_model", F.date_format("taken_at", "yyyy:MM:dd HH:mm:ss"), "gps_lat").alias("content"))
    found = heads.filter("id % 41 <> 0").select("id", files.metadata(exif.raw_metadata(F.col("content"))).alias("m"))
    return found.select("id", "m.camera_make", "m.camera_model", "m.orientation", F.round("m.gps_lat", 4).alias("gps_lat"), F.unix_timestamp("m.taken_at").alias("taken_s"))


READ = f"""{CTE}, r as (select *, id % 31 = 0 or id % 37 = 0 as none from media where camera_make is not null and taken_at is not null and gps_lat is not null and id % 41 <> 0)
 select id, case when not none then camera_make end as camera_make, case when not none then camera_model end as camera_model, case when not none then cast(id % 8 + 1 as int) end as orientation,
 case when not none then case when gps_lat < 0 then -(abs(gps_lat)::int + 0.5) else abs(gps_lat)::int + 0.5 end end::double as gps_lat, case when not none then taken_s end::bigint as taken_s from r"""

QUERIES = {
    "sc8_opened_archives": (_opened, OPENED),
    "sc7_listed_archives": (lambda s, d: packed(s, d).select("path", archives.has_media("content").alias("has")), LISTED),
    "sc14_metadata_from_bytes": (_read, READ),
}
