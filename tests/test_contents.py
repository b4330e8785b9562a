"""Archives and picture heads from their bytes, whole and damaged."""

import io
import struct
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from medialake.plans.contents import tiff
from medialake.sources import archives, exif, files


def said(content):
    return {f"{g}:{n}": v for g, n, v in exif.tags(content)}


WHOLE = {"EXIF:Make": "Canon", "EXIF:Model": "EOS 5D", "EXIF:Orientation": "6", "EXIF:DateTimeOriginal": "2005:02:28 14:30:00", "GPS:GPSLatitudeRef": "S", "GPS:GPSLatitude": "12.5"}


@pytest.mark.parametrize("order", ["<", ">"])
def test_tags_in_both_byte_orders(order):
    """The first directory points to itself: a loop."""
    body = tiff(order, "Canon", "EOS 5D", 6, "2005:02:28 14:30:00", -12.0)
    assert said(body) == WHOLE
    jpeg = b"\xff\xd8\xff\xe0\0\x04ab\xff\xe1" + struct.pack(">H", len(body) + 8) + b"Exif\0\0" + body + b"\xff\xda\0\x04"
    assert said(jpeg) == WHOLE and said(jpeg[2:]) == {}
    for end in range(len(body)):  # cut off anywhere: no error, and nothing that isn't there
        assert said(body[:end]).items() <= WHOLE.items()


def test_tags_with_wrong_numbers():
    body = bytearray(tiff("<", "Canon", "EOS 5D", 6, "2005:02:28 14:30:00", -12.0))
    for at in range(len(body) - 3):  # every number made huge in turn
        broken = bytes(body[:at] + b"\xff\xff\xff\x7f" + body[at + 4 :])
        assert set(said(broken)) <= set(WHOLE)
    assert said(None) == said(b"") == said(b"II*\0") == said(b"\xff\xd8\xff\xe1\0\0") == {}
    many = b"II*\0" + struct.pack("<IH", 8, 65_535)
    assert said(many) == {}


def test_tags_as_rows_and_metadata(spark):
    body = tiff(">", "Nikon", "D90", 3, "2007:07:15 08:00:00", 45.0)
    df = spark.createDataFrame([("a.tif", body), ("b.jpg", b"junk"), ("c.jpg", None)], "path string, content binary")
    rows = {(r.path, r.name): r.value for r in exif.tag_rows(df).collect()}
    assert rows["a.tif", "Make"] == "Nikon" and {p for p, _ in rows} == {"a.tif"} and len(rows) == 6
    m = {r.path: r.m for r in df.select("path", files.metadata(exif.raw_metadata(F.col("content"))).alias("m")).collect()}
    assert (m["a.tif"].camera_model, m["a.tif"].orientation, m["a.tif"].gps_lat, str(m["a.tif"].taken_at)) == ("D90", 3, 45.5, "2007-07-15 08:00:00")
    assert m["b.jpg"].camera_make is None and m["c.jpg"].taken_at is None


def test_damaged_archives_give_what_they_have(spark):
    z, t = io.BytesIO(), io.BytesIO()
    with zipfile.ZipFile(z, "w", zipfile.ZIP_DEFLATED) as f:
        for k in range(3):
            f.writestr(f"a/{k}.jpg", bytes(range(256)) * 40)
    with tarfile.open(fileobj=t, mode="w:gz") as f:
        for name in ("b/1.png", "b/note.txt", "../up.png"):
            info = tarfile.TarInfo(name)
            info.size = 3
            f.addfile(info, io.BytesIO(b"abc"))
    whole = z.getvalue()
    first = whole.find(b"PK\x03\x04", 10)
    broken = whole[: first + 60] + bytes(64) + whole[first + 124 :]
    rows = [("x.zip", whole), ("y.tar.gz", t.getvalue()), ("z.zip", broken), ("e.zip", b""), ("n.zip", None), ("t.tar", t.getvalue()[:40])]
    df = spark.createDataFrame(rows, "path string, content binary")
    got = sorted(r.rel_path for r in archives.expanded(df).collect())
    assert got[:3] == [f"archives/x/a/{k}.jpg" for k in range(3)] and "archives/y/b/1.png" in got and "archives/z/a/0.jpg" in got and len(got) <= 7
    assert {r.path: r.has for r in df.select("path", archives.has_media("content").alias("has")).collect()} == {"x.zip": True, "y.tar.gz": True, "z.zip": True, "e.zip": False, "n.zip": False, "t.tar": False}
    assert "archive_files" not in [t.name for t in spark.catalog.listTables()]


def test_members_leave_in_bounded_batches(monkeypatch):
    """However many members archives have, few bytes are held before they go on."""
    import pandas as pd

    packs = []
    for k in range(3):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for i in range(10):
                z.writestr(f"{k}-{i}.jpg", bytes(100))
        packs.append(out.getvalue())
    monkeypatch.setattr(archives, "BATCH_BYTES", 350)
    got = list(archives._members(iter([pd.DataFrame({"path": ["/a.zip", "/b.zip", "/c.zip", "/none.zip"], "content": [*packs, None]})])))
    assert sum(map(len, got)) == 30 and max(map(len, got)) <= 4
    assert set(pd.concat(got)["archive"]) == {"/a.zip", "/b.zip", "/c.zip"}
