"""A media catalogue made from the driver's tables, in Spark and as SQL: what the registered queries run on.

documents stand for media files, labels for their annotations, sources for discs. Columns that documents lack are
arithmetic on doc_id; each is one expression that Spark and DuckDB both read, but for times and hashes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

ID = "d.doc_id"
YMD = f"lpad(cast(1 + {ID} % 28 as varchar(2)), 2, '0')"
MONTH = f"lpad(cast(1 + {ID} % 12 as varchar(2)), 2, '0')"
YEAR = f"cast(1995 + {ID} % 28 as varchar(4))"
NUMBER = f"lpad(cast({ID} as varchar(12)), 7, '0')"
PATH = f"""case {ID} % 9
 when 0 then concat('downloads/pic ', {NUMBER}, '.jpg')
 when 1 then concat('Holiday/', {YEAR}, '-', {MONTH}, '-', {YMD}, '/IMG_', {NUMBER}, '.JPG')
 when 2 then concat('Forest Park ', {YMD}, '-', {MONTH}, '-', {YEAR}, '/P', {NUMBER}, '.jpg')
 when 3 then concat('trip_', {YEAR}, {MONTH}, {YMD}, '/photo ', {NUMBER}, '.png')
 when 4 then concat('icons/button_', {NUMBER}, '.gif')
 when 5 then concat('odd 31-02-2005/clip ', {NUMBER}, '.mp4')
 when 6 then concat(d.source, '/drawing ', {NUMBER}, '.svg')
 else concat(d.source, '/IMG_', {NUMBER}, '.webp') end"""
MEDIA = {
    "id": ID,
    "disc_id": "d.source",
    "original_path": PATH,
    "filename": f"concat('IMG ', cast({ID} % 40 as varchar(4)), ' ', d.lang, '.jpg')",
    "media_type": "case when d.lang = 'en' then 'image' else 'video' end",
    "file_size": "d.n_chars * 100",
    "width": f"case when {ID} % 17 = 0 then null else cast(200 + ({ID} * 7919) % 3800 as int) end",
    "height": f"case when {ID} % 17 = 0 then null else cast(150 + ({ID} * 104729) % 2900 as int) end",
    "taken_s": f"case when {ID} % 11 = 0 then null else 1104537600 + ({ID} * 2 + ({ID} % 97) * 5) * 86400 + ({ID} % 5) * 3600 end",
    "created_s": f"1700000000 + {ID} * 60",
    "camera_make": f"case {ID} % 4 when 0 then 'Canon' when 1 then 'Nikon' when 2 then 'Apple' end",
    "camera_model": f"case {ID} % 4 when 0 then 'EOS 5D' when 1 then 'D90' when 2 then 'iPhone 6' end",
    "gps_lat": f"case when {ID} % 3 = 0 then null else cast({ID} % 180 as double) - 90.0 end",
    "blur_score": f"case when {ID} % 13 = 0 then null else cast(({ID} * 37) % 4000 as double) / 10.0 end",
    "is_blurry": f"({ID} * 37) % 4000 < 800 and {ID} % 13 <> 0",
    "is_duplicate": f"{ID} % 8 = 0",
    "flag": f"{ID} % 7 = 0",
    "rating": f"cast({ID} % 6 as int)",
    "hitl_status": f"case when {ID} % 6 = 5 then 'pending' else 'accepted' end",
    "lifecycle": f"case {ID} % 10 when 0 then 'trash' when 1 then null when 2 then 'rejected' when 3 then 'staging' else 'library' end",
    "quality_score": "cast(l.quality as double)",
    "phash": f"lpad(substr('0123456789abcdef0123456789abcdef', cast(1 + d.n_chars % 16 as int), 16), 16, '0')",
}
ANALYSIS = {
    "media_id": "d.doc_id",
    "caption_short": "substr(d.text, 1, 60)",
    "description": "substr(d.text, 61)",
    "scene_type": f"case {ID} % 5 when 0 then 'beach' when 1 then 'group_photo' when 2 then 'unknown' when 3 then 'City-scape' end",
    "people_count": f"cast(l.toxic * 2 + {ID} % 3 as int)",
    "suggested_tags": f"case when {ID} % 19 = 0 then '[broken' else concat('[\"', d.lang, '\", \" Sea \", \"', d.source, '\", \"\"]') end",
    "estimated_era": f"case {ID} % 3 when 0 then '2000s' when 1 then 'unknown' end",
    "raw_quality": f"case {ID} % 4 when 0 then '0.7' when 1 then 'n/a' when 2 then '0' else '1.5' end",
    "model_name": f"case {ID} % 6 when 0 then null when 1 then 'heuristic' when 2 then 'vision' when 3 then 'vlm-failed' when 4 then 'quality-gate' else 'vision' end",
    "model_version": f"case {ID} % 7 when 0 then null when 1 then 'vlm-failed:2' when 2 then 'vlm-gave-up' when 3 then 'vlm-failed' when 4 then 'vlm-failed:x' else 'v1' end",
}
#: The driver's own clock never enters a query.
NOW = "2024-06-01 00:00:00"


def _columns(spec: dict[str, str]) -> list[str]:
    return [f"{e} as {c}" for c, e in spec.items()]


def media(spark: SparkSession, d: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{d}/documents.parquet").alias("d"), spark.read.parquet(f"{d}/labels.parquet").alias("l")
    rows = docs.join(labels, F.col("d.doc_id") == F.col("l.doc_id"), "left")
    made = rows.selectExpr(*_columns(MEDIA), "sha2(d.text, 256) as sha256")
    return made.withColumns({"taken_at": F.timestamp_seconds("taken_s"), "created_at": F.timestamp_seconds("created_s"), "deleted_at": F.lit(None).cast("timestamp")})


def analysis(spark: SparkSession, d: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{d}/documents.parquet").alias("d"), spark.read.parquet(f"{d}/labels.parquet").alias("l")
    return docs.join(labels, F.col("d.doc_id") == F.col("l.doc_id")).selectExpr(*_columns(ANALYSIS))


def items(spark: SparkSession, d: str) -> DataFrame:
    """media with annotations."""
    from ..operators.catalog import with_analysis

    return with_analysis(media(spark, d), analysis(spark, d))


_TIMES = "make_timestamp(taken_s * 1000000) as taken_at, make_timestamp(created_s * 1000000) as created_at"
CTE = f"""with media0 as (select {", ".join(_columns(MEDIA))}, sha256(d.text) as sha256 from documents d left join labels l on d.doc_id = l.doc_id),
media as (select *, {_TIMES} from media0),
analysis as (select {", ".join(_columns(ANALYSIS))} from documents d join labels l on d.doc_id = l.doc_id),
items as (select m.*, a.* exclude (media_id) from media m left join analysis a on a.media_id = m.id)
"""
