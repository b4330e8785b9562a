"""Annotations: heuristic ones, the clean-up of a model's, and failure counts."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from .names import scene_title

#: Scene labels and what is taken for one of them.
SCENES = [
    "portrait", "group_photo", "family", "indoor", "outdoor", "landscape", "cityscape", "beach", "water", "boat", "travel", "food", "restaurant", "party", "celebration",
    "sports", "nature", "architecture", "document", "screenshot", "pet", "vehicle", "night", "sunset", "other",
]
SYNONYMS = {
    "group": "group_photo", "people": "group_photo", "sea": "water", "ocean": "water", "lake": "water", "ship": "boat", "yacht": "boat", "dinner": "food", "meal": "food",
    "party": "party", "city": "cityscape", "building": "architecture",
}
GAVE_UP = 10_000


def scene(raw: Column) -> Column:
    """The label itself, a synonym's, or 'other'."""
    label = F.regexp_replace(F.lower(F.trim(F.coalesce(F.nullif(raw, F.lit("")), F.lit("other")))), " ", "_")
    other = F.lit("other")
    for word, known in SYNONYMS.items():
        other = F.when(label == word, known).otherwise(other)
    return F.when(label.isin(*SCENES), label).otherwise(other)


def tags(items: Column, most: int = 15) -> Column:
    """Trimmed lower-case items, blanks dropped, the first 15."""
    clean = F.filter(F.transform(F.coalesce(items, F.array().cast("array<string>")), lambda x: F.lower(F.trim(x))), lambda x: x.isNotNull() & (x != ""))
    return F.slice(clean, 1, most)


def unit_score(raw: Column) -> Column:
    """A number clamped to 0..1; nothing, zero and no number count as a half."""
    value = raw.try_cast("double")
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(value.isNull() | (value == 0), 0.5).otherwise(value)))


def decade(ts: Column) -> Column:
    return F.concat((F.floor(F.year(ts) / 10) * 10).cast("string"), F.lit("s"))


def era(raw: Column, ts: Column) -> Column:
    """The stated era, else the decade of the capture date, else unknown."""
    stated = F.coalesce(raw, F.lit("unknown"))
    return F.when(stated.isin("unknown", "", "none"), F.coalesce(decade(ts), stated)).otherwise(stated)


def normalised_tags(items: Column, label: Column, blurry: Column) -> Column:
    """Tags with 'blurry' added for blurry items and the scene put first, 15 at most."""
    base = tags(items)
    base = F.when(F.coalesce(blurry, F.lit(False)) & ~F.array_contains(base, "blurry"), F.array_append(base, "blurry")).otherwise(base)
    return F.slice(F.when((label != "other") & ~F.array_contains(base, label), F.array_prepend(base, label)).otherwise(base), 1, 15)


def caption(raw: Column, label: Column) -> Column:
    text = F.trim(F.coalesce(raw, F.lit("")))
    return F.left(F.when(text == "", F.concat(scene_title(label), F.lit(" photo"))).otherwise(text), F.lit(160))


def failures(version: Column) -> Column:
    """How often a model failed on an item, by its version mark."""
    v = F.lower(F.trim(F.coalesce(version, F.lit(""))))
    count = F.regexp_extract(v, r"^vlm-failed:\s*([+-]?\d+)\s*$", 1).try_cast("int")
    return F.when(v.startswith("vlm-gave-up"), GAVE_UP).when(v == "vlm-failed", 1).when(v.startswith("vlm-failed:"), F.greatest(F.lit(1), F.coalesce(count, F.lit(1)))).otherwise(0)


def failed_version(before: Column, most: int = 2) -> Column:
    """The version written after one more failure: counted, and given up at `most`."""
    n = F.greatest(F.coalesce(before, F.lit(0)), F.lit(0)) + 1
    return F.when(n >= most, "vlm-gave-up").otherwise(F.concat(F.lit("vlm-failed:"), n.cast("string")))


def annotation_row(result: Column, model: Column, version: Column, at: Column) -> list[Column]:
    """Columns of an annotation to be stored from a model's result: lists as JSON, a missing or zero confidence as 0.5."""
    listed = lambda name: F.to_json(F.coalesce(result[name], F.array().cast("array<string>"))).alias(name)
    plain = [result[c].alias(c) for c in ("caption_short", "description", "scene_type", "people_count", "estimated_era")]
    sure = F.coalesce(F.nullif(result["confidence"].cast("double"), F.lit(0.0)), F.lit(0.5)).alias("confidence")
    return [*plain, listed("objects"), listed("suggested_tags"), sure, model.alias("model_name"), version.alias("model_version"), at.alias("analysed_at")]


def heuristic_quality(width: Column, height: Column, blurry: Column) -> Column:
    """By megapixels, a half where unknown, at most 0.35 for blurry items; three decimals."""
    pixels = width.cast("double") * height
    base = F.when(pixels > 0, F.least(F.lit(1.0), 0.35 + pixels / 1e6 / 12.0)).otherwise(0.5)
    return F.round(F.when(F.coalesce(blurry, F.lit(False)), F.least(base, F.lit(0.35))).otherwise(base), 3)


def heuristic_tags(media_type: Column, make: Column, model: Column, gps: Column, ts: Column) -> Column:
    return F.array_compact(
        F.array(media_type, F.lower(F.nullif(make, F.lit(""))), F.regexp_replace(F.lower(F.nullif(model, F.lit(""))), " ", "-"), F.when(gps.isNotNull(), "geo-tagged"), F.year(ts).cast("string"))
    )


def is_heuristic(name: Column, version: Column, gave_up: bool = False) -> Column:
    """Not a real model's annotation, in SQL's three values: a null version excludes the row, as the catalogue's own filter does."""
    marks = name.isNull() | (name == "") | name.ilike("%heuristic%") | name.ilike("%quality-gate%") | name.ilike("%vlm-failed%") | version.ilike("%vlm-failed%")
    return marks | version.ilike("%vlm-gave-up%") if gave_up else marks & ~version.ilike("%vlm-gave-up%")


def repaired(text: str | None) -> str | None:
    """The JSON object in a model's answer, as JSON again: fences and talk around it gone, trailing commas too, and
    what a cut-off left open closed in the order it was opened; null where there is no object."""
    start = (text or "").find("{")
    if start < 0:
        return None
    end = text.rfind("}")
    whole, rest = text[start : end + 1] if end > start else "", re.sub(r"\s*```\s*$", "", text[start:])
    for candidate in (whole, _closed(whole), _closed(rest)):
        for attempt in (candidate, re.sub(r",\s*([}\]])", r"\1", candidate)):
            try:
                found = json.loads(attempt)
            except json.JSONDecodeError:
                continue
            if isinstance(found, dict):
                return json.dumps(found, ensure_ascii=False)
    return None


def _closed(text: str) -> str:
    """The text with an open string and open brackets closed."""
    stack, quoted, skip = [], False, False
    for ch in text:
        if skip or (quoted and ch == "\\"):
            skip = not skip
        elif ch == '"':
            quoted = not quoted
        elif not quoted and ch in "{[":
            stack.append("}" if ch == "{" else "]")
        elif not quoted and stack and ch == stack[-1]:
            stack.pop()
    return re.sub(r"[,:]\s*$", "", (text + '"' if quoted else text).rstrip()) + "".join(reversed(stack))


@F.pandas_udf(T.StringType())
def repaired_json(texts: pd.Series) -> pd.Series:
    return pd.Series([repaired(t) for t in texts], dtype=object)
