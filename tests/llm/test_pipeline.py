"""The pipeline's rows against the same steps done plainly."""

import shutil
import zlib

import corpus_pipeline
import numpy as np
from medialake.llm import packing, secret_scans, toxicity
from medialake.llm.encoding import vocabulary_path
from pyspark.sql import functions as F
from test_operators import AWKWARD, brute_base, brute_components, brute_contamination, valid_bins

SF = "/root/testdata/sf0.001"


def brute_pieces(rows):
    """What the packing stage has to place, from (id, text) that went through all others."""
    from tokenizers import Tokenizer

    tokenizer, path = Tokenizer.from_file(vocabulary_path()), vocabulary_path(secret_scans.RANKS)
    out = []
    for i, t in rows:
        t = secret_scans.without(t or "", brute_base(t or "") + secret_scans.random_spans(t or "", path), "[SECRET]")
        ids = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 2], "<u4")
        at = packing.cut_points(len(ids), 1024)
        out += [(i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(at, at[1:]))]
    return out


def brute_kept(rows, items, model):
    rows = [(i, t) for i, t in rows if model.score(t or "") < 0.5]
    groups = brute_components([(i, t) for i, t in rows if i is not None])
    seen, kept = set(), []
    for i, t in rows:
        if i is None or groups[i][1] == i and i not in seen:
            seen.add(i)
            kept.append((i, t))
    return [(i, t) for i, t in kept if not brute_contamination([(i, t)], items)[i][4]]


def held(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.fit(docs, labels)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    left = brute_kept(rows, items, model)
    got = corpus_pipeline.run(spark, sf).collect()
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=repr) == sorted(brute_pieces(left), key=repr)
    valid_bins([(0, r.sequence_id, r.offset, r.length) for r in got], 1024)
    return rows, left


def test_pipeline(spark):
    rows, left = held(spark, SF)
    secret = {i for i, t in left if brute_base(t)}
    assert len(left) < len(rows) and len(secret) < len(left)


def test_pipeline_on_awkward_rows(spark, tmp_path):
    """Nulls, empty and long texts, repeated rows, missing ids and clashing columns among real documents."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = [(None if i is None else i + 10_000, t) for i, t in AWKWARD] + [(None, "no id here"), (None, "no id here"), (None, None), (20_000, "token = abcdef1234 " * 40)]
    extra = spark.createDataFrame(odd, "doc_id long, text string").select("doc_id", "text", F.lit(None).cast("string").alias("lang"), F.lit("x").alias("source"), F.lit(None).cast("long").alias("n_chars"))
    whole = docs.unionByName(extra).withColumns({c: F.lit("clash") for c in ("id", "key", "score", "length", "kept_id", "copy")})
    for name in ("labels", "benchmark"):
        path = f"{SF}/{name}.parquet"
        spark.read.parquet(path).write.parquet(f"{tmp_path}/{name}.parquet")
    whole.write.parquet(f"{tmp_path}/documents.parquet")
    held(spark, str(tmp_path))
    stages = dict(corpus_pipeline.STAGES[:-1])
    for name, stage in stages.items():
        assert stage(spark, whole, str(tmp_path)).columns == whole.columns, name
    shutil.rmtree(f"{tmp_path}/documents.parquet")
    whole.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
