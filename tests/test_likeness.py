"""Hashes of pictures and texts, and near vectors by projections against the exact way."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from medialake.functions import hashes
from medialake.operators import duplicates


def apart(a, b):
    return bin(int(a, 16) ^ int(b, 16)).count("1")


def picture(seed, height=90, width=120):
    rng = np.random.default_rng(seed)
    y, x = np.mgrid[0:height, 0:width] / 30
    waves = sum(rng.uniform(10, 40) * np.cos(rng.uniform(-2, 2) * x + rng.uniform(-2, 2) * y + rng.uniform(0, 6)) for _ in range(6))
    return np.clip(128 + waves, 0, 255)


def test_a_picture_and_its_copies_have_near_hashes():
    for seed in range(20):
        p = picture(seed)
        rng = np.random.default_rng(100 + seed)
        noisy, smaller, lighter = p + rng.normal(0, 3, p.shape), hashes.resized(p, 60, 80), np.clip(p * 0.9 + 10, 0, 255)
        for h in (hashes.dct_hash, hashes.difference_hash):
            own = h(p)
            assert len(own) == 16 and all(apart(own, h(c)) <= 8 for c in (noisy, smaller, lighter))
            assert sum(apart(own, h(picture(s))) for s in range(200, 210)) / 10 > 18


def test_hashes_by_their_definitions():
    """The cosine transform and the median written out, and a slope of light that only rises."""
    p = np.floor(picture(3, 32, 32))
    low = [[sum(p[y, x] * np.cos(np.pi * u * (2 * y + 1) / 64) * np.cos(np.pi * v * (2 * x + 1) / 64) for y in range(32) for x in range(32)) for v in range(8)] for u in range(8)]
    flat = sorted(c for row in low for c in row)
    bits = "".join("1" if c > (flat[31] + flat[32]) / 2 else "0" for row in low for c in row)
    assert hashes.dct_hash(p) == f"{int(bits, 2):016x}"
    slope = np.tile(np.linspace(0, 255, 90), (40, 1))
    assert hashes.difference_hash(slope) == "f" * 16 and hashes.difference_hash(slope[:, ::-1]) == "0" * 16
    assert (hashes.resized(p, 32, 32) == p).all() and (hashes.resized(np.full((50, 70), 9.0), 8, 9) == 9).all()


def test_hashes_of_what_is_no_picture(spark):
    rows = [(1, None, 4), (2, [], 4), (3, [1.0, 2.0, 3.0], 2), (4, [1.0] * 8, 0), (5, [1.0] * 8, None), (6, [1.0] * 8, 4), (7, [float("nan")] * 8, 4)]
    df = spark.createDataFrame(rows, "id int, p array<double>, w int")
    got = {r.id: r.h for r in df.select("id", hashes.picture_hashes(F.col("p"), F.col("w")).alias("h")).collect()}
    assert all(got[i].phash is None and got[i].dhash is None for i in (1, 2, 3, 4, 5, 7)) and got[6].dhash == "0" * 16


def test_simhash_of_near_texts(spark):
    r = random.Random(1)
    lexicon = [f"word{i}" for i in range(500)]
    base = [r.choice(lexicon) for _ in range(300)]
    near = base[:100] + ["other"] + base[101:]
    far = [r.choice(lexicon) for _ in range(300)]
    rows = [(1, " ".join(base)), (2, "  \n".join(near)), (3, " ".join(far)), (4, None), (5, " \t"), (6, "two words"), (7, "two  words")]
    got = {x.id: x.h for x in spark.createDataFrame(rows, "id int, t string").select("id", hashes.simhash(F.col("t")).alias("h")).collect()}
    assert apart(got[1], got[2]) <= 8 < apart(got[1], got[3]) and got[4] is None and got[5] is None and got[6] == got[7]


@pytest.mark.parametrize("together", [4, 30])
def test_projections_find_what_the_exact_way_finds(spark, monkeypatch, together):
    """Recall at the threshold itself, far above 0.9, with copies, zero and null vectors; what is found is exact."""
    monkeypatch.setattr(duplicates, "TOGETHER", 5)  # buckets are dealt by salts
    rng = np.random.default_rng(3)
    base = rng.normal(size=(150, 24))
    rows, k = [], 0
    for v in base:
        for angle in (0.0, np.arccos(0.921), np.arccos(0.919), np.arccos(0.97)):
            w = rng.normal(size=24)
            w -= (w @ v) / (v @ v) * v
            rows.append((k, (np.cos(angle) * v / np.linalg.norm(v) + np.sin(angle) * w / np.linalg.norm(w)).tolist()))
            k += 1
    rows += [(9_000 + i, rows[4][1]) for i in range(30)] + [(9_100, [0.0] * 24), (9_101, [0.0] * 24), (9_102, None)]
    df = spark.createDataFrame(rows, "id long, embedding array<double>")
    exact = {(r.a, r.b): r.similarity for r in duplicates.cosine_pairs(df, 0.92).collect() if r.a < 9_000 and r.b < 9_000}
    got = duplicates.projected_pairs(df, 0.92, together=together).collect()
    found = {(r.a, r.b): r.similarity for r in got if r.a < 9_000 and r.b < 9_000}
    assert found.keys() <= exact.keys() and len(found) >= 0.99 * len(exact) and all(abs(s - exact[p]) < 1e-9 for p, s in found.items())
    assert {(r.a, r.b) for r in got if r.b >= 9_000} == {(4, 9_000 + i) for i in range(30)}
    assert duplicates.projected_pairs(df.limit(0)).count() == 0 and duplicates.projected_pairs(df.filter("id >= 9100")).count() == 0


def test_projected_pairs_of_copies(spark):
    """With copies, every id of a class has the pairs of its class: what all vectors compared give."""
    rng = np.random.default_rng(5)
    base = rng.normal(size=(12, 16))
    rows = [(10 * i + k, (v + 0.05 * (k // 3) * rng.normal(size=16) if k > 2 else v).tolist()) for i, v in enumerate(base) for k in range(5)]
    rows += [(1_000 + k, [0.0] * 16) for k in range(2)]
    df = spark.createDataFrame(rows, "id long, embedding array<double>")
    exact = {(r.a, r.b): round(r.similarity, 9) for r in duplicates.cosine_pairs(df, 0.92).collect()}
    got = duplicates.projected_pairs(df, 0.92, miss=1e-9, copies=True).collect()
    assert len(got) == len(exact) == 120 and {(r.a, r.b): round(r.similarity, 9) for r in got} == exact
    alone = duplicates.projected_pairs(df, 0.92, miss=1e-9).collect()
    assert len(alone) == 60 and {(r.a, r.b) for r in alone} < exact.keys()


def test_vectors_are_not_joined_to_pairs_that_met(spark, monkeypatch):
    """A bucket is compared where it lies: each pair comes once, also from cut buckets, and no join has vectors on it but that of copies."""
    rng = np.random.default_rng(8)
    base = rng.normal(size=(40, 12))
    rows = [(i, (base[i % 40] + 0.2 * rng.normal(size=12)).tolist()) for i in range(400)] + [(900, [math.nan] * 12), (901, [math.inf] * 12)]
    df = spark.createDataFrame(rows, "id long, embedding array<double>")
    exact = {(r.a, r.b) for r in duplicates.cosine_pairs(df.filter("id < 900"), 0.92).collect()}
    for crowded in (7, 10_000):
        monkeypatch.setattr(duplicates, "TOGETHER", crowded)
        monkeypatch.setattr(duplicates, "VERIFIED", 50, raising=False)
        found = duplicates.projected_pairs(df, 0.92, miss=1e-9, together=100)
        got = [(r.a, r.b) for r in found.collect()]
        assert len(got) == len(set(got)) and set(got) == exact and len(exact) > 1_000
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 2  # full buckets, and the members of a class


def test_coefficients_that_equal_the_median_are_not_above_it():
    """Symmetric pictures have symmetric coefficients, so their hashes are symmetric; a flat one has its mean light alone."""
    for seed in range(300):
        p = np.random.default_rng(seed).integers(0, 40, (32, 32))
        bits = np.unpackbits(np.frombuffer(bytes.fromhex(hashes.dct_hash((p + p.T).astype(float))), np.uint8)).reshape(8, 8)
        assert (bits == bits.T).all(), seed
    assert hashes.dct_hash(np.full((32, 32), 77.0)) == "8" + "0" * 15


def test_simhash_counts_long_texts_in_blocks(monkeypatch):
    r = random.Random(2)
    texts = [" ".join(r.choice("abcdefgh") for _ in range(n)) for n in (1, 2, 3, 4, 9, 10, 11, 300)]
    whole = [hashes.simhash_of(t) for t in texts]
    monkeypatch.setattr(hashes, "COUNTED", 4)
    assert [hashes.simhash_of(t) for t in texts] == whole


def test_queries_hand_few_rows_to_python(spark):
    from medialake.plans import registry

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    for name in ("sf23_simhash", "sf28_hash_embedding", "sc8_opened_archives"):
        registry.queries()[name](spark, "/root/testdata/sf0.001")
        assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1_000
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
