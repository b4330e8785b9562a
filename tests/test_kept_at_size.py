"""A kept index shuffles no postings of a batch, and gives what a search over all documents gives."""

import pytest

from medialake.operators import search as S

ROWS = [(i, " ".join(f"w{(i * k) % 7}" for k in range(i % 9)), "w1" if i % 4 else None) for i in range(40)]


def test_postings_are_made_without_a_shuffle(spark):
    docs = spark.createDataFrame(ROWS, "id long, t string, u string")
    plan = S.index(docs, "id", ["t", "u"])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    expected = {}
    for i, t, u in ROWS:
        for field, text in (("t", t), ("u", u or "")):
            for pos, token in enumerate(text.split()):
                expected.setdefault((i, len(t.split()) + len((u or "").split()), field, token), []).append(pos)
    assert {(r.id, r.dl, r.field, r.token): list(r.positions) for r in S.index(docs, "id", ["t", "u"]).collect()} == expected


@pytest.mark.parametrize("sent", [0, 2_000_000])
def test_merged_and_repeated_documents(spark, monkeypatch, tmp_path, sent):
    monkeypatch.setattr(S.KeptIndex, "SENT", sent, raising=False)
    kept = S.KeptIndex(spark, f"file://{tmp_path}/index", ["t"], buckets=3)
    frame = lambda rows: spark.createDataFrame(rows, "id long, t string")
    kept.upsert(frame([(i, "w1 old") for i, _, _ in ROWS]), "id")
    kept.delete(frame([(i, "") for i in range(0, 40, 7)]))
    kept.merge()
    new = [(i, t) for i, t, _ in ROWS if i % 3 == 0]
    kept.upsert(frame(new + new), "id")
    live = {i: "w1 old" for i in range(40) if i % 7} | dict(new)
    for query in ("w1", "old", "w1 w2"):
        rows = lambda found: [(r.id, round(r.score, 9)) for r in found.collect()]
        assert rows(kept.search(query)) == rows(S.search(frame(list(live.items())), query, "id", ["t"]))


def test_segments_whose_joins_change_their_plan(spark, tmp_path):
    """A large and a small segment are read by one scan: as a union, one part's join is replanned and the search fails or counts hidden rows."""
    frame = lambda ids, text: spark.createDataFrame([(i, text) for i in ids], "id long, t string")
    kept = S.KeptIndex(spark, f"file://{tmp_path}/index", ["t"], buckets=3)
    kept.upsert(frame(range(20_000), "w1 old"), "id")
    kept.upsert(frame(range(0, 20_000, 1_000), "w1 w1 new"), "id")
    asked = S._asked("w1", ["t"], False)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        for most in ("1k", "4k", "16k", "64k"):
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)
            assert "Union" not in kept.hits(asked, kept._commits())._jdf.queryExecution().executedPlan().toString()
            got = {r.id: round(r.score, 9) for r in kept.search("w1", limit=30_000).collect()}
            assert got.keys() == set(range(20_000)) and len(set(got.values())) == 2, most
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
