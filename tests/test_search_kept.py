"""Search by phrases and fields in one read of the documents, and an index that is kept."""

import random

import pytest

from medialake.operators import search as S

ROWS = [
    (1, "New York in spring", "travel"), (2, "a new house in York", "travel"), (3, "York, new: york new york", ""), (4, None, None), (5, "", "new york"), (6, "Élan of the newest yorkers", "x"),
]


def ids(df):
    return sorted(r.id for r in df.collect())


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc long, title string, tags string")


@pytest.mark.parametrize(
    "query,expected",
    [
        ('"new york"', [1, 3, 5]), ('title:"new york"', [1, 3]), ("new york", [1, 2, 3, 5]), ('york NOT "new york"', [2]), ("york*", [1, 2, 3, 5, 6]), ("tags:travel house OR elan", [2, 6]),
        ('"york new"', [3]), ('"new york" OR house', [1, 2, 3, 5]), ("", []), ("NOT new", []), ('"elan of the"', [6]), ('"spring new"', []),
    ],
)
def test_queries_and_the_kept_index_agree(spark, docs, tmp_path, query, expected):
    assert ids(S.search(docs, query, "doc", ["title", "tags"])) == expected
    kept = S.KeptIndex(spark, f"file://{tmp_path}/index", ["title", "tags"], buckets=5)
    kept.upsert(docs, "doc")
    assert ids(kept.search(query)) == expected


def test_documents_are_read_once(docs):
    plan = S.search(docs, 'title:"new york" house', "doc", ["title", "tags"])._jdf.queryExecution().toString()
    assert "LocalTableScan" not in plan and plan.count("Scan ExistingRDD") <= 2 * plan.count("Physical Plan") + 8  # all read the checkpoint


def test_upserts_deletes_and_merges_equal_a_rebuilt_index(spark, tmp_path):
    r = random.Random(5)
    lexicon = ["alpha", "beta", "gamma", "delta", "epsilon", "a", "be"]
    text = lambda: " ".join(r.choice(lexicon) for _ in range(r.randint(0, 12)))
    kept, live = S.KeptIndex(spark, f"file://{tmp_path}/index", ["t"], buckets=3), {}
    frame = lambda d: spark.createDataFrame(list(d.items()), "id long, t string")
    assert kept.search("alpha").count() == 0
    kept.delete(frame({1: ""}))
    for step in range(6):
        if step in (2, 4):
            gone = set(r.sample(sorted(live), 8)) | {10_000}
            kept.delete(frame(dict.fromkeys(gone, "")))
            live = {i: t for i, t in live.items() if i not in gone}
        else:
            batch = {r.randrange(60): text() for _ in range(25)}
            kept.upsert(frame(batch), "id")
            live |= batch
        if step == 3:
            kept.merge()
        for query in ("alpha beta", "a", "be* NOT gamma", '"beta alpha" OR delta'):
            got, expected = ([(x.id, round(x.score, 9)) for x in found.collect()] for found in (kept.search(query), S.search(frame(live), query, "id", ["t"])))
            assert got == expected, (step, query)
    assert len(kept._commits()) == 3  # the merged segment, and two after it


def test_a_search_reads_only_its_tokens_folders(spark, tmp_path):
    kept = S.KeptIndex(spark, f"file://{tmp_path}/index", ["t"], buckets=50)
    kept.upsert(spark.createDataFrame([(i, f"word{chr(97 + i % 26)} {chr(97 + i % 26)}x") for i in range(100)], "id long, t string"), "id")
    asked = S._asked("ax", ["t"], False)
    plan = kept.hits(asked, kept._commits())._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_a_write_without_a_commit_is_not_seen(spark, tmp_path):
    kept = S.KeptIndex(spark, f"file://{tmp_path}/index", ["t"])
    kept.upsert(spark.createDataFrame([(1, "one")], "id long, t string"), "id")
    lost = spark.createDataFrame([(2, "one")], "id long, t string")
    kept._write(S.index(lost, "id", ["t"]), lost.selectExpr("id", "1 as dl"))
    assert ids(kept.search("one")) == [1]
