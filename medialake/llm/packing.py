"""Best-fit packing of token pieces into sequences, in bulk-synchronous rounds of successor sweeps."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from heapq import heappop, heappush
from math import isqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F, types as T

from .common import stored, text_of, told, told_type
from .encoding import encoder, vocabulary_path

PIECES = T.StructType(
    [
        T.StructField("piece", T.IntegerType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
    ]
)
#: Pieces and gaps in a range bucket, which one task sweeps, or the square root of their number where that is more: then
#: the table of buckets, which one task sweeps too, is no larger.
TOGETHER = 256


def cut_points(n: int, room: int) -> list[int]:
    """Starts of the pieces of n ids, and n: only the first piece may be shorter than room."""
    return [0, *range((n - 1) % room + 1, n + 1, room)]


def pieces(docs: DataFrame, room: int, end_id: int, path: str | None, id_column: str, text_column: str) -> DataFrame:
    """Each document's ids and the end id, cut into pieces of at most room ids."""
    end = end_id.to_bytes(4, "little")

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = encoder(path or vocabulary_path())  # looked up where the task runs
        for batch in batches:
            out = []
            for doc, text in zip(batch["id"], batch["text"]):
                ids = memoryview(coder.ids(text) + end)
                at = cut_points(len(ids) // 4, room)
                out += [(doc, k, a, b - a, zlib.crc32(ids[4 * a : 4 * b])) for k, (a, b) in enumerate(zip(at, at[1:]))]
            yield pd.DataFrame(out, columns=["id", *PIECES.names])

    kind = docs.schema[id_column].dataType
    schema = T.StructType([T.StructField("id", told_type(kind)), *PIECES])
    rows = docs.select(told(docs[id_column], kind).alias("id"), text_of(docs, text_column).alias("text"))
    return rows.mapInPandas(encode, schema).withColumn("id", F.col("id").cast(kind))


# Items of a round are pieces (pid, length) and gaps (gap) of open sequences (seq); SWEPT rows are what a sweep makes of
# them: pieces with their places (pid, seq, offset), and what is left over, with its rank q where it may be carried on.
ITEM = "bucket long, size long, pid long, length long, seq long, gap long"
SWEPT = "bucket long, q long, pid long, length long, seq long, gap long, offset long"
ITEM_NAMES, SWEPT_NAMES = ([f.split()[0] for f in x.split(", ")] for x in (ITEM, SWEPT))


def buckets(sizes: list[tuple[int, bool, int]], together: int) -> list[tuple[int, bool, int, int]]:
    """Range buckets, largest sizes first, from (size, whether gaps, rows): (size, whether gaps, first bucket, buckets).

    At one size gaps come before pieces. A size that many rows share has buckets of its own, dealt by hash.
    """
    out, bucket, held = [], 0, 0
    for size, gaps, rows in sorted(sizes, key=lambda x: (-x[0], not x[1])):
        many = -(-rows // together)
        if held and held + rows > together:
            bucket, held = bucket + 1, 0
        out.append((size, gaps, bucket, many))
        bucket, held = (bucket + many, 0) if many > 1 else (bucket, held + rows)
    return out


def sweep(items: list[tuple[int, bool, int]], room: int) -> tuple[list[tuple[int, int, int]], list[tuple[int, int]], list[tuple[int, int]], list[tuple[int, int]]]:
    """A sweep down a bucket's items (size, whether a gap, pid or seq), the largest first and gaps first at one size.

    Each piece takes its successor, the smallest gap that is left and wide enough: the last one met. Of pieces with
    one successor the first in rank has it, the others the next ones up. What remains of a gap is met again where the
    sweep comes down to it. Gives places (pid, seq, offset), pieces left over in order, gaps left over (gap, seq) from
    the widest on, and gaps narrower than all of the bucket.
    """
    free: list[tuple[int, int]] = []
    later: list[tuple[int, int]] = []  # a heap of minus gap, seq
    placed, left = [], []
    for size, is_gap, name in items:
        while later and -later[0][0] >= size:
            gap, seq = heappop(later)
            free.append((-gap, seq))
        if is_gap:
            free.append((size, name))
        elif free:
            gap, seq = free.pop()
            placed.append((name, seq, room - gap))
            if gap - size >= size:
                free.append((gap - size, seq))
            elif gap > size:
                heappush(later, (size - gap, seq))
        else:
            left.append((name, size))
    return placed, left, free, [(-gap, seq) for gap, seq in later]


def _sweeper(room: int):
    def one(group: pd.DataFrame) -> pd.DataFrame:
        is_gap = group["seq"].notna().to_numpy()
        name = np.where(is_gap, group["seq"].fillna(0), group["pid"].fillna(0)).astype(np.int64)
        size = group["size"].to_numpy(np.int64)
        order = np.lexsort((name, ~is_gap, -size))
        placed, left, free, narrow = sweep(list(zip(size[order].tolist(), is_gap[order].tolist(), name[order].tolist())), room)
        bucket = int(group["bucket"].iloc[0])
        rows = [(bucket, None, pid, None, seq, None, offset) for pid, seq, offset in placed]
        rows += [(bucket, q, pid, length, None, None, None) for q, (pid, length) in enumerate(left)]
        rows += [(bucket, q, None, None, seq, gap, None) for q, (gap, seq) in enumerate(free)]
        rows += [(bucket, None, None, None, seq, gap, None) for gap, seq in narrow]
        return pd.DataFrame(rows, columns=SWEPT_NAMES).astype("Int64")

    return one


def carried(totals: pd.DataFrame) -> pd.DataFrame:
    """What leftover pieces of each bucket get of the gaps left in those before it, in runs of ranks.

    One row per bucket comes in (pieces and longest of them, gaps and narrowest of them), and a few runs per bucket go
    out: pieces `first` and the `many` - 1 after it get gaps from rank `top` down of bucket `source`, `each` a gap.
    """
    free: list[list[int]] = []
    runs = []
    for t in totals.sort_values("bucket").itertuples(index=False):
        first = 0
        while first < t.pieces and free:
            source, height, narrowest = free[-1]
            each = max(1, int(narrowest // t.longest))
            used = min(height, -(-(t.pieces - first) // each))
            many = min(used * each, t.pieces - first)
            runs.append((t.bucket, first, many, source, height - 1, each))
            first += many
            if height == used:
                free.pop()
            else:
                free[-1][1] -= used
        if t.gaps:
            free.append([t.bucket, t.gaps, t.narrowest])
    return pd.DataFrame(runs, columns=["bucket", "first", "many", "source", "top", "each"]).astype("int64")


RUNS = "bucket long, first long, many long, source long, top long, each long"


def _round(items: DataFrame, room: int, several: bool) -> tuple[list[DataFrame], DataFrame, DataFrame]:
    """One sweep of each bucket and one over their totals: places, gaps (seq, gap) and pieces (pid, length) left."""
    swept = stored(items.groupBy("bucket").applyInPandas(_sweeper(room), SWEPT), "swept")
    placed = [swept.filter("offset is not null").select("pid", "seq", "offset")]
    left, free = swept.filter("length is not null"), swept.filter("gap is not null")
    if not several:
        return placed, free.select("seq", "gap"), left.select("pid", "length")
    totals = swept.filter("q is not null").groupBy("bucket").agg(
        F.count("length").alias("pieces"), F.coalesce(F.max("length"), F.lit(0)).alias("longest"), F.count("gap").alias("gaps"), F.coalesce(F.min("gap"), F.lit(0)).alias("narrowest")
    )
    # one row per bucket of items
    runs = stored(totals.groupBy().applyInPandas(carried, RUNS), "runs").withColumnRenamed("bucket", "run")
    within = (F.col("q") >= F.col("first")) & (F.col("q") < F.col("first") + F.col("many"))
    sent = left.join(runs, (F.col("bucket") == F.col("run")) & within, "left")
    turn = F.col("q") - F.col("first")
    going = sent.filter("source is not null").select(
        F.col("source").alias("to"), (F.col("top") - F.floor(turn / F.col("each"))).alias("rank"), (turn % F.col("each")).alias("turn"), F.col("pid").alias("p"), F.col("length").alias("l")
    )
    met = free.join(going, (F.col("bucket") == F.col("to")) & (F.col("q") == F.col("rank")), "left")
    own, length = W.partitionBy("seq"), F.coalesce("l", F.lit(0))
    before = F.coalesce(F.sum(length).over(own.orderBy("turn").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    settled = stored(
        met.select(F.col("p").alias("pid"), "seq", F.coalesce("turn", F.lit(0)).alias("turn"), (room - F.col("gap") + before).alias("offset"), (F.col("gap") - F.sum(length).over(own)).alias("gap")),
        "settled",
    )
    gaps = settled.filter("turn = 0 and gap > 0").select("seq", "gap")
    return [*placed, settled.filter("pid is not null").select("pid", "seq", "offset")], gaps, sent.filter("source is null").select("pid", "length")


def _items(pieces_left: DataFrame, gaps: DataFrame) -> DataFrame:
    none = F.lit(None).cast("long")
    return pieces_left.select(F.col("length").alias("size"), "pid", "length", none.alias("seq"), none.alias("gap")).unionByName(
        gaps.select(F.col("gap").alias("size"), none.alias("pid"), none.alias("length"), "seq", "gap")
    )


def places(lengths: DataFrame, room: int, together: int = TOGETHER) -> tuple[list[DataFrame], int]:
    """Where pieces (pid, length < room) go: tables (pid, seq, offset), and a number that no sequence reaches.

    Rounds, each a few jobs: pieces that no open gap is wide enough for open as many sequences as their tokens need;
    pieces and gaps are range-sorted together by size into buckets; a sweep in each bucket, then one over the buckets'
    few totals, give each piece the smallest gap that is left for it; gaps are updated. Only counts by size, at most
    2 * room of them, come to the driver, to cut buckets. Rounds go on until no piece is left: the longest piece of a
    round always gets a place.
    """
    spark = lengths.sparkSession
    left, gaps = lengths, spark.createDataFrame([], "seq long, gap long")
    placed: list[DataFrame] = []
    opened = 0
    while True:
        counts = left.groupBy("length").count().withColumn("gaps", F.lit(False)).union(gaps.groupBy("gap").count().withColumn("gaps", F.lit(True))).collect()  # at most 2 * room rows
        by_length = {r[0]: r[1] for r in counts if not r[2]}
        if not by_length:
            return placed, opened
        shortest = min(by_length)
        by_gap = {r[0]: r[1] for r in counts if r[2] and r[0] >= shortest}
        gaps = gaps.filter(F.col("gap") >= shortest)
        items = sum(by_length.values()) + sum(by_gap.values())
        widest = max(by_gap, default=0)
        new = -(-sum(n * many for n, many in by_length.items() if n > widest) // room)
        if new:
            gaps = gaps.unionByName(spark.range(opened, opened + new).select(F.col("id").alias("seq"), F.lit(room).cast("long").alias("gap")))
            by_gap[room] = by_gap.get(room, 0) + new
            opened += new
        cuts = buckets([(n, False, rows) for n, rows in by_length.items()] + [(n, True, rows) for n, rows in by_gap.items()], max(together, isqrt(items)))
        # at most 2 * room rows
        table = F.broadcast(spark.createDataFrame(cuts, "size long, is_gap boolean, low long, many long"))
        dealt = _items(left, gaps).withColumn("is_gap", F.col("seq").isNotNull()).join(table, ["size", "is_gap"])
        dealt = dealt.withColumn("bucket", F.col("low") + F.pmod(F.xxhash64("pid", "seq"), F.col("many")))
        found, gaps, left = _round(dealt.select(ITEM_NAMES), room, cuts[-1][2] + cuts[-1][3] > 1)
        placed += found


def packed(
    docs: DataFrame, room: int = 1024, end_id: int = 2, path: str | None = None, id_column: str = "doc_id", text_column: str = "text", together: int = TOGETHER
) -> DataFrame:
    """Packs all documents into sequences of at most room tokens, by best fit.

    Pieces are made where the rows lie and written once as narrow rows. A piece as long as a sequence is one; the
    others get their places in rounds (see places), and meet them by their numbers. Lengths that many pieces share are
    dealt over many buckets. Null texts are empty: one piece with the end id alone. Equal lengths (ties) are ranked by
    the pieces' numbers; repeated rows are packed each; very long texts become many pieces; an empty table gives no
    rows; other columns are ignored. Returns id, piece, start, length, ids_crc32, sequence_id, offset.
    """
    spark = docs.sparkSession
    made = pieces(docs, room, end_id, path, id_column, text_column)
    made = stored(made.withColumn("pid", F.monotonically_increasing_id()), "pieces")
    short, long = made.filter(F.col("length") < room), made.filter(F.col("length") == room)
    found, opened = places(short.select("pid", "length"), room, together)
    at = _union(spark, found)
    columns = [F.col("id").alias(id_column), "piece", "start", "length", "ids_crc32"]
    alone = long.select(*columns, (F.lit(opened) + F.col("pid")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return short.join(at, "pid").select(*columns, F.col("seq").alias("sequence_id"), "offset").unionByName(alone)


def _union(spark: SparkSession, tables: list[DataFrame]) -> DataFrame:
    whole = spark.createDataFrame([], "pid long, seq long, offset long")
    for t in tables:
        whole = whole.unionByName(t)
    return whole
