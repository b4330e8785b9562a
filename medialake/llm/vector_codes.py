"""Product codes of vectors: Lloyd's rounds that filter codebook entries down kd-trees, a tree per part of each block."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .common import small_batches, stored

#: Vectors under one set of trees, and under a leaf, at most. Both bound memory and work, never a result.
BLOCK, LEAF = 2_048, 16
#: Components are floor(SCALE * x); they have to stay below LARGEST, so that squared distances are exact in 64 bits.
SCALE, LARGEST = 4096, 1 << 28


class Tree(NamedTuple):
    """A balanced kd-tree over points of one part: node i of level d holds rows i*n >> d to (i+1)*n >> d of `points`."""

    points: np.ndarray  # int64 (n, width), in the tree's order
    rows: np.ndarray  # where each point stands in its block
    low: list[np.ndarray]  # per level, the boxes' corners and the sums of the points under each node
    high: list[np.ndarray]
    sums: list[np.ndarray]

    def starts(self, level: int) -> np.ndarray:
        return np.arange((1 << level) + 1) * len(self.points) >> level


def depth_of(n: int) -> int:
    """Levels below the root, so that leaves have LEAF points or fewer."""
    depth = 0
    while -(-n >> depth) > LEAF:
        depth += 1
    return depth


def _reduced(points: np.ndarray, rows: np.ndarray) -> Tree:
    """The tree of points that are in its order: boxes and sums of leaves, then of their parents."""
    depth = depth_of(len(points))
    at = (np.arange(1 << depth) * len(points)) >> depth
    low, high, sums = ([f.reduceat(points, at, axis=0)] for f in (np.minimum, np.maximum, np.add))
    for _ in range(depth):
        for levels, f in ((low, np.minimum), (high, np.maximum), (sums, np.add)):
            levels.insert(0, f(levels[0][0::2], levels[0][1::2]))
    return Tree(points, rows, low, high, sums)


def order_of(points: np.ndarray) -> np.ndarray:
    """An order of points in which each node's halves are parted at the median of its box's longest side."""
    n, order = len(points), np.arange(len(points))
    for level in range(depth_of(n)):
        at = (np.arange((1 << level) + 1) * n) >> level
        here = points[order]
        side = (np.maximum.reduceat(here, at[:-1], axis=0) - np.minimum.reduceat(here, at[:-1], axis=0)).argmax(axis=1)
        node = np.repeat(np.arange(1 << level), np.diff(at))
        order = order[np.lexsort((here[np.arange(n), side[node]], node))]
    return order


def filtered(tree: Tree, entries: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(level, nodes, entry of each) of whole subtrees, then (-1, points, entry of each) of points at leaves.

    Level by level, each node keeps the entries that may be nearest to some point of its box: the entry nearest to
    the box's middle rules out those that are farther from the box's farthest corner on their side, or as far with a
    higher index. A node with one entry left gives its whole subtree to it.
    """
    k = len(entries)
    nodes, alive = np.zeros(1, np.int64), np.ones((1, k), bool)
    depth = len(tree.low) - 1
    index = np.arange(k)
    for level in range(depth + 1):
        low, high = tree.low[level][nodes], tree.high[level][nodes]
        middle = ((2 * entries[None] - (low + high)[:, None]) ** 2).sum(axis=2)
        best = np.where(alive, middle, np.iinfo(np.int64).max).argmin(axis=1)
        corner = np.where(entries[None] > entries[best][:, None], high[:, None], low[:, None])
        away = ((corner - entries[None]) ** 2).sum(axis=2) - ((corner - entries[best][:, None]) ** 2).sum(axis=2)
        alive &= ~((away > 0) | ((away == 0) & (index[None] > best[:, None])))
        single = alive.sum(axis=1) == 1
        if single.any():
            yield level, nodes[single], alive[single].argmax(axis=1)
        nodes, alive = nodes[~single], alive[~single]
        if not len(nodes):
            return
        if level < depth:
            nodes, alive = np.concatenate((2 * nodes, 2 * nodes + 1)), np.concatenate((alive, alive))
    at = tree.starts(depth)
    sizes = np.diff(at)[nodes]
    points = np.repeat(at[nodes] - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(sizes.sum())
    away = ((tree.points[points][:, None] - entries[None]) ** 2).sum(axis=2)
    yield -1, points, np.where(np.repeat(alive, sizes, axis=0), away, np.iinfo(np.int64).max).argmin(axis=1)


def tallied(tree: Tree, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many points each entry gets, and their sums, from the nodes' cached ones."""
    counts, sums = np.zeros(len(entries), np.int64), np.zeros(entries.shape, np.int64)
    for level, which, to in filtered(tree, entries):
        np.add.at(counts, to, 1 if level < 0 else np.diff(tree.starts(level))[which])
        np.add.at(sums, to, tree.points[which] if level < 0 else tree.sums[level][which])
    return counts, sums


def assigned(tree: Tree, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each point's entry and its squared distance to it, in the order of the block."""
    code = np.zeros(len(tree.points), np.int64)
    for level, which, to in filtered(tree, entries):
        if level < 0:
            code[which] = to
        else:
            at = tree.starts(level)
            for a, b, entry in zip(at[which].tolist(), at[which + 1].tolist(), to.tolist()):
                code[a:b] = entry
    error = ((tree.points - entries[code]) ** 2).sum(axis=1)
    codes, errors = np.empty_like(code), np.empty_like(error)
    codes[tree.rows], errors[tree.rows] = code, error
    return codes, errors


def _kept(vectors: DataFrame, id_column: str, vector_column: str, label_column: str) -> DataFrame:
    """Rows whose vector has finite components only, as whole numbers."""
    v = vectors[vector_column]
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    named = vectors.select(vectors[id_column].alias("id"), vectors[label_column].alias("label"), F.transform(v, lambda x: x.cast("double")).alias("v"))
    usable = named.filter(F.col("v").isNotNull() & ~F.exists("v", odd))
    fits = lambda x: F.when(F.abs(x) < LARGEST // SCALE, F.floor(x * SCALE)).otherwise(F.raise_error(F.lit("vector components have to lie below 65,536")).cast("long"))
    return usable.select("id", "label", F.transform("v", fits).alias("v"))


def _forest(columns: dict, parts: int) -> list[Tree]:
    """The trees of a stored block."""
    n, width = int(columns["n"]), int(columns["width"])
    points = np.frombuffer(columns["points"], "<i4").reshape(parts, n, width).astype(np.int64)
    rows = np.frombuffer(columns["rows"], "<i4").reshape(parts, n)
    return [_reduced(p, r) for p, r in zip(points, rows)]


def blocks_of(kept: DataFrame, parts: int, width: int) -> DataFrame:
    """Blocks of at most BLOCK vectors each, with the points of every part in the order of its kd-tree."""

    def block(held: pa.Table) -> pa.RecordBatch:
        n = held.num_rows
        grid = held["v"].combine_chunks().flatten().to_numpy().reshape(n, parts, width).transpose(1, 0, 2)
        orders = [order_of(p) for p in grid]
        points = np.stack([p[o] for p, o in zip(grid, orders)]).astype("<i4").tobytes()
        listed = [pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), held[c].combine_chunks()) for c in ("id", "label")]
        scalars = [pa.array([n], pa.int32()), pa.array([width], pa.int32()), pa.array([points], pa.binary()), pa.array([np.stack(orders).astype("<i4").tobytes()], pa.binary())]
        return pa.RecordBatch.from_arrays([*listed, *scalars], names=["ids", "labels", "n", "width", "points", "rows"])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            held = pa.Table.from_batches([*(held.to_batches() if held is not None else []), batch])
            while held.num_rows >= BLOCK:
                yield block(held.slice(0, BLOCK))
                held = held.slice(BLOCK)
        if held is not None and held.num_rows:
            yield block(held)

    listed = [T.StructField(f"{c}s", T.ArrayType(kept.schema[c].dataType)) for c in ("id", "label")]
    scalars = [T.StructField("n", T.IntegerType()), T.StructField("width", T.IntegerType()), T.StructField("points", T.BinaryType()), T.StructField("rows", T.BinaryType())]
    return kept.mapInArrow(build, T.StructType([*listed, *scalars]))


def _round(blocks: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round: parts x entries rows come to the driver, whatever the number of vectors."""
    parts, entries, width = books.shape

    def tally(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts, sums = np.zeros((parts, entries), np.int64), np.zeros(books.shape, np.int64)
        for batch in batches:
            for columns in batch.to_dict("records"):
                for j, tree in enumerate(_forest(columns, parts)):
                    c, s = tallied(tree, books[j])
                    counts[j] += c
                    sums[j] += s
        if counts.any():
            yield pd.DataFrame([(j, e, int(counts[j, e]), sums[j, e].tolist()) for j, e in np.argwhere(counts).tolist()], columns=["part", "entry", "n", "s"])

    met = blocks.select("n", "width", "points", "rows").mapInPandas(tally, "part int, entry int, n long, s array<long>")
    total = [F.sum(F.element_at("s", i + 1).cast("decimal(38,0)")).alias(f"s{i}") for i in range(width)]
    new = books.copy()
    for r in met.groupBy("part", "entry").agg(F.sum("n").alias("n"), *total).collect():
        new[r.part, r.entry] = [int(r[f"s{i}"]) // r.n for i in range(width)]
    return new


def fitted(kept: DataFrame, blocks: DataFrame, parts: int, width: int, entries: int, rounds: int) -> np.ndarray:
    """Codebooks (parts, entries, width): they start from the smallest ids' vectors and are moved `rounds` times."""
    first = [r.v for r in kept.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).collect()]  # `entries` rows
    books = np.array(first, np.int64).reshape(len(first), parts, width).transpose(1, 0, 2)
    for _ in range(rounds):
        books = _round(blocks, books)
    return books


def digest(books: np.ndarray) -> str:
    """SHA-256 of all components in decimal, by part, entry and position."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def _nothing(spark: SparkSession, id_type: T.DataType, id_column: str) -> DataFrame:
    names = [(id_column, id_type), ("code", T.StringType()), ("error", T.LongType()), ("label_error", T.LongType()), ("codebooks_sha256", T.StringType())]
    return spark.createDataFrame([], T.StructType([T.StructField(n, t) for n, t in names]))


def codes(
    vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label"
) -> DataFrame:
    """Product codes of all vectors, and what they cost.

    Vectors that are null or have null or non-finite components are left out. kd-trees are built once, in blocks of a
    bounded number of vectors, and stored; each round reads them, filters the codebook's entries down each tree and
    sums per task, so parts * entries rows are shuffled and collected. All numbers are whole and exact, so neither
    blocks nor partitions show in the result. Ties of distance go to the lower entry; among repeated ids the smaller
    vector comes first for the start, null ids last; fewer vectors than entries give fewer entries; null labels are
    one label; an empty table gives no rows; other columns are ignored. Vectors have one length, a multiple of
    `parts`, and components below 65,536, else an error is raised. Returns id, code (two hex digits a part), error,
    label_error (error summed over equal labels), codebooks_sha256.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    kept = _kept(vectors, id_column, vector_column, label_column)
    lengths = [r[0] for r in kept.select(F.size("v")).distinct().limit(2).collect()]
    if not lengths:
        return _nothing(spark, vectors.schema[id_column].dataType, id_column)
    if len(lengths) > 1 or lengths[0] == 0 or lengths[0] % parts:
        raise ValueError(f"vectors have to have one length, a multiple of {parts}")
    width = lengths[0] // parts
    blocks = stored(blocks_of(kept, parts, width), "blocks")
    books = fitted(kept, blocks, parts, width, entries, rounds)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, columns in enumerate(batch.select(["n", "width", "points", "rows"]).to_pylist()):
                found = [assigned(tree, book) for tree, book in zip(_forest(columns, parts), books)]
                digits = np.stack([c for c, _ in found], axis=1).astype(np.uint8)
                own = [batch.column(c).slice(k, 1).flatten() for c in ("ids", "labels")]
                yield pa.RecordBatch.from_arrays([*own, pa.array([d.tobytes().hex() for d in digits], pa.string()), pa.array(sum(e for _, e in found), pa.int64())], names=["id", "label", "code", "error"])

    own = [T.StructField(c, kept.schema[c].dataType) for c in ("id", "label")]
    coded = blocks.mapInArrow(encode, T.StructType([*own, T.StructField("code", T.StringType()), T.StructField("error", T.LongType())]))
    coded = stored(coded, "codes")
    by_label = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    return coded.join(by_label, F.col("label").eqNullSafe(F.col("of"))).select(F.col("id").alias(id_column), "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
