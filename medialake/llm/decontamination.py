"""Benchmark decontamination: one automaton over the windows of test items, run once over each text."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from .common import stored, text_of

WINDOW = 13
#: Bytes of normalised windows that one broadcast automaton may hold; more items are scanned for in further blocks.
BLOCK_BYTES = 32_000_000
#: The column that tells rows apart where several blocks are scanned for.
ROW = "__decontamination_row__"

#: Bytes to what words are made of: A-Z to lower case, 0-9, a-z and all of 0x80 and above kept, the rest to spaces.
FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def words(text: str) -> list[bytes]:
    """Normalised words, as UTF-8 bytes."""
    return text.encode("utf-8", "surrogatepass").translate(FOLD).split()


def spans(text: str) -> list[tuple[int, int]]:
    """Code point offsets (start, end) of each normalised word in the text itself."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    inside = np.frombuffer(bytes(raw).translate(FOLD), np.uint8) != 32
    edges = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).astype(np.int8)))
    points = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))  # code points begun before each byte
    return list(zip(points[edges[::2]].tolist(), points[edges[1::2]].tolist()))


def windows(text: str, size: int = WINDOW) -> list[bytes]:
    """Windows of an item's words, or all its words where it has fewer."""
    w = words(text)
    return [b" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))] if w else []


def automaton(items: list[tuple[str, str]], size: int = WINDOW):
    """An Aho-Corasick automaton: keys are windows between spaces, values (words in the window, indices of items)."""
    import ahocorasick

    owners: dict[bytes, set[int]] = {}
    for i, (_, text) in enumerate(items):
        for w in windows(text, size):
            owners.setdefault(w, set()).add(i)
    auto = ahocorasick.Automaton()
    for w, who in owners.items():
        auto.add_word(f" {w.decode('latin-1')} ", (w.count(b" ") + 1, sorted(who)))
    auto.make_automaton()
    return auto if owners else None


def _parts(item: str, text: str, most: int) -> Iterator[tuple[str, str]]:
    """An item, in parts of at most `most` bytes of windows that share windows' ends, so that they have its windows."""
    if WINDOW * len(text) <= most:
        yield item, text
        return
    w = [x.decode() for x in words(text)]
    step = max(1, most * len(w) // max(1, WINDOW * len(text)))
    for i in range(0, max(1, len(w) - WINDOW + 1), step):
        yield item, " ".join(w[i : i + step + WINDOW - 1])


def blocks(benchmark: DataFrame, id_column: str, text_column: str, most: int) -> Iterator[list[tuple[str, str]]]:
    """The items, a bounded number of bytes at a time: the query set, which all texts are held against."""
    rows = benchmark.select(benchmark[id_column].cast("string").alias("i"), benchmark[text_column].alias("t"))
    block, held = [], 0
    for row in rows.filter("t is not null").toLocalIterator():
        for item, text in _parts(row.i, row.t, most):
            cost = WINDOW * len(text)  # windows of one item repeat its words
            if block and held + cost > most:
                yield block
                block, held = [], 0
            block.append((item, text))
            held += cost
    yield block


def _several(parts: Iterator[list[tuple[str, str]]]) -> tuple[list[tuple[str, str]], Iterator[list[tuple[str, str]]] | None]:
    """The first block, and all of them where there are more: no more than two are held at once."""
    first, second = next(parts), next(parts, None)
    return first, None if second is None else chain((first, second), parts)


def hits(w: list[bytes], auto) -> tuple[np.ndarray, list[int]] | None:
    """Which words lie in windows that occur, and the indices of the items these come from; None if none does."""
    if auto is None or not w:
        return None
    found = list(auto.iter(f" {b' '.join(w).decode('latin-1')} "))
    if not found:
        return None
    starts = np.concatenate(([0], np.cumsum([len(x) + 1 for x in w])))  # of each word's leading space
    marks, who = np.zeros(len(w) + 1, np.int64), set()
    for end, (n, owners) in found:
        last = int(np.searchsorted(starts, end))  # the space after the window's last word
        marks[last - n] += 1
        marks[last] -= 1
        who.update(owners)
    return np.cumsum(marks[:-1]) > 0, sorted(who)


def contaminated(n_hit: int, n_words: int) -> bool:
    """Whether a twentieth of the words or more is hit."""
    return n_hit > 0 and 20 * n_hit >= n_words


def merged(hit: list[list[int]]) -> list[list[int]]:
    """Spans of neighbouring words, from ascending (index, start, end) of each."""
    runs, last = [], -2
    for i, start, end in hit:
        if i == last + 1:
            runs[-1][1] = end
        else:
            runs.append([start, end])
        last = i
    return runs


def _scan(docs: DataFrame, id_column: str, text_column: str, items: list[tuple[str, str]], as_spans: bool) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(([i for i, _ in items], automaton(items)))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        listed, auto = shared.value
        for batch in batches:
            out = []
            for text in batch["text"]:
                w = words(text)
                got = hits(w, auto)
                if got is None:
                    out.append((len(w), 0, [], []))
                    continue
                hit, who = got
                at = spans(text)
                each = [[i, *at[i]] for i in np.flatnonzero(hit).tolist()]
                runs = merged(each) if as_spans else each
                out.append((len(w), int(hit.sum()), runs, list(dict.fromkeys(listed[i] for i in who))))
            yield pd.DataFrame(
                {
                    "id": batch["id"],
                    "n_words": [x[0] for x in out],
                    "n_hit": [x[1] for x in out],
                    "hits": [x[2] for x in out],
                    "items": [x[3] for x in out],
                }
            )

    schema = T.StructType(
        [
            T.StructField("id", docs.schema[id_column].dataType),
            T.StructField("n_words", T.LongType()),
            T.StructField("n_hit", T.LongType()),
            T.StructField("hits", T.ArrayType(T.ArrayType(T.LongType()))),
            T.StructField("items", T.ArrayType(T.StringType())),
        ]
    )
    return docs.select(docs[id_column].alias("id"), text_of(docs, text_column).alias("text")).mapInPandas(scan, schema)


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Per document the words that lie in benchmark windows and the items these come from.

    The items' windows make one automaton (several, one after another, where they exceed block_bytes), which runs
    once over each text's normalised words; offsets are mapped back to the original, so `hits` are spans of code
    points. Documents stay where they are with one block; with more, rows are numbered and stored once, blocks are made
    and scanned for one at a time, and what they find in a row is united by its number, so results are the same for any
    number of blocks; an item larger than a block is cut into parts that have its windows. Each row has its own
    verdict, whether its id is null, repeated or neither. Null texts have no words, null items no windows; very long
    texts are scanned whole, in time in proportion; an empty benchmark leaves everything clean, an empty table gives
    no rows; ties don't arise. Returns id, n_words, n_hit, hits, items.
    """
    first, parts = _several(blocks(benchmark, item_id, item_text, block_bytes))
    if parts is None:
        return _scan(docs, id_column, text_column, first, True).withColumnRenamed("id", id_column)
    rows = _numbered(docs.select(docs[id_column].alias("id"), text_of(docs, text_column).alias("text")))
    return _united(rows, "text", parts).join(rows.select(ROW, "id"), ROW).select(F.col("id").alias(id_column), "n_words", "n_hit", "hits", "items")


def _numbered(docs: DataFrame) -> DataFrame:
    """docs, stored, with a number of its own for each row."""
    return stored(docs.withColumn(ROW, F.monotonically_increasing_id()), "numbered")


def _united(rows: DataFrame, text_column: str, parts: Iterator[list[tuple[str, str]]]) -> DataFrame:
    """What all blocks find in each numbered row: ROW, n_words, n_hit, hits, items.

    Each block's finds are stored before the next block is made; after the first, of the rows with hits only.
    """
    found = None
    for part in parts:
        one = _scan(rows, ROW, text_column, part, False)
        one = stored(one if found is None else one.filter("n_hit > 0"), "hits")
        found = one if found is None else found.union(one)

    @F.pandas_udf("array<array<bigint>>")
    def as_spans(hits: pd.Series) -> pd.Series:
        return pd.Series([merged(h) for h in hits], dtype=object)

    per_row = found.groupBy(F.col("id").alias(ROW)).agg(
        F.max("n_words").alias("n_words"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("hits")))).alias("hits"),
        F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"),
    )
    return per_row.select(ROW, "n_words", F.size("hits").cast("long").alias("n_hit"), as_spans("hits").alias("hits"), "items")


def verdicts(found: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """The digest of contamination(): counts, the items' hash, and whether a twentieth of the words or more is hit."""
    return found.select(
        id_column,
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs that aren't contaminated, all columns as they are; null texts are kept.

    With one block of items rows are judged where they lie; with more, the numbers of contaminated rows are joined
    away. Each row is judged by its own text, whatever its id.
    """
    first, parts = _several(blocks(benchmark, "item_id", "text", block_bytes))
    if parts is not None:
        rows = _numbered(docs)
        bad = verdicts(_united(rows, text_column, parts), ROW).filter("contaminated").select(ROW)
        return rows.join(bad, ROW, "left_anti").select(docs.columns)
    shared = docs.sparkSession.sparkContext.broadcast(automaton(first))

    @F.pandas_udf("boolean")
    def bad(texts: pd.Series) -> pd.Series:
        out = []
        for text in texts:
            w = words(text or "")
            got = hits(w, shared.value)
            out.append(got is not None and contaminated(int(got[0].sum()), len(w)))
        return pd.Series(out, dtype=bool)

    return docs.filter(~bad(docs[text_column]))
