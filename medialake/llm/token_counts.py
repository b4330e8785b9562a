"""Token counts by a map-side two-tier lookup: a broadcast table of frequent pre-tokens, then a cache per worker."""

from __future__ import annotations

from collections import Counter as Times
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from .common import text_of, told, told_type
from .encoding import LONGEST, Known, encoder, vocabulary_path

#: The frequent pre-tokens are chosen by the first SAMPLE_TASKS tasks, each by counting those of its first SAMPLE_CHARS
#: characters and handing on the SAMPLE_KEPT most frequent: bounds of what is read, counted and sent to the driver. The
#: choice decides which tier answers, never a result.
SAMPLE_TASKS, SAMPLE_CHARS, SAMPLE_KEPT = 64, 1 << 18, 8_000
#: Frequent pre-tokens, at most, and slots of their table, a power of two: 8 + 4 + 1 bytes each, so 1.7 MB at any size.
FREQUENT, SLOTS = 60_000, 1 << 17
#: Slots that an entry may lie behind its own.
STEPS = 8

Table = tuple[np.ndarray, np.ndarray, np.ndarray]


def hashes(pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """For each pre-token a 64-bit key and a 32-bit check of another hash: equal keys alone are no match."""
    return np.array([xxhash.xxh3_64_intdigest(p) for p in pieces], np.uint64), np.array([xxhash.xxh32_intdigest(p) for p in pieces], np.uint32)


def table_of(lengths: dict[str, int], slots: int = SLOTS) -> Table:
    """An open hash table (keys, checks, lengths) of pre-tokens; one whose run of slots is full, or too long, is left out."""
    keys, checks, counts = np.zeros(slots, np.uint64), np.zeros(slots, np.uint32), np.zeros(slots, np.uint8)
    for h, c, n in zip(*hashes(list(lengths)), lengths.values()):
        for at in ((int(h) + step) % slots for step in range(STEPS)):
            if counts[at] == 0 and 0 < n < 256:
                keys[at], checks[at], counts[at] = h, c, n
                break
    return keys, checks, counts


def looked_up(table: Table, pieces: list[str]) -> np.ndarray:
    """Lengths of pre-tokens in the table, 0 for those that it lacks."""
    keys, checks, counts = table
    h, c = hashes(pieces)
    found = np.zeros(len(pieces), np.int64)
    for step in range(STEPS):
        at = ((h + np.uint64(step)) % np.uint64(len(keys))).astype(np.int64)
        here = (found == 0) & (keys[at] == h) & (checks[at] == c)
        found[here] = counts[at[here]]
    return found


def frequent_table(texts: DataFrame, path: str | None, chars: int = SAMPLE_CHARS, most: int = FREQUENT) -> Table:
    """The table of the pre-tokens that a bounded sample of the texts (column text) has most often, each twice or more.

    Tasks count, each on its own, and the driver adds up their bounded counters: no pre-token is shuffled.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if TaskContext.get().partitionId() >= SAMPLE_TASKS:
            return
        coder, times, left = encoder(path or vocabulary_path()), Times(), chars
        for text in (t for batch in batches for t in batch["text"]):
            if coder.plainly(text):
                times.update(p for p in coder.split(text[:left]) if len(p) <= LONGEST)
            left -= len(text)
            if left <= 0:
                break
        if times:
            top = times.most_common(SAMPLE_KEPT)
            yield pd.DataFrame({"piece": [p for p, _ in top], "n": [n for _, n in top]})

    total = Times()
    for r in texts.select("text").mapInPandas(count, "piece string, n long").collect():  # SAMPLE_TASKS * SAMPLE_KEPT rows at most
        total[r.piece] += r.n
    top = sorted((p for p, n in total.items() if n > 1), key=lambda p: (-total[p], p))[:most]
    coder = encoder(path or vocabulary_path())
    return table_of({p: len(coder.tokens(p)) for p in top})


class _Numbers(dict):
    """Numbers distinct pre-tokens in the order they come."""

    def __missing__(self, piece: str) -> int:
        self[piece] = n = len(self)
        return n


class Counter:
    """Tokens of texts: each distinct pre-token is looked up in the table, then in this worker's cache of misses."""

    def __init__(self, path: str, table: Table):
        self.coder, self.table = encoder(path), table
        self.missed = Known(lambda piece: len(self.coder.tokens(piece)))

    def count(self, texts: list[str]) -> list[int]:
        numbers, at, out = _Numbers(), [], [0] * len(texts)
        for i, text in enumerate(texts):
            if self.coder.plainly(text):
                at.append((i, np.fromiter(map(numbers.__getitem__, self.coder.split(text)), np.int64)))
            else:
                out[i] = len(self.coder.tokenizer.encode(text, add_special_tokens=False).ids)
        pieces = list(numbers)
        lengths = looked_up(self.table, pieces)
        for j in np.flatnonzero(lengths == 0).tolist():
            lengths[j] = self.missed[pieces[j]]
        for i, codes in at:
            out[i] = int(lengths[codes].sum())
        return out


#: One per worker process and vocabulary, kept from task to task, so that its cache is.
COUNTERS: dict[str, Counter] = {}


def token_counts(
    docs: DataFrame, limit: int = 1024, path: str | None = None, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """Tokens of each whole text, without special tokens added; special strings in a text are read as special.

    One pass over the rows where they lie: no shuffle of pre-tokens. The broadcast table has a fixed size. A worker's
    cache is bounded and holds what the table lacks; pre-tokens in neither are encoded by the library. Null texts are
    empty and have 0 tokens; repeated rows are counted each, equal texts alike (ties); very long texts are split whole;
    an empty table gives no rows; other columns are ignored. Returns id, n_bytes, n_tokens, over_limit (n_tokens > limit).
    """
    text = text_of(docs, text_column)
    kind = docs.schema[id_column].dataType
    rows = docs.select(told(docs[id_column], kind).alias("id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(frequent_table(rows, path))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here = path or vocabulary_path()  # where this worker's machine keeps it
        if here not in COUNTERS:
            COUNTERS[here] = Counter(here, shared.value)
        one = COUNTERS[here]
        one.table = shared.value
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"], "n_bytes": batch["n_bytes"], "n_tokens": one.count(list(batch["text"]))})

    schema = T.StructType([T.StructField("id", told_type(kind)), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])
    return rows.mapInPandas(count, schema).select(
        F.col("id").cast(kind).alias(id_column), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
