"""Packing by lexical retrieval: a seed document's window is filled by its nearest unused documents, by BM25."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from .common import stored, text_of
from .encoding import encoder, vocabulary_path

#: BM25's usual constants.
K1, B = 1.2, 0.75
#: A shard of the index holds documents until their tokens reach this; a task makes one shard after another.
SHARD_TOKENS = 2_000_000
#: A seed asks for its terms of the greatest weight, so many of them.
QUERY_TERMS = 64

PIECE_COLUMNS = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def coded(docs: DataFrame, room: int, end_id: int, path: str | None, id_column: str, text_column: str) -> DataFrame:
    """Each document's tokens and the end id: full windows as finished pieces, and what is left over as a row with ids.

    Rows with ids carry the distinct tokens of the whole document and how often each occurs.
    """
    end = end_id.to_bytes(4, "little")

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = encoder(path or vocabulary_path())  # looked up where the task runs
        window = TaskContext.get().partitionId() << 40
        for batch in batches:
            out = []
            for doc, text in zip(batch["id"], batch["text"]):
                ids = coder.ids(text) + end
                total = len(ids) // 4
                for start in range(0, total - room + 1, room):
                    window += 1
                    out.append((doc, start, room, zlib.crc32(ids[4 * start : 4 * (start + room)]), total, -window, 0, None, None, None))
                if rest := total % room:
                    terms, times = np.unique(np.frombuffer(ids, "<u4"), return_counts=True)
                    out.append((doc, total - rest, rest, None, total, None, None, ids[4 * (total - rest) :], terms.astype("<u4").tobytes(), times.astype("<u4").tobytes()))
            if out:
                frame = pd.DataFrame(out, columns=["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids", "terms", "times"])
                yield frame.astype({"ids_crc32": "Int64", "sequence_id": "Int64", "offset": "Int64"})

    fields = T._parse_datatype_string(f"{PIECE_COLUMNS}, ids binary, terms binary, times binary")
    schema = T.StructType([T.StructField("id", docs.schema[id_column].dataType), *fields])
    return docs.select(docs[id_column].alias("id"), text_of(docs, text_column).alias("text")).mapInPandas(encode, schema)


class Weights:
    """BM25 over the whole corpus: how telling each token of the vocabulary is, and the mean length."""

    def __init__(self, in_docs: np.ndarray, docs: int, tokens: int):
        self.idf = np.log1p((docs - in_docs + 0.5) / (in_docs + 0.5))
        self.idf[in_docs < 2] = 0.0  # tokens of one document lead to no other
        self.mean = tokens / max(1, docs)

    def of(self, terms: np.ndarray, times: np.ndarray, length: int) -> np.ndarray:
        return self.idf[terms] * times * (K1 + 1) / (times + K1 * (1 - B + B * length / self.mean))


def weights(rows: DataFrame) -> Weights:
    """Document frequencies by token: at most one row for each token of the vocabulary comes to the driver."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = np.zeros(0, np.int64)
        for batch in batches:
            for terms in batch["terms"]:
                t = np.frombuffer(terms, "<u4")
                if t[-1] >= len(held):
                    held = np.concatenate((held, np.zeros(int(t[-1]) + 1 - len(held), np.int64)))
                held[t] += 1
        if held.any():
            there = np.flatnonzero(held)
            yield pd.DataFrame({"token": there, "docs": held[there]})

    found = rows.select("terms").mapInPandas(count, "token long, docs long").groupBy("token").agg(F.sum("docs").alias("docs")).collect()
    sums = rows.agg(F.count("*").alias("docs"), F.coalesce(F.sum("doc_tokens"), F.lit(0)).alias("tokens")).first()
    in_docs = np.zeros(1 + max((r.token for r in found), default=0), np.int64)
    for r in found:
        in_docs[r.token] = r.docs
    return Weights(in_docs, sums.docs, sums.tokens)


class Index:
    """The inverted index of one shard: postings by token, scores added up per document."""

    def __init__(self, documents: list[tuple[np.ndarray, np.ndarray]]):
        """documents: (terms, weights) of each."""
        sizes = [len(t) for t, _ in documents]
        terms = np.concatenate([t for t, _ in documents])
        order = np.argsort(terms, kind="stable")
        self.docs = np.repeat(np.arange(len(documents)), sizes)[order]
        self.values = np.concatenate([w for _, w in documents])[order]
        terms = terms[order]
        starts = np.flatnonzero(np.append(True, terms[1:] != terms[:-1]))
        self.terms, self.starts = terms[starts], np.append(starts, len(terms))
        self.size = len(documents)

    def scores(self, query: np.ndarray) -> np.ndarray:
        """BM25 of every document of the shard for distinct query tokens."""
        at = np.minimum(np.searchsorted(self.terms, query), len(self.terms) - 1)
        at = at[self.terms[at] == query]
        spans = [slice(a, b) for a, b in zip(self.starts[at].tolist(), self.starts[at + 1].tolist())]
        if not spans:
            return np.zeros(self.size)
        return np.bincount(np.concatenate([self.docs[s] for s in spans]), np.concatenate([self.values[s] for s in spans]), self.size)


def powers(n: int, room: int) -> list[int]:
    """Lengths of sequences for n tokens, n <= room: whole windows or powers of two, the longest first."""
    return [room] if n == room else [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


def fill(lengths: list[int], queries: list[np.ndarray], index: Index, room: int) -> Iterator[list[tuple[int, int, int]]]:
    """Windows of (document, start, length) in order: each seed, then unused documents by falling score for it.

    The first unused document is the seed, or the one that the window before cut: a document that is too long for what
    is left of a window goes on in the next one. Equal scores go to the earlier document, and so does a seed to which no
    unused document is related. Only the last window can be short.
    """
    unused = np.ones(len(lengths), bool)
    first, cut, window, left = 0, None, [], room
    while True:
        if cut is None:
            while first < len(lengths) and not unused[first]:
                first += 1
            if first == len(lengths):
                break
            seed, start = first, 0
            unused[seed] = False
        else:
            seed, start = cut
        scores, cut, doc = None, None, seed
        while True:
            took = min(left, lengths[doc] - start)
            window.append((doc, start, took))
            left -= took
            if left == 0:
                yield window
                if start + took < lengths[doc]:
                    cut = doc, start + took
                window, left = [], room
                break
            if scores is None:
                scores = index.scores(queries[seed])
                scores[~unused] = -1.0
            doc, start = int(scores.argmax()), 0
            if scores[doc] < 0:
                break
            scores[doc], unused[doc] = -1.0, False
        if window:
            break
    if window:
        yield window


def _shard_packer(room: int, weigh, shard_tokens: int, query_terms: int):
    def pack(rows: list, number: int) -> pd.DataFrame:
        documents, queries = [], []
        for r in rows:
            terms, times = np.frombuffer(r.terms, "<u4"), np.frombuffer(r.times, "<u4")
            w = weigh.value.of(terms, times, r.doc_tokens)
            documents.append((terms, w))
            best = np.argpartition(-w, query_terms - 1)[:query_terms] if len(w) > query_terms else np.arange(len(w))
            queries.append(np.sort(terms[best[w[best] > 0]]))
        out = []
        for window in fill([r.length for r in rows], queries, Index(documents), room):
            ends = np.cumsum(powers(sum(n for _, _, n in window), room)).tolist()
            offset = at = 0
            for doc, start, n in window:
                while n:
                    took = min(n, ends[0] - at)
                    r = rows[doc]
                    out.append((r.id, r.start + start, took, zlib.crc32(r.ids[4 * start : 4 * (start + took)]), r.doc_tokens, number, offset))
                    start, n, at, offset = start + took, n - took, at + took, offset + took
                    if at == ends[0]:
                        ends.pop(0)
                        number, offset = number + 1, 0
        return pd.DataFrame(out, columns=["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]), number

    def shards(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number, held, tokens = TaskContext.get().partitionId() << 40, [], 0
        for batch in batches:
            for row in batch.itertuples(index=False):
                held.append(row)
                tokens += row.length
                if tokens >= shard_tokens:
                    packed, number = pack(held, number)
                    yield packed
                    held, tokens = [], 0
        if held:
            yield pack(held, number)[0]

    return shards


def packed(
    docs: DataFrame, room: int = 1024, end_id: int = 0, path: str | None = None, id_column: str = "doc_id", text_column: str = "text",
    shard_tokens: int = SHARD_TOKENS, query_terms: int = QUERY_TERMS,
) -> DataFrame:
    """Packs all documents into sequences of room tokens (a power of two), related ones together.

    Documents are encoded once, where they lie. Full windows of long ones are sequences; what is left, less than room
    tokens a document, is packed: documents are range-sorted by their two most telling tokens (BM25 with counts of the
    whole corpus) and read in that order into shards of shard_tokens tokens or a little more, each with an inverted
    index of its documents' tokens. In a shard, each seed's window is filled by the unused documents of the highest
    BM25, the last of them cut; the rest of it is the next seed. A shard's last window is cut into powers of two, so no
    sequence is padded. Where shards end depends on the order of tokens alone: a hot token or a thousand copies fill
    several. Null texts are empty: the end id alone. Ties go by id, then by how the rows lie; repeated rows are packed each; very long
    texts are many windows; an empty table gives no rows; other columns are ignored. Returns id, start, length,
    ids_crc32, doc_tokens, sequence_id, offset.
    """
    if room & (room - 1):
        raise ValueError("room has to be a power of two")
    spark = docs.sparkSession
    made = stored(coded(docs, room, end_id, path, id_column, text_column), "coded")
    rest = made.filter("ids is not null")
    weigh = spark.sparkContext.broadcast(weights(rest))  # one number for each token of the vocabulary

    @F.pandas_udf("first int, second int")
    def telling(terms: pd.Series, times: pd.Series, length: pd.Series) -> pd.DataFrame:
        out = []
        for t, n, tokens in zip(terms, times, length):
            t = np.frombuffer(t, "<u4")
            w = weigh.value.of(t, np.frombuffer(n, "<u4"), tokens)
            best = int(w.argmax())
            w[best] = -1.0
            out.append((int(t[best]), int(t[w.argmax()])))
        return pd.DataFrame(out, columns=["first", "second"])

    keyed = rest.select("id", "start", "length", "doc_tokens", "ids", "terms", "times", telling("terms", "times", "doc_tokens").alias("key"))
    keyed = keyed.withColumn("tie", F.xxhash64("id"))
    order = ["key.first", "key.second", "tie", "id"]
    ranged = keyed.repartitionByRange(*order).sortWithinPartitions(*order)
    schema = T.StructType([T.StructField("id", docs.schema[id_column].dataType), *T._parse_datatype_string(PIECE_COLUMNS)])
    pieces = ranged.drop("key", "tie").mapInPandas(_shard_packer(room, weigh, shard_tokens, query_terms), schema)
    whole = made.filter("ids is null").select(pieces.columns)
    return whole.unionByName(pieces).withColumnRenamed("id", id_column)
