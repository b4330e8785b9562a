"""Full-text search: tokens, postings with positions, query syntax and BM25, and an index that is kept."""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..functions.stem import stem, stems
from .graph import shared_folder

K1, B = 1.2, 0.75
#: Letters with marks, and the same without: what folds away before tokens are compared.
MARKED, BARE = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"


def tokens(text: Column) -> Column:
    """Lower-case tokens of letters and digits, marks removed."""
    folded = F.translate(F.lower(F.coalesce(text, F.lit(""))), MARKED, BARE)
    return F.filter(F.split(folded, r"[^\p{L}\p{N}]+"), lambda t: t != "")


def flattened(raw: Column) -> Column:
    """A JSON list's items with spaces between them; what is no list stays as it is, null is empty."""
    return F.coalesce(F.array_join(F.from_json(raw, "array<string>"), " "), raw, F.lit(""))


#: The fields of a catalogue item's document; those that hold JSON lists are flattened.
FIELDS = ("filename", "caption_short", "description", "scene_type", "people_desc", "objects", "suggested_tags", "camera_make", "camera_model")
LISTS = ("objects", "suggested_tags")


def document(items: DataFrame) -> DataFrame:
    """(id, *FIELDS) of items joined with their annotations: what is searched. Missing columns and nulls are empty."""
    value = lambda f: flattened(F.col(f)) if f in LISTS else F.coalesce(F.col(f).cast("string"), F.lit(""))
    return items.select("id", *[(value(f) if f in items.columns else F.lit("")).alias(f) for f in FIELDS])


@dataclass(frozen=True)
class Term:
    """One term of a query: the words it matches one behind the other, in which field, and whether it must not."""

    words: tuple[str, ...]
    prefix: bool = False
    field: str | None = None
    negated: bool = False


def parsed(query: str, fields: list[str]) -> list[list[Term]]:
    """Alternatives (OR) of terms that all have to match; what isn't syntax is taken as terms, quoted words as a phrase."""
    out: list[list[Term]] = [[]]
    negate = False
    for word in re.findall(r'\w+:"[^"]*"|"[^"]*"|\S+', query or ""):
        if word == "OR":
            out.append([])
        elif word == "NOT":
            negate = True
        elif word != "AND":
            field, _, rest = word.partition(":")
            name, body = (field, rest) if rest and field in fields else (None, word)
            found = re.findall(r"[^\W_]+", body.lower().translate(str.maketrans(MARKED, BARE)))
            whole = body.startswith('"') and len(found) > 1
            out[-1] += [Term(t, body.endswith("*") and not whole, name, negate) for t in ([tuple(found)] if whole else [(t,) for t in found])]
            negate = False
    return [terms for terms in out if terms]


def _asked(query: str, fields: list[str], stemmed: bool) -> list[list[Term]]:
    alternatives = parsed(query, fields)
    if stemmed:
        alternatives = [[t if t.prefix else replace(t, words=tuple(map(stem, t.words))) for t in terms] for terms in alternatives]
    return [terms for terms in alternatives if any(not t.negated for t in terms)]  # one that only forbids asks for nothing


def _wanted(token: Column, alternatives: list[list[Term]]) -> Column:
    """Whether any term of the query looks at the token."""
    terms = [t for ts in alternatives for t in ts]
    exact = sorted({w for t in terms if not t.prefix for w in t.words})
    return reduce(lambda a, b: a | b, [token.startswith(t.words[0]) for t in terms if t.prefix], token.isin(exact) if exact else F.lit(False))


def _listed(fields: list[str], stemmed: bool) -> Column:
    """All tokens of a document's fields as (field, pos, token)."""
    entry = lambda f: lambda t, i: F.struct(F.lit(f).alias("field"), i.alias("pos"), t.alias("token"))
    return F.concat(*[F.transform(stems(tokens(F.col(f))) if stemmed else tokens(F.col(f)), entry(f)) for f in fields])


def index(docs: DataFrame, id_column: str, fields: list[str], stemmed: bool = False) -> DataFrame:
    """Postings (id, dl, field, token, positions): one row per token of a document's field, dl being its tokens in all."""
    return _with_lengths(docs, id_column, fields, stemmed).filter("token is not null")


def _with_lengths(docs: DataFrame, id_column: str, fields: list[str], stemmed: bool) -> DataFrame:
    """Postings, and for each document a row without a token besides, from one reading and without a shuffle.

    A document's tokens are sorted within its row, so that those of a posting lie together: where one starts, those up
    to the next start are its positions.
    """
    order = F.array_sort(F.transform("all", lambda e: F.struct(e["field"], e["token"], e["pos"])))
    rows = docs.select(F.col(id_column).alias("id"), _listed(fields, stemmed).alias("all")).select("id", F.size("all").alias("dl"), order.alias("all"))
    at = lambda i, name: F.get("all", i)[name]
    first = lambda i: (i == 0) | (at(i, "token") != at(i - 1, "token")) | (at(i, "field") != at(i - 1, "field"))
    rows = rows.withColumn("starts", F.when(F.col("dl") > 0, F.filter(F.sequence(F.lit(0), F.col("dl") - 1), first)).otherwise(F.array().cast("array<int>")))
    positions = lambda a, n: F.transform(F.sequence(a, F.coalesce(F.get("starts", n + 1), F.col("dl")) - 1), lambda i: at(i, "pos"))
    posting = lambda a, n: F.struct(at(a, "field").alias("field"), at(a, "token").alias("token"), positions(a, n).alias("positions"))
    length = F.struct(F.lit(None).cast("string").alias("field"), F.lit(None).cast("string").alias("token"), F.lit(None).cast("array<int>").alias("positions"))
    told = rows.select("id", "dl", F.explode(F.concat(F.array(length), F.transform("starts", posting))).alias("e"))
    return told.select("id", "dl", "e.field", "e.token", "e.positions")


def ranked(postings: DataFrame, totals: DataFrame, alternatives: list[list[Term]], fields: list[str], limit: int) -> DataFrame:
    """The best documents (id, score) by BM25, from the postings of the query's tokens and one row (docs, mean).

    Each document's terms are counted in one aggregation, phrases by their shifted positions; how many documents have
    a term is a one-row aggregate of the same rows. Of a query's alternatives the best counts.
    """
    terms = list(dict.fromkeys(t for ts in alternatives for t in ts))
    back = lambda k: lambda p: p - k
    here = lambda t: F.col("field") == t.field if t.field else F.lit(True)
    counted = []
    for i, t in enumerate(terms):
        if len(t.words) == 1:
            match = F.col("token").startswith(t.words[0]) if t.prefix else F.col("token") == t.words[0]
            counted.append(F.sum(F.when(match & here(t), F.size("positions")).otherwise(0)).alias(f"tf{i}"))
        else:
            at = lambda w, f: F.coalesce(F.max(F.when((F.col("token") == w) & (F.col("field") == f), F.col("positions"))), F.array().cast("array<int>"))
            per_field = []
            for f in [t.field] if t.field else fields:
                shifted = [F.transform(at(w, f), back(k)) for k, w in enumerate(t.words)]
                per_field.append(F.size(reduce(F.array_intersect, shifted)))
            counted.append(reduce(lambda a, b: a + b, per_field).alias(f"tf{i}"))
    found = postings.groupBy("id", "dl").agg(*counted)
    known = found.agg(*[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))])
    rows = found.join(F.broadcast(known)).join(F.broadcast(totals))  # one row each

    def part(i: int) -> Column:
        idf = F.log(1 + (F.col("docs") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5))
        return idf * F.col(f"tf{i}") * (K1 + 1) / (F.col(f"tf{i}") + K1 * (1 - B + B * F.col("dl") / F.col("mean")))

    def alternative(ts: list[Term]) -> Column:
        at = {t: terms.index(t) for t in ts}
        fits = reduce(lambda a, b: a & b, [F.col(f"tf{i}") == 0 if t.negated else F.col(f"tf{i}") > 0 for t, i in at.items()])
        return F.when(fits, reduce(lambda a, b: a + b, [part(i) for t, i in at.items() if not t.negated]))

    scores = [alternative(ts) for ts in alternatives]
    best = scores[0] if len(scores) == 1 else F.greatest(*scores)  # nulls are passed over
    return rows.select("id", best.alias("score")).filter("score is not null").orderBy(F.desc("score"), "id").limit(limit)


def _nothing(docs: DataFrame, id_column: str) -> DataFrame:
    return docs.limit(0).select(F.col(id_column).alias("id"), F.lit(0.0).alias("score"))


def search(docs: DataFrame, query: str, id_column: str, fields: list[str], limit: int = 500, stemmed: bool = False) -> DataFrame:
    """The best matches (id, score) by BM25 over all fields alike; a blank query gives none.

    Documents are read once: each leaves its length and the places of the query's tokens, in a checkpoint, from which
    both the totals and the postings come. With stemmed, words of texts and query are compared by their stems (prefixes
    are not).
    """
    alternatives = _asked(query, fields, stemmed)
    if not alternatives:
        return _nothing(docs, id_column)
    shared_folder(docs.sparkSession)
    listed = docs.select(F.col(id_column).alias("id"), _listed(fields, stemmed).alias("all"))
    narrow = listed.select("id", F.size("all").alias("dl"), F.filter("all", lambda e: _wanted(e["token"], alternatives)).alias("hits")).checkpoint()
    totals = narrow.agg(F.count(F.lit(1)).alias("docs"), F.avg("dl").alias("mean"))
    hits = narrow.filter(F.size("hits") > 0).select("id", "dl", F.explode("hits").alias("e"))
    postings = hits.groupBy("id", "dl", "e.field", "e.token").agg(F.array_sort(F.collect_list("e.pos")).alias("positions"))
    return ranked(postings, totals, alternatives, fields, limit)


class KeptIndex:
    """An index of documents that stays in a shared folder and is changed by batches.

    A batch is a segment: postings in folders by the hash of the token's first letters, and its documents' lengths. Segments are
    folders of one table of postings and of one of lengths, so all are read by one scan and never united: Spark 4.1 takes
    a union of equally partitioned parts for partitioned likewise, and when it changes a part's plan meanwhile, a join with the union fails
    ("Can't zip RDDs with unequal numbers of partitions") or an aggregate of it counts a key twice.
    A batch's tasks write what they read, each into all folders; a merge gathers a folder's postings in few files.
    A commit row makes it visible once it is written whole; a failed or repeated write leaves only files that no
    commit names. A document counts in its latest segment; a deletion is a segment that names it without a length. Each commit
    carries by how much it changes the number of live documents and of their tokens, so a search reads the commits, the folders of
    its tokens, and the names of the documents that match. One writer at a time; readers need no lock.
    """

    def __init__(self, spark: SparkSession, path: str, fields: list[str], stemmed: bool = False, buckets: int = 64):
        self.spark, self.path, self.fields, self.stemmed, self.buckets = spark, path.rstrip("/"), fields, stemmed, buckets

    COMMIT = "seq long, segment string, first long, docs long, tokens long"
    #: The folder, beside those of tokens, in which a batch writes its documents' lengths.
    LENGTHS = -1
    #: Documents that a merge leaves out are sent to all tasks up to this number (about 100 MB); more are joined by a shuffle.
    SENT = 2_000_000

    def _bucket(self, token: Column) -> Column:
        return F.pmod(F.xxhash64(F.left(token, F.lit(2))), F.lit(self.buckets)).cast("int")

    def _commits(self) -> list:
        """Visible segments in order: those since the last merge. A row per batch comes to the driver."""
        try:
            rows = self.spark.read.schema(self.COMMIT).parquet(f"{self.path}/commits").orderBy("seq").collect()
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return []
        since = max((r.first for r in rows), default=0)
        return [r for r in rows if r.seq >= since]

    def _read(self, what: str, commits: list) -> DataFrame:
        """All segments' rows of one kind, with their seq: one scan of their folders."""
        rows = self.spark.read.option("basePath", f"{self.path}/{what}").parquet(*[self._folder(what, c.segment) for c in commits])
        seqs = F.create_map(*[F.lit(x) for c in commits for x in (c.segment, c.seq)])
        return rows.withColumn("seq", seqs[F.col("segment")]).drop("segment")

    def _folder(self, what: str, segment: str) -> str:
        return f"{self.path}/{what}/segment={segment}"

    def _latest(self, commits: list) -> DataFrame:
        """(id, seq, dl) of each document's latest row; dl is null for deleted ones."""
        return self._read("docs", commits).groupBy("id").agg(F.max("seq").alias("seq"), F.max_by("dl", "seq").alias("dl"))

    def _commit(self, segment: str, docs: int, tokens_: int, merged: bool = False) -> None:
        seq = max((c.seq for c in self._commits()), default=0) + 1
        row = self.spark.createDataFrame([(seq, segment, seq if merged else 0, docs, tokens_)], self.COMMIT)
        row.coalesce(1).write.mode("append").parquet(f"{self.path}/commits")

    def _write(self, postings: DataFrame | None, docs: DataFrame) -> str:
        segment = f"segment-{uuid.uuid4().hex}"
        if postings is not None:
            bucketed = postings.withColumn("bucket", self._bucket(F.col("token")))
            bucketed.hint("rebalance", "bucket").write.partitionBy("bucket").parquet(self._folder("postings", segment))
        docs.write.parquet(self._folder("docs", segment))
        return segment

    def _write_read(self, rows: DataFrame) -> str:
        """A segment of postings and rows without a token, written where they are made: no shuffle and no sort.

        The lengths are written with the postings, in a folder of their own (LENGTHS), and copied from there, so both
        come from one reading of the documents.
        """
        segment, writers = f"segment-{uuid.uuid4().hex}", "spark.sql.maxConcurrentOutputFileWriters"
        bucketed = rows.withColumn("bucket", F.when(F.col("token").isNull(), self.LENGTHS).otherwise(self._bucket(F.col("token"))))
        before = self.spark.conf.get(writers, None)
        self.spark.conf.set(writers, str(self.buckets + 1))  # a task keeps all its folders' files open
        try:
            bucketed.write.partitionBy("bucket").parquet(self._folder("postings", segment))
        finally:
            self.spark.conf.unset(writers) if before is None else self.spark.conf.set(writers, before)
        written = self.spark.read.schema(bucketed.schema).parquet(self._folder("postings", segment))
        written.filter(F.col("bucket") == self.LENGTHS).select("id", "dl").write.parquet(self._folder("docs", segment))
        return segment

    def _change(self, segment: str, commits: list) -> tuple[int, int]:
        """By how much a segment changes the live documents and their tokens."""
        new = self.spark.read.parquet(self._folder("docs", segment)).select("id", F.col("dl").alias("now"))
        if commits:
            new = new.join(self._latest(commits).select("id", F.col("dl").alias("was")), "id", "left")
        else:
            new = new.withColumn("was", F.lit(None).cast("int"))
        zero = lambda c: F.coalesce(c, F.lit(0))
        r = new.agg((F.count("now") - F.count("was")).alias("docs"), zero(F.sum(zero(F.col("now")) - zero(F.col("was")))).alias("tokens")).first()
        return r.docs, r.tokens

    def upsert(self, docs: DataFrame, id_column: str) -> None:
        """Documents come in, or take the place of those with the same ids; of repeated ids in a batch one row counts."""
        repeated = docs.groupBy(id_column).count().filter("count > 1")
        one = docs if repeated.isEmpty() else docs.dropDuplicates([id_column])  # texts are shuffled for repeated ids alone
        commits = self._commits()
        segment = self._write_read(_with_lengths(one, id_column, self.fields, self.stemmed))
        self._commit(segment, *self._change(segment, commits))

    def delete(self, ids: DataFrame) -> None:
        """Documents (id) go; unknown ids do nothing."""
        commits = self._commits()
        if commits:
            segment = self._write(None, ids.select("id").distinct().withColumn("dl", F.lit(None).cast("int")))
            self._commit(segment, *self._change(segment, commits))

    def _postings(self, commits: list) -> list:
        """Segments that have postings: deletions have none."""
        return [c for c in commits if self._has_postings(c.segment)]

    def _has_postings(self, segment: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self._folder("postings", segment))
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def merge(self) -> None:
        """One segment of what is live takes the place of all."""
        commits = self._commits()
        if not commits:
            return
        shared_folder(self.spark)
        latest = self._latest(commits).checkpoint()
        live = latest.filter("dl is not null")
        listed = self._read("docs", self._postings(commits)).select("id", "seq")
        gone = listed.join(live.select("id", "seq"), ["id", "seq"], "left_anti").checkpoint()
        gone = F.broadcast(gone) if gone.count() <= self.SENT else gone
        postings = self._read("postings", self._postings(commits)).filter(F.col("bucket") != self.LENGTHS).drop("bucket").join(gone, ["id", "seq"], "left_anti").drop("seq")
        segment = self._write(postings, live.select("id", "dl"))
        self._commit(segment, sum(c.docs for c in commits), sum(c.tokens for c in commits), merged=True)

    def hits(self, alternatives: list[list[Term]], commits: list) -> DataFrame:
        """Live postings of the query's tokens, from the folders that can have them."""
        token, terms = F.col("token"), [t for ts in alternatives for t in ts]
        wanted = _wanted(token, alternatives)
        if not any(t.prefix and len(t.words[0]) < 2 for t in terms):
            starts = sorted({w[:2] for t in terms for w in t.words})
            named = self.spark.createDataFrame([(s,) for s in starts], "token string").select(self._bucket(token)).distinct().collect()  # as many as the query has words
            wanted &= F.col("bucket").isin([r[0] for r in named])
        found = self._read("postings", self._postings(commits)).filter(wanted)
        latest = self._read("docs", commits).join(found.select("id").distinct(), "id", "left_semi").groupBy("id").agg(F.max("seq").alias("seq"))
        return found.join(latest, ["id", "seq"], "left_semi").select("id", "dl", "field", "token", "positions")

    def search(self, query: str, limit: int = 500) -> DataFrame:
        """As search() over the live documents."""
        alternatives, commits = _asked(query, self.fields, self.stemmed), self._commits()
        if not alternatives or not self._postings(commits):
            return self.spark.createDataFrame([], "id long, score double")
        docs, tokens_ = sum(c.docs for c in commits), sum(c.tokens for c in commits)
        totals = self.spark.range(1).select(F.lit(docs).alias("docs"), F.lit(tokens_ / max(1, docs)).alias("mean"))
        shared_folder(self.spark)
        hits = self.hits(alternatives, commits).checkpoint()  # read twice
        return ranked(hits, totals, alternatives, self.fields, limit)


def search_or_name(docs: DataFrame, query: str, id_column: str, fields: list[str], name: str, limit: int = 500) -> DataFrame:
    """Ids that match, or where none does, those whose name holds the query as it is."""
    hits = search(docs, query, id_column, fields, limit).select("id")
    named = docs.filter(F.col(name).ilike(f"%{query}%")).select(F.col(id_column).alias("id"))
    any_hit = hits.limit(1).select(F.lit(1).alias("one"))
    return hits.unionByName(named.join(F.broadcast(any_hit), F.lit(True), "left_anti")) if query.strip() else hits


def nearest(vectors: DataFrame, query: list[float], limit: int = 200) -> DataFrame:
    """Ids (id, score) of the vectors nearest to a query by cosine."""
    from ..functions.vectors import cosine

    point = F.array(*[F.lit(float(x)) for x in query])
    return vectors.select("id", cosine(F.col("embedding"), point).alias("score")).orderBy(F.desc("score"), "id").limit(limit)


def fused(rankings: list[DataFrame], limit: int = 50, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of short rankings (id, score): each adds 1 / (k + rank)."""
    parts = None
    for ranking in rankings:  # each holds at most its own limit of rows
        one = ranking.select("id", (1.0 / (k + F.row_number().over(W.orderBy(F.desc("score"), "id")))).alias("part"))
        parts = one if parts is None else parts.unionByName(one)
    return parts.groupBy("id").agg(F.sum("part").alias("score")).orderBy(F.desc("score"), "id").limit(limit)
