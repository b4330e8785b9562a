"""WARC archives: writing, and reading back by verified chains of record boundaries."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from .common import cut, scratch, stored

#: Fixed values of the format: what a record begins with, and what ends lines, headers and records.
MAGIC = "WARC/1.1\r\n"
LINE, END = "\r\n", "\r\n\r\n"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Records in one archive file, at most.
PER_FILE = 1_000


def base32_of(hexadecimal: Column) -> Column:
    """40 hexadecimal digits in upper-case base32: each five of them are four base32 digits."""
    group = lambda i: F.conv(F.substring(hexadecimal, F.floor(i / 4).cast("int") * 5 + 1, F.lit(5)), 16, 10).cast("int")
    digit = lambda i: F.floor(group(i) / F.pow(F.lit(32), 3 - i % 4)).cast("int") % 32
    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.substring(F.lit(ALPHABET), digit(i) + 1, F.lit(1))), "")


def base32_sha1(content: Column) -> Column:
    """SHA-1 in bare upper-case base32."""
    return base32_of(F.sha1(content.cast("binary")))


def write_archives(
    pages: DataFrame, path: str, least: int = 0, per_file: int = PER_FILE, id_column: str = "page_id", url_column: str = "url", html_column: str = "html"
) -> None:
    """One record per page, in files of at most per_file records under path, by Spark's own writer.

    Of pages with equal payloads of at least `least` bytes the one with the smallest id is a response and the others
    revisit it; a row that repeats that id is a response too (ties). Null payloads are empty; a null id stays null and
    is never referred to; ids may repeat with other payloads; very long payloads are one value each, never collected.
    Only ids and digests are grouped and joined by digest; pages then meet their marks by id and digest, so no group of
    equal payloads gathers texts in one task. Other columns are ignored; an empty table writes no record.
    """
    payload = F.coalesce(pages[html_column], F.lit(""))
    keys = stored(
        pages.select(pages[id_column].alias("id"), F.sha1(payload.cast("binary")).alias("sha"), F.octet_length(payload).alias("bytes")), "payload-digests"
    )
    firsts = keys.filter((F.col("bytes") >= least) & F.col("id").isNotNull()).groupBy("sha").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    # only groups of several pages are joined: most pages are alone; AQE splits a digest that many pages have
    marks = (
        keys.join(firsts.filter("n > 1").drop("n"), "sha")
        .filter(~F.col("id").eqNullSafe(F.col("first")))
        .select(F.col("id").alias("marked"), F.col("sha").alias("of"), "first")
        .distinct()  # one row per id and payload
    )
    rows = pages.select(
        pages[id_column].alias("id"), F.coalesce(pages[url_column], F.lit("")).alias("url"), payload.alias("payload"), F.sha1(payload.cast("binary")).alias("sha")
    )
    made = rows.join(stored(marks, "revisits"), F.col("id").eqNullSafe(F.col("marked")) & (F.col("sha") == F.col("of")), "left")
    made = made.withColumn("revisit", F.col("first").isNotNull())
    http = F.concat_ws(LINE, F.lit("HTTP/1.1 200 OK"), F.lit("Content-Type: text/html; charset=utf-8"), F.concat(F.lit("Content-Length: "), F.octet_length("payload")))
    block = F.concat(http, F.lit(END), F.when(F.col("revisit"), F.lit("")).otherwise(F.col("payload")))
    made = made.withColumn("block", block)
    header = F.concat_ws(
        LINE,
        F.when(F.col("revisit"), "WARC-Type: revisit").otherwise("WARC-Type: response"),
        F.concat(F.lit("WARC-Record-ID: <urn:page:"), F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(">")),
        F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace("url", r"[\r\n]", "")),
        F.lit("WARC-Date: 2024-01-01T00:00:00Z"),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), base32_of(F.col("sha"))),
        F.when(F.col("revisit"), F.concat(F.lit("WARC-Refers-To: <urn:page:"), F.col("first").cast("string"), F.lit(">"))),
        F.when(F.col("revisit"), F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length("block")),
    )
    records = made.select(F.concat(F.lit(MAGIC), header, F.lit(END), F.col("block")).alias("value"))
    # a line end of this kind is what ends a record
    records.write.option("lineSep", END).option("maxRecordsPerFile", per_file).text(path)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """What lies between magics: file, block (where the task's split of the file begins), turn (ascending in it), value."""
    return spark.read.option("lineSep", MAGIC).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("turn"), "value"
    )


def parsed(pieces: DataFrame) -> DataFrame:
    """A piece's header, the length it states, the block after it, and the payload inside the block."""
    head = F.substring_index("value", END, 1)
    stated = F.regexp_extract(F.concat(F.lit(LINE), F.col("head")), r"\r\nContent-Length: (\d{1,18})(?:\r\n|$)", 1)
    body = F.expr("substr(value, length(head) + 5)")
    return (
        pieces.withColumn("head", head)
        .withColumn("length", F.when(stated != "", stated.cast("long")))
        .withColumn("body", body)
        .withColumn("payload", F.expr("substr(body, length(substring_index(body, '\\r\\n\\r\\n', 1)) + 5)"))
        .withColumn("payload", F.expr("left(payload, greatest(0, length(payload) - 4))"))
    )


def _field(name: str, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(F.concat(F.lit(LINE), F.col("head")), rf"\r\n{name}: {pattern}(?:\r\n|$)", 1), F.lit(""))


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """Every place in the archives where a record may begin, by file, block and turn, with the step to its successor.

    Tasks read splits of the files, cut at the magic. A piece that holds its whole record gives its payload's length
    and digest at once; the text of others is kept, to be put together later.
    """
    split = parsed(_pieces(spark, path)).withColumn("bytes", F.octet_length("value").cast("long"))
    whole = (F.col("length") >= 0) & (F.octet_length("body") == F.col("length") + len(END))
    return split.select(
        "file", "block", "turn", "bytes",
        F.when(F.col("length") >= 0, len(MAGIC) + F.octet_length("head") + 2 * len(END) + F.col("length")).alias("step"),
        _field("WARC-Record-ID", "<urn:page:(.*?)>").alias("id"),
        _field("WARC-Type", r"(\w+)").alias("record_type"),
        _field("WARC-Refers-To", "<urn:page:(.*?)>").alias("refers_to"),
        _field("WARC-Payload-Digest", r"sha1:(\w+)").alias("stated"),
        F.when(whole, F.octet_length("payload").cast("long")).alias("payload_bytes"),
        F.when(whole, base32_sha1(F.col("payload"))).alias("payload_digest"),
        F.when(~F.coalesce(whole, F.lit(False)), F.col("value")).alias("value"),
    )


def _ordered(group: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray, np.ndarray, np.ndarray]:
    """A split's pieces in order, where each begins in the file, where its successor would, and that one's index.

    The index is the number of pieces where the successor is none of the split's; the piece before a file's first
    magic is no candidate.
    """
    group = group.sort_values("turn", kind="stable", ignore_index=True)
    length = group["bytes"].to_numpy(np.int64) + len(MAGIC)
    at = group["base"].to_numpy(np.int64) + np.cumsum(length) - length
    step = group["step"].fillna(-1).to_numpy(np.int64)
    to = np.where(step >= 0, at + step, -1)
    if group["block"].iloc[0] == 0:
        to[0] = -1
    n = len(at)
    index = np.searchsorted(at, to)
    found = (to >= 0) & (index < n)
    found[found] = at[index[found]] == to[found]
    return group, at, to, np.where(found, index, n)


def _leaving(group: pd.DataFrame) -> pd.DataFrame:
    """Where the chain from each piece of a split leaves the split, by pointer jumping inside it; null if it ends there."""
    group, at, to, index = _ordered(group)
    n = len(at)
    end = at[-1] + int(group["bytes"].iloc[-1]) + len(MAGIC)
    jump = np.append(np.where(index < n, index, np.arange(n)), n)
    for _ in range(n.bit_length()):
        jump = jump[jump]
    leaves = to[jump[:n]]
    out = group[["file", "block"]].assign(at=at, pointer=pd.array(np.where(leaves >= end, leaves, 0), dtype="Int64"))
    out.loc[leaves < end, "pointer"] = pd.NA
    return out


LEAVING = "file string, block long, at long, pointer long"


def _entered(splits: DataFrame, places: DataFrame, most: int) -> DataFrame:
    """Where the chain from the start of each file enters its splits: file, block, entry. The file's first is known.

    Splits are contracted first: from each piece only where its chain leaves the split is kept, and of pieces only
    those that some chain leads to. Pointer jumping then goes over these few: in each round every pointer becomes its
    pointer's pointer, and what reached places point to is reached; after k rounds 2^k splits of every file are known.
    """
    several = splits.filter("splits > 1").select("file", "block", "base")
    jumps = stored(places.select("file", "block", "turn", "bytes", "step").join(several, ["file", "block"]).groupBy("file", "block").applyInPandas(_leaving, LEAVING), "jumps")
    targets = jumps.filter("pointer is not null").select("file", F.col("pointer").alias("at")).distinct()
    first = F.col("at") == len(MAGIC)
    known = cut(jumps.join(targets, ["file", "at"], "left_semi").union(jumps.select("file", "at", "block", "pointer").filter(first)).withColumn("reached", first))
    for _ in range(int(most).bit_length()):
        further = known.select("file", F.col("at").alias("pointer"), F.col("pointer").alias("next"))
        marks = known.filter("reached and pointer is not null").select("file", F.col("pointer").alias("at"), F.lit(True).alias("mark"))
        known = cut(
            known.join(further, ["file", "pointer"], "left")
            .join(marks, ["file", "at"], "left")
            .select("file", "at", "block", F.col("next").alias("pointer"), (F.col("reached") | F.col("mark").isNotNull()).alias("reached"))
        )
    return known.filter(F.col("reached") & (F.col("block") > 0)).groupBy("file", "block").agg(F.min("at").alias("entry"))


def _marked(group: pd.DataFrame) -> pd.DataFrame:
    """A split's pieces with their places, whether the file's chain reaches them, and the reached piece each belongs to."""
    group, at, _, index = _ordered(group)
    n = len(at)
    entry = group["entry"].iloc[0]
    reached = np.zeros(n + 1, bool)
    if not pd.isna(entry):
        i = int(np.searchsorted(at, int(entry)))
        # the piece before a file's first magic is empty, or nothing is reached
        if i < n and at[i] == int(entry) and not (group["block"].iloc[0] == 0 and i == 0):
            reached[i] = True
            jump = np.append(index, n)
            for _ in range(n.bit_length()):
                reached[jump[reached]] = True
                jump = jump[jump]
    reached = reached[:n] & group["step"].notna().to_numpy()
    owner = np.maximum.accumulate(np.where(reached, at, -1))
    out = group.drop(columns=["bytes", "step", "base", "entry"]).assign(place=np.arange(n), at=at, reached=reached)
    out["owner"] = pd.array(np.maximum(owner, 0), dtype="Int64")
    out.loc[owner < 0, "owner"] = pd.NA
    return out[MARKED_NAMES]


MARKED = "file string, block long, turn long, id string, record_type string, refers_to string, stated string, payload_bytes long, payload_digest string, place long, at long, reached boolean, owner long"
MARKED_NAMES = [f.split()[0] for f in MARKED.split(", ")]


def reachable(places: DataFrame) -> DataFrame:
    """The candidate places, each with whether the chain of successors from its file's start reaches it, and its owner.

    Offsets are prefix sums: of pieces in a split, and of the few splits of a file. Inside a split, which is of bounded
    size, numpy jumps pointers; between the splits of a file rounds of joins do, over contracted splits. A file of one
    split needs no round.
    """
    totals = places.groupBy("file", "block").agg(F.sum(F.col("bytes") + len(MAGIC)).alias("total"))
    before = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    splits = stored(
        totals.select("file", "block", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"), F.count(F.lit(1)).over(W.partitionBy("file")).alias("splits")), "splits"
    )
    most = splits.agg(F.max("splits")).first()[0] or 0
    start = F.when(F.col("block") == 0, F.lit(len(MAGIC)).cast("long"))
    entries = splits.select("file", "block", "base", start.alias("entry"))
    if most > 1:
        entered = _entered(splits, places, most).withColumnRenamed("entry", "entered")
        entries = entries.join(entered, ["file", "block"], "left").withColumn("entry", F.coalesce("entry", "entered")).drop("entered")
    narrow = places.drop("value").join(entries, ["file", "block"])
    return stored(narrow.groupBy("file", "block").applyInPandas(_marked, MARKED), "reached")


def _mended(spark: SparkSession, path: str, places: DataFrame, marked: DataFrame, torn: DataFrame) -> DataFrame:
    """Length and digest of the payloads of torn records (file, owner), whose pieces are put together again."""
    last = marked.groupBy("file", "block").agg(F.max(F.when(F.col("reached"), F.col("at"))).alias("last"))
    earlier = F.last("last", ignorenulls=True).over(W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1))
    # pieces at the start of a split may belong to a record that began in an earlier one
    owned = marked.join(last.select("file", "block", earlier.alias("earlier")), ["file", "block"]).withColumn("owner", F.coalesce("owner", "earlier"))
    parts = owned.select("file", "block", "turn", "place", "at", "owner").join(torn, ["file", "owner"], "left_semi")
    parts = stored(parts.join(places.select("file", "block", "turn", "value"), ["file", "block", "turn"]), "torn")
    lost = parts.filter("value is null").select("file", "block", "place")
    if not lost.isEmpty():  # a false piece that happens to look whole lost its text: its file is read again
        again = _pieces(spark, path).withColumnRenamed("value", "text").join(lost.select("file").distinct(), "file", "left_semi")
        again = again.withColumn("place", (F.row_number().over(W.partitionBy("file", "block").orderBy("turn")) - 1).cast("long")).drop("turn")
        parts = parts.join(again.join(lost, ["file", "block", "place"], "left_semi"), ["file", "block", "place"], "left").withColumn("value", F.coalesce("value", "text"))
    whole = parts.groupBy("file", "owner").agg(F.array_sort(F.collect_list(F.struct("at", "value"))).alias("parts"))
    whole = parsed(whole.select("file", "owner", F.array_join(F.transform("parts", lambda p: p["value"]), MAGIC).alias("value")))
    return whole.select("file", F.col("owner").alias("at"), F.octet_length("payload").cast("long").alias("own_bytes"), base32_sha1(F.col("payload")).alias("own_digest"))


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives under path: id, record_type, refers_to, payload_bytes, payload_digest (computed).

    A magic inside a payload is a candidate too, but no chain from the file's start leads to it: its piece belongs to
    the record before it and is put back there. A revisit gets length and digest of the response that it refers to and
    whose digest it states, so ids may repeat; without such a response the length is null and the digest the stated
    one. An empty folder or file gives no rows.
    """
    places = stored(candidates(spark, path), "places")
    marked = reachable(places)
    true = marked.filter("reached")
    torn = true.filter("payload_bytes is null").select("file", F.col("at").alias("owner"))
    if not torn.isEmpty():
        mended = _mended(spark, path, places, marked, torn)
        true = true.join(mended, ["file", "at"], "left").withColumns(
            {"payload_bytes": F.coalesce("payload_bytes", "own_bytes"), "payload_digest": F.coalesce("payload_digest", "own_digest")}
        )
    records = true.select("id", "record_type", "refers_to", "stated", "payload_bytes", "payload_digest")
    revisits = records.filter("record_type = 'revisit'")
    wanted = revisits.select(F.col("refers_to").alias("id"), F.col("stated").alias("payload_digest")).distinct()
    responses = records.filter("record_type = 'response'").join(wanted, ["id", "payload_digest"], "left_semi").groupBy("id", "payload_digest").agg(F.max("payload_bytes").alias("full"))
    resolved = revisits.join(
        responses.select(F.col("id").alias("to"), F.col("payload_digest").alias("digest"), "full"), (F.col("refers_to") == F.col("to")) & (F.col("stated") == F.col("digest")), "left"
    ).select("id", "record_type", "refers_to", F.col("full").alias("payload_bytes"), F.col("stated").alias("payload_digest"))
    return records.filter("not record_type <=> 'revisit'").select(resolved.columns).unionByName(resolved)


def round_trip(pages: DataFrame, least: int = 0, per_file: int = PER_FILE, id_column: str = "page_id") -> DataFrame:
    """Writes archives of all pages into the shared folder and reads them back; ids get the pages' own type again."""
    spark = pages.sparkSession
    path = f"{scratch(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, path, least=least, per_file=per_file, id_column=id_column)
    kind = pages.schema[id_column].dataType
    return read_archives(spark, path).select(
        F.col("id").cast(kind).alias(id_column), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to")
    )
