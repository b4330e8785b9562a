"""Document fingerprints: a homomorphic multiset hash over paragraphs, in DataFrame operations only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import bucket_of, range_buckets, stored, text_of

#: Dense lanes: sums modulo 2^32 of the 16 words of SHA-512 of whole paragraphs; equal multisets agree in all.
DENSE = 16
#: Packed lanes: longs that hold two 32-bit lanes; a lane counts how often one hash bit is set over the pieces. Half of
#: them are of one hash, half of another.
PACKED = 64
#: Pieces end behind a word that ends in one of these (about every third word of European texts), or at so many code
#: points: content decides where, so an edit changes the pieces it touches and no others.
ENDINGS = "sdnr.,;:!?"
LONGEST = 64
#: The lowest bit of each packed lane: 32 bits apart, so that no text Spark can hold overflows a lane.
LANES = 0x0000000100000001
LIMIT32 = 0xFFFFFFFF
#: Documents in a range bucket, which one task sorts. Buckets grow beyond 65,536 of them: at 5e10 documents of 2 kB one
#: has 1.5 GB, which the sort spills.
ROWS_PER_BUCKET = 2_000
NAMES = [*[f"d{i}" for i in range(DENSE)], *[f"p{i}" for i in range(PACKED)], "n_pieces"]


def _pieces(paragraph: Column) -> Column:
    """Content-defined pieces of at most LONGEST code points; an empty paragraph is one empty piece."""
    pattern = f"(?s).{{1,{LONGEST}}}?(?:(?<=[{ENDINGS}])\\s+|\\z)|.{{1,{LONGEST}}}"
    return F.when(paragraph == "", F.array(F.lit(""))).otherwise(F.regexp_extract_all(paragraph, F.lit(pattern), F.lit(0)))


def sums(texts: DataFrame, keys: list[str], text_column: str) -> DataFrame:
    """Per key the lanes of its text: columns d0.. (dense), p0.. (packed) and n_pieces.

    One explode to paragraphs and one to pieces, then sums, which Spark combines before the shuffle: what is shuffled
    is one row of lanes per text. Sums commute, so the order of paragraphs doesn't matter, and lanes of parts add up.
    """
    paragraphs = texts.select(*keys, F.explode(F.split(F.col(text_column), "\n", -1)).alias("para"))
    pieces = paragraphs.select(*keys, "para", F.posexplode(_pieces(F.col("para"))).alias("at", "piece"))
    # a paragraph is hashed once, with its first piece
    hashed = pieces.select(
        *keys, F.when(F.col("at") == 0, F.sha2("para", 512)).alias("para_sha"), F.xxhash64("piece").alias("h0"), F.xxhash64(F.concat("piece", F.lit("\n"))).alias("h1")
    )
    words = [F.conv(F.substring("para_sha", 16 * i + 1, 16), 16, -10).cast("long").alias(f"w{i}") for i in range(DENSE // 2)]
    lanes = hashed.select(*keys, "h0", "h1", *words)
    dense = [x for i in range(DENSE // 2) for x in (F.shiftrightunsigned(f"w{i}", 32), F.col(f"w{i}").bitwiseAND(F.lit(LIMIT32)))]
    packed = [F.shiftrightunsigned(h, i).bitwiseAND(F.lit(LANES)) for h in ("h0", "h1") for i in range(PACKED // 2)]
    return lanes.groupBy(*keys).agg(
        *[F.sum(d).bitwiseAND(F.lit(LIMIT32)).alias(f"d{i}") for i, d in enumerate(dense)],
        *[F.sum(p).alias(f"p{i}") for i, p in enumerate(packed)],
        F.count(F.lit(1)).alias("n_pieces"),
    )


def digest(prefix: str = "") -> Column:
    """The fingerprint as text: dense lanes, then packed lanes, then the number of pieces, big-endian, in base64."""
    lanes = [F.lpad(F.hex(F.col(f"{prefix}d{i}")), 8, "0") for i in range(DENSE)]
    lanes += [F.lpad(F.hex(F.col(f"{prefix}p{i}")), 16, "0") for i in range(PACKED)]
    packed = F.base64(F.unhex(F.concat_ws("", *lanes, F.lpad(F.hex(F.col(f"{prefix}n_pieces")), 16, "0"))))
    return F.regexp_replace(packed, r"\s", "")


def merged(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Lanes of the union of parts: insertion adds a part's lanes."""
    return parts.groupBy(*keys).agg(
        *[F.sum(f"d{i}").bitwiseAND(F.lit(LIMIT32)).alias(f"d{i}") for i in range(DENSE)],
        *[F.sum(f"p{i}").alias(f"p{i}") for i in range(PACKED)],
        F.sum("n_pieces").alias("n_pieces"),
    )


def negated(part: DataFrame) -> DataFrame:
    """Lanes that, merged, delete the part again."""
    return part.withColumns({c: -F.col(c) for c in NAMES})


def _signs(prefix: str) -> Column:
    """The lanes of piece signs: set bits less unset ones."""
    packed = F.array(*[F.col(f"{prefix}p{i}") for i in range(PACKED)])
    halves = F.flatten(F.transform(packed, lambda p: F.array(F.shiftrightunsigned(p, 32), p.bitwiseAND(F.lit(LIMIT32)))))
    return F.transform(halves, lambda c: (2 * c - F.col(f"{prefix}n_pieces")).cast("double"))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def likeness(one: str, other: str) -> Column:
    """Cosine of the two piece multisets, estimated from the 128 sign lanes.

    A lane is a sum of one random sign per piece, so products of lanes estimate the number of common pieces: the
    standard error is (1 - cosine^2) / sqrt(128), at most 0.09, and near 0 for near copies. 1 if all lanes agree, else
    at most just below; estimates below 0 are 0.
    """
    same = reduce(lambda a, b: a & b, [F.col(f"{one}{c}") == F.col(f"{other}{c}") for c in NAMES])
    mine, theirs = _signs(one), _signs(other)
    norm = F.sqrt(_dot(mine, mine) * _dot(theirs, theirs))
    estimate = F.when(norm > 0, _dot(mine, theirs) / F.when(norm > 0, norm)).otherwise(0.0)
    return F.when(same, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(0.999), estimate)))


def _before(buckets: DataFrame) -> DataFrame:
    """A table of buckets, one row each, with the bucket before each, around the end: numbers alone, in one task."""
    ring = W.orderBy("bucket")
    last = F.last("bucket").over(ring.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return buckets.withColumn("before", F.coalesce(F.lag("bucket").over(ring), last))


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Fingerprint of each text and of its edited text, with likeness to that and to the next document.

    The edited text has the last floor(n / 2) code points replaced by the first as many (or all) of the next document
    in ascending id (after the last comes the first). Texts meet their successors in range buckets of ids; the first
    document of each bucket is also sent, as a guest, to the bucket before, where the last one needs it. So a text is
    shuffled once, to its bucket, and no task has texts of many buckets. Ids are of any type that can be ordered, null ones first; rows with equal ids (ties) are
    ordered by their text's hash. Null texts are empty; very long ones are exploded piece by piece; a single row is its
    own next; repeated rows stay; an empty table gives no rows; other columns are ignored.
    """
    rows = docs.select(docs[id_column].alias("id"), text_of(docs, text_column).alias("text"))
    cuts = range_buckets(docs.select(docs[id_column].alias("id")), "id", ROWS_PER_BUCKET)
    rows = rows.withColumn("bucket", bucket_of(F.col("id"), cuts)).withColumn("tie", F.xxhash64("text")).withColumn("guest", F.lit(False))
    first = rows.groupBy("bucket").agg(F.min(F.struct("id", "tie")).alias("first"))
    before = _before(first).select(F.col("bucket").alias("own"), F.col("first.id").alias("first_id"), F.col("first.tie").alias("first_tie"), F.col("before").alias("to"))
    # one row per bucket, of which there are 65,536 at most
    guests = rows.join(F.broadcast(before), (F.col("bucket") == F.col("own")) & F.col("id").eqNullSafe(F.col("first_id")) & (F.col("tie") == F.col("first_tie")))
    hosted = rows.unionByName(guests.select("id", "text", F.col("to").alias("bucket"), "tie", F.lit(True).alias("guest")))
    inside = W.partitionBy("bucket").orderBy("guest", F.asc_nulls_first("id"), "tie")
    placed = hosted.withColumns({"place": F.row_number().over(inside), "after": F.lead("text").over(inside)}).filter("not guest")
    edited = placed.withColumn(
        "edited", F.concat(F.expr("left(text, int(length(text) - floor(length(text) / 2)))"), F.expr("left(after, int(floor(length(text) / 2)))"))
    ).withColumn("n_chars", F.length("text").cast("long"))
    both = edited.select(
        "bucket",
        "id",
        "place",
        F.explode(
            F.array(
                F.struct(F.lit(0).alias("which"), F.col("text").alias("body"), F.col("n_chars").alias("n_chars"), F.lit("").alias("sha")),
                F.struct(F.lit(1).alias("which"), F.col("edited").alias("body"), F.col("n_chars").alias("n_chars"), F.sha2("edited", 256).alias("sha")),
            )
        ).alias("t"),
    ).select("bucket", "id", "place", "t.*")
    keys = ["bucket", "id", "place", "which", "n_chars", "sha"]
    lanes = stored(sums(both, keys, "body"), "fingerprints")
    mine = lanes.filter("which = 0").drop("which", "sha")
    changed = lanes.filter("which = 1").select("bucket", "place", "sha", *[F.col(c).alias(f"e_{c}") for c in NAMES])
    lane_row = F.struct(*NAMES)
    heads = mine.filter("place = 1").select("bucket", lane_row.alias("lanes"))
    ring = _before(mine.select("bucket").distinct()).withColumnRenamed("bucket", "own")
    # the lanes of each bucket's first document go to the bucket before, behind its last
    visiting = heads.join(F.broadcast(ring), F.col("bucket") == F.col("own")).select(F.col("before").alias("bucket"), F.lit(None).cast(mine.schema["place"].dataType).alias("place"), "lanes")
    ordered = W.partitionBy("bucket").orderBy(F.asc_nulls_last("place"))
    every = mine.select("bucket", "id", "place", "n_chars", lane_row.alias("lanes")).unionByName(visiting, allowMissingColumns=True)
    after = every.withColumn("next", F.lead("lanes").over(ordered)).filter("place is not null").select("bucket", "id", "place", "n_chars", "lanes.*", "next")
    full = after.join(changed, ["bucket", "place"]).select("*", *[F.col(f"next.{c}").alias(f"x_{c}") for c in NAMES])
    return full.select(
        F.col("id").alias(id_column),
        "n_chars",
        F.col("sha").alias("edited_sha256"),
        digest().alias("fingerprint"),
        digest("e_").alias("edited_fingerprint"),
        likeness("", "e_").alias("near_edited"),
        likeness("", "x_").alias("near_next"),
    )
