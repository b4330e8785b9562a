"""N-gram Jaccard join: prefixes of rare shingles, combinations of frequent ones, exact verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from .common import cut, stored, text_of
from .components import components

WORDS = 5
#: Two sets link when PERCENT of their union is common.
PERCENT = 80
#: Shingles in more documents than this are frequent: they come last in the order of prefixes.
RARE_MOST = 32
#: Frequent shingles in an extended prefix up to which all pairs of them are indexed; longer ones index single shingles.
PAIRS_OF = 12
#: Share of a set, in percent, by which prefixes of rare shingles are extended: what they have in common bounds the rest.
EXTENDED = 10
#: Most and least bits of the slots of a broadcast bit table (8 MB and 8 kB), and the slots that it has for each word of the input up to there.
SLOT_BITS, LEAST_BITS, SLOTS_A_WORD = 26, 16, 16
#: Shingles counted in one group.
COUNTED_TOGETHER = 4_000_000
#: Bits of a set's sketch: a set bit says that an odd number of its shingles fell there.
SKETCH = 1024
#: Classes under one key from which pivots come first, how many rounds of them, and how many a class meets in each.
HOT, PIVOT_ROUNDS, PIVOTS = 16, 2, 16
#: Kinds of keys: a rare shingle; a pair of frequent ones; a single frequent one, of a set that has pairs and of one that hasn't.
RARE, PAIR, STRICT, OPEN = range(4)

UPPER_TO_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
MIX = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose bits all depend on each other."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _byte_hashes() -> np.ndarray:
    """A fixed random number for each byte at each of 64 places of a word."""
    return np.array([xxhash.xxh3_64_intdigest(bytes((place, b))) for place in range(64) for b in range(256)], np.uint64)


BYTES = _byte_hashes()
SPACE = np.array([b == 32 or 9 <= b <= 13 for b in range(256)])


def _word_hashes(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words in a buffer, and where they begin: sums of their bytes' numbers, mixed."""
    inside = ~SPACE[raw]
    edges = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).astype(np.int8)))
    starts, lengths = edges[::2], edges[1::2] - edges[::2]
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    at = np.flatnonzero(inside)
    place = at - np.repeat(starts, lengths)
    numbers = BYTES[((place & 63) << 8) + raw[at]]
    if lengths.max() > 64:
        numbers = numbers * (2 * (place >> 6) + 1).astype(np.uint64)
    return mixed(np.add.reduceat(numbers, np.cumsum(lengths) - lengths) ^ lengths.astype(np.uint64)), starts


def shingle_sets(texts: list[str | None], size: int = WORDS) -> list[np.ndarray]:
    """Each text's set of shingles as ascending 64-bit hashes; a shorter text is one shingle, one without words none.

    Two shingles of a pair of texts share a hash with a chance of about n * m / 2^64, which is neglected.
    """
    raws = [(t or "").encode("utf-8", "surrogatepass").translate(UPPER_TO_LOWER) for t in texts]
    hashes, starts = _word_hashes(np.frombuffer(b"\n".join(raws), np.uint8))
    begins = np.cumsum([0] + [len(r) + 1 for r in raws])
    first = np.searchsorted(starts, begins)
    rolled = hashes[: max(0, len(hashes) - size + 1)] + np.uint64(size)
    for i in range(1, size):
        rolled = rolled * MIX + hashes[i : i + len(rolled)]
    rolled = mixed(rolled)
    out = []
    for a, b in zip(first, first[1:]):
        if b - a >= size:
            out.append(np.unique(rolled[a : b - size + 1]))
            continue
        short = hashes[a : min(a + 1, b)] + np.uint64(b - a)
        for i in range(a + 1, b):
            short = short * MIX + hashes[i]
        out.append(mixed(short))
    return out


def shingles(text: str | None, size: int = WORDS) -> np.ndarray:
    return shingle_sets([text], size)[0]


def chunks(batch: pd.DataFrame, most: int = 1 << 20) -> Iterator[pd.DataFrame]:
    """Slices of a batch with about a megabyte of text each: what one task works on at once."""
    ends = np.cumsum([len(t) for t in batch["text"]]) // most
    cuts = [0, *(np.flatnonzero(np.diff(ends)) + 1).tolist(), len(batch)]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.iloc[a:b]


def sketch(tokens: np.ndarray) -> np.ndarray:
    """SKETCH bits: two sets differ in at least as many shingles as their sketches in bits."""
    odd = np.bincount((tokens & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def set_hash(tokens: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set."""
    h = xxhash.xxh3_128_intdigest(tokens.tobytes())
    return (h >> 64) - (1 << 63), (h & (2**64 - 1)) - (1 << 63)


def prefix_length(n: int, k: int) -> int:
    """Sets that link share at least k of the first so many tokens, in any order that both are sorted by."""
    return n - -(-PERCENT * n // 100) + k


def slot_bits(total: int) -> int:
    """Bits of a table's slots for an input of so many words: small inputs have small tables, in the driver too."""
    return min(SLOT_BITS, max(LEAST_BITS, (SLOTS_A_WORD * total).bit_length()))


def keys_of(tokens: np.ndarray, repeated: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Index keys of a set, their kinds, how many of its shingles are frequent, and how many follow its prefix.

    Rare shingles come first. Those in the extended prefix are keys, if other documents have them; a set whose rare
    ones don't fill it has all rare ones as keys, and -1 is given for what follows. Where rare ones don't fill even the plain prefix, sets that link and share no rare one share
    two frequent ones in the prefix extended by one: pairs of these are keys. Where that makes too many pairs, single
    frequent ones of the plain prefix are keys; so that both sorts meet, sets with pairs have these too, as strict keys
    that meet open ones only.
    """
    n = len(tokens)
    if n < 100 // (100 - PERCENT) - 1:
        return np.zeros(0, np.uint64), np.zeros(0, np.int8), 0, -1  # nothing but an equal set is near enough
    slots = tokens >> np.uint64(65 - (8 * len(repeated)).bit_length())
    byte, bit = (slots >> np.uint64(3)).astype(np.int64), (slots & np.uint64(7)).astype(np.uint8)
    common = (frequent[byte] >> bit) & 1 == 1
    rare, often = tokens[~common], tokens[common]
    singles = tokens[~common & ((repeated[byte] >> bit) & 1 == 1)]
    length = prefix_length(n, max(1, EXTENDED * n // 100))
    rich = len(rare) >= length
    if rich:
        singles = singles[singles <= rare[length - 1]]
    parts = [mixed(singles ^ np.uint64(1))]
    kinds = [np.full(len(singles), RARE, np.int8)]
    first = prefix_length(n, 1)
    if len(rare) < first:
        extended, alone = often[: prefix_length(n, 2) - len(rare)], often[: first - len(rare)]
        pairs = len(extended) <= PAIRS_OF
        if pairs:
            i, j = np.triu_indices(len(extended), 1)
            parts.append(mixed(mixed(extended[i]) + extended[j] * MIX))
            kinds.append(np.full(len(i), PAIR, np.int8))
        parts.append(mixed(alone ^ np.uint64(2)))
        kinds.append(np.full(len(alone), STRICT if pairs else OPEN, np.int8))
    return np.concatenate(parts), np.concatenate(kinds), len(often), n - length if rich else -1


def _tables(docs: DataFrame, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Bit tables of repeated and of frequent shingles, by the first slot_bits(total) bits of their hashes.

    All shingles of all documents are counted: tasks send them sorted, 32 bits each, to the group of their first bits;
    there are as many groups as the input needs. A slot is set if any of its shingles is repeated (frequent), so at
    sizes where slots are shared the tables only say "repeated" too often, which costs work and loses nothing.
    """
    bits_of_slots = slot_bits(total)
    shard_bits = min(bits_of_slots - 3, max(2, (total // COUNTED_TOGETHER).bit_length()))

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in (p for batch in batches for p in chunks(batch, 8 << 20)):
            sets = [s for p in chunks(part) for s in shingle_sets(list(p["text"]))]
            every = np.concatenate(sets)
            if not len(every):
                continue
            short, times = np.unique(every >> np.uint64(32 - shard_bits), return_counts=True)
            shard, rest = (short >> np.uint64(32)).astype(np.int64), short.astype(np.uint32)
            edges = np.flatnonzero(np.diff(shard)) + 1
            rows = []
            for r, t in zip(np.split(rest, edges), np.split(np.minimum(times, 255).astype(np.uint8), edges)):
                rows.append((r[t == 1].tobytes(), r[t > 1].tobytes(), t[t > 1].tobytes()))
            yield pd.DataFrame(rows, columns=["once", "more", "times"]).assign(shard=shard[np.concatenate(([0], edges))])

    slots = 1 << (bits_of_slots - shard_bits)

    def count(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        once = np.frombuffer(b"".join(group["once"]), np.uint32)
        more = np.frombuffer(b"".join(group["more"]), np.uint32)
        times = np.concatenate([np.ones(len(once), np.int64), np.frombuffer(b"".join(group["times"]), np.uint8).astype(np.int64)])
        every = np.concatenate([once, more])
        order = np.argsort(every, kind="stable")
        every, times = every[order], times[order]
        starts = np.flatnonzero(np.concatenate(([True], every[1:] != every[:-1])))
        sums, slot = np.add.reduceat(times, starts), every[starts] >> np.uint32(32 - bits_of_slots + shard_bits)
        bits = []
        for least in (2, RARE_MOST + 1):
            table = np.zeros(slots, np.uint8)
            table[slot[sums >= least]] = 1
            bits.append(np.packbits(table, bitorder="little").tobytes())
        return pd.DataFrame({"shard": [key[0]], "repeated": [bits[0]], "frequent": [bits[1]]})

    sent = docs.mapInPandas(send, "once binary, more binary, times binary, shard long")
    repeated, frequent = (np.zeros(1 << (bits_of_slots - 3), np.uint8) for _ in range(2))
    # 16 MB in all at most
    for row in sent.groupBy("shard").applyInPandas(count, "shard long, repeated binary, frequent binary").toLocalIterator():
        at = slice(row.shard * slots // 8, (row.shard + 1) * slots // 8)
        repeated[at], frequent[at] = np.frombuffer(row.repeated, np.uint8), np.frombuffer(row.frequent, np.uint8)
    return repeated, frequent


def _indexed(docs: DataFrame, tables: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """In one pass a row (id, n, c1, c2) for each document, and rows with a key too for its class."""
    shared = docs.sparkSession.sparkContext.broadcast(tables)

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in (p for b in batches for p in chunks(b)):
            sets = shingle_sets(list(batch["text"]))
            names = [set_hash(s) for s in sets]
            sizes = [len(s) for s in sets]
            yield pd.DataFrame({"id": batch["id"].to_numpy(), "n": sizes, "c1": [a for a, _ in names], "c2": [b for _, b in names]}).reindex(columns=schema.names)
            seen, keys, heads = set(), [], []
            for tokens, name in zip(sets, names):
                if name not in seen:
                    seen.add(name)
                    own, kinds, often, rest = keys_of(tokens, *shared.value)
                    if len(own):
                        keys.append((own, kinds))
                        heads.append((len(own), len(tokens), *name, often, rest))
            if heads:
                times, n, c1, c2, often, rest = (np.array(x, np.int64) for x in zip(*heads))
                per_key = {c: np.repeat(v, times) for c, v in (("n", n), ("c1", c1), ("c2", c2), ("often", often), ("rest", rest))}
                per_key |= {"key": np.concatenate([k for k, _ in keys]).view(np.int64), "kind": np.concatenate([k for _, k in keys])}
                yield pd.DataFrame(per_key).reindex(columns=schema.names)

    schema = T.StructType([T.StructField("id", docs.schema["id"].dataType), *[T.StructField(c, T.LongType()) for c in ("n", "c1", "c2", "key")], T.StructField("kind", T.ByteType()), T.StructField("often", T.LongType()), T.StructField("rest", T.LongType())])
    made = stored(docs.mapInPandas(index, schema), "index")
    shared.destroy()
    return made


def _may_link(one: str, other: str) -> Column:
    """Whether two postings of one key can be of sets that link, by their sizes and kinds.

    Where a pair meets only in frequent shingles it has no others in common: then the smaller number of frequent ones
    bounds what is common.
    """
    c = lambda side, name: F.col(f"{side}.{name}")
    sizes = 100 * F.least(c(one, "n"), c(other, "n")) >= PERCENT * F.greatest(c(one, "n"), c(other, "n"))
    common = F.least(c(one, "often"), c(other, "often"))
    bound = 100 * common >= PERCENT * (c(one, "n") + c(other, "n") - common)
    strict = (c(one, "kind") == STRICT) & (c(other, "kind") == STRICT)
    return sizes & ((c(one, "kind") == RARE) | (bound & ~strict))


def _sets(docs: DataFrame, wanted: DataFrame, bits: int) -> DataFrame:
    """Shingle sets of the wanted ids, made where the texts lie, without a shuffle.

    A table of 2^bits bits for the wanted ids' hashes keeps other rows from being worked on; few others of equal hash
    bits get in, and do no harm.
    """
    slot = F.shiftrightunsigned(F.xxhash64("id"), 64 - bits)
    words = wanted.withColumn("place", slot.bitwiseAND(F.lit(63)).cast("int")).select(F.shiftrightunsigned(slot, 6).alias("word"), F.col("place")).withColumn("bit", F.expr("shiftleft(1L, place)"))
    table = np.zeros(1 << (bits - 6), np.int64)
    for row in words.groupBy("word").agg(F.bit_or("bit").alias("bit")).toLocalIterator():
        table[row.word] = row.bit
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            at = batch["slot"].to_numpy()
            batch = batch[(shared.value[at >> 6] >> (at & 63)) & 1 == 1]
            for part in chunks(batch):
                sets = shingle_sets(list(part["text"]))
                yield pd.DataFrame({"id": part["id"].to_numpy(), "n": [len(s) for s in sets], "sketch": [sketch(s) for s in sets], "tokens": [s.view(np.int64) for s in sets]})

    schema = T.StructType([T.StructField("id", docs.schema["id"].dataType), T.StructField("n", T.LongType()), *[T.StructField(c, T.ArrayType(T.LongType())) for c in ("sketch", "tokens")]])
    made = docs.withColumn("slot", slot).mapInPandas(make, schema)
    made = stored(made, "sets")
    shared.destroy()
    return made


def _verified(pairs: DataFrame, sets: DataFrame, each: int | None = None) -> DataFrame:
    """The pairs (a, b) that link; with `each` only that many for each a are tried, those that look nearest.

    Sketches come first, a few per cent of the sets' bytes: they bound what a pair has in common from above, so only
    pairs that may link meet their whole sets.
    """
    small = sets.select("id", "n", "sketch")
    one = small.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    other = small.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
    apart = F.aggregate(F.zip_with("sa", "sb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    total = F.col("na") + F.col("nb")
    # both = (total - apart) / 2 at most; a link has (100 + PERCENT) * both >= PERCENT * total
    likely = pairs.join(one, "a").join(other, "b").withColumn("apart", apart).filter((100 + PERCENT) * (total - F.col("apart")) >= 2 * PERCENT * total)
    if each:
        likely = likely.withColumn("turn", F.row_number().over(W.partitionBy("a").orderBy("apart", "b"))).filter(F.col("turn") <= each)
    likely = cut(likely.select("a", "b"))
    one = sets.select(F.col("id").alias("a"), F.col("tokens").alias("ta"))
    other = sets.select(F.col("id").alias("b"), F.col("tokens").alias("tb"))
    found = likely.join(one, "a").join(other, "b").withColumn("both", F.size(F.array_intersect("ta", "tb")))
    return cut(found.filter(100 * F.col("both") >= PERCENT * (F.size("ta") + F.size("tb") - F.col("both"))).select("a", "b"))


def linked(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Components of the documents whose 5-word shingle sets have a Jaccard similarity of 0.8 or more.

    1. All shingles are counted; two bit tables of fixed size tell repeated and frequent ones.
    2. Each text gives the index keys of keys_of(). Equal sets are one class from here on: copies never meet as pairs.
    3. Classes that share keys are candidates, if what they share in their prefixes and all that follows could make a
       link. Under hot keys classes first meet a few pivots a round, and what links becomes one component;
       then classes of different components meet, all of them. So a group of near copies costs about its size, and no
       link between components is missed.
    4. Candidates are verified exactly on their whole sets.

    Texts leave their tasks as index keys, and as sets where a candidate needs them. Null and empty texts have empty
    sets and are alone; very long ones are sets like others. Repeated rows stay apart in the result, with one
    component. A row without an id is linked with nothing: its component is null. Rows of one id with different texts
    are each judged by their own; where that id is the smallest of both texts' copies, links of one count for the
    other too. Other columns are ignored; an empty table gives no rows.
    Returns id, n_shingles, component_id (the smallest id reachable by links).
    """
    rows = docs.select(docs[id_column].alias("id"), text_of(docs, text_column).alias("text"))
    length = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    words = length // 6  # about six bytes a word
    index = _indexed(rows, _tables(rows, words))
    members = index.filter("key is null").select("id", "n", "c1", "c2")
    classes = stored(members.filter("id is not null").groupBy("c1", "c2").agg(F.min("id").alias("rep"), F.first("n").alias("n")), "class-reps")
    found = _components_of_classes(rows, classes, index.filter("key is not null"), slot_bits(words))
    by_class = classes.join(found.withColumnRenamed("id", "rep"), "rep", "left").select("c1", "c2", F.coalesce("label", "rep").alias("component"))
    return members.join(by_class, ["c1", "c2"], "left").select(
        F.col("id").alias(id_column),
        F.col("n").alias("n_shingles"),
        F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.col("component")).otherwise(F.col("id")).alias("component_id"),
    )


def _components_of_classes(rows: DataFrame, classes: DataFrame, postings: DataFrame, bits: int) -> DataFrame:
    """Labels (id, label) of the classes, by their smallest ids, that link with others; bits: of the tables of ids."""
    first = [F.first(c).alias(c) for c in ("n", "kind", "often", "rest")]
    # a rare key has RARE_MOST documents at most: one shuffle deals it, and a window counts its classes
    rare = postings.filter(F.col("kind") == RARE).repartition("key").groupBy("key", "c1", "c2").agg(*first)
    rare = rare.withColumn("met", F.count(F.lit(1)).over(W.partitionBy("key"))).filter("met > 1")
    # other keys may be hot: distinct classes are dealt by key and class, counts combined before they are
    other = stored(postings.filter(F.col("kind") != RARE).groupBy("key", "c1", "c2").agg(*first), "frequent-postings")
    # stored, so that the join reads plain shuffles of both sides and AQE can split hot keys
    counts = stored(other.groupBy("key").agg(F.count(F.lit(1)).alias("met")).filter("met > 1"), "frequent-keys")
    met = rare.unionByName(other.join(counts, "key").select(rare.columns))
    posted = met.join(classes.select("c1", "c2", F.col("rep").alias("id")), ["c1", "c2"]).select("key", "id", "n", "kind", "often", "rest", "met")
    posted = stored(posted, "postings")
    hot = posted.filter(F.col("met") > HOT)
    edges = labels = sets = pool = None
    for turn in range(PIVOT_ROUNDS):
        # a key's pivot is of its largest component, by chance one or another of it
        entry = F.struct((-F.col("size")).alias("order"), F.xxhash64("id", "key", F.lit(turn)).alias("turn"), "id", "n", "kind", "often", "label")
        if not turn:
            entry = F.struct(F.col("id").alias("order"), F.col("id").alias("turn"), "id", "n", "kind", "often", "label")
        here = _labelled(hot, labels)
        # keys that more than one component has; their pivots come of an aggregate, as a hot key is no group for one task
        per = here.groupBy("key").agg(F.min(entry).alias("pivot"), F.min("label").alias("low"), F.max("label").alias("high")).filter("low != high")
        per = stored(per.select("key", "pivot"), "pivots")
        pivots = here.join(per, "key").filter("pivot.label != label").select(F.struct("id", "n", "kind", "often").alias("one"), F.col("pivot").alias("other"))
        pairs = pivots.filter(_may_link("one", "other")).groupBy(F.col("one.id").alias("a"), F.col("other.id").alias("b")).count()
        first = F.row_number().over(W.partitionBy("a").orderBy(F.desc("count"), "b"))
        if not turn:  # classes that could link with a pivot are the ones that later rounds look at
            pairs = cut(pairs)
            pool = cut(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct())
            hot = hot.join(pool, "id", "left_semi")
        best = cut(pairs.withColumn("turn", first).filter(F.col("turn") <= (PIVOTS if turn else 2)).select("a", "b"))
        if best.isEmpty():
            break
        if sets is None:
            sets = _sets(rows, pool, bits)
        new = _verified(best, sets, each=2)
        edges = new if edges is None else edges.union(new)
        labels = components(edges)
    here = posted.withColumn("label", F.col("id")) if labels is None else posted.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
    one, other = here.alias("one"), here.alias("other")
    met_again = one.join(other, (F.col("one.key") == F.col("other.key")) & (F.col("one.id") < F.col("other.id")) & (F.col("one.label") != F.col("other.label")) & _may_link("one", "other"))
    follow = F.greatest("one.rest", "other.rest")  # shared shingles past the earlier end of two prefixes; of one prefix where the other holds all rare ones
    follow = F.when(follow >= 0, follow).otherwise(F.least("one.often", "other.often"))
    rest = (
        met_again.select(F.col("one.id").alias("a"), F.col("other.id").alias("b"), (F.col("one.kind") == RARE).alias("rare"), follow.alias("follow"), (F.col("one.n") + F.col("other.n")).alias("sum"))
        .groupBy("a", "b")
        .agg(F.count_if("rare").alias("rare"), F.first("follow").alias("follow"), F.first("sum").alias("sum"))
        .filter((100 + PERCENT) * (F.col("rare") + F.col("follow")) >= PERCENT * F.col("sum"))
        .select("a", "b")
    )
    rest = stored(rest, "candidates")
    last = _sets(rows, rest.select(F.col("a").alias("id")).union(rest.select("b")).distinct(), bits)
    new = _verified(rest, last)
    return components(new if edges is None else edges.union(new))


def _labelled(posted: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Postings with the labels of their components and these components' sizes."""
    if labels is None:  # every class is alone
        return posted.withColumns({"label": F.col("id"), "size": F.lit(1)})
    sized = labels.join(labels.groupBy("label").agg(F.count(F.lit(1)).alias("size")), "label")
    return posted.join(sized, "id", "left").withColumns({"label": F.coalesce("label", "id"), "size": F.coalesce("size", F.lit(1))})


def one_of_each(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """docs with one document, the smallest id, of each component, and one of its rows where they repeat.

    All columns stay. Rows without an id are kept as they are. Kept rows are found and made distinct in one shuffle.
    """
    whole = docs.filter(docs[id_column].isNotNull())
    kept = linked(whole, id_column, text_column).filter(F.col(id_column) == F.col("component_id")).select(F.col(id_column).alias("kept_id"))
    kept = stored(kept, "kept")
    chosen = whole.join(kept, whole[id_column] == kept["kept_id"], "left_semi").dropDuplicates([id_column])
    return chosen.unionByName(docs.filter(docs[id_column].isNull()))
