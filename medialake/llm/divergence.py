"""How the sources of each language differ in their words, by joint histograms of term counts."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import stored, text_of

#: Terms are runs of bytes that this table doesn't turn into spaces: A-Z become a-z; ASCII controls, digits, white space
#: and punctuation end a term; what is beyond ASCII is kept as it is.
FOLD = bytes(b if b >= 0x80 or chr(b).islower() else b + 32 if chr(b).isupper() else 32 for b in range(256))
#: Entries of a task's counters, beyond which they are handed on and begun anew: bounds its memory, never a result.
HELD = 500_000
SCALE = 1_000_000_000
COUNTED = "lang string, source string, term string, n long, docs long"


def term_counts(docs: DataFrame, text_column: str = "text", lang_column: str = "lang", source_column: str = "source") -> DataFrame:
    """Occurrences and documents of each term in each (lang, source), combined in the tasks before they are shuffled.

    Each group has a row with the empty term as well, so that groups without terms are known.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        times: dict[tuple[str, str], Counter] = defaultdict(Counter)
        among: dict[tuple[str, str], Counter] = defaultdict(Counter)

        def rows() -> Iterator[pa.RecordBatch]:
            for group, counts in times.items():
                names = [pa.array([name], pa.string()).take(pa.array(np.zeros(len(counts), np.int32))) for name in group]
                terms = pa.array(list(counts), pa.binary()).cast(pa.string())
                numbers = [pa.array(list(counts.values()), pa.int64()), pa.array(list(map(among[group].__getitem__, counts)), pa.int64())]
                yield pa.RecordBatch.from_arrays([*names, terms, *numbers], names=["lang", "source", "term", "n", "docs"])
            times.clear()
            among.clear()

        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), texts):
                terms = text.translate(FOLD).split()
                times[lang, source].update(terms)
                among[lang, source].update(set(terms))
                times[lang, source][b""] = 0
            if sum(map(len, times.values())) > HELD:
                yield from rows()
        yield from rows()

    named = docs.select(*[text_of(docs, c).cast("string").alias(n) for c, n in ((lang_column, "lang"), (source_column, "source"), (text_column, "text"))])
    return named.mapInArrow(count, COUNTED).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE * (count + 2) / (total + 2 * kept)), exactly."""
    above = F.lit(SCALE).cast("decimal(10,0)") * (count + 2).cast("decimal(19,0)")
    return F.call_function("div", above, (total + 2 * kept).cast("decimal(20,0)")) + 1


def distance(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)), exactly: shares are at most SCALE + 1, so no product overflows."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def _cells(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """For each pair of sources a < b of a language, how many kept terms have counts (ca, cb): all cells, zeros too.

    Terms are met only in sources that have them. Cells with a zero follow from each source's own histogram, less what
    the pair has in common.
    """
    own = ["lang", "term"]
    left, right = (kept.select(*own, F.col("source").alias(s), F.col("n").alias(f"c{s}")) for s in "ab")
    shared = left.join(right, own).filter("a < b").groupBy("lang", "a", "b", "ca", "cb").agg(F.count("*").alias("m"))
    less = shared.select(
        "lang", "a", "b", F.inline(F.array(*[F.struct(x.alias("ca"), y.alias("cb"), (F.col("m") * sign).alias("m")) for x, y, sign in (
            (F.col("ca"), F.col("cb"), 1), (F.col("ca"), F.lit(0).cast("long"), -1), (F.lit(0).cast("long"), F.col("cb"), -1), (F.lit(0).cast("long"), F.lit(0).cast("long"), 1)
        )]))
    )
    histogram = kept.groupBy("lang", "source", "n").agg(F.count("*").alias("h"))
    several = groups.select("lang", F.col("source").alias("a"), "kept")
    pairs = several.join(groups.select("lang", F.col("source").alias("b")), "lang").filter("a < b")
    zero = F.lit(0).cast("long")
    alone = [
        pairs.join(histogram.withColumnRenamed("source", s), ["lang", s]).select(
            "lang", "a", "b", F.inline(F.array(
                F.struct((F.col("n") if s == "a" else zero).alias("ca"), (F.col("n") if s == "b" else zero).alias("cb"), F.col("h").alias("m")),
                F.struct(zero.alias("ca"), zero.alias("cb"), (-F.col("h")).alias("m")),
            ))
        )
        for s in "ab"
    ]
    whole = pairs.select("lang", "a", "b", zero.alias("ca"), zero.alias("cb"), F.col("kept").alias("m"))
    every = less.union(alone[0]).union(alone[1]).union(whole)
    return every.groupBy("lang", "a", "b", "ca", "cb").agg(F.sum("m").alias("m"))


def audit(
    docs: DataFrame, least_docs: int = 10, top_terms: int = 10, text_column: str = "text", lang_column: str = "lang", source_column: str = "source"
) -> DataFrame:
    """Ranks, for each source of a language, the other sources by how far their word shares lie apart, and its own words.

    A language keeps the terms of least_docs of its documents or more. Part `pair` has each other source with the sum of
    `distance` over all kept terms: a pair's terms are tallied by their two counts, zeros included, and the distance is
    evaluated once for each distinct pair of counts. Part `term` has the terms that a source has and uses more than its
    language does, top_terms of them. Null texts, languages and sources are empty strings; a group without terms has
    its pairs; repeated rows count each; ties go to the item that is smaller in UTF-8; very long texts are counted
    whole; an empty table gives no rows; other columns are ignored. Only (group, term) counts are shuffled, combined by
    each task first, so a hot source or word is a few rows a task.
    """
    counted = stored(term_counts(docs, text_column, lang_column, source_column), "terms")
    words = counted.filter("term != ''")
    chosen = words.groupBy("lang", "term").agg(F.sum("docs").alias("in_docs"), F.sum("n").alias("all")).filter(F.col("in_docs") >= least_docs)
    kept = stored(words.join(chosen.select("lang", "term", "all"), ["lang", "term"]).select("lang", "source", "term", "n", "all"), "kept")
    langs = kept.groupBy("lang").agg(F.count_distinct("term").alias("kept"), F.sum("n").alias("lang_total"))
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    none = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    groups = stored(
        counted.filter("term = ''").select("lang", "source").join(langs, "lang", "left").join(sums, ["lang", "source"], "left").select("lang", "source", *map(none, ("kept", "lang_total", "total"))), "groups"
    )

    cells = _cells(kept, groups).filter("m != 0")
    totals = {s: groups.select("lang", F.col("source").alias(s), F.col("total").alias(f"total_{s}"), *(["kept"] if s == "a" else [])) for s in "ab"}
    apart = cells.join(totals["a"], ["lang", "a"]).join(totals["b"], ["lang", "b"])
    p, q = (share(F.col(f"c{s}"), F.col(f"total_{s}"), F.col("kept")) for s in "ab")
    # groups without kept terms have no cells but are pairs all the same
    found = apart.select("lang", "a", "b", (distance(p, q) * F.col("m")).alias("value")).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    bare = groups.filter("kept = 0").select("lang", "source")
    without = bare.select("lang", F.col("source").alias("a")).join(bare.select("lang", F.col("source").alias("b")), "lang").filter("a < b").withColumn("value", F.lit(0).cast("long"))
    once = found.unionByName(without)
    both = once.select("lang", F.inline(F.array(*[F.struct(F.col(x).alias("source"), F.col(y).alias("item"), "value") for x, y in ("ab", "ba")])))
    order = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked_pairs = both.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))

    of_group = kept.join(groups, ["lang", "source"])
    shares = of_group.select(
        "lang", "source", F.col("term").alias("item"), share(F.col("n"), F.col("total"), F.col("kept")).alias("p"), share(F.col("all"), F.col("lang_total"), F.col("kept")).alias("q")
    )
    more = shares.filter("p > q").select("lang", "source", F.lit("term").alias("part"), "item", distance(F.col("p"), F.col("q")).alias("value"))
    ranked_terms = more.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top_terms)
    return ranked_pairs.unionByName(ranked_terms)
