"""Secret scans: fixed patterns, and random strings exposed by few characters per token."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .common import text_of
from .encoding import vocabulary_path

#: The base patterns, and the least length of what they have to hold.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
#: For these two a match that is long enough is found at the same place by asking for the length in the pattern.
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_LEAST = 6
KINDS = ("assign", "access", "hex", "random")

#: The vocabulary of the efficiency test.
RANKS = "byte_bpe_50k.tiktoken"
#: Strings the efficiency test looks at; shorter ones say too little.
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}(?![A-Za-z0-9+/_=-])")
#: Random strings have at most so many characters a token; words and names have three or more.
RATIO = 2.1
#: Known digests (lengths in hexadecimal digits of MD5, SHA-1, SHA-224, SHA-256, SHA-384, SHA-512) and identifiers.
DIGESTS = {32, 40, 56, 64, 96, 128}
UUID = re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
HEXADECIMAL = re.compile(r"[0-9a-fA-F]+")

Span = tuple[str, int, int]


@cache
def vocabulary(path: str):
    """The tiktoken encoding of a file of ranks."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def base_spans(text: str) -> list[Span]:
    """Spans of the base patterns, leftmost and not overlapping within a kind; code points, end exclusive."""
    found = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    found += [("access", *m.span()) for m in ACCESS.finditer(text)]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    return found


#: Dates and times, with or without their marks between.
STAMP = re.compile(r"(?<!\d)(19|20)\d\d([-_/]?)[01]\d\2[0-3]\d([T_-]?[0-2]\d([-_]?)[0-5]\d(\4[0-5]\d)?Z?)?(?!\d)")
#: What joins the parts of a name: marks, and changes of case or between letters and digits.
PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
#: Digits that a number in a name has, at most.
NUMBER = 8


def _tokens(string: str, path: str) -> int:
    return len(vocabulary(path).encode_ordinary(string))


def known_identifier(string: str, path: str, ratio: float = RATIO) -> bool:
    """Digests, UUIDs, numbers, dates, and names put together from words and short numbers.

    The parts of a name are words by the same test: they have more than ratio characters a token. A string of one part
    is no name; the test of the whole string decides on it.
    """
    if UUID.fullmatch(string) or (HEXADECIMAL.fullmatch(string) and len(string) in DIGESTS):
        return True
    if not any(c.isalpha() for c in string):
        return True
    parts = PART.findall(STAMP.sub("-", string))
    if len(parts) < 2:
        return len(parts) < len(PART.findall(string)) and all(_tokens(p, path) * ratio < len(p) for p in parts)
    words = [p for p in parts if p.isalpha()]
    # a random string falls into many parts of one or two characters
    if len("".join(parts)) < 4 * len(parts) or any(len(p) > NUMBER for p in parts if p.isdigit()):
        return False
    return all(len(p) <= 2 or _tokens(p, path) * ratio < len(p) for p in words)


def random_spans(text: str, path: str, ratio: float = RATIO) -> list[Span]:
    """Spans of strings with at most ratio characters per token that are no known digests or identifiers."""
    found = []
    for m in CANDIDATE.finditer(text):
        if len(m[0]) <= ratio * _tokens(m[0], path) and not known_identifier(m[0], path, ratio):
            found.append(("random", *m.span()))
    return found


def uncovered(spans: list[Span], base: list[Span]) -> list[Span]:
    """The spans, in order of their starts, that lie not wholly in what base spans cover: one sweep over both."""
    covered: list[list[int]] = []
    for _, a, b in sorted(base, key=lambda s: s[1]):
        if covered and a <= covered[-1][1]:
            covered[-1][1] = max(covered[-1][1], b)
        else:
            covered.append([a, b])
    out, i = [], 0
    for s in spans:
        while i < len(covered) and covered[i][1] < s[2]:
            i += 1
        if i == len(covered) or not covered[i][0] <= s[1]:
            out.append(s)
    return out


def secrets(
    docs: DataFrame, path: str | None = None, ratio: float = RATIO, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """Spans of secrets in each whole text: the base patterns, and random strings that these don't cover wholly.

    One pass over the rows where they lie, without a shuffle. Null and empty texts have none; repeated rows are
    scanned each; spans of several kinds may begin at one place (ties) and all count; very long texts are scanned
    whole, in time in proportion; an empty table gives no rows; other columns are ignored. Returns id, base (array of
    kind, start, end), added (the same).
    """

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        as_rows = lambda spans: [{"kind": k, "start": a, "end": b} for k, a, b in spans]
        here = path or vocabulary_path(RANKS)  # where this worker's machine keeps it
        for batch in batches:
            base, added = [], []
            for text in batch["text"]:
                own = base_spans(text)
                base.append(as_rows(own))
                added.append(as_rows(uncovered(random_spans(text, here, ratio), own)))
            yield pd.DataFrame({"id": batch["id"], "base": base, "added": added})

    spans = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    schema = T.StructType([T.StructField("id", docs.schema[id_column].dataType), T.StructField("base", spans), T.StructField("added", spans)])
    return (
        docs.select(docs[id_column].alias("id"), text_of(docs, text_column).alias("text"))
        .mapInPandas(scan, schema)
        .withColumnRenamed("id", id_column)
    )


def _line(spans: Column) -> Column:
    """kind:start:end by start, then kind as listed, comma-joined."""
    rank = lambda s: F.array_position(F.array(*map(F.lit, KINDS)), s["kind"])
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"], rank(s), s["end"], s["kind"].alias("kind"), s["start"].alias("at"), s["end"].alias("to"))))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", s["kind"], s["at"], s["to"])), ",")


def digests(found: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Counts of the base kinds, the hash of the base spans, and all spans as text."""
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        id_column,
        *[count(k) for k in KINDS[:3]],
        F.sha2(_line(F.col("base")), 256).alias("base_sha256"),
        _line(F.concat("base", "added")).alias("spans"),
    )


def without(text: str, spans: list[Span], mark: str) -> str:
    """The text with spans replaced by a mark; those that overlap or touch become one."""
    parts, at, last = [], 0, -1
    for _, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a > last:
            parts += [text[at:a], mark]
        at = last = max(at, b)
    return "".join(parts) + text[at:]


def redacted(docs: DataFrame, mark: str = "[SECRET]", path: str | None = None, text_column: str = "text", ratio: float = RATIO) -> DataFrame:
    """docs with the text's secrets replaced by a mark; overlapping spans become one. Other columns stay; nulls stay."""

    @F.pandas_udf("string")
    def redact(texts: pd.Series) -> pd.Series:
        here = path or vocabulary_path(RANKS)
        return pd.Series([None if t is None else without(t, base_spans(t) + random_spans(t, here, ratio), mark) for t in texts], dtype=object)

    return docs.withColumn(text_column, redact(docs[text_column]))
