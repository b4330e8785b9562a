"""Toxicity by maximum-scoring segments of word log-odds, calibrated by extreme values."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from .common import stored, text_of

#: Labelled documents that the model is fitted on, at most: those with the smallest hash of their id.
FIT_ROWS = 20_000
#: The Dirichlet prior: PRIOR words spread as in the whole corpus, and FLOOR of each word on either side.
PRIOR, FLOOR = 500.0, 0.5
#: Standard errors by which a word's log-odds are drawn towards 0: rare words need more evidence.
DOUBT = 2.0
#: What each word costs a segment, so that scores drift downwards between toxic words.
DRIFT = 0.05
#: A passage with repetitions ends where its sum has fallen so far below its height.
DROP = 12.0
#: Documents have passages listed whose expected number by chance is at most this.
SIGNIFICANT = 0.05

WORD = re.compile(r"\w+")
#: Beginnings of words that are tokens too, in characters: inflected and compound words share them.
STEMS = (4, 5, 6)
#: Words whose scores a worker keeps, beyond which it starts anew.
CACHED = 100_000


def tokens(word: str) -> list[str]:
    """A word and its beginnings."""
    return [word, *[word[:k] + "-" for k in STEMS if len(word) > k]]


def words_of(text: str) -> list[str]:
    """The words in lower case, in the order and number of WORD's matches in the text itself."""
    low = text.lower()
    return WORD.findall(low) if len(low) == len(text) else [w.lower() for w in WORD.findall(text)]


def in_training(id_column: F.Column) -> F.Column:
    """Rows that may be learned from: crc32 of the id as text, modulo 5, isn't 0."""
    return F.crc32(id_column.cast("string").cast("binary")) % 5 != 0


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score), in linear time (Ruzzo and Tompa).

    Each kept segment links to the last one before it that begins at a lower sum, so no segment is passed twice in
    search of it; where none begins lower, all that are kept are final and leave the stack.
    """
    sums = np.concatenate(([0.0], np.cumsum(scores))).tolist()
    final: list[tuple[int, int, float, float, int]] = []
    kept: list[tuple[int, int, float, float, int]] = []  # start, end, sum before it, sum after it, link
    for i in np.flatnonzero(np.asarray(scores) > 0).tolist():
        start, left, right = i, sums[i], sums[i + 1]
        j = len(kept) - 1
        while True:
            while j >= 0 and kept[j][2] >= left:
                j = kept[j][4]
            if j < 0:
                final += kept
                kept = [(start, i + 1, left, right, -1)]
                break
            if kept[j][3] >= right:
                kept.append((start, i + 1, left, right, j))
                break
            start, left = kept[j][0], kept[j][2]
            below = kept[j][4]
            del kept[j:]
            j = below
    return [(a, b, right - left) for a, b, left, right, _ in final + kept]


def passages_once(words: list[str], scores: np.ndarray, drift: float) -> list[tuple[int, int, float]]:
    """Maximal segments of scores less drift, where a word's repetitions within one segment add nothing.

    Repetitions only lower sums, so these lie in the segments of the full scores; one without repetitions stays as it
    is, others are searched for passages. Time is linear: at most DROP / drift steps a word.
    """
    found = []
    for a, b, total in segments(scores - drift):
        telling = [words[i] for i in (np.flatnonzero(scores[a:b] > 0) + a).tolist()]
        found += [(a, b, total)] if len(set(telling)) == len(telling) else _inside(words, scores[a:b].tolist(), drift, a, b)
    return sorted(found)


def _inside(words: list[str], scores: list[float], drift: float, a: int, b: int) -> list[tuple[int, int, float]]:
    """Passages of words[a:b], whose scores are given: each word's repetitions in one add nothing.

    A passage runs from a word above drift to its highest sum, until the sum is used up or has dropped, and is drawn
    in at its start where that gains. What was left before it is searched with each word counted once; the search goes
    on right behind it with all words at full score.
    """
    found, i, stop = [], 0, b - a
    while i < stop:
        if scores[i] <= drift:
            i += 1
            continue
        total, top, end, seen = 0.0, 0.0, i, set()
        for j in range(i, stop):
            s = scores[j]
            if s > 0:
                w = words[a + j]
                if w in seen:
                    s = 0.0
                else:
                    seen.add(w)
            total += s - drift
            if total > top:
                top, end = total, j + 1
            elif total <= 0 or total < top - DROP:
                break
        total, top, start, seen = 0.0, 0.0, end, set()
        for j in range(end - 1, i - 1, -1):
            s = scores[j]
            if s > 0:
                w = words[a + j]
                if w in seen:
                    s = 0.0
                else:
                    seen.add(w)
            total += s - drift
            if total >= top:
                top, start = total, j
        found.append((a + start, a + end, top))
        if start > i:
            once, seen = np.array(scores[i:start]), set()
            for j in range(i, start):
                if scores[j] > 0:
                    once[j - i] = 0.0 if words[a + j] in seen else scores[j]
                    seen.add(words[a + j])
            found += [(a + i + x, a + i + y, s) for x, y, s in segments(once - drift)]
        i = end
    return found


@dataclass(frozen=True)
class Model:
    """Scores of tokens, the extreme-value parameters, and the calibration of the evidence."""

    scores: dict[str, float]
    drift: float = DRIFT
    rate: float = 1.0
    size: float = 1.0
    slope: float = 0.0
    further: float = 0.0
    offset: float = -50.0
    known: dict[str, float] = field(default_factory=dict, compare=False)

    def word(self, word: str) -> float:
        """A word's score is that of its most telling token."""
        return max((self.scores.get(t, 0.0) for t in tokens(word)), key=abs)

    def words(self, text: str) -> list[float]:
        """Scores of a text's words, before drift."""
        return self.each(words_of(text))

    def each(self, found: list[str]) -> list[float]:
        """Scores of words, before drift."""
        known = self.known
        try:
            return [known[w] for w in found]
        except KeyError:
            if len(known) > CACHED:
                known.clear()
            own = {w: known[w] if w in known else self.word(w) for w in set(found)}
            known.update(own)
            return [own[w] for w in found]

    def passages(self, text: str) -> tuple[list[tuple[int, int, float]], int]:
        """Maximal segments as (first word, last word + 1, score), and the number of words."""
        found = words_of(text)
        scores = np.array(self.each(found))
        if not len(scores) or scores.max() <= self.drift:
            return [], len(scores)
        return passages_once(found, scores, self.drift), len(scores)

    def expected(self, score: float, n: int) -> float:
        """How many segments of at least this score a clean text of n words has by chance."""
        return self.size * max(n, 1) * math.exp(-self.rate * score)

    def evidence(self, scores: list[float], n: int) -> tuple[float, float]:
        """What the segments of a text of n words tell: the best one, and the sum of all others better than chance.

        A segment's evidence is minus the logarithm of how many as good ones chance makes; the sum enters by its
        logarithm, as passages of one text aren't independent.
        """
        base = math.log(self.size * max(n, 1))
        each = sorted((self.rate * s - base for s in scores), reverse=True)
        return (each[0], math.log1p(sum(s for s in each[1:] if s > 0))) if each else (-base, 0.0)

    def score(self, text: str) -> float:
        """How likely the text is toxic."""
        found, n = self.passages(text)
        return self.probability(*self.evidence([s for _, _, s in found], n))

    def probability(self, best: float, others: float) -> float:
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, self.slope * best + self.further * others + self.offset))))


def training_rows(docs: DataFrame, labels: DataFrame, id_column: str, text_column: str, most: int) -> DataFrame:
    """Texts and labels to learn from, copies of a text once, at most a given number of labelled rows."""
    chosen = (
        labels.filter(in_training(labels[id_column]) & labels["toxic"].isNotNull())
        .groupBy(labels[id_column].alias("id"))
        .agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("id"), "id")
        .limit(most)
    )
    texts = docs.select(docs[id_column].alias("id"), text_of(docs, text_column).alias("text"))
    # at most FIT_ROWS rows of two numbers
    return (
        texts.join(F.broadcast(chosen), "id")
        .withColumn("copy", F.xxhash64("text"))
        .groupBy("copy")
        .agg(F.max("toxic").alias("toxic"), F.first("text").alias("text"))
        .select("text", "toxic")
    )


def token_scores(rows: DataFrame) -> dict[str, float]:
    """Log-odds of tokens in toxic against clean documents, of all tokens that differ by more than doubt.

    A token counts once a document, so one document's repetitions teach nothing. Both sides get the pooled frequency
    times PRIOR, and FLOOR, as pseudo-counts; a score is the log-odds ratio drawn DOUBT standard errors to 0. There
    are no more tokens than the bounded sample of labelled rows has.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sides = (Counter(), Counter())
            for text, toxic in zip(batch["text"], batch["toxic"]):
                sides[int(toxic)].update({t for w in set(words_of(text)) for t in tokens(w)})
            both = list(sides[0].keys() | sides[1].keys())
            if both:  # an empty column has no type
                yield pd.DataFrame({"token": both, "clean": [sides[0][w] for w in both], "bad": [sides[1][w] for w in both]})

    counts = rows.mapInPandas(count, "token string, clean long, bad long").groupBy("token").agg(F.sum("clean").alias("clean"), F.sum("bad").alias("bad"))
    counts = stored(counts, "token-counts")
    n0, n1 = counts.agg(F.coalesce(F.sum("clean"), F.lit(0)), F.coalesce(F.sum("bad"), F.lit(0))).first()
    if not n0 or not n1:
        return {}
    pseudo = FLOOR + PRIOR * (F.col("clean") + F.col("bad")) / (n0 + n1)
    bad, clean = F.col("bad") + pseudo, F.col("clean") + pseudo
    ratio = F.log(bad / (n1 + PRIOR + FLOOR)) - F.log(clean / (n0 + PRIOR + FLOOR))
    error = F.sqrt(1 / bad + 1 / clean)
    scored = counts.select("token", (F.signum(ratio) * F.greatest(F.lit(0.0), F.abs(ratio) - DOUBT * error)).alias("score"))
    return {r.token: r.score for r in scored.filter("score != 0").collect()}  # tokens of at most FIT_ROWS rows


def chance(rows: DataFrame, scores: dict[str, float]) -> tuple[np.ndarray, np.ndarray]:
    """How word scores are spread in clean documents: values in steps of 0.01, and how many words have each.

    The highest score counts FLOOR times more, so that chance never rules it out.
    """
    shared = rows.sparkSession.sparkContext.broadcast(Model(scores))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = Counter(round(100 * s) for t in batch["text"] for s in shared.value.words(t))
            if found:
                yield pd.DataFrame({"step": list(found), "n": list(found.values())})

    steps = rows.filter("toxic = 0").mapInPandas(count, "step long, n long").groupBy("step").agg(F.sum("n").alias("n")).collect()
    shared.destroy()
    values = [r.step / 100 for r in steps] + [max(scores.values())]
    return np.array(values), np.array([float(r.n) for r in steps] + [FLOOR])


def decay(values: np.ndarray, n: np.ndarray) -> float:
    """The positive root of mean(exp(rate * value)) = 1: how fast chance scores thin out."""
    p, low, high = n / n.sum(), 1e-6, 1.0
    mean = lambda rate: float((p * np.exp(np.minimum(rate * values, 700))).sum())
    while mean(high) < 1 and high < 100:
        high *= 2
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (low, middle) if mean(middle) > 1 else (middle, high)
    return (low + high) / 2


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Slopes, none below 0, and offset of P(y | columns of x), by Newton steps with a little ridge."""
    mean, spread = x.mean(axis=0), x.std(axis=0)
    spread = np.where(spread > 0, spread, 1.0)
    z, w = np.column_stack([(x - mean) / spread, np.ones(len(x))]), np.zeros(x.shape[1] + 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -50, 50)))
        gradient = z.T @ (y - p) - 1e-3 * w
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 1e-3 * np.eye(len(w)), gradient)
        w = w + np.clip(step, -2, 2)
    if (w[:-1] < 0).any() and x.shape[1] > 1:
        one, offset = logistic(x[:, :1], y)
        return np.array([one[0], 0.0]), offset
    slopes = np.maximum(0.0, w[:-1]) / spread
    return slopes, float(w[-1] - slopes @ mean)


def fit(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", most: int = FIT_ROWS) -> Model:
    """Learns from at most `most` labelled rows whose crc32(id) mod 5 isn't 0; nothing but texts is an input.

    Counting is a Spark aggregation; the driver holds scores of the sample's tokens and a pair of numbers per labelled
    row. Segments of the sample's texts are found once and stored: the extreme-value size comes from the best ones of
    clean texts, then the evidence of all is calibrated. With no labels, or only one kind, all texts score 0.
    """
    rows = stored(training_rows(docs, labels, id_column, text_column, most), "training")
    scores = token_scores(rows)
    if not scores or max(scores.values()) <= 0:
        return Model({})
    values, n = chance(rows, scores)
    drift = DRIFT + max(0.0, float((values * n).sum() / n.sum()))  # chance scores fall on average
    model = Model(scores, drift, decay(values - drift, n))
    first = docs.sparkSession.sparkContext.broadcast(model)

    def segment(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [first.value.passages(t) for t in batch["text"]]
            yield pd.DataFrame({"found": [[s for _, _, s in f] for f, _ in found], "n": [max(n, 1) for _, n in found], "toxic": batch["toxic"]})

    parts = stored(rows.mapInPandas(segment, "found array<double>, n long, toxic int"), "segments")
    first.destroy()
    top = F.coalesce(F.array_max("found"), F.lit(0.0))
    clean, chances = parts.filter("toxic = 0").agg(F.count(F.lit(1)), F.sum(F.col("n") * F.exp(-model.rate * top))).first()
    sized = Model({}, drift, model.rate, clean / max(1e-300, chances or 0.0))  # most likely, given the rate

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            told = [sized.evidence(f, n) for f, n in zip(batch["found"], batch["n"])]
            yield pd.DataFrame({"best": [t[0] for t in told], "others": [t[1] for t in told], "toxic": batch["toxic"]})

    got = parts.mapInPandas(weigh, "best double, others double, toxic int").toPandas()  # bounded by FIT_ROWS
    (slope, further), offset = logistic(got[["best", "others"]].to_numpy(float), got.toxic.to_numpy(float))
    return replace(model, size=sized.size, slope=float(slope), further=float(further), offset=offset, known={})


def scored(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Score of each whole text and its significant toxic passages, in one pass where the rows lie.

    Null texts are empty and score as such; equal texts score alike (ties) and repeated rows are scored each; very long
    texts take time in proportion to their words; other columns are ignored; an empty table gives no rows. The
    broadcast model holds tokens of at most FIT_ROWS labelled rows. Returns id, score, passages (code points from start to end, score, expected).
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        one = shared.value
        for batch in batches:
            out = []
            for text in batch["text"]:
                found, n = one.passages(text)
                good = [f for f in found if one.expected(f[2], n) <= SIGNIFICANT]
                at = [m.span() for m in WORD.finditer(text)] if good else []
                listed = [{"start": at[a][0], "end": at[b - 1][1], "score": s, "expected": one.expected(s, n)} for a, b, s in good]
                out.append((one.probability(*one.evidence([s for _, _, s in found], n)), listed))
            yield pd.DataFrame({"id": batch["id"], "score": [o[0] for o in out], "passages": [o[1] for o in out]})

    passage = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("expected", T.DoubleType())])
    schema = T.StructType([T.StructField("id", docs.schema[id_column].dataType), T.StructField("score", T.DoubleType()), T.StructField("passages", T.ArrayType(passage))])
    rows = docs.select(docs[id_column].alias("id"), text_of(docs, text_column).alias("text"))
    return rows.mapInPandas(score, schema).withColumnRenamed("id", id_column)


def verdicts(found: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """The digest of scored()."""
    return found.select(id_column, (~in_training(F.col(id_column))).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def clean(docs: DataFrame, model: Model, text_column: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of docs that score below the threshold, all columns as they are; null texts score as empty ones."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series([shared.value.score(t or "") for t in texts], dtype=float)

    return docs.filter(score(docs[text_column]) < threshold)
