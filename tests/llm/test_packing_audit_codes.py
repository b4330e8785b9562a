"""Retrieval packing, the audit of sources and vector codes against plain Python."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from medialake.llm import divergence, retrieval_packing, vector_codes
from medialake.llm.encoding import vocabulary_path

SF = "/root/testdata/sf0.001"
AWKWARD = [(0, None), (1, ""), (2, "  \n "), (3, "One line."), (4, "One line."), (5, "x " * 3000), (6, "é 中文 😀 <|endoftext|> fine"), (7, "a\nb"), (8, "b\na"), (8, "b\na"), (None, "no id")]


def encoded(rows):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary_path())
    return [(i, tokenizer.encode(t or "", add_special_tokens=False).ids + [0]) for i, t in rows]


def check_packing(got, rows, room):
    """Every token in exactly one piece with its checksum; sequences are gapless and need no padding."""
    left = collections.Counter()
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    texts = collections.defaultdict(list)
    for i, ids in encoded(rows):
        texts[i].append(ids)
        left[i] += len(ids)
    for r in got:
        assert any(len(ids) == r.doc_tokens and crc(ids[r.start : r.start + r.length]) == r.ids_crc32 for ids in texts[r.doc_id]), r
        left[r.doc_id] -= r.length
    assert not any(left.values())
    for i, copies in texts.items():
        at = sorted((r.start, r.length) for r in got if r.doc_id == i)
        assert collections.Counter(p for ids in copies for p in range(len(ids))) == collections.Counter(p for a, n in at for p in range(a, a + n))
    sequences = collections.defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end and length > 0
            end += length
        assert end <= room and end & (end - 1) == 0
    return sequences


@pytest.mark.parametrize("shard_tokens", [300, 2_000_000])
def test_retrieval_packing(spark, shard_tokens):
    rows = AWKWARD + [(100 + r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("id", "ids", "key", "tie", "length", "terms")})
    got = retrieval_packing.packed(df, room=64, shard_tokens=shard_tokens).collect()
    sequences = check_packing(got, rows, 64)
    short = sum(sum(n for _, n in parts) < 64 for parts in sequences.values())
    assert shard_tokens == 300 or short <= 7 * 4  # the last window of each task's last shard


def test_retrieval_packing_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert retrieval_packing.packed(empty).count() == 0
    rows = [(i, None if i % 2 else "") for i in range(1500)]
    got = retrieval_packing.packed(spark.createDataFrame(rows, "doc_id long, text string"), room=1024).collect()
    assert len(check_packing(got, rows, 1024)) < 30 and len(got) == 1500


def brute_windows(terms, lengths, room, mean):
    """Greedy windows by plain BM25 of whole documents."""
    docs = len(terms)
    df = collections.Counter(t for d in terms for t in d)
    idf = {t: math.log1p((docs - n + 0.5) / (n + 0.5)) if n > 1 else 0.0 for t, n in df.items()}

    def weight(d, t):
        tf = terms[d][t]
        return idf[t] * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * sum(terms[d].values()) / mean)) if tf else 0.0

    unused, cut, out = list(range(docs)), None, []
    while unused or cut:
        seed, start = cut or (unused.pop(0), 0)
        cut, window, left, doc = None, [], room, seed
        by_score = sorted(unused, key=lambda d: (-round(sum(weight(d, t) for t in terms[seed] if idf[t]), 9), d))
        while True:
            took = min(left, lengths[doc] - start)
            window.append((doc, start, took))
            left -= took
            if not left:
                cut = (doc, start + took) if start + took < lengths[doc] else None
                break
            if not by_score:
                break
            doc, start = by_score.pop(0), 0
            unused.remove(doc)
        out.append(window)
    return out


@pytest.mark.parametrize("seed", range(6))
def test_windows_are_filled_by_score(seed):
    r = random.Random(seed)
    topics = [[r.randrange(200) for _ in range(12)] for _ in range(5)]
    terms = [collections.Counter(r.choice(topics[k % 5]) if r.random() < 0.8 else r.randrange(200) for _ in range(r.randint(1, 30))) for k in range(40)]
    lengths = [sum(t.values()) for t in terms]
    mean = sum(lengths) / len(lengths)
    df = np.bincount([t for d in terms for t in d], minlength=200)
    weights = retrieval_packing.Weights(df, len(terms), sum(lengths))
    arrays = [(np.array(sorted(d), np.uint32), np.array([d[t] for t in sorted(d)], np.uint32)) for d in terms]
    weighed = [(t, np.round(weights.of(t, n, x), 12)) for (t, n), x in zip(arrays, lengths)]
    index = retrieval_packing.Index(weighed)
    rounded = index.scores
    index.scores = lambda q: np.round(rounded(q), 9)
    queries = [t[w > 0] for t, w in weighed]
    assert list(retrieval_packing.fill(lengths, queries, index, 32)) == brute_windows(terms, lengths, 32, mean)


def test_related_documents_share_windows(spark):
    """Two subjects mixed in the table are kept apart by the index, but for the window where one ends."""
    r = random.Random(1)
    subjects = [["harbour", "sailor", "anchor", "ship", "tide", "mast"], ["flour", "oven", "dough", "baker", "crust", "yeast"]]
    rows = [(i, " ".join(r.choice(subjects[i % 2]) for _ in range(20))) for i in range(120)]
    got = retrieval_packing.packed(spark.createDataFrame(rows, "doc_id long, text string"), room=128).collect()
    check_packing(got, rows, 128)
    kinds = collections.defaultdict(set)
    for x in got:
        kinds[x.sequence_id].add(x.doc_id % 2)
    assert sum(len(k) > 1 for k in kinds.values()) <= 2


def brute_audit(rows, least):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(low))) for lang, source, t in rows]
    out = []
    for lang in {w[0] for w in words}:
        df, by_source = collections.Counter(), collections.defaultdict(collections.Counter)
        for x, source, found in words:
            if x == lang:
                df.update(set(found))
                by_source[source].update(found)
        kept = {t for t, n in df.items() if n >= least}
        p = {}
        every = sum(by_source.values(), collections.Counter())
        for source, counts in [*by_source.items(), (None, every)]:
            total = sum(counts[t] for t in kept)
            p[source] = {t: 1 + 10**9 * (counts[t] + 2) // (total + 2 * len(kept)) for t in kept}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for source in by_source:
            pairs = sorted((-sum(f(p[source][t], p[o][t]) for t in kept), o.encode(), o) for o in by_source if o != source)
            out += [(lang, source, "pair", o, -v, k + 1) for k, (v, _, o) in enumerate(pairs)]
            terms = sorted((-f(p[source][t], p[None][t]), t.encode(), t) for t in kept if by_source[source][t] and p[source][t] > p[None][t])
            out += [(lang, source, "term", t, -v, k + 1) for k, (v, _, t) in enumerate(terms[:10])]
    return sorted(out)


def test_audit_matches_plain_python(spark, monkeypatch):
    monkeypatch.setattr(divergence, "HELD", 50)  # counters are handed on many times
    r = random.Random(2)
    lexicon = [f"w{c}" for c in "abcdefghijklmnop"] + ["É", "éa", "Z", "z", "中文", "it's"]
    rows = [(r.choice(["en", "de", None, ""]), r.choice(["s1", "s2", "s3", "ä", None]), " ".join(r.choice(lexicon[: r.randint(3, 22)]) for _ in range(r.randint(0, 40)))) for _ in range(150)]
    rows += [("en", "bare", None), ("en", "bare too", "1 2 3"), ("xx", "only", "one two"), ("xx", "other", ""), *[rows[3]] * 40]
    df = spark.createDataFrame(rows, "lang string, source string, text string").withColumns({c: F.lit("clash") for c in ("term", "n", "docs", "kept", "a", "b", "value")})
    for least in (1, 10):
        assert sorted(map(tuple, divergence.audit(df, least_docs=least).collect())) == brute_audit(rows, least)
    assert divergence.audit(df.limit(0)).count() == 0
    assert sorted(map(tuple, divergence.audit(df.withColumn("text", F.lit(None).cast("string"))).collect())) == brute_audit([(a, b, None) for a, b, _ in rows], 10)


def test_shares_of_large_counts_are_exact(spark):
    n, total, kept = 3 * 10**15 + 7, 9 * 10**15 + 1, 123_457
    row = spark.createDataFrame([(n, total, kept)], "n long, t long, k long")
    assert row.select(divergence.share(F.col("n"), F.col("t"), F.col("k"))).first()[0] == 1 + 10**9 * (n + 2) // (total + 2 * kept)


def brute_codes(rows, parts=8, entries=16, rounds=6):
    kept = [(i, x, [math.floor(4096 * c) for c in v]) for i, v, x in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    width = len(kept[0][2]) // parts
    books = [[v[j * width : (j + 1) * width] for _, _, v in sorted(kept, key=lambda k: (k[0] is None, k[0] or 0, k[2]))[:entries]] for j in range(parts)]

    def nearest(book, part):
        return min((sum((a - b) ** 2 for a, b in zip(part, e)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for j, book in enumerate(books):
            groups = collections.defaultdict(list)
            for _, _, v in kept:
                part = v[j * width : (j + 1) * width]
                groups[nearest(book, part)[1]].append(part)
            books[j] = [[sum(c) // len(groups[k]) for c in zip(*groups[k])] if k in groups else e for k, e in enumerate(book)]
    out, by_label = [], collections.Counter()
    for i, x, v in kept:
        found = [nearest(book, v[j * width : (j + 1) * width]) for j, book in enumerate(books)]
        out.append((i, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found), x))
        by_label[x] += out[-1][2]
    digest = hashlib.sha256(",".join(str(c) for book in books for e in book for c in e).encode()).hexdigest()
    return sorted(((i, code, error, by_label[x], digest) for i, code, error, x in out), key=repr)


@pytest.mark.parametrize("block", [7, 2_048])
@pytest.mark.parametrize("kind", ["spread", "ties", "few"])
def test_codes_match_plain_lloyd(spark, monkeypatch, block, kind):
    monkeypatch.setattr(vector_codes, "BLOCK", block)
    r = random.Random(4)
    draw = {"spread": lambda: r.gauss(0, 1), "ties": lambda: r.randint(-1, 1) / 4096, "few": lambda: r.gauss(0, 1)}[kind]
    rows = [(r.choice([i, 2**60 + i]), [draw() for _ in range(16)], r.choice([None, 0, 1, 7])) for i in range(5 if kind == "few" else 150)]
    rows += [(900, None, 1), (901, [None] + [0.5] * 15, 1), (902, [math.nan] + [0.5] * 15, 1), (903, [-math.inf] + [0.5] * 15, 1), (None, [0.25] * 16, None), (rows[0][0], [0.5] * 16, 0), *[rows[2]] * 20]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumns({c: F.lit("clash") for c in ("id", "v", "code", "n", "rows")})
    got = sorted(map(tuple, vector_codes.codes(df).collect()), key=repr)
    assert got == brute_codes(rows)


def test_codes_of_nothing_and_of_uneven_vectors(spark):
    df = spark.createDataFrame([(1, None, 2), (2, [math.nan] * 8, 1)], "vec_id long, embedding array<float>, label int")
    assert vector_codes.codes(df).count() == 0 and vector_codes.codes(df.limit(0)).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    for odd in ([[1.0] * 8, [1.0] * 16], [[1.0] * 9], [[]]):
        with pytest.raises(ValueError):
            vector_codes.codes(spark.createDataFrame([(i, v, 0) for i, v in enumerate(odd)], "vec_id long, embedding array<double>, label int"))


def test_trees_assign_whole_subtrees():
    """Clustered points: most are given out by boxes, and every one to its nearest entry, ties to the lower."""
    rng = np.random.default_rng(0)
    for spread in (3, 200, 4000):
        points = (rng.integers(-5000, 5000, (16, 8))[rng.integers(0, 16, 1500)] + rng.integers(-spread, spread + 1, (1500, 8))).astype(np.int64)
        order = vector_codes.order_of(points)
        tree = vector_codes._reduced(points[order], order)
        entries = np.concatenate([points[:14], points[:2]])
        nearest = ((points[:, None] - entries[None]) ** 2).sum(axis=2)
        codes, errors = vector_codes.assigned(tree, entries)
        assert (codes == nearest.argmin(axis=1)).all() and (errors == nearest.min(axis=1)).all()
        counts, sums = vector_codes.tallied(tree, entries)
        assert (counts == np.bincount(codes, minlength=16)).all() and all((sums[k] == points[codes == k].sum(axis=0)).all() for k in range(16))
        singly = sum(len(which) for level, which, _ in vector_codes.filtered(tree, entries) if level < 0)
        assert spread > 3 or singly < 300


def test_ranks_give_what_the_library_gives():
    """The fast path for pre-tokens against the library's own model: on the whole vocabulary and on strings of its parts."""
    from medialake.llm.encoding import SHOWN, encoder

    coder = encoder(vocabulary_path())
    byte = {ord(c): b for b, c in SHOWN.items()}
    words = [bytes(s.translate(byte), "latin-1").decode(errors="ignore") for s in coder.tokenizer.get_vocab() if s not in coder.special]
    r = random.Random(0)
    words += ["".join(r.choice(words) for _ in range(r.randint(2, 5))) for _ in range(5_000)] + ["x" * 500, "é中😀" * 40]
    assert coder.ranks and all(coder.tokens(w) == [t.id for t in coder.model.tokenize(w.encode().decode("latin-1").translate(SHOWN))] for w in words if w)


def test_texts_without_runs_of_white_space_are_encoded_whole():
    """Against the library: all plain characters, contractions and mixtures; such texts leave nothing in the cache of pre-tokens."""
    from medialake.llm.encoding import PLAIN, Encoder

    coder = Encoder(vocabulary_path())
    plain = [chr(c) for c in range(0x2100) if re.match(f"[{PLAIN}]", chr(c))]
    parts = [*plain, *plain, "'s", "'re", "don't", "''ll", " '", "Привет", "12", "½", "über", "the", " ", "\n", "\t", "\xa0"] + [" "] * 200
    r = random.Random(1)
    texts = ["".join(f"{a}{b}" for b in parts) for a in ("a", "7", "-")] + ["".join(r.choice(parts) for _ in range(n)) for n in range(400)]
    single = [re.sub(r"(\s)\s+", r"\1", t) for t in texts]
    library = lambda t: np.array(coder.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
    assert all(coder.ids(t) == library(t) for t in single) and not coder.known and not coder.known.older
    assert all(coder.ids(t) == library(t) for t in texts) and coder.known
