"""Spelling variants against brute force, with edges."""

import os
import re
import zlib
from collections import Counter

import pytest

from brightquay.llm import spelling

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def one_edit(a, b):
    """Exactly one inserted, deleted or replaced code point."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) - len(a) == 1 and any(a == b[:i] + b[i + 1 :] for i in range(len(b)))


def brute_counts(docs):
    """Counts of damaged words in plain Python."""
    low, out = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", text or ""):
            w = run.translate(low)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 199 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            out[w] += 1
    return {w: n for w, n in out.items() if len(w) >= 6 and n >= 5}


def brute_variants(counts):
    """All pairs."""
    out = {}
    for w, n in counts.items():
        near = sorted(((-counts[v], v) for v in counts if v != w and abs(len(v) - len(w)) <= 1 and one_edit(w, v)), key=lambda x: (x[0], x[1].encode()))
        form = near[0][1] if near and -near[0][0] >= 5 * n else None
        out[w] = (form, n, len(near), counts[form] if form else None)
    root = lambda w: w if out[w][0] is None else root(out[w][0])
    return sorted((w, f, root(w), n, k, m) for w, (f, n, k, m) in out.items())


def rows(df):
    """Sorted tuples."""
    return sorted(tuple(r) for r in df.collect())


def test_bands_halves_and_chains(spark):
    """Edits at both ends and in the middle, doubled and accented letters, ties, chains of forms."""
    words = {"letter": 5000, "leter": 900, "lettter": 5, "lettre": 7, "aletter": 20, "lettera": 19, "better": 5000, "bettes": 6, "bettesx": 5, "\u00e9tudes": 30, "etudes": 300, "\u00e8tudes": 5, "aaaaaa": 50, "aaaaaaa": 10, "aaaaab": 9, "abcdef": 125, "abcdeg": 25, "abcdgg": 5, "\u00c0bcdef": 5}
    counts = {w: n for w, n in words.items() if len(w) >= 6}
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = rows(spelling.spelling_variants(df))
    assert got == brute_variants(counts)
    assert ("abcdgg", "abcdeg", "abcdef", 5, 1, 25) in got


def test_many_random_words(spark):
    """A dense family over two letters finds every pair."""
    import random

    rng = random.Random(5)
    counts = {"".join(rng.choice("ab\u00ff") for _ in range(rng.randint(6, 9))): rng.randint(5, 200) for _ in range(400)}
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert rows(spelling.spelling_variants(df)) == brute_variants(counts)


def test_edges(spark):
    """Null and empty texts, null ids, other columns, empty tables."""
    docs = [(1, None), (2, ""), (None, "\u00d7\u00f7abcdef ABCDEF abcdef"), (3, "abcdef abcdef abcde " * 3), (3, "abcdef abcdef abcde " * 3), (4, "word\u0100s " * 9)]
    df = spark.createDataFrame([(i, t, "w", 1) for i, t in docs], "doc_id long, text string, word string, n int")
    assert {r.word: r.n for r in spelling.word_counts(df, 199).collect()} == brute_counts(docs)
    assert rows(spelling.spelling_variants(spelling.word_counts(df.limit(0), 199))) == []
    assert rows(spelling.spelling_variants(spark.createDataFrame([(None, 9), ("lonely", 9)], "word string, n long"))) == [("lonely", None, "lonely", 9, 0, None)]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_query(spark):
    """The query's rows on the smallest tables."""
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    assert rows(spelling.op12_spelling_variants(spark, DATA)) == brute_variants(brute_counts(docs))
