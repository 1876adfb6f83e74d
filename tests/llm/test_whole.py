"""The classifier against plain numpy, and the pipeline against plain Python, stage by stage."""

import hashlib
import math
import os
import zlib
from collections import defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from brightquay.llm import packing, quality
from brightquay.llm.common import write_table

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


@pytest.fixture(scope="module")
def rows():
    """Documents as tuples (doc_id, text, source)."""
    t = pq.read_table(f"{DATA}/documents.parquet", columns=["doc_id", "text", "source"])
    return list(zip(*(t.column(c).to_pylist() for c in t.column_names), strict=True))


def plain_scores(rows):
    """Scores of all rows by one solved ridge, one histogram and one isotonic pass."""
    labels = defaultdict(list)
    y = pq.read_table(f"{DATA}/labels.parquet")
    for i, q in zip(y.column("doc_id").to_pylist(), y.column("quality").to_pylist(), strict=True):
        if i is not None and q is not None:
            labels[i].append(q)
    stats = np.array([quality.document_stats(t or "") for _, t, _ in rows], float)
    learn = [k for k, (i, _, _) in enumerate(rows) if i in labels and zlib.crc32(str(i).encode()) % 3 != 1]
    checked = np.array([zlib.crc32(f"calibrate:{rows[k][0]}".encode()) % 5 == 0 for k in learn])
    target = np.array([np.mean(labels[rows[k][0]]) for k in learn])
    x, own = stats[learn], ~checked
    mean, scale = x[own].mean(axis=0), np.maximum(x[own].std(axis=0), 1e-6)
    rng = np.random.default_rng(quality.SEED)
    directions, phases = rng.standard_normal((x.shape[1], quality.FEATURES)) / quality.WIDTH, rng.uniform(0, 2 * math.pi, quality.FEATURES)

    def phi(v):
        z = np.clip((v - mean) / scale, -8, 8)
        return np.hstack([math.sqrt(2 / quality.FEATURES) * np.cos(z @ directions + phases), np.ones((len(v), 1))])

    p = phi(x[own])
    penalty = np.diag([quality.RIDGE * own.sum()] * quality.FEATURES + [0.0]) + 1e-9 * np.eye(quality.FEATURES + 1)
    weights = np.linalg.solve(p.T @ p + penalty, p.T @ target[own])
    raw = phi(x[checked]) @ weights
    at = np.floor(np.clip((raw + 0.5) / 2, 0, 1) * quality.BINS).astype(int)
    used = np.unique(at)
    n, m = np.array([(at == b).sum() for b in used]), np.array([target[checked][at == b].mean() for b in used])
    # the isotonic fit by its definition: the largest of the least means
    level = [max(min((n[i : j + 1] * m[i : j + 1]).sum() / n[i : j + 1].sum() for j in range(k, len(n))) for i in range(k + 1)) for k in range(len(n))]
    return np.clip(np.interp(phi(stats) @ weights, (used + 0.5) / quality.BINS * 2 - 0.5, level), 0, 1)


def test_classifier_against_numpy(spark, rows):
    """Every score is the plain one."""
    want = dict(zip((i for i, _, _ in rows), plain_scores(rows), strict=True))
    got = {r.doc_id: r.score for r in quality.op7_quality_classifier(spark, DATA).collect()}
    assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i], abs=1e-6) for i in want)


def nearest(docs):
    """Ids that stay of near copies: the least of each component, all pairs tried."""
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := t.encode().lower().split()) else set() for i, t in docs.items()}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i for i in ids if find(i) == i}


def mixed(docs, source):
    """(id, words) of every document that the mix takes, as often as it takes it."""
    size = {i: len(t.encode().split()) for i, t in docs.items()}
    names = sorted({source[i] for i in docs}, key=lambda s: (s is None, s or ""))
    total, cap = sum(size.values()), {s: 3 * sum(size[i] for i in docs if source[i] == s) for s in names}
    weight, target, left = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}, {}, float(total)
    while True:
        open_ = [s for s in names if s not in target]
        level = left / sum(weight[s] for s in open_) if open_ else 0
        over = [s for s in open_ if cap[s] < level * weight[s]]
        if not over:
            target |= {s: level * weight[s] for s in open_}
            break
        for s in over:
            target[s] = cap[s]
            left -= cap[s]
    out = []
    for s in names:
        own = sorted((i for i in docs if source[i] == s), key=lambda i: int(hashlib.md5(f"{i}:mix".encode()).hexdigest()[:15], 16))
        whole, rest = divmod(math.floor(target[s] + 0.5), cap[s] // 3) if cap[s] else (0, 0)
        for i in own:
            part = max(0, min(size[i], rest))
            rest -= part
            out += [(i, size[i])] * (whole if size[i] else 0) + ([(i, size[i])] if part == size[i] and part else [(i, part)] if part else [])
    return sorted(out)


def test_pipeline_against_plain_python(spark, rows):
    """Each stage keeps what plain Python keeps of the rows that the stage before kept."""
    from tokenizers import Tokenizer

    text, source = {i: t or "" for i, t, _ in rows}, {i: s for i, _, s in rows}
    docs, kept = spark.read.parquet(f"{DATA}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = write_table(stage(spark, docs, DATA), f"test-{name}")
        kept[name] = docs
    ids = lambda name: {r.doc_id for r in kept[name].select("doc_id").collect()}
    want = {i for (i, _, _), s in zip(rows, plain_scores(rows), strict=True) if s >= 0.5}
    assert ids("quality") == want
    groups = defaultdict(list)
    for i in want:
        groups["".join(text[i].translate({ord(c): None for c in " \t\n\x0b\x0c\r"}))].append(i)
    want = {min(g, key=lambda i: (-len(text[i]), i)) for g in groups.values()}
    assert ids("exact") == want
    want = nearest({i: text[i] for i in want})
    assert ids("near") == want
    want = mixed({i: text[i] for i in want}, source)
    rows_of = kept["mixing"].select("doc_id", "text").collect()
    assert sorted((r.doc_id, len(r.text.encode().split())) for r in rows_of) == want
    tok = Tokenizer.from_file(packing.default_tokenizer())
    pieces = sorted((r.doc_id, zlib.crc32(np.array(ids_, "<u4")[k : k + 4096].tobytes())) for r in rows_of for ids_ in [[*tok.encode(r.text, add_special_tokens=False).ids, 1]] for k in range(0, len(ids_), 4096))
    assert sorted((r.doc_id, r.ids_crc32) for r in kept["packing"].collect()) == pieces
    assert kept["packing"].groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("m")).filter("n <> m OR n > 4096").count() == 0
