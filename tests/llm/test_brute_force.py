"""Operators that SQL can't express, against plain Python on the smallest tables."""

import hashlib
import math
import os
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from brightquay.llm import katz, media, near_dup, packing, pii, quality, suffix_dedup

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


@pytest.fixture(scope="module")
def texts():
    """Texts by id."""
    t = pq.read_table(f"{DATA}/documents.parquet")
    return dict(zip(t.column("doc_id").to_pylist(), t.column("text").to_pylist(), strict=True))


def test_packing(spark, texts):
    """Ids are the tokenizer's own, bins are gapless and full, and as few as the tokens need."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.default_tokenizer())
    rows = packing.op1_best_fit_packing(spark, DATA).collect()
    pieces = defaultdict(dict)
    for r in rows:
        pieces[r.doc_id][r.piece] = r
    for i, t in texts.items():
        ids = np.array([*tok.encode(t, add_special_tokens=False).ids, 1], "<u4")
        own = [pieces[i][k] for k in range(len(pieces[i]))]
        assert [p.start for p in own] == list(range(0, len(ids), 4096)) and sum(p.length for p in own) == len(ids)
        assert all(zlib.crc32(ids[p.start : p.start + p.length].tobytes()) == p.ids_crc32 for p in own)
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(bins) <= math.ceil(sum(r.length for r in rows) / 4096) + 1


def test_best_fit_takes_the_tightest_bin():
    """Against a search through all bins."""
    rng = np.random.default_rng(5)
    lengths = rng.integers(1, 101, 400)
    bins, offsets, made = packing.best_fit_decreasing(lengths, 100)
    rooms = []
    for i in np.argsort(-lengths, kind="stable"):
        fit = [r for r in rooms if r >= lengths[i]]
        if fit:
            rooms[rooms.index(min(fit))] -= lengths[i]
        else:
            rooms.append(100 - lengths[i])
    assert made == len(rooms) and sorted(np.bincount(bins, lengths)) == sorted(100 - r for r in rooms)


def test_near_duplicates(spark, texts):
    """Components of all pairs, tried one by one."""
    sets = {}
    for i, t in texts.items():
        w = t.encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.op2_ngram_jaccard_join(spark, DATA).collect()}
    assert got == {i: (len(sets[i]), find(i)) for i in ids}


def test_segments_lose_no_link(spark):
    """A dense family of variants, and strangers: components equal those of all pairs."""
    rng = np.random.default_rng(2)
    base = [f"w{i}" for i in range(120)]
    docs = []
    for i in range(60):
        w = list(base)
        for k in rng.choice(120, int(rng.integers(0, 7)), replace=False):
            w[k] = f"v{rng.integers(0, 9)}"
        docs.append((i, " ".join(w)))
    docs += [(100 + i, " ".join(f"z{rng.integers(0, 10**6)}" for _ in range(int(rng.integers(1, 12))))) for i in range(20)]
    docs += [(200, "a b c d e f g h"), (201, "a b c d e f g"), (202, "q a b c d e f g")]
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    sets = {i: set(near_dup.shingle_set(t).tolist()) for i, t in docs}
    root = {i: i for i in sets}
    for _ in sets:
        for i in sets:
            for j in sets:
                both = len(sets[i] & sets[j])
                if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                    root[i] = root[j] = min(root[i], root[j])
    assert got == root


def test_hot_segment_is_dealt_in_chunks(spark, monkeypatch):
    """Strangers with a passage in common, and copies among them: links equal those of all pairs, and no group has more than two chunks."""
    rng = np.random.default_rng(3)
    passage = [f"p{i}" for i in range(40)]
    docs = []
    for i in range(240):
        w = passage + [f"z{rng.integers(0, 10**6)}" for _ in range(50)]
        docs.append((i, " ".join(w)))
        if i % 6 == 0:
            w[-1] = "other"
            docs.append((1000 + i, " ".join(w)))
    sets = {i: near_dup.shingle_set(t) for i, t in docs}
    monkeypatch.setattr(near_dup, "CHUNK", 16)
    groups, made = [], near_dup.meetings

    def seen(*args):
        out = made(*args)
        groups.extend(out.groupBy("k", "i", "j").agg(F.sum(F.length("sig") / 8).alias("n")).collect())
        return out

    monkeypatch.setattr(near_dup, "meetings", seen)
    table = spark.createDataFrame([(i, len(s), s.tobytes()) for i, s in sets.items()], "doc_id long, n long, s binary")
    got = {r.node: r.component for r in near_dup.link_components(table, centres=False).collect()}
    assert got == {i: i % 1000 for j, _ in docs if j >= 1000 for i in (j, j - 1000)}
    pairs = [g for g in groups if g.i >= 0]
    assert len({g.k for g in pairs}) > 1 and max(g.n for g in pairs) <= 4 * 16


class PlainKatz:
    """A backoff model in dictionaries, evaluated word by word."""

    def __init__(self, texts, order):
        self.order, self.grams = order, [Counter() for _ in range(order + 1)]
        for toks in texts:
            w = ["<s>", *toks]
            for k in range(1, order + 1):
                self.grams[k].update(tuple(w[i - k + 1 : i + 1]) for i in range(max(1, k - 1), len(w)))
        self.total, self.types = sum(self.grams[1].values()), len(self.grams[1])
        self.d = [None]
        for k in range(1, order + 1):
            n = Counter(self.grams[k].values())
            self.d.append(katz.Counts(0, 0, tuple(n[r] for r in range(1, katz.GT + 2))).discounts())
        self.free = sum(c * (1 - self.d[1][min(c, katz.GT + 1)]) for c in self.grams[1].values()) / self.total
        self.following = defaultdict(list)
        for k in range(2, order + 1):
            for g in self.grams[k]:
                self.following[g[:-1]].append(g[-1])
        self.known = {}

    def context(self, h):
        """Tokens, whether nothing was freed, and the weight of a context."""
        if h not in self.known:
            k, after = len(h) + 1, self.following.get(h, ())
            n = sum(self.grams[k][(*h, w)] for w in after)
            seen = sum(self.d[k][min(c, katz.GT + 1)] * c / n for c in (self.grams[k][(*h, w)] for w in after))
            spent = bool(n) and seen >= 1 - 1e-9
            self.known[h] = (n + spent, (1 / (n + 1) if spent else 1 - seen) / (1 - sum(self.p(h[1:], w) for w in after)) if n else 1)
        return self.known[h]

    def p(self, h, w):
        """Probability of a word behind a context, from the highest order down."""
        if not h:
            c = self.grams[1][(w,)]
            return self.d[1][min(c, katz.GT + 1)] * c / self.total if c else self.free
        n, weight = self.context(h)
        c = self.grams[len(h) + 1][(*h, w)]
        return self.d[len(h) + 1][min(c, katz.GT + 1)] * c / n if c else weight * self.p(h[1:], w)


@pytest.mark.parametrize(("order", "hot"), [(1, 10**9), (2, 40), (3, 10**9), (3, 20), (4, 40)])
def test_language_model(spark, texts, monkeypatch, order, hot):
    """Scores by a plain model, over several batches, slices and hot contexts; contexts sum to one."""
    monkeypatch.setattr(katz, "BATCH_TOKENS", 20_000)
    monkeypatch.setattr(katz, "SLICE_KEYS", 20_000)
    monkeypatch.setattr(katz, "HOT", hot)
    got = {r.doc_id: r for r in katz.katz_scores(spark.read.parquet(f"{DATA}/documents.parquet"), order=order).collect()}
    toks = {i: [*t.encode().lower().split(), None] for i, t in texts.items()}
    train = {i for i in toks if zlib.crc32(str(i).encode()) % 7 != 2}
    plain = PlainKatz([toks[i] for i in train], order)
    c1 = {w: c for (w,), c in plain.grams[1].items()}
    for i, t in toks.items():
        r, w = got[i], ["<s>", *t]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(t), sum(x in c1 for x in t), plain.total, i not in train)
        assert r.base_score == pytest.approx(sum(math.log10((c1.get(x, 0) + 1) / (plain.total + plain.types + 1)) for x in t))
        assert r.score == pytest.approx(sum(math.log10(plain.p(tuple(w[max(0, k - order + 1) : k]) if order > 1 else (), w[k])) for k in range(1, len(w))))
    for h in [next(iter(plain.grams[k])) for k in range(1, order)]:
        assert sum(plain.p(h, w) for w in c1) + plain.p(h, "?") == pytest.approx(1)
    held = [i for i in toks if i not in train]
    assert sum(got[i].score for i in held) > sum(got[i].base_score for i in held)


def test_fitted_model_is_kept(spark, texts):
    """A model fitted on some texts scores others as if they had been there."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7
    model = katz.fit_katz(docs.filter(fold != 2))
    want = {r.doc_id: (r.n_known, r.score) for r in katz.katz_scores(docs).collect()}
    got = {r.doc_id: (r.n_known, r.score) for r in katz.score_katz(model, docs).collect()}
    assert got.keys() == want.keys() and all(got[i][0] == want[i][0] and got[i][1] == pytest.approx(want[i][1]) for i in want)


def test_media_round_trip(spark, texts):
    """Payloads come back as they were."""
    for r in media.op4_media_columns(spark, DATA).collect():
        t = texts[r.doc_id].encode()
        payload = t + b" " * (-len(t) % 192 if t else 192)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(t), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))


def test_passages(spark, texts, monkeypatch):
    """Against a set of all strings seen so far, over many small shards and slices."""
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", 30_000)
    monkeypatch.setattr(suffix_dedup, "SLICE_KEYS", 3_000)
    got = {r.doc_id: r for r in suffix_dedup.op5_suffix_dedup(spark, DATA).collect()}
    seen = set()
    for i in sorted(texts):
        b = texts[i].encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 99):
            s = b[p : p + 100]
            if s in seen:
                gone[p : p + 100] = True
            seen.add(s)
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = int(np.count_nonzero(np.diff(np.concatenate([[0], gone.astype(int)])) == 1))
        r = got[i]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())


def test_suffix_order_and_prefixes():
    """Order and common prefixes of a repetitive text, cut at a depth, against sorting."""
    rng = np.random.default_rng(3)
    raw = bytes(rng.integers(97, 99, 700).astype(np.uint8)) * 2 + b"abc" * 90 + bytes(300)
    text = np.frombuffer(raw, np.uint8)
    order = suffix_dedup.suffix_order(text, len(text))
    assert order.tolist() == sorted(range(len(raw)), key=lambda i: raw[i:])
    cut = suffix_dedup.suffix_order(text, 20)
    prefix = suffix_dedup.common_prefixes(text, cut, 20)
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        assert raw[a : a + 20] <= raw[b : b + 20]
        assert prefix[b] == len(os.path.commonprefix([raw[a : a + 20], raw[b : b + 20]]))


def test_surrogates(spark, texts):
    """Nothing found stays, formats do, distinct entities stay distinct, mentions agree, clean texts are unchanged."""
    got = {r.doc_id: r for r in pii.op6_pii(spark, DATA).collect()}
    pattern = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}|\b[0-9]{16}\b|\+\d \(\d{3}\) \d{3}-\d{4}|\b[0-9a-f]{40}\b")
    images = defaultdict(set)
    for i, t in texts.items():
        old, new = pattern.findall(t), pattern.findall(got[i].text)
        assert len(old) == len(new)
        if not re.search(r"[0-9@]", t):
            assert got[i].text == t
        for a, b in zip(old, new, strict=True):
            assert a != b and re.sub("[a-z]", "a", re.sub(r"\d", "9", a.split("@")[0])) == re.sub("[a-z]", "a", re.sub(r"\d", "9", b.split("@")[0])) or re.fullmatch("[0-9a-f]{40}", b)
            images[a.lower()].add(b.lower())
    assert all(len(v) == 1 for v in images.values())
    assert len({next(iter(v)) for v in images.values()}) == len(images)


def test_surrogates_of_names_and_variants(spark):
    """Gender, script, case, punctuation and the card's check digit are kept; a collision is drawn again."""
    rows = [(1, "Patricia Smith met ROBERT JONES, Наталья Петрова and Patricia Smith."), (2, "4111 1111 1111 1111 or 4111111111111111; A@B.com, a@b.com; 10.0.0.1")]
    out = {r.doc_id: r.text for r in pii.replace_pii(spark.createDataFrame(rows, "doc_id long, text string"), "key").collect()}
    women, men, russian = ({n.lower() for n in pii.GIVEN[k]} for k in (("f", "latin"), ("m", "latin"), ("f", "cyrillic")))
    first, met = out[1].split(" met ")
    assert first.split()[0].lower() in women and met.split()[0].lower() in men and met.split(",")[0].isupper()
    assert met.split(", ")[1].split()[0].lower() in russian and met.endswith(f" and {first}.")
    a, b = out[2].split("; ")[0].split(" or ")
    assert a.replace(" ", "") == b and a != "4111 1111 1111 1111"
    digits = [int(x) for x in b][::-1]
    assert sum(d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for k, d in enumerate(digits)) % 10 == 0
    ssns = spark.createDataFrame([(i, f"{i:03d}-00-0000") for i in range(100, 160)], "doc_id long, text string")
    assert pii.replace_pii(ssns, "key").select("text").distinct().count() == 60


def test_quality_on_held_out_rows(spark):
    """Held-out accuracy, and scores within bounds."""
    got = quality.op7_quality_classifier(spark, DATA)
    assert got.filter("score < 0 OR score > 1 OR score IS NULL").count() == 0
    y = spark.read.parquet(f"{DATA}/labels.parquet")
    j = got.filter("held_out").join(y, "doc_id")
    assert j.filter("predicted = quality").count() >= 0.9 * j.count()


def test_isotonic_pooling():
    """Means never fall, and blocks keep their weight."""
    n, m = np.array([1.0, 2, 1, 4, 1]), np.array([0.1, 0.5, 0.3, 0.2, 0.9])
    out = quality.pool_adjacent(n, m)
    assert (np.diff(out) >= 0).all() and (out * n).sum() == pytest.approx((m * n).sum())
