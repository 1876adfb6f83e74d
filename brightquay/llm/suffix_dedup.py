"""Removal of repeated passages with suffix arrays, shard by shard.

Texts are cut into shards of whole documents, kept as a table bucketed by shard.

1. Anchors. Every string of MIN_BYTES bytes has one 32-byte gram of smallest hash in it,
   the same wherever the string occurs. Shards exchange counts of their anchors; strings
   whose anchor occurs once in the corpus occur once themselves and are done with.
2. Suffix arrays. A shard sorts the suffixes of what is left by doubling of sorted ranks
   (Larsson and Sadakane), down to the depth that counts, and gets common prefixes of
   neighbours in text order (Kasai). All but the first of the starts that agree in
   MIN_BYTES bytes are repeats.
3. Merging across shards. Runs of starts of one anchor that no earlier text of the shard
   repeats are looked up by binary search among the sorted runs of all shards: all but the
   first of equal runs are repeats as a whole. Where an anchor occurs in different runs,
   the single starts are looked up in the same way.
4. Every shard takes out the bytes that its repeats cover.

What shards send has been reduced to distinct strings of the shard first, and its place
is a hash of the whole string, so a passage that a third of all documents hold is one key
per shard. Runs and starts are named by 128 bits in step 3: two hashes of all their bytes.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brightquay.llm.common import load, text_of, write_table
from brightquay.llm.exchange import bucketed, mixed, packed, slices_of, unpacked

#: Bytes of a repeated string, of an anchor, and of a shard (a longer document is a shard of its own).
MIN_BYTES, GRAM, SHARD_BYTES = 100, 32, 1_500_000
#: Keys of a slice, on average.
SLICE_KEYS = 1_500_000
_SHARD = "shard long, n long, ids binary, known binary, lens binary, text binary, run_at binary, run_n binary, run_off binary"
_ASK = "slice long, shard long, names binary, low binary, docs binary, starts binary, counts binary"
_ASK_COLUMNS = [c.split()[0] for c in _ASK.split(", ")]
_REPLY = "what int, shard long, slice long, values binary"


def shard_table(docs: DataFrame) -> DataFrame:
    """Shards of whole documents in the order in which they are read."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, made = TaskContext.get().partitionId() << 32, 0
        ids: list[int | None] = []
        texts: list[bytes] = []

        def flush() -> pa.RecordBatch:
            nonlocal made, ids, texts
            row = [base + made, sum(map(len, texts)), np.array([i or 0 for i in ids], "<i8").tobytes(), np.array([i is not None for i in ids], np.uint8).tobytes()]
            lens = np.array([len(t) for t in texts], "<i8")
            raw = b"".join(texts)
            at, n, anchor = runs_of(np.frombuffer(raw, np.uint8), lens)
            row += [lens.tobytes(), zstandard.ZstdCompressor(level=3).compress(raw), packed(np.diff(at, prepend=0).astype("<u4")), packed(n.astype("<u2")), packed((anchor - at).astype("<u2"))]
            made, ids, texts = made + 1, [], []
            kinds = [pa.int64()] * 2 + [pa.binary()] * 7
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], [c.split()[0] for c in _SHARD.split(", ")])

        size = 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                t = text.as_py().encode("utf-8", "surrogatepass")
                if texts and size + len(t) > SHARD_BYTES:
                    yield flush()
                    size = 0
                ids.append(doc_id)
                texts.append(t)
                size += len(t)
        if texts:
            yield flush()

    return docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInArrow(of, _SHARD)


_BASE, _OTHER = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_POWERS = {b: np.array([pow(b, GRAM - 1 - i, 1 << 64) for i in range(GRAM)], np.uint64) for b in (_BASE, _OTHER)}


def grams(text: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes from each position on, by doubling."""
    h, width = text.astype(np.uint64) + np.uint64(1), 1
    while width < GRAM:
        h = h[:-width] * np.uint64(pow(_BASE, width, 1 << 64)) + h[width:]
        width *= 2
    return mixed(h)


def grams_at(text: np.ndarray, places: np.ndarray) -> np.ndarray:
    """:func:`grams` at some places."""
    return _both_grams(text, places, (_BASE,))[0]


def _both_grams(text: np.ndarray, places: np.ndarray, bases: tuple[int, ...] = (_BASE, _OTHER)) -> list[np.ndarray]:
    out = [np.zeros(len(places), np.uint64) for _ in bases]
    for i in range(GRAM):
        x = text[places + i].astype(np.uint64) + np.uint64(1)
        for o, b in zip(out, bases, strict=True):
            o += x * _POWERS[b][i]
    return [mixed(o) for o in out]


def names_of(text: np.ndarray, starts: np.ndarray, offsets: list, seed: np.ndarray | int = 0) -> tuple[np.ndarray, np.ndarray]:
    """128-bit names of the strings that the grams at ``offsets`` from each start cover."""
    keys = [np.zeros(len(starts), np.uint64) + seed for _ in range(2)]
    for off in offsets:
        for k, g in enumerate(_both_grams(text, starts + off)):
            keys[k] = mixed(keys[k] * np.uint64(0xC2B2AE3D27D4EB4F) + g)
    return keys[0], keys[1]


def groups_of(names: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Equal names get one number."""
    by = np.lexsort(names)
    new = [np.append(True, n[by][1:] != n[by][:-1])[: len(by)] for n in names]
    out = np.empty(len(by), np.int64)
    out[by] = np.cumsum(new[0] | new[1]) - 1
    return out


def runs_of(text: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of starts that have one anchor: first start, number of starts, place of the anchor."""
    none = np.zeros(0, np.int64)
    if len(text) < MIN_BYTES:
        return none, none, none
    span, low = MIN_BYTES - GRAM + 1, np.uint64(0xFFFFFFFF)
    m = (grams(text) & ~low) | np.arange(len(text) - GRAM + 1, dtype=np.uint64)
    width = 1
    while 2 * width <= span:
        m = np.minimum(m[:-width], m[width:])
        width *= 2
    m = np.minimum(m[: len(m) - (span - width)], m[span - width :])
    anchor = (m & low).astype(np.int32)
    del m
    ends = np.cumsum(lens)
    whole = np.ones(len(text), bool)  # starts whose string lies within one document
    for end, n in zip(ends.tolist(), lens.tolist(), strict=True):
        whole[max(end - n, end - MIN_BYTES + 1) : end] = False
    starts = np.flatnonzero(whole[: len(anchor)])
    if not len(starts):
        return none, none, none
    anchor = anchor[starts]
    new = np.append(True, (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1))
    at = np.flatnonzero(new)
    return starts[at], np.diff(np.append(at, len(starts))), anchor[at].astype(np.int64)


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in order of their first ``depth`` bytes (all, where depth is the length).

    Sorted once by 8 bytes; then, as long as there are groups of equal rank, the members
    of these groups are sorted by the ranks of their suffixes so many bytes on.
    """
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    padded = np.zeros(n + 8, np.uint64)
    padded[:n] = text.astype(np.uint64) + np.uint64(1)  # 0 stands for the end
    key = np.zeros(n, np.uint64)
    first = min(7, depth)  # 9 bits a byte
    for k in range(first):
        key = key << np.uint64(9) | padded[k : k + n]
    order = np.argsort(key, kind="stable")
    rank, key = np.empty(n + 1, np.int64), key[order]
    new = np.append(True, key[1:] != key[:-1])
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank[n] = -1
    # positions in the order, of groups that have more than one member
    multi = ~(new & np.append(new[1:], True))
    open_at = np.flatnonzero(multi)
    done = first
    while len(open_at) and done < depth:
        step = min(done, depth - done)
        p = order[open_at]
        ahead = rank[np.minimum(p + step, n)]
        group = rank[p]
        again = np.lexsort((ahead, group))
        p, group, ahead = p[again], group[again], ahead[again]
        order[open_at] = p
        new = np.append(True, (group[1:] != group[:-1]) | (ahead[1:] != ahead[:-1]))
        rank[p] = open_at[np.maximum.accumulate(np.where(new, np.arange(len(p)), 0))]
        open_at = open_at[~(new & np.append(new[1:], True))]
        done += step
    return order


def common_prefixes(text: np.ndarray, order: np.ndarray, most: int, lanes: int = 4096) -> np.ndarray:
    """Common prefix of each suffix with the one before it in ``order``, up to ``most`` bytes.

    In text order a value is at least its predecessor's less one (Kasai); ``lanes``
    stretches of the text are walked side by side. Suffixes that agree in ``most`` bytes
    are expected in the order of their places.
    """
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    out = np.zeros(n, np.int64)
    if n < 2:
        return out
    lanes = max(1, min(lanes, n // 64))
    starts = np.arange(lanes) * n // lanes
    ends = np.append(starts[1:], n)
    have = np.zeros(lanes, np.int64)
    p = starts.copy()
    raw = np.concatenate([text, np.zeros(8, np.uint8)])
    words = np.ascontiguousarray(np.ndarray((n + 1,), "<u8", raw, strides=(1,)))  # eight bytes from each place on
    for _ in range(int((ends - starts).max())):
        q = before[p]
        have = np.where(q < 0, 0, have)
        grow = np.flatnonzero((q >= 0) & (have < most))
        while len(grow):
            h = have[grow]
            differ = words[np.minimum(p[grow] + h, n)] ^ words[np.minimum(q[grow] + h, n)]
            same = differ == 0
            lowest = np.where(same, np.uint64(1), differ & (~differ + np.uint64(1)))
            h += np.where(same, 8, np.log2(lowest.astype(np.float64)).astype(np.int64) >> 3)
            have[grow] = h
            grow = grow[same & (h < most)]
        have = np.minimum(have, np.minimum(most, n - np.maximum(p, q)))
        out[p] = have
        # beyond ``most`` bytes the order says nothing: there the value only carries over to the same neighbour
        beside = before[np.minimum(p + 1, n - 1)] == q + 1
        have = np.where((have < most) | beside, np.maximum(have - 1, 0), 0)
        p = p + 1
        live = p < ends
        if not live.all():
            p, ends, have = p[live], ends[live], have[live]
    return out


class Shard:
    """A shard unpacked: its text, documents and the runs of starts by anchor."""

    def __init__(self, row):
        self.number = int(row.shard)
        self.ids, self.lens = np.frombuffer(row.ids, "<i8"), np.frombuffer(row.lens, "<i8")
        self.known = np.frombuffer(row.known, np.uint8).astype(bool)
        self.text = np.frombuffer(zstandard.ZstdDecompressor().decompress(row.text, max_output_size=max(1, row.n)), np.uint8)
        self.doc_at = np.cumsum(self.lens) - self.lens
        # null ids come first; rows of one id in the order of reading
        self.doc_order = np.where(self.known, self.ids, np.iinfo(np.int64).min)
        self.run_at = np.cumsum(unpacked(row.run_at, "<u4"), dtype=np.int64)
        self.run_n = unpacked(row.run_n, "<u2").astype(np.int64)
        self.run_anchor = self.run_at + unpacked(row.run_off, "<u2")
        # anchors have the smallest hashes around: scrambled once more, they spread over the slices
        self.run_name = mixed(grams_at(self.text, self.run_anchor) ^ np.uint64(0x5851F42D4C957F2D))

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct anchor names and how many runs each has."""
        return np.unique(self.run_name, return_counts=True)

    def candidates(self, replies: dict[int, bytes], slices: int) -> np.ndarray:
        """How often each run's anchor occurs in the corpus."""
        names, _ = self.anchors()
        total = answers(names, slices, replies)
        return total[np.searchsorted(names, self.run_name)] if len(names) else np.zeros(0, np.int64)

    def order_of(self, starts: np.ndarray) -> np.ndarray:
        """Rank of starts in the shard by document id, then place."""
        rank = np.empty(len(self.ids), np.int64)
        rank[np.argsort(self.doc_order, kind="stable")] = np.arange(len(self.ids))
        doc = np.searchsorted(self.doc_at, starts, side="right") - 1
        doc = self._of_text(doc, starts)
        return rank[doc] << 40 | starts

    def _of_text(self, doc: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Skip empty documents that begin at the same place."""
        while len(doc):
            off = starts >= self.doc_at[doc] + self.lens[doc]
            if not off.any():
                break
            doc = doc - off
        return doc

    def places(self, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Document id (nulls first) and place in its text, of starts."""
        doc = self._of_text(np.searchsorted(self.doc_at, starts, side="right") - 1, starts)
        return self.doc_order[doc], starts - self.doc_at[doc]

    def run_keys(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Names of whole runs: all their bytes, and where the anchor lies."""
        at, size = self.run_at[which], self.run_n[which] + MIN_BYTES - 1
        seed = mixed(size.astype(np.uint64) << np.uint64(32) | (self.run_anchor[which] - at).astype(np.uint64))
        return names_of(self.text, at, [np.minimum(k * GRAM, size - GRAM) for k in range(-(-(2 * MIN_BYTES) // GRAM))], seed)

    def start_keys(self, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Names of the strings of MIN_BYTES bytes at ``starts``."""
        return names_of(self.text, starts, [*range(0, MIN_BYTES - GRAM, GRAM), MIN_BYTES - GRAM])


def starts_of(at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """All starts of runs."""
    return np.repeat(at - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def repeats_inside(shard: Shard, starts: np.ndarray) -> np.ndarray:
    """Which of the ascending ``starts`` repeat a string that the shard holds earlier on."""
    if not len(starts):
        return np.zeros(0, bool)
    # the bytes that the starts cover, moved together
    n = len(shard.text)
    inside = np.cumsum(np.bincount(starts, minlength=n + 1) - np.bincount(starts + MIN_BYTES, minlength=n + 1))[:n] > 0
    text, place = shard.text[inside], np.cumsum(inside) - 1
    order = suffix_order(text, MIN_BYTES)
    prefix = common_prefixes(text, order, MIN_BYTES)
    group_of = np.empty(len(text), np.int64)
    group_of[order] = np.cumsum(prefix[order] < MIN_BYTES)
    group, rank = group_of[place[starts]], shard.order_of(starts)
    by = np.lexsort((rank, group))
    first = np.append(True, group[by][1:] != group[by][:-1])
    out = np.empty(len(starts), bool)
    out[by] = ~first
    return out


def asks(shard: int, names: tuple[np.ndarray, np.ndarray], slices: int, docs: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> list[tuple]:
    """Rows that ask each slice for its part of ``names``."""
    cols = (docs.astype("<i8"), starts.astype("<i8"), counts.astype("<u4"))
    return [(k, shard, *(n[o].astype("<u8").tobytes() for n in names), *(packed(c[o]) for c in cols)) for k, o in slices_of(names[0], slices)]


def answers(names: np.ndarray, slices: int, replies: dict[int, bytes]) -> np.ndarray:
    """Answers of all slices in the order of ``names``."""
    out = np.zeros(len(names), np.int64)
    for k, o in slices_of(names, slices):
        out[o] = unpacked(replies[k], "<u8")
    return out


def _slice_of(what: int):
    """A slice's answers: twice the total count of each key, and 1 more for the first of all that ask."""

    def of(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("shard")
        sizes = [len(x) // 8 for x in f["names"]]
        high = np.concatenate([np.frombuffer(x, "<u8") for x in f["names"]])
        low = np.concatenate([np.frombuffer(x, "<u8") for x in f["low"]]) if what > 1 else np.zeros(len(high), np.uint64)
        docs, starts, counts = (np.concatenate([unpacked(x, k) for x in f[c]]) for c, k in (("docs", "<i8"), ("starts", "<i8"), ("counts", "<u4")))
        merged = np.lexsort((low, high))
        new = np.append(True, (high[merged][1:] != high[merged][:-1]) | (low[merged][1:] != low[merged][:-1]))
        table = merged[new]
        at = np.searchsorted(high[table], high)  # each shard's keys, by binary search in the merged order
        while len(off := np.flatnonzero(low[table[at]] != low)):
            at[off] += 1
        total = np.bincount(at, counts, len(table)).astype(np.int64)
        by = np.lexsort((starts, docs, at))
        first = np.zeros(len(high), np.int64)
        first[by[np.append(True, at[by][1:] != at[by][:-1])]] = 1
        value = total[at] * 2 + first
        k = int(f["slice"].iloc[0])
        return pd.DataFrame([(what, int(s), k, packed(p.astype("<u8"))) for s, p in zip(f["shard"], np.split(value, np.cumsum(sizes)[:-1]), strict=True)], columns=["what", "shard", "slice", "values"])

    return of


def _by_kind(replies: pd.DataFrame) -> dict[int, dict[int, bytes]]:
    return {int(w): dict(zip(g["slice"], g["values"], strict=True)) for w, g in replies.groupby("what")}


class Findings:
    """A shard with what the exchanges so far say of it."""

    def __init__(self, row, replies: pd.DataFrame, slices: int):
        got = _by_kind(replies)
        self.shard = Shard(row)
        self.slices = slices
        count = self.shard.candidates({k: _halved(v) for k, v in got.get(1, {}).items()}, slices)
        self.runs = np.flatnonzero(count > 1)
        self.anchor_count = count[self.runs]
        self.starts = starts_of(self.shard.run_at[self.runs], self.shard.run_n[self.runs])
        self.of_run = np.repeat(np.arange(len(self.runs)), self.shard.run_n[self.runs])
        if 0 in got:  # what the suffix array has said
            self.repeat = np.unpackbits(np.frombuffer(zstandard.ZstdDecompressor().decompress(got[0][-1]), np.uint8))[: len(self.starts)].astype(bool)
        else:
            self.repeat = repeats_inside(self.shard, self.starts)
        self.keys = self.shard.run_keys(self.runs) if len(self.runs) else (np.zeros(0, np.uint64),) * 2
        self.group = groups_of(self.keys)
        self.open_runs = self._open_runs()
        if 2 in got or (3 in got):
            self._apply_runs(got.get(2, {}))
        if 3 in got:
            value = answers(self.asked_keys()[0], slices, got[3])
            self.repeat[self.asked] = (value & 1) == 0

    def _open_runs(self) -> np.ndarray:
        """The first run of each name, of runs with a start that nothing in the shard repeats."""
        fresh = np.flatnonzero(np.bincount(self.of_run[~self.repeat], minlength=len(self.runs)))
        if not len(fresh):
            return fresh
        rank = self.shard.order_of(self.shard.run_at[self.runs[fresh]])
        by = np.lexsort((rank, self.group[fresh]))
        k = self.group[fresh][by]
        return fresh[by[np.append(True, k[1:] != k[:-1])]]

    def ask_runs(self) -> list[tuple]:
        """Whole runs, with how often the shard has each."""
        if not len(self.open_runs):
            return []
        docs, starts = self.shard.places(self.shard.run_at[self.runs[self.open_runs]])
        return asks(self.shard.number, tuple(n[self.open_runs] for n in self.keys), self.slices, docs, starts, np.bincount(self.group)[self.group[self.open_runs]])

    def _apply_runs(self, replies: dict[int, bytes]) -> None:
        value = answers(self.keys[0][self.open_runs], self.slices, replies) if len(self.open_runs) else np.zeros(0, np.int64)
        state = np.zeros(len(self.runs), np.int64)  # 1: repeats an earlier shard's run, 2: other runs have its anchor
        state[self.open_runs] = np.where((value & 1) == 0, 1, np.where(value >> 1 < self.anchor_count[self.open_runs], 2, 0))
        of = state[self.of_run]
        self.repeat = self.repeat | (of == 1)
        self.asked = np.flatnonzero((of == 2) & ~self.repeat)

    def asked_keys(self) -> tuple[np.ndarray, np.ndarray]:
        """Names of the single starts that are still open."""
        return self.shard.start_keys(self.starts[self.asked]) if len(self.asked) else (np.zeros(0, np.uint64),) * 2

    def ask_starts(self) -> list[tuple]:
        """Single starts."""
        if not len(self.asked):
            return []
        docs, starts = self.shard.places(self.starts[self.asked])
        return asks(self.shard.number, self.asked_keys(), self.slices, docs, starts, np.ones(len(self.asked), np.int64))


def _halved(b: bytes) -> bytes:
    return packed(unpacked(b, "<u8") >> np.uint64(1))


def dedup_passages(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` per row.

    A byte goes when a string of MIN_BYTES bytes that covers it also starts earlier: in a
    row with a smaller id (null ids are the smallest; rows of one id by order of reading),
    or before it in the same row. Null and empty texts keep nothing and lose nothing. A
    document has to fit in a worker's memory. Empty table, empty result; further columns
    are ignored.
    """
    shards = bucketed(shard_table(docs), "shard", "shards")
    # an anchor for every 35 bytes of text, at most a key for each
    slices = max(1, math.ceil((shards.agg(F.sum("n")).first()[0] or 0) / 35 / SLICE_KEYS))

    def ask_anchors(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for row in f.itertuples():
                names, n = Shard(row).anchors()
                rows = [(k, row.shard, names[o].astype("<u8").tobytes(), packed(n[o].astype("<u4"))) for k, o in slices_of(names, slices)]
                yield pd.DataFrame(rows, columns=["slice", "shard", "names", "counts"])

    def anchors_of(f: pd.DataFrame) -> pd.DataFrame:
        zeros = [packed(np.zeros(len(x) // 8, "<i8")) for x in f["names"]]
        return _slice_of(1)(f.assign(docs=zeros, starts=zeros))

    anchors = write_table(shards.mapInPandas(ask_anchors, "slice long, shard long, names binary, counts binary").groupBy("slice").applyInPandas(anchors_of, _REPLY), "anchors")
    own = shards.groupBy("shard")

    def ask_runs(f: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        rows: list[tuple] = []
        for row in f.itertuples():
            x = Findings(row, replies, slices)
            rows += x.ask_runs()
            rows.append((-1, row.shard, zstandard.ZstdCompressor(level=1).compress(np.packbits(x.repeat).tobytes()), *[b""] * 4))
        return pd.DataFrame(rows, columns=_ASK_COLUMNS)

    asked = write_table(own.cogroup(anchors.groupBy("shard")).applyInPandas(ask_runs, _ASK), "suffix-runs")
    inside = asked.filter("slice = -1").select(F.lit(0).alias("what"), "shard", "slice", F.col("names").alias("values"))
    runs = write_table(asked.filter("slice >= 0").groupBy("slice").applyInPandas(_slice_of(2), _REPLY), "merged-runs")
    so_far = anchors.unionByName(inside).unionByName(runs)

    def ask_starts(f: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        rows: list[tuple] = []
        for row in f.itertuples():
            x = Findings(row, replies, slices)
            if len(x.open_runs):
                rows += x.ask_starts()
        return pd.DataFrame(rows, columns=_ASK_COLUMNS)

    starts = write_table(own.cogroup(so_far.groupBy("shard")).applyInPandas(ask_starts, _ASK).groupBy("slice").applyInPandas(_slice_of(3), _REPLY), "merged-starts")

    def cut(f: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in f.itertuples():
            x = Findings(row, replies, slices)
            s, n = x.shard, len(x.shard.text)
            at = x.starts[x.repeat]
            change = np.bincount(at, minlength=n + 1) - np.bincount(at + MIN_BYTES, minlength=n + 1)
            removed = np.cumsum(change)[:n] > 0
            for doc_id, known, a, size in zip(s.ids, s.known, s.doc_at, s.lens, strict=True):
                r = removed[a : a + size]
                kept = s.text[a : a + size][~r].tobytes()
                spans = int(r[0]) + int(np.count_nonzero(r[1:] & ~r[:-1])) if size else 0
                out.append((int(doc_id) if known else None, int(size), int(r.sum()), spans, hashlib.sha256(kept).hexdigest()))
        return pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]).astype({"doc_id": "Int64"})

    return own.cogroup(so_far.unionByName(starts).groupBy("shard")).applyInPandas(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's query over all documents."""
    return dedup_passages(load(spark, sf_dir, "documents"))
