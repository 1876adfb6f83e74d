"""N-gram Jaccard join: universe-partition pigeonhole, verified exactly.

1. One scan reduces every text to its number of shingles and a digest of its set;
   documents with equal sets are a class, and one of them stands for it.
2. A document that has a link shares at least three quarters of its shingles. Shingle
   hashes of one half of the universe are gathered as arrays per slice of the hash
   range; a document too few of whose shingles occur in another one has no link. What is
   left is counted once more, by all its shingles among itself. The bound holds for every
   pair, so nothing is lost.
3. The hash universe is cut into segments, as many as its size band needs: two linked
   sets differ in so few shingles that a segment agrees exactly, or up to one shingle
   where one-deletion neighbourhoods are indexed too. An allocation by cost picks, per
   band, how many segments of either kind to have, and, per set, which to leave out. A
   pair meets where one side looks and one side's segment is whole.
4. Sets that meet in a segment are verified on their sorted shingle hashes. A segment's
   sets are compared with one centre first. Where a segment still spans several
   components, sketches of its sets are compared: the closest pair of any two components
   is verified, and where it fails and others may be similar, every such pair that still
   lies across. A signature of many sets is dealt to chunks, and every pair of chunks is a
   group of its own.

Shingles are named by 64-bit hashes; sets of a pair are compared through these alone, and
equal sets are classes by a 128-bit digest of these names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brightquay.llm.common import Scratch, drop_table, free_name, load, numbered, text_of, write_table
from brightquay.llm.components import components
from brightquay.llm.exchange import fresh_worker, mixed, row_pieces, slices_of

#: Words of a shingle; the similarity as a fraction.
WORDS, SIM = 5, (75, 100)
#: Hashes that one slice of the hash range holds, ratio of size bands.
SLICE_HASHES, BAND_RATIO = 1_000_000, 4 / 3
#: Rows that a task works on at once; sets that a chunk of a hot signature holds on average; sets of one piece from which a signature does not travel to its slice.
PIECE, CHUNK, TOGETHER = 2500, 4096, 16

_C = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3], np.uint64)


def shingle_set(text: str, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of a text's word shingles; shorter texts are one shingle, empty ones none."""
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, text.encode("utf-8", "surrogatepass").lower().split()), np.uint64)
    if not len(w):
        return w
    k = min(len(w), words)
    factors = [np.uint64(pow(0x9E3779B97F4A7C15, i + 1, 1 << 64)) for i in range(k)]
    x = np.full(len(w) - k + 1, k, np.uint64) * _C[5]
    for i, f in enumerate(factors):
        x += mixed(w[i : len(w) - k + 1 + i] + np.uint64(i)) * f
    return np.unique(mixed(x))


def _ids(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)


def set_table(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """``doc_id, n, half, digest``: set size, size of its lower half, digest of the set."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh_worker()
        for batch in row_pieces(batches, PIECE):
            n, half, digest = [], [], []
            for t in batch.column(1):
                s = shingle_set(t.as_py(), words)
                n.append(len(s))
                half.append(int(np.searchsorted(s, np.uint64(1 << 63))))
                digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(half, pa.int64()), pa.array(digest, pa.binary())], ["doc_id", "n", "half", "digest"])

    return docs.mapInArrow(of, "doc_id long, n long, half long, digest binary")


def lower_half(text: str, words: int = WORDS) -> np.ndarray:
    """The shingle hashes of a text that lie in the lower half of the universe."""
    s = shingle_set(text, words)
    return s[: np.searchsorted(s, np.uint64(1 << 63))]


def shared_counts(rows: DataFrame, slices: int, hashes: Callable[[object], np.ndarray]) -> DataFrame:
    """``doc_id, c``: at least as many ``hashes`` of a row's second column as other rows have too.

    Within a batch a hash travels once, however many documents have it. A slice sends its
    counts as arrays to slices of the documents, where they are added up.
    """

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh_worker()
        for batch in row_pieces(batches, PIECE):
            ids = _ids(batch)
            sets = [hashes(x.as_py()) for x in batch.column(1)]
            if not sets:
                continue
            h, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
            order = np.argsort(h)
            h, owner = h[order], owner[order]
            new = np.append(True, h[1:] != h[:-1])[: len(h)]
            run = np.cumsum(new) - 1
            many = np.bincount(run, minlength=1)[run] > 1 if len(h) else np.zeros(0, bool)
            at = ((h >> np.uint64(32)) % np.uint64(slices)).astype(np.int64)
            low = (h & np.uint64(0xFFFFFFFF)).astype("<u4")
            rows = []
            every = np.unique(at)
            for which in (~many, many & new, many):  # own hashes, hashes of several documents, whose they are
                o = np.flatnonzero(which)
                o = o[np.lexsort((owner[o], at[o]))]
                rows.append((o, np.searchsorted(at[o], every), np.searchsorted(at[o], every, side="right")))
            out: list[tuple] = []
            for i, k in enumerate(every.tolist()):
                own, several, theirs = (o[a[i] : b[i]] for o, a, b in rows)
                if len(own) + len(several):
                    d, n = np.unique(owner[own], return_counts=True)
                    e, m = np.unique(owner[theirs], return_counts=True)
                    out.append((k, low[own].tobytes(), ids[d].tobytes(), n.astype("<u4").tobytes(), low[several].tobytes(), ids[e].tobytes(), m.astype("<u4").tobytes()))
            cols = list(zip(*out, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if i == 0 else pa.binary()) for i, c in enumerate(cols)], ["k", "h", "d", "n", "g", "e", "m"])

    def meet(f: pd.DataFrame) -> pd.DataFrame:
        own = np.concatenate([np.frombuffer(x, "<u4") for x in f["h"]])
        docs_of = np.concatenate([np.repeat(np.frombuffer(d, "<i8"), np.frombuffer(n, "<u4")) for d, n in zip(f["d"], f["n"], strict=True)])
        several = np.concatenate([np.frombuffer(x, "<u4") for x in f["g"]])
        every = np.sort(np.concatenate([own, several]))
        twice = np.unique(every[1:][every[1:] == every[:-1]])
        hit = docs_of[np.isin(own, np.concatenate([twice, several]))]
        doc, c = np.unique(hit, return_counts=True)
        doc = np.concatenate([doc, *(np.frombuffer(x, "<i8") for x in f["e"])])
        c = np.concatenate([c, *(np.frombuffer(x, "<u4") for x in f["m"])])
        return pd.DataFrame([(k, doc[o].tobytes(), c[o].astype("<u4").tobytes()) for k, o in slices_of(mixed(doc.view(np.uint64)), slices)], columns=["k", "d", "c"])

    def add(f: pd.DataFrame) -> pd.DataFrame:
        doc, at = np.unique(np.concatenate([np.frombuffer(x, "<i8") for x in f["d"]]), return_inverse=True)
        return pd.DataFrame({"doc_id": doc, "c": np.bincount(at, np.concatenate([np.frombuffer(x, "<u4") for x in f["c"]])).astype(np.int64)})

    blobs = rows.mapInArrow(parts, "k long, h binary, d binary, n binary, g binary, e binary, m binary")
    return blobs.groupBy("k").applyInPandas(meet, "k long, d binary, c binary").groupBy("k").applyInPandas(add, "doc_id long, c long")


class Band:
    """Sizes ``low`` to ``high``: segments of either kind, chosen by cost for ``sets`` sets."""

    def __init__(self, number: int, low: int, high: int, sets: int, sim: tuple[int, int] = SIM):
        self.number, self.low, self.high, self.sim = number, low, high, sim
        need = most_apart(high, sim) + 1
        best = None
        for share in (0, 0.25, 0.5, 0.75, 1):
            near = round(share * need / 2)
            exact = max(0, need - 2 * near)
            spare = 0
            for _ in range(8):  # spare segments for the empty ones
                m = near + exact + spare
                empty = m * math.exp(-low / m)
                spare = math.ceil(empty + 3 * math.sqrt(empty)) if m > 1 else 0
                spare = min(spare, need)
            m = near + exact + spare
            density = low / m
            cost = exact + spare + near * (1 + density) + sets * 0.01 * m * math.exp(-2 * density)
            if best is None or cost < best[0]:
                best = (cost, near, exact + spare)
        _, self.near, self.exact = best
        self.segments = self.near + self.exact


def most_apart(size: int, sim: tuple[int, int] = SIM) -> int:
    """Largest symmetric difference of linked sets the larger of which has ``size``."""
    a, b = sim
    return (b - a) * 2 * size // (a + b)


def make_bands(largest: int, sets: int, sim: tuple[int, int] = SIM) -> list[Band]:
    """Bands from size 1 to ``largest``."""
    out, low = [], 1
    while low <= largest:
        high = max(low, math.ceil(low * BAND_RATIO) - 1)
        out.append(Band(len(out), low, high, sets, sim))
        low = high + 1
    return out


#: Bits of a signature's role: the set looks for others by it; it names a whole segment, not one less a shingle.
LOOKS, WHOLE = 1, 2


def signatures(s: np.ndarray, band: Band, probes: bool) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of a set in a band, and the role of each."""
    m = band.segments
    seg = (mixed(s + np.uint64(band.number)) >> np.uint64(33)).astype(np.int64) % m
    order = np.argsort(seg, kind="stable")
    seg, value = seg[order], mixed(s ^ np.uint64(0xA5A5A5A5A5A5A5A5))[order]
    cut = np.searchsorted(seg, np.arange(m + 1))
    upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value)])
    total, size = upto[cut[1:]] - upto[cut[:-1]], np.diff(cut)
    where = np.arange(m, dtype=np.uint64) + np.uint64(band.number << 32)
    name = lambda t, n, w: mixed(t * _C[2] + mixed(w * _C[3] + n.astype(np.uint64)))
    full = name(total, size, where)
    looks = np.full(m, probes)
    if probes:
        # leave out segments, the emptiest first, as far as what this size needs allows
        worth = np.where(np.arange(m) < band.near, 2, 1)
        left = int(worth.sum()) - (most_apart(len(s), band.sim) + 1)
        for i in np.argsort(size, kind="stable").tolist():
            if worth[i] <= left:
                looks[i] = False
                left -= int(worth[i])
            elif left <= 0:
                break
    near = seg < band.near
    less = name(total[seg[near]] - value[near], size[seg[near]] - 1, where[seg[near]])
    return np.concatenate([full, less]), np.concatenate([looks + np.uint8(WHOLE), looks[seg[near]].astype(np.uint8)])


def segment_table(sets: DataFrame, bands: list[Band], slices: int, sim: tuple[int, int] = SIM) -> DataFrame:
    """``sig, doc_id, n, role`` of ``doc_id, n, s`` sets, for signatures that several sets have, one looks for and one has as a whole segment.

    A set looks for partners in its own band and can be found there and in the next
    band, where it may be the smaller one of a pair. Signatures travel as arrays, to
    slices of their range; most are a single set's and end there. Of a signature that many
    sets of a batch have, a mark goes to its slice; its sets go on batch by batch, also
    where no one looks for them.
    """
    edges = np.array([b.low for b in bands])

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh_worker()
        for batch in row_pieces(batches, PIECE):
            found: list[tuple[np.ndarray, np.ndarray]] = []
            sizes = []
            for s in batch.column(2):
                s = np.frombuffer(s.as_py(), "<u8")
                k = int(np.searchsorted(edges, len(s), side="right")) - 1
                own = [signatures(s, bands[k], True)]
                own += [signatures(s, b, False) for b in bands[k + 1 :] if b.low * sim[0] <= len(s) * sim[1]]
                found.append((np.concatenate([x[0] for x in own]), np.concatenate([x[1] for x in own])))
                sizes.append(len(s))
            if not found:
                continue
            sig, role = (np.concatenate(x) for x in zip(*found, strict=True))
            owner = np.repeat(np.arange(len(found)), [len(x) for x, _ in found])
            name, inverse, count = np.unique(sig, return_inverse=True, return_counts=True)
            often = count >= TOGETHER
            many = np.flatnonzero(often[inverse])
            # marks are of size 0 and have all roles of the batch's sets
            ids, sizes = np.append(_ids(batch), 0), np.array([*sizes, 0], "<i8")
            few = np.flatnonzero(~often[inverse])
            s, l, w = np.append(sig[few], name[often]), np.append(role[few], _roles(inverse, role)[often]), np.append(owner[few], np.full(often.sum(), len(found)))  # noqa: E741
            parted = [(k, s, l, w, o) for k, o in slices_of(s, slices)]
            parted.append((slices + int(mixed(ids[:1].view(np.uint64))[0] % np.uint64(slices)), sig, role, owner, many))
            rows = []
            for k, s, l, w, o in parted:  # noqa: E741
                if len(o):
                    d, n = np.unique(w[o], return_counts=True)
                    rows.append((k, s[o].astype("<u8").tobytes(), l[o].tobytes(), ids[d].tobytes(), sizes[d].tobytes(), n.astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if i == 0 else pa.binary()) for i, c in enumerate(zip(*rows, strict=True))], ["k", "sig", "role", "d", "size", "n"])

    def meet(f: pd.DataFrame) -> pd.DataFrame:
        sig = np.concatenate([np.frombuffer(x, "<u8") for x in f["sig"]])
        role = np.concatenate([np.frombuffer(x, np.uint8) for x in f["role"]])
        doc, size = (np.concatenate([np.repeat(np.frombuffer(x, "<i8"), np.frombuffer(n, "<u4")) for x, n in zip(f[c], f["n"], strict=True)]) for c in ("d", "size"))
        keep = np.ones(len(sig), bool)
        if f["k"].iloc[0] < slices:
            _, inverse = np.unique(sig, return_inverse=True)
            keep = ((np.bincount(inverse, np.where(size > 0, 1, 2)) > 1) & (_roles(inverse, role) == LOOKS | WHOLE))[inverse] & (size > 0)
        return pd.DataFrame({"sig": sig[keep].view(np.int64), "doc_id": doc[keep], "n": size[keep], "role": role[keep]})

    blobs = sets.mapInArrow(parts, "k long, sig binary, role binary, d binary, size binary, n binary")
    return blobs.groupBy("k").applyInPandas(meet, "sig long, doc_id long, n long, role int")


def _roles(group: np.ndarray, role: np.ndarray) -> np.ndarray:
    """All roles of each group's members."""
    return sum((np.bincount(group, role & bit) > 0).astype(np.uint8) * np.uint8(bit) for bit in (LOOKS, WHOLE))


def verified(pairs: DataFrame, sets: DataFrame, sim: tuple[int, int] = SIM) -> DataFrame:
    """Those of the distinct ``a, b`` pairs whose sets are similar enough."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh_worker()
        for batch in row_pieces(batches, PIECE):
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_py(), "<u8"), np.frombuffer(y.as_py(), "<u8")
                at = np.minimum(np.searchsorted(x, y), len(x) - 1)
                both = int((x[at] == y).sum())
                keep.append(sim[1] * both >= sim[0] * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    with_b = pairs.join(sets.select(F.col("doc_id").alias("b"), F.col("s").alias("y")), "b")
    return with_b.join(sets.select(F.col("doc_id").alias("a"), F.col("s").alias("x")), "a").select("a", "b", "x", "y").mapInArrow(of, "a long, b long")


def _fits(m: str, n: str, sim: tuple[int, int]) -> str:
    return f"{m} * {sim[1]} >= {n} * {sim[0]} AND {n} * {sim[1]} >= {m} * {sim[0]}"


def link_components(sets: DataFrame, words: int = WORDS, sim: tuple[int, int] = SIM, centres: bool = True) -> DataFrame:
    """``node, component`` over links of distinct sets, ``doc_id, n, s``.

    After the turn of the centres only the sets of segments that still span several
    components go on. ``centres`` leaves that turn out, which costs time and loses nothing.
    """
    most = sets.agg(F.count("*"), F.max("n"), F.sum("n")).first()
    if not most[0]:
        return sets.sparkSession.createDataFrame([], "node long, component long")
    slices = max(1, math.ceil(most[2] / SLICE_HASHES))
    bands = make_bands(most[1], most[0], sim)
    members = write_table(segment_table(sets, bands, slices, sim), "segment-sets")
    labels, made = None, []

    def turn(pairs: DataFrame) -> DataFrame | None:
        """Verify new pairs and join the components that they link; the links, or none where there were no pairs."""
        nonlocal labels
        for before in made:
            pairs = pairs.join(before.select("a", "b"), ["a", "b"], "left_anti")
        made.append(write_table(pairs, "pairs"))
        if made[-1].isEmpty():
            return None
        made.append(write_table(verified(made[-1].select("a", "b").distinct(), sets, sim), "links"))
        labels = _joined(labels, made[-1])
        return made[-1]

    if centres:
        centre = members.filter(f"role & {LOOKS} > 0").groupBy("sig").agg(F.min(F.struct("doc_id", "n")).alias("c"))
        turn(members.join(centre, "sig").filter(f"doc_id <> c.doc_id AND {_fits('n', 'c.n', sim)}").select(F.least("doc_id", "c.doc_id").alias("a"), F.greatest("doc_id", "c.doc_id").alias("b")).distinct())
        open_ = _labelled_sets(members, labels).groupBy("sig").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.bit_or("role").alias("any")).filter(f"any = {LOOKS | WHOLE} AND lo <> hi").select("sig")
        left = write_table(members.join(open_, "sig", "left_semi"), "segment-sets")
        drop_table(members)
        members = left
    if not members.isEmpty():
        links = turn(pairs_between(open_sets(members, sets, labels), bands, slices, sim, True))
        # components with further candidates, whose closest pair is no link
        failed = links is not None and made[-2].filter("more").join(links, ["a", "b"], "left_anti")
        if failed and not failed.isEmpty():
            ends = failed.select(F.explode(F.array("c", "d")).alias("doc_id")).distinct()
            again = _labelled_sets(ends, labels).select("component").distinct()
            rest = _labelled_sets(members, labels).join(again, "component", "left_semi").select(*members.columns)
            turn(pairs_between(open_sets(rest, sets, labels), bands, slices, sim))
    drop_table(members, *made)
    return sets.sparkSession.createDataFrame([], "node long, component long") if labels is None else labels


def _labelled_sets(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    """``members`` and ``component``: a set without links is its own."""
    if labels is None:
        return members.withColumn("component", F.col("doc_id"))
    return members.join(labels, F.col("doc_id") == F.col("node"), "left").withColumn("component", F.coalesce("component", "doc_id")).drop("node")


def _joined(labels: DataFrame | None, found: DataFrame) -> DataFrame:
    """Labels after new links: a label is a link too, so what is labelled stays together."""
    edges = found if labels is None else found.unionByName(labels.select(F.col("node").alias("a"), F.col("component").alias("b")))
    out = components(edges)
    if labels is not None:
        drop_table(labels)
    return out


def _parity(s: np.ndarray, bits: int) -> np.ndarray:
    """Parities of a set's hashes by place: sketches of two sets differ in no more places than the sets in members."""
    odd = np.bincount((mixed(s ^ np.uint64(0x5851F42D4C957F2D)) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.uint64)


def open_sets(members: DataFrame, sets: DataFrame, labels: DataFrame | None) -> DataFrame:
    """``doc_id, n, s, component, sigs`` of the sets in ``members``; ``sigs`` has each signature, its role, and its chunks."""
    hot = members.groupBy("sig").agg(F.count("*").alias("k")).filter(F.col("k") > CHUNK).select("sig", F.ceil(F.col("k") / CHUNK).cast("int").alias("chunks"))
    own = members.join(hot, "sig", "left").groupBy("doc_id").agg(F.collect_list(F.struct("sig", "role", F.coalesce("chunks", F.lit(1)).alias("chunks"))).alias("sigs"))
    return _labelled_sets(sets.join(own, "doc_id"), labels).select("doc_id", "n", "s", "component", "sigs")


def meetings(sets: DataFrame, bands: list[Band], slices: int) -> DataFrame:
    """Sets of :func:`open_sets` as arrays, by the group ``k, i, j`` in which they meet.

    A slice of the signatures' range is a group, ``i = j = -1``. A signature of several
    chunks is a group per pair of chunks ``i <= j`` and goes to no slice, so no group holds
    more than two chunks of it.
    """
    edges = np.array([b.low for b in bands])
    lengths = [max(64, 1 << (2 * b.high - 1).bit_length()) for b in bands]

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh_worker()
        for batch in row_pieces(batches, PIECE):
            ids = _ids(batch)
            if not len(ids):
                continue
            sets = [np.frombuffer(s.as_py(), "<u8") for s in batch.column(2)]
            entries = np.stack([ids, np.array([len(s) for s in sets]), batch.column(3).to_numpy(zero_copy_only=False).astype(np.int64)], axis=1).astype("<i8")
            sketches = [_parity(s, lengths[int(np.searchsorted(edges, len(s), side="right")) - 1]) for s in sets]
            lists = batch.column(4)
            flat = lists.flatten()
            sig, role, chunks = (flat.field(c).to_numpy(zero_copy_only=False) for c in range(3))
            sig, role, chunks = sig.astype(np.int64).view(np.uint64), role.astype(np.uint8), chunks.astype(np.int64)
            owner = np.repeat(np.arange(len(ids)), lists.value_lengths().to_numpy(zero_copy_only=False))
            rows: list[tuple] = []

            def put(k: int, i: int, j: int, second: bool, o: np.ndarray, owner=owner, sig=sig, role=role, rows=rows, entries=entries, sketches=sketches) -> None:
                e, n = np.unique(owner[o], return_counts=True)
                own = [sketches[x] for x in e]
                rows.append((k, i, j, second, sig[o].astype("<u8").tobytes(), role[o].tobytes(), entries[e].tobytes(), n.astype("<u4").tobytes(), np.array([len(x) for x in own], "<u4").tobytes(), np.concatenate(own).tobytes()))

            cold = np.flatnonzero(chunks == 1)
            for k, o in slices_of(sig[cold], slices):
                put(k, -1, -1, False, cold[o])
            hot = np.flatnonzero(chunks > 1)
            chunk = (mixed(ids[owner[hot]].view(np.uint64)) % chunks[hot].astype(np.uint64)).astype(np.int64)
            by = np.lexsort((owner[hot], chunk, sig[hot]))
            hot, chunk = hot[by], chunk[by]
            new = np.append(True, (sig[hot][1:] != sig[hot][:-1]) | (chunk[1:] != chunk[:-1]))[: len(hot)]
            for o, c in zip(np.split(hot, np.flatnonzero(new)[1:]), chunk[new].tolist(), strict=False):
                for x in range(int(chunks[o[0]])):
                    put(int(sig[o[0]].view(np.int64)), min(c, x), max(c, x), c > x, o)
            names = ["k", "i", "j", "second", "sig", "role", "e", "n", "size", "sketch"]
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.bool_()] + [pa.binary()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return sets.mapInArrow(parts, "k long, i int, j int, second boolean, sig binary, role binary, e binary, n binary, size binary, sketch binary")


def _folded(sketch: np.ndarray, size: int) -> np.ndarray:
    """Sketches, a row each, at a smaller power of two: a place's parity is that of the places that fall together."""
    while sketch.shape[1] > size:
        half = sketch.shape[1] // 2
        sketch = sketch[:, :half] ^ sketch[:, half:]
    return sketch


def _close(x: tuple[np.ndarray, ...], y: tuple[np.ndarray, ...], sim: tuple[int, int]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places, and distance of the sketches, of pairs of ``doc, n, component, whole, sketch`` arrays that may be similar; one side looks.

    Both sides go by size, so that a tile meets only sizes that can be similar to its own.
    """
    a, b = sim
    (by, of), share = (np.argsort(z[1], kind="stable") for z in (x, y)), (b - a) / (a + b)
    (n, c, w, m), (p, d, v, q) = (tuple(col[o] for col in z[1:]) for z, o in ((x, by), (y, of)))
    most_n, most_p = n * share + 1e-6, p * share
    words = m.shape[1]
    for r in range(0, len(n), 64):
        rows = slice(r, min(r + 64, len(n)))
        low, high = np.searchsorted(p, n[r] * a / b, "left"), np.searchsorted(p, n[rows.stop - 1] * b / a, "right")
        for t in range(int(low), int(high), 1024):
            cols = slice(t, min(t + 1024, int(high)))
            ok = (c[rows, None] != d[cols]) & (w[rows, None] | v[cols])
            bound = most_n[rows, None] + most_p[cols]
            apart, k, few = np.zeros(ok.shape, np.uint32), 0, ok.size // 8
            while k < words and np.count_nonzero(ok) > few:
                apart += np.bitwise_count(m[rows, None, k] ^ q[None, cols, k])
                ok &= apart <= bound
                k += 1
            i, j = np.nonzero(ok)
            sofar, most = apart[i, j].astype(np.int64), bound[i, j]
            for at in range(k, words, 8):
                sofar = sofar + np.bitwise_count(m[rows][i, at : at + 8] ^ q[cols][j, at : at + 8]).sum(axis=1)
                still = sofar <= most
                i, j, sofar, most = i[still], j[still], sofar[still], most[still]
            yield by[i + r], of[j + t], sofar


def _neighbours(sig: np.ndarray, owner: np.ndarray, role: np.ndarray, entries: np.ndarray, sketches: list[np.ndarray], sim: tuple[int, int]) -> Iterator[np.ndarray]:
    """Rows ``a, b, c, d, far`` of pairs that may be similar, of signatures in order: each set that looks meets every other once, in however many of them."""
    a, b = sim
    doc, n, component = entries.T
    cut = np.append(np.flatnonzero(np.append(True, sig[1:] != sig[:-1])), len(sig))
    low, high, any_ = (g.reduceat(x, cut[:-1]) for g, x in ((np.minimum, component[owner]), (np.maximum, component[owner]), (np.bitwise_or, role)))
    group = np.repeat(np.arange(len(cut) - 1), np.diff(cut))
    whole = (role & WHOLE) > 0
    size = np.array([len(x) for x in sketches])
    level = {int(z): np.flatnonzero(size >= z) for z in np.unique(size)}
    # every sketch at its own size and the smaller ones
    folded = {z: np.concatenate([_folded(np.stack([sketches[i] for i in own[size[own] == y]]), z) for y in np.unique(size[own])]) for z, own in level.items()}
    place = {}
    for z, own in level.items():
        place[z] = np.full(len(size), -1)
        place[z][np.concatenate([own[size[own] == y] for y in np.unique(size[own])])] = np.arange(len(own))
    asks = np.flatnonzero(((role & LOOKS) > 0) & ((low != high) & (any_ == LOOKS | WHOLE))[group])
    asks = asks[np.argsort(owner[asks], kind="stable")]
    mark = np.zeros(len(size), bool)
    for own in np.split(asks, np.flatnonzero(np.diff(owner[asks])) + 1) if len(asks) else ():
        x = int(owner[own[0]])
        for i in own.tolist():
            members = slice(cut[group[i]], cut[group[i] + 1])
            mark[owner[members] if whole[i] else owner[members][whole[members]]] = True
        met = np.flatnonzero(mark)
        mark[met] = False
        met = met[(component[met] != component[x]) & (n[met] * b >= n[x] * a) & (n[x] * b >= n[met] * a)]
        at = np.minimum(size[met], size[x])
        for z in np.unique(at).tolist():
            y = met[at == z]
            most, far = (b - a) * (n[y] + n[x]) // (a + b), np.zeros(len(y), np.int64)
            one, every, rows = folded[z][place[z][x]], folded[z], place[z][y]
            for k in range(0, z, 4):
                far = far + np.bitwise_count(every[rows, k : k + 4] ^ one[k : k + 4]).sum(axis=1)
                still = far <= most
                if not still.all():
                    y, rows, far, most = y[still], rows[still], far[still], most[still]
            if len(y):
                yield _pair_rows(np.full(len(y), doc[x]), doc[y], np.full(len(y), component[x]), component[y], far)


def _pair_rows(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray, far: np.ndarray) -> np.ndarray:
    return np.stack([np.minimum(a, b), np.maximum(a, b), np.minimum(c, d), np.maximum(c, d), far], axis=1)


def pairs_between(sets: DataFrame, bands: list[Band], slices: int, sim: tuple[int, int] = SIM, closest: bool = False) -> DataFrame:
    """Distinct ``a, b`` that meet in a segment one of them looks for, lie in two components and may be similar, of :func:`open_sets`.

    Sizes and parity sketches are compared where the sets meet, so only pairs that pass
    both bounds are rows; both are exact. ``closest`` asks for one pair of any two
    components ``c, d`` that meet in a group, the closest by sketch, and whether there
    are ``more``.
    """

    def reduced(rows: np.ndarray) -> np.ndarray:
        """Distinct pairs; the first of each two components by distance and their number, where that is asked for."""
        rows = rows[np.lexsort((rows[:, 1], rows[:, 0], rows[:, 4], rows[:, 3], rows[:, 2]))]
        if not len(rows):
            return rows
        rows = rows[np.append(True, (rows[1:, :2] != rows[:-1, :2]).any(axis=1))]
        if not closest:
            return rows
        first = np.flatnonzero(np.append(True, (rows[1:, 2:4] != rows[:-1, 2:4]).any(axis=1)))
        out = rows[first]
        out[:, 5] = np.add.reduceat(rows[:, 5], first)
        return out

    def meet(f: pd.DataFrame) -> pd.DataFrame:
        join = lambda c, kind: np.concatenate([np.frombuffer(x, kind) for x in f[c]])
        sig, role, entries, size = join("sig", "<u8"), join("role", np.uint8), join("e", "<i8").reshape(-1, 3), join("size", "<u4").astype(np.int64)
        owner = np.repeat(np.arange(len(entries)), join("n", "<u4"))
        sketch, at = join("sketch", "<u8"), np.cumsum(size) - size
        found = [np.zeros((0, 6), np.int64)]
        if f["i"].iloc[0] < 0:
            order = np.argsort(sig, kind="stable")
            near = _neighbours(sig[order], owner[order], role[order], entries, [sketch[i : i + z] for i, z in zip(at.tolist(), size.tolist(), strict=True)], sim)
        else:
            near = chunks_meet(owner, role, np.repeat(f["second"].to_numpy(bool), [len(x) // 8 for x in f["sig"]]), entries, sketch, at, size, f["i"].iloc[0] != f["j"].iloc[0])
        held = 0
        for rows in near:
            found.append(np.concatenate([rows, np.ones((len(rows), 1), np.int64)], axis=1))
            held += len(rows)
            if held > 1_000_000:
                found = [reduced(np.concatenate(found))]
                held = 0
        out = reduced(np.concatenate(found))
        return pd.DataFrame({"a": out[:, 0], "b": out[:, 1], "c": out[:, 2], "d": out[:, 3], "more": out[:, 5] > 1})

    def chunks_meet(owner: np.ndarray, role: np.ndarray, second: np.ndarray, entries: np.ndarray, sketch: np.ndarray, at: np.ndarray, size: np.ndarray, across: bool) -> Iterator[np.ndarray]:
        """Rows of one signature's two chunks, or of one: who looks is compared with all, who doesn't with those who look."""
        least, looks, every = int(size[owner].min()), (role & LOOKS) > 0, np.arange(len(owner))

        def side(which: np.ndarray) -> tuple[np.ndarray, ...]:
            o = owner[which]
            m = np.empty((len(o), least), np.uint64)
            for z in np.unique(size[o]):
                own = np.flatnonzero(size[o] == z)
                m[own] = _folded(sketch[at[o[own]][:, None] + np.arange(z)], least)
            return *entries[o].T, (role[which] & WHOLE) > 0, m

        meets = [(every[looks & ~second], every[second]), (every[~looks & ~second], every[looks & second])] if across else [(every[looks], every)]
        for x, y in ((side(p), side(q)) for p, q in meets if len(p) and len(q)):
            for i, j, far in _close(x, y, sim):
                yield _pair_rows(x[0][i], y[0][j], x[2][i], y[2][j], far)

    out = meetings(sets, bands, slices).groupBy("k", "i", "j").applyInPandas(meet, "a long, b long, c long, d long, more boolean")
    return out.groupBy("a", "b").agg(F.first("c").alias("c"), F.first("d").alias("d"), F.max("more").alias("more")) if closest else out.select("a", "b").distinct()


def near_duplicates(docs: DataFrame, words: int = WORDS, sim: tuple[int, int] = SIM) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row.

    Null and empty texts have no shingles and are linked with nothing; texts with fewer
    words than a shingle are one shingle. Rows of one id count as one document; rows with
    a null id are linked with nothing and have a null component. Empty table, empty
    result; further columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    known = rows.filter("doc_id IS NOT NULL")
    table = write_table(set_table(rows, words), "sets")
    classes = table.filter("n > 0 AND doc_id IS NOT NULL").groupBy("n", "digest").agg(F.min("doc_id").alias("rep"), F.max("half").alias("half"))
    classes = write_table(classes, "classes")
    total = table.agg(F.sum("half")).first()[0] or 0
    counts = shared_counts(known, max(1, math.ceil(total / SLICE_HASHES)), lambda t: lower_half(t, words))
    a, b = sim
    maybe = classes.join(counts, F.col("rep") == F.col("doc_id"), "left").filter(f"coalesce(c, 0) >= half - ((n * ({b} - {a})) div {b})").select(F.col("rep").alias("_id"))
    maybe = write_table(maybe.distinct(), "maybe-linked")

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh_worker()
        for batch in row_pieces(batches, PIECE):
            sets = [shingle_set(t.as_py(), words) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["doc_id", "n", "s"])

    sets = write_table(known.join(maybe, F.col("doc_id") == F.col("_id"), "left_semi").mapInArrow(sets_of, "doc_id long, n long, s binary"), "candidate-sets")
    whole = shared_counts(sets.select("doc_id", "s"), max(1, math.ceil((sets.agg(F.sum("n")).first()[0] or 0) / SLICE_HASHES)), lambda s: np.frombuffer(s, "<u8"))
    enough = whole.filter("c > 0").withColumnRenamed("doc_id", "_id")
    linked = write_table(sets.join(enough, F.col("doc_id") == F.col("_id")).filter(f"c * {b} >= n * {a}").select("doc_id", "n", "s"), "linked-sets")
    labels = link_components(linked, words, sim)
    drop_table(sets, maybe, linked)
    named = classes.join(labels, F.col("rep") == F.col("node"), "left").select(F.col("n").alias("_n"), F.col("digest").alias("_digest"), F.coalesce("component", "rep").alias("component"))
    out = table.join(named, (F.col("n") == F.col("_n")) & (F.col("digest") == F.col("_digest")), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))


def keep_one_of_each(docs: DataFrame, words: int = WORDS, sim: tuple[int, int] = SIM) -> DataFrame:
    """One row of each component stays: the one with the smallest id, null last, all its columns unchanged.

    Every row is a document here, whatever its id.
    """
    row = free_name(docs, "_row")
    rows = numbered(docs, row)
    with Scratch() as scratch:
        own = rows.select(F.col(row).alias("_row"), "doc_id", "text")
        found = near_duplicates(own.select(F.col("_row").alias("doc_id"), "text"), words, sim).select(F.col("doc_id").alias("_row"), "component_id")
        rank = F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "_row").alias("rank")
        placed = write_table(found.join(own.select("_row", "doc_id"), "_row").select("_row", "component_id", rank), "near-rows")
        first = placed.groupBy("component_id").agg(F.min("rank").alias("first"), F.count("*").alias("k")).filter("k > 1").select("component_id", F.col("first._row").alias("_first"))
        gone = scratch.keep(write_table(placed.join(first, "component_id").filter("_row <> _first").select(F.col("_row").alias(row)), "near-copies"))
    return rows.join(gone, row, "left_anti").select(*docs.columns)


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's query over all documents."""
    return near_duplicates(load(spark, sf_dir, "documents"))
