"""Katz backoff language model: tables of discounted n-grams, evaluated recursively.

A model of order n holds, for every order, the n-grams of its training texts with their
counts, and for every context what its weight is made of. Its tables are partitioned by
slices of a hash range of contexts.

1. Texts become batches of tokens. Batches send their distinct words, named by 128 bits,
   with their training counts to slices, which number them. The batches are written again
   with the numbers in place of the names.
2. Order by order, batches send their distinct n-grams with their training counts to the
   slices. A slice adds up all batches and the tables of a model that was there before,
   writes its part of the model, and answers every batch in the order in which it asked:
   counts of n-grams, and per context the mass that discounting frees, by counts, and the
   lower order's tokens of the words seen, by counts too, unless the batch has all of
   these words itself. They are one context's in the lower order too, so that the batch,
   which has that context's tokens, makes a mass of them.
3. A batch evaluates its tokens from the lowest order up: the discounted n-gram if it was
   seen, and else the context's weight times the probability of the order below. Weights
   make every context sum to one exactly.

An n-gram is one entry per batch, so none is hot. A context with very many tokens is dealt
to several slices by its next word; its sums are added up in a table of their own and are
joined to the batches that ask for them.

Discounts are Good-Turing's as Katz has them. N-grams of up to three words are named by
the numbers of all their words; the contexts of higher orders by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brightquay.llm.common import drop_table, fold_of, load, shuffles_dropped, text_of, write_table
from brightquay.llm.exchange import bucketed, drop_bucketed, fresh_worker, mixed, packed, slices_of, unpacked

#: Order of the model, and that of the query; counts up to GT are discounted.
ORDER, QUERY_ORDER, GT = 3, 3, 5
#: Tokens of a batch and n-grams of a slice, on average; tokens from which a context is dealt to several slices.
BATCH_TOKENS, SLICE_KEYS, HOT = 1_500_000, 1_500_000, 200_000
#: The end and the begin of a text; words have no blanks. The number of a word that isn't known.
_END, _BEGIN, UNKNOWN = b" ", b"\t", 0xFFFFFFFF
_TOKENS = "batch long, n long, keys binary, ids binary, known binary, train binary, lens binary, pre binary, words binary, counts binary, toks binary"
#: Batches whose words have numbers.
_NUMBERED = _TOKENS.replace("words binary", "gids binary")
#: N-grams of a slice in order, and its contexts: counts of their n-grams with each small count, the lower order's tokens and small counts of them, whether they are hot.
_TABLE_KINDS = {"context": "<u8", "word": "<u4", "counts": "<u8", "names": "<u8", "small": "<u4", "low": "<u8", "hot": "u1"}
_TABLE = ", ".join(f"{c} binary" for c in _TABLE_KINDS)
_ASK_KINDS = {"context": "<u8", "word": "<u4", "counts": "<u8", "lower": "<u8", "hot": "u1"}
_ASK = f"slice long, batch long, {_TABLE}, lower binary"
_REPLY = f"kind int, k int, slice long, batch long, a binary, b binary, c binary, name long, sums array<double>, {_TABLE}"
#: Kinds of replies: to a batch, a slice's part of the model, its statistics, sums of a hot context, a batch that asks for one.
_TO_BATCH, _OF_MODEL, _STATISTICS, _SUMS, _ASKS = range(5)


def _columns(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def token_table(docs: DataFrame, order: int, folds: int, held_out_fold: int | None) -> DataFrame:
    """Batches of whole texts; a text longer than a batch goes on in the next one, behind its last ``order - 1`` tokens."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 32
        names = _columns(_TOKENS)
        kinds = [pa.int64()] * 2 + [pa.binary()] * 9
        made = serial = size = 0
        segs: list[tuple] = []
        local: dict[bytes, int] = {_END: 0, _BEGIN: 1}
        toks: list[list[int]] = []

        def flush() -> pa.RecordBatch:
            nonlocal made, size, segs, local, toks
            flat = np.concatenate([np.array(t, np.int64) for t in toks])
            # frequent words get small numbers, which pack well
            freq = np.bincount(flat, minlength=len(local))
            by = np.argsort(-freq, kind="stable")
            place = np.empty(len(by), np.int64)
            place[by] = np.arange(len(by))
            flat, words = place[flat], list(local)
            key, ids, known, train, lens, pre = (list(c) for c in zip(*segs, strict=True))
            layout = Layout(np.array(lens), np.array(pre), np.array(train, bool))
            counts = np.bincount(flat[layout.scored & layout.in_train], minlength=len(by))
            counts[place[1]] = np.count_nonzero(layout.train & (flat[layout.starts] == place[1]))  # training texts
            row = [base + made, int(layout.scored.sum()), np.array(key, "<i8").tobytes(), np.array(ids, "<i8").tobytes(), np.array(known, np.uint8).tobytes(), np.array(train, np.uint8).tobytes(), np.array(lens, "<i4").tobytes(), np.array(pre, np.uint8).tobytes()]
            row += [b"".join(xxhash.xxh3_128_digest(words[i]) for i in by.tolist()), packed(counts.astype("<u4")), packed(flat.astype("<u4"))]
            made, size, segs, local, toks = made + 1, 0, [], {_END: 0, _BEGIN: 1}, []
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names)

        for batch in batches:
            for doc_id, train, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                raw = text.as_py().encode("utf-8", "surrogatepass").lower().split()
                raw.append(_END)
                serial += 1
                before = [_BEGIN]
                for at in range(0, len(raw), BATCH_TOKENS):
                    part = raw[at : at + BATCH_TOKENS]
                    segs.append((base + serial, doc_id or 0, doc_id is not None, train, len(part), len(before)))
                    number = local.setdefault
                    toks.append([number(w, len(local)) for w in (*before, *part)])
                    size += len(part)
                    before = (before + part)[1 - order :] if order > 1 else []
                    if size >= BATCH_TOKENS:
                        yield flush()
        if segs:
            yield flush()

    train = F.lit(True) if held_out_fold is None else fold_of(F.col("doc_id"), folds) != held_out_fold
    return docs.select(F.col("doc_id").cast("long"), train.alias("train"), text_of().alias("text")).mapInArrow(of, _TOKENS)


class Layout:
    """How the positions of a batch belong to segments: the tokens of each, behind those that precede it."""

    def __init__(self, lens: np.ndarray, pre: np.ndarray, train: np.ndarray):
        whole = lens + pre
        self.lens, self.train = lens, train
        self.starts = np.cumsum(whole) - whole
        self.owner = np.repeat(np.arange(len(whole), dtype=np.int32), whole)
        self.offset = np.arange(len(self.owner), dtype=np.int32) - np.repeat(self.starts.astype(np.int32), whole)
        self.scored = self.offset >= np.repeat(pre.astype(np.int32), whole)
        self.in_train = np.repeat(train, whole)


class Counts(NamedTuple):
    """N, V and numbers of keys with count 1 to GT + 1."""

    total: int
    types: int
    of_counts: tuple[int, ...]

    def discounts(self) -> np.ndarray:
        """Katz's discounts for counts 0 to GT, then 1 for all above.

        Where counts of counts are too few for a ratio between 0 and 1, absolute discounting
        by one half stands in.
        """
        n = (0, *self.of_counts)
        out = np.ones(GT + 2)
        out[0] = 0
        common = (GT + 1) * n[GT + 1] / n[1] if n[1] else 1.0
        for r in range(1, GT + 1):
            d = ((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common) if n[r] and common < 1 else -1.0
            out[r] = d if 0 < d < 1 else (r - 0.5) / r
        return out


@dataclass
class KatzModel:
    """A fitted model: tables of words, n-grams and contexts by order and slice, and counts of fixed size."""

    order: int
    tables: DataFrame
    counts: list[Counts]
    slices: int


def _words_of(row) -> tuple[np.ndarray, np.ndarray]:
    """High and low halves of the names of a batch's words."""
    both = np.frombuffer(row.words, ">u8").astype(np.uint64).reshape(-1, 2)
    return both[:, 0].copy(), both[:, 1].copy()


def count_words(tokens: DataFrame, slices: int, model: DataFrame | None, keep: bool) -> DataFrame:
    """Replies of order one: numbers and counts of all batches' words, statistics, and with ``keep`` the table of words.

    A slice numbers its words by falling count, in steps of ``slices``, so numbers are
    distinct and frequent words' are small. The begin of texts has a number too and is no
    word of the statistics.
    """
    begin = np.frombuffer(xxhash.xxh3_128_digest(_BEGIN), ">u8").astype(np.uint64)

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for row in f.itertuples():
                high, low = _words_of(row)
                counts = unpacked(row.counts, "<u4").astype("<u8")
                yield pd.DataFrame([(k, row.batch, high[o].tobytes(), low[o].tobytes(), packed(counts[o])) for k, o in slices_of(high, slices)], columns=["slice", "batch", "high", "low", "counts"])

    def of(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("batch")
        high, low = (np.concatenate([np.frombuffer(x, "<u8") for x in f[c]]) for c in ("high", "low"))
        counts = np.concatenate([unpacked(x, "<u8") for x in f["counts"]]).astype(np.int64)
        by = np.lexsort((low, high))
        new = np.append(True, (high[by][1:] != high[by][:-1]) | (low[by][1:] != low[by][:-1]))
        of_word = np.empty(len(by), np.int64)
        of_word[by] = np.cumsum(new) - 1
        one, c = by[new], np.bincount(of_word, counts).astype(np.int64)
        falling = np.argsort(-c, kind="stable")
        s = int(f["slice"].iloc[0])
        number = np.empty(len(one), np.int64)
        number[falling] = np.arange(len(one)) * slices + s
        if number.max() >= UNKNOWN:
            raise ValueError("more than 2**32 distinct words")
        number[c == 0] = UNKNOWN
        rows, end = [], 0
        for batch, size in zip(f["batch"], [len(x) // 8 for x in f["high"]], strict=True):
            begin_, end = end, end + size
            if batch >= 0:
                own = of_word[begin_:end]
                rows.append({"kind": _TO_BATCH, "batch": batch, "a": packed(number[own].astype("<u4")), "b": packed(c[own].astype("<u8"))})
        word = c * ~((high[one] == begin[0]) & (low[one] == begin[1]))
        rows.append({"kind": _STATISTICS, "sums": [float(word.sum()), float((word > 0).sum()), *np.bincount(np.minimum(word, GT + 2), minlength=GT + 3)[1 : GT + 2].astype(float).tolist()]})
        if keep:
            kept = one[c > 0]
            rows.append({"kind": _OF_MODEL, "context": high[kept].tobytes(), "names": low[kept].tobytes(), "counts": packed(c[c > 0].astype("<u8"))})
        blank = dict.fromkeys(_columns(_REPLY)) | {"k": 1, "slice": s, "batch": -1, "name": 0}
        return pd.DataFrame([blank | row for row in rows])

    asked = tokens.mapInPandas(ask, "slice long, batch long, high binary, low binary, counts binary")
    if model is not None:
        asked = asked.unionByName(model.select("slice", "batch", F.col("context").alias("high"), F.col("names").alias("low"), "counts"))
    return write_table(asked.groupBy("slice").applyInPandas(of, _REPLY), "katz-1", "kind")


def number_words(tokens: DataFrame, replies: DataFrame, slices: int) -> DataFrame:
    """Batches with their words' numbers and counts in place of the names."""
    columns = _columns(_NUMBERED)

    def told(own: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for row in own.itertuples():
            high, _ = _words_of(row)
            gids, counts = np.zeros(len(high), np.uint32), np.zeros(len(high), np.uint64)
            a, b = (dict(zip(replies["slice"], replies[c], strict=True)) for c in "ab")
            for s, o in slices_of(high, slices):
                gids[o], counts[o] = unpacked(a[s], "<u4"), unpacked(b[s], "<u8")
            new = {"gids": packed(gids.astype("<u4")), "counts": packed(counts.astype("<u8"))}
            rows.append([new[c] if c in new else getattr(row, c) for c in columns])
        return pd.DataFrame(rows, columns=columns)

    return tokens.groupBy("batch").cogroup(replies.groupBy("batch")).applyInPandas(told, _NUMBERED)


def _distinct(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first place of each distinct key, by rising keys, and the number of every place's key; ``key`` is used up.

    Keys are sorted with their places behind them where both fit into 63 bits, which
    takes a fraction of the time and memory of an indirect sort.
    """
    bits = len(key).bit_length()
    if int(key.max(initial=0)) < 1 << (63 - bits):
        key <<= bits
        key |= np.arange(len(key))
        key.sort()
        place = key & ((1 << bits) - 1)
        key >>= bits
    else:
        place = np.argsort(key, kind="stable")
        key = key[place]
    new = np.append(True, key[1:] != key[:-1])[: len(key)]
    number = np.empty(len(key), np.int32)
    number[place] = np.cumsum(new, dtype=np.int32) - np.int32(1)
    return place[new], number


class Batch:
    """A batch of numbered tokens, and what the slices have said of it so far.

    What depends on the n-gram is held once for each, and what depends on its context once
    for each context; positions have numbers of n-grams and, where the batch is ``scored``, probabilities.
    """

    def __init__(self, row, model: Fit, replies: pd.DataFrame, scored: bool):
        self.number = int(row.batch)
        self.keys, self.ids, lens = (np.frombuffer(x, k) for x, k in ((row.keys, "<i8"), (row.ids, "<i8"), (row.lens, "<i4")))
        self.known, train = np.frombuffer(row.known, np.uint8).astype(bool), np.frombuffer(row.train, np.uint8).astype(bool)
        self.at = Layout(lens.astype(np.int64), np.frombuffer(row.pre, np.uint8).astype(np.int64), train)
        self.toks = unpacked(row.toks, "<u4").astype(np.int32)
        self.gids, self.counts = unpacked(row.gids, "<u4"), unpacked(row.counts, "<u8").astype(np.int64)
        self.model = model
        # of the order reached: the number of the n-gram that ends at each position, and by number its count, name and its context's tokens
        self.local, self.count, self.name = self.toks, self.counts, self.gids.astype(np.uint64)
        self.total = np.full(len(self.gids), max(model.counts[0].total, 1), np.int64)
        self.p = np.where(self.count > 0, self._discounted(0) / self.total, model.unknown)[self.toks] if scored else None
        for k in range(2, len(model.counts) + 1):
            self._climb(k, replies[replies["k"] == k])

    def _discounted(self, k: int) -> np.ndarray:
        """Counts of the n-grams of the order reached after discounts number ``k``."""
        return self.model.discounts[k][np.minimum(self.count, GT + 1)] * self.count

    def distinct(self, k: int) -> tuple[np.ndarray, ...]:
        """N-grams of order ``k`` in known contexts, by contexts: positions that have one, a position of each, the number at each position, and their contexts' numbers."""
        open_ = 1 + np.flatnonzero((self.at.offset[1:] >= k - 1) & (self.count > 0)[self.local[:-1]])
        key = self.local[open_ - 1].astype(np.int64)
        key *= len(self.gids)
        key += self.toks[open_]
        first, inverse = _distinct(key)
        first = open_[first]
        return open_, first, inverse, self.local[first - 1]

    def ask(self, k: int) -> Iterator[dict]:
        """Rows for the slices."""
        open_, first, inverse, context = self.distinct(k)
        counted = (self.at.scored & self.at.in_train)[open_]
        counts = np.bincount(inverse[counted], minlength=len(first))
        del open_, inverse, counted
        blank = dict.fromkeys(_columns(_ASK)) | {"batch": self.number}
        for s, o in slices_of(self._slice_names(first, context), self.model.slices):
            above = context[o]
            cols = {"context": self.name[above], "word": self.gids[self.toks[first[o]]], "counts": counts[o], "lower": self.count[self.local[first[o]]], "hot": self.count[above] > HOT}
            yield blank | {"slice": s} | {c: packed(v.astype(_ASK_KINDS[c])) for c, v in cols.items()}

    def _slice_names(self, first: np.ndarray, context: np.ndarray) -> np.ndarray:
        """Where n-grams go: by their contexts, and those of a hot one to as many places as it has tokens for."""
        names = self.name[context]
        hot = np.flatnonzero((self.count > HOT)[context])
        if len(hot):
            places = 1 + self.count[context[hot]] // HOT
            salt = mixed(self.gids[self.toks[first[hot]]].astype(np.uint64) + np.uint64(1)) % places.astype(np.uint64)
            names[hot] ^= mixed(salt + np.uint64(7))
        return mixed(names)

    def _told(self, replies: pd.DataFrame, first: np.ndarray, context: np.ndarray, run: np.ndarray, n_runs: int, each: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, ...]:
        """Counts of n-grams; of contexts the freed tokens, the lower order's discounted tokens, and whether these were sent."""
        a, b, c = (dict(zip(replies["slice"], replies[x], strict=True)) for x in "abc")
        count, free = np.zeros(len(first), np.int64), np.zeros(n_runs)
        mass, given = np.zeros(n_runs), np.zeros(n_runs, bool)
        for s, o in slices_of(self._slice_names(first, context), self.model.slices):
            count[o] = unpacked(a[s], "<u8")
            of_run, _ = _runs(self.name[context[o]])
            told, of = unpacked(b[s], "<u4").reshape(GT + 1, -1), run[o]
            free[of] = (told[:GT].T * each).sum(axis=1)[of_run]
            if self.p is not None:
                low, has = np.zeros(told.shape[1]), told[GT] > 0
                low[has] = below @ unpacked(c[s], "<u8").reshape(GT + 1, -1)
                mass[of], given[of] = low[of_run], has[of_run]
        return count, free, mass, given

    def _climb(self, k: int, replies: pd.DataFrame) -> None:
        """Go on to order ``k`` with the slices' replies."""
        open_, first, inverse, context = self.distinct(k)
        run, starts = _runs(self.name[context])
        run = run.astype(np.int32)
        d = self.model.discounts[k - 1]
        each = np.arange(1, GT + 1) * (1 - d[1 : GT + 1])
        below = np.append(1, -np.arange(1, GT + 1) * (1 - self.model.discounts[k - 2][1 : GT + 1]))
        count, free, mass, given = self._told(replies[replies["kind"] == _TO_BATCH], first, context, run, len(starts), each, below)
        if self.p is not None:
            # of a context whose seen words are all here, their tokens of the lower order are added up here
            seen = count > 0
            mass = np.where(given, mass, np.bincount(run[seen], self._discounted(k - 2)[self.local[first[seen]]], len(starts)))
            del seen
        hot = np.flatnonzero(self.count[context[starts]] > HOT)
        if len(hot):
            summed = replies[replies["kind"] == _SUMS]
            names = summed["name"].to_numpy(np.int64).view(np.uint64)
            by = np.argsort(names)
            at = by[np.searchsorted(names[by], self.name[context[starts[hot]]])]
            sums = np.stack(summed["sums"].to_numpy())[at]
            free[hot], mass[hot] = (sums[:, :GT] * each).sum(axis=1), sums[:, GT:] @ below
        total = self.count[context[starts]]
        free /= np.maximum(total, 1)
        spent = free <= 1e-9  # nothing was freed: the context counts one more, for what it hasn't seen
        total = total + spent
        if self.p is not None:
            # the order below stays where there is no context
            mass /= np.maximum(self.total[self.local[first[starts]]], 1)
            weight = np.where(spent, 1 / np.maximum(total, 1), free) / np.maximum(1 - mass, 1e-300)
            p = d[np.minimum(count, GT + 1)]
            p *= count
            p /= total[run]
            np.copyto(p, weight[run] * self.p[first], where=count == 0)
            self.p[open_] = p[inverse]
            if k == len(self.model.counts):
                return  # nothing is asked any more
        name, word = self.name[context], self.gids[self.toks[first]]
        name = name * np.uint64(1 << 32) + word if k < 3 else mixed(name * np.uint64(0xC2B2AE3D27D4EB4F) + mixed(word.astype(np.uint64)))
        # number 0 is no n-gram
        self.count, self.name, self.total = np.append(0, count), np.append(np.uint64(0), name), np.append(1, total[run])
        self.local = np.zeros(len(self.toks), np.int32)
        self.local[open_] = inverse + np.int32(1)

    def by_doc(self, values: np.ndarray) -> np.ndarray:
        """Sums of the scored tokens' values by segment."""
        return np.bincount(self.at.owner[self.at.scored], values[self.at.scored], len(self.keys))


class Fit(NamedTuple):
    """What tasks know of a model: counts and discounts of the orders so far, slices, the unknown word's probability."""

    counts: list[Counts]
    discounts: list[np.ndarray]
    slices: int
    unknown: float


def _runs(names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the run of equal neighbours that each name is in, and where runs begin."""
    new = np.append(True, names[1:] != names[:-1])[: len(names)]
    return np.cumsum(new) - 1, np.flatnonzero(new)


def _slice(k: int, keep: bool):
    """A slice's work on order ``k``; with ``keep`` it writes its part of the model."""

    def of(f: pd.DataFrame) -> pd.DataFrame:
        fresh_worker()
        f = f.sort_values("batch")
        known, f = f[f["batch"] < 0], f[f["batch"] >= 0]
        own = {c: [unpacked(x, kind) for x in known[c]] for c, kind in _TABLE_KINDS.items()}

        def column(c: str) -> list[np.ndarray]:
            return [unpacked(x, _ASK_KINDS[c]) for x in f[c]]

        # a model's n-grams come behind those that are asked for; its contexts bring their sums along
        contexts = column("context")
        sizes = [len(x) for x in contexts]
        context = np.concatenate([*contexts, *own["context"]])
        del contexts
        word = np.concatenate([*column("word"), *own["word"]])
        hot = np.concatenate([*column("hot"), np.zeros(len(context) - sum(sizes), np.uint8)])
        by = np.lexsort((word, context))
        new_context = np.append(True, context[by][1:] != context[by][:-1])
        new = new_context | np.append(True, word[by][1:] != word[by][:-1])
        of_gram = np.empty(len(by), np.int64)
        of_gram[by] = np.cumsum(new) - 1
        one = by[new]  # one place of each n-gram
        del by
        c = np.bincount(of_gram, np.concatenate([*column("counts"), *own["counts"]]), len(one)).astype(np.int64)
        first = np.flatnonzero(new_context[new])
        of_context = np.cumsum(new_context[new]) - 1
        names, is_hot = context[one[first]], np.maximum.reduceat(hot[one], first) > 0
        seen = c > 0
        types = np.bincount(of_context[seen], minlength=len(first))
        # what a context's weight is made of: how many of its n-grams have each small count, and the lower order's tokens of all and numbers of small counts
        small, low = np.zeros((GT, len(first)), np.uint32), np.zeros((GT + 1, len(first)), np.uint64)
        if len(known):
            at = np.searchsorted(names, own["names"][0])
            small[:, at], low[:, at] = own["small"][0].reshape(GT, -1), own["low"][0].reshape(GT + 1, -1)
            is_hot[at] |= own["hot"][0] > 0
        else:
            for r in range(1, GT + 1):
                small[r - 1] = np.bincount(of_context[c == r], minlength=len(first))
            n, of_seen = np.concatenate(column("lower"))[one[seen]], of_context[seen]
            low[0] = np.bincount(of_seen, n, len(first))
            for r in range(1, GT + 1):
                low[r] = np.bincount(of_seen[n == r], minlength=len(first))
            del n, of_seen
        s, rows, end = int(known["slice"].iloc[0] if len(known) else f["slice"].iloc[0]), [], 0
        for batch, size in zip(f["batch"], sizes, strict=True):
            begin, end = end, end + size
            grams, theirs = of_gram[begin:end], context[begin:end]
            of_run, starts = _runs(theirs)
            runs = of_context[grams[starts]]
            given = np.bincount(of_run, seen[grams], len(runs)) < types[runs]
            rows.append({"kind": _TO_BATCH, "batch": batch, "a": packed(c[grams].astype("<u8")), "b": packed(np.vstack([small[:, runs], given]).astype("<u4").ravel()), "c": packed(low[:, runs[given]].astype("<u8").ravel())})
            rows += [{"kind": _ASKS, "batch": batch, "name": name} for name in np.unique(theirs[hot[begin:end] > 0]).view(np.int64).tolist()]
        for i in np.flatnonzero(is_hot).tolist():
            rows.append({"kind": _SUMS, "name": int(names[i].view(np.int64)), "sums": [*small[:, i].astype(float).tolist(), *low[:, i].astype(float).tolist()]})
        rows.append({"kind": _STATISTICS, "sums": [float(c.sum()), float(seen.sum()), *np.bincount(np.minimum(c, GT + 2), minlength=GT + 3)[1 : GT + 2].astype(float).tolist()]})
        if keep:
            kept, some = one[seen], np.unique(of_context[seen])
            table = (context[kept], word[kept], c[seen], names[some], small[:, some].ravel(), low[:, some].ravel(), is_hot[some])
            rows.append({"kind": _OF_MODEL} | {name: packed(np.ascontiguousarray(x.astype(kind))) for (name, kind), x in zip(_TABLE_KINDS.items(), table, strict=True)})
        blank = dict.fromkeys(_columns(_REPLY)) | {"k": k, "slice": s, "batch": -1, "name": 0}
        return pd.DataFrame([blank | row for row in rows])

    return of


def _asked(tokens: DataFrame, replies: DataFrame, fit: Fit, k: int) -> DataFrame:
    """What all batches ask of order ``k``."""

    def told(own: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        fresh_worker()
        return pd.DataFrame([x for row in own.itertuples() for x in Batch(row, fit, replies, scored=False).ask(k)], columns=_columns(_ASK))

    return tokens.groupBy("batch").cogroup(replies.groupBy("batch")).applyInPandas(told, _ASK)


def _statistics(replies: DataFrame) -> Counts:
    """Sums of the slices' own statistics."""
    s = replies.filter(f"kind = {_STATISTICS}").agg(*[F.sum(F.get("sums", F.lit(i))) for i in range(GT + 3)]).first()
    return Counts(int(s[0] or 0), int(s[1] or 0), tuple(int(x or 0) for x in s[2:]))


def _climbed(tokens: DataFrame, order: int, slices: int, model: KatzModel | None, keep: bool = False) -> tuple[DataFrame, DataFrame, list[Counts], DataFrame]:
    """The numbered batches, the replies to them, counts by order, and with ``keep`` the model's tables.

    ``tokens`` is a table of :func:`bucketed`; it goes once the words have numbers.
    """
    own = ["kind", "k", "slice", "batch", "a", "b", "c", "name", "sums"]
    none = lambda kind: F.lit(None).cast(kind)
    counts, replies, tables = [], None, None
    for k in range(1, order + 1):
        before = None if model is None else model.tables.filter(F.col("k") == k)
        if k == 1:
            out = count_words(tokens, slices, before, keep)
        else:
            fit = fit_of(counts, slices)
            asked = _asked(tokens, replies, fit, k)
            if before is not None:
                asked = asked.unionByName(before.select(*_columns(_ASK)[:2], *_TABLE_KINDS, none("binary").alias("lower")))
            out = write_table(asked.groupBy("slice").applyInPandas(_slice(k, keep), _REPLY), f"katz-{k}", "kind")
        counts.append(_statistics(out) if model is None else model.counts[k - 1])
        now = out.filter(f"kind = {_TO_BATCH}").select(*own)
        if k == 1:
            named, tokens = tokens, bucketed(number_words(tokens, now, slices), "batch", "katz")
            drop_bucketed(named)
            now = tokens.sparkSession.createDataFrame([], now.schema)
            if not keep:
                drop_table(out)
        else:
            summed = out.filter(f"kind = {_SUMS}").groupBy("name").agg(F.array(*[F.sum(F.get("sums", F.lit(i))) for i in range(2 * GT + 1)]).alias("sums"))
            hot = out.filter(f"kind = {_ASKS}").select("batch", "name").distinct().join(summed, "name")
            now = now.unionByName(hot.select(F.lit(_SUMS).alias("kind"), F.lit(k).alias("k"), F.lit(-1).cast("long").alias("slice"), "batch", *[none("binary").alias(c) for c in "abc"], "name", "sums"))
        replies = now if replies is None else replies.unionByName(now)
        if keep:
            table = out.filter(f"kind = {_OF_MODEL}").select("k", "slice", "batch", *_TABLE_KINDS)
            tables = table if tables is None else tables.unionByName(table)
    return tokens, replies, counts, tables


def fit_of(counts: list[Counts], slices: int) -> Fit:
    """What tasks know of a model."""
    uni, d = counts[0], counts[0].discounts()
    total = max(uni.total, 1)
    # the unigram mass that discounting frees is the unknown word's
    freed = sum(n * r * (1 - d[r]) for r, n in enumerate(uni.of_counts[:GT], 1)) / total
    return Fit(counts, [c.discounts() for c in counts], slices, freed if freed > 0 else 1.0 if not uni.total else 1 / (total + 1))


_SCORED = "key long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def _scores(tokens: DataFrame, replies: DataFrame, fit: Fit) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` per text."""
    uni = fit.counts[0]
    base = uni.total + uni.types + 1

    def score(row, replies: pd.DataFrame) -> pd.DataFrame:
        b = Batch(row, fit, replies, scored=True)
        out = {"key": b.keys, "doc_id": pd.array(b.ids, dtype="Int64"), "held_out": ~b.at.train, "n_tokens": b.at.lens, "n_known": b.by_doc((b.counts > 0)[b.toks]).astype(np.int64), "base_score": b.by_doc(np.log10((b.counts + 1) / base)[b.toks]), "score": b.by_doc(np.log10(np.where(b.at.scored, b.p, 1)))}
        return pd.DataFrame(out).assign(doc_id=lambda f: f["doc_id"].where(b.known))

    def told(own: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        fresh_worker()
        rows = [score(row, replies) for row in own.itertuples()]
        return pd.concat(rows) if rows else pd.DataFrame(columns=_columns(_SCORED))

    parts = tokens.groupBy("batch").cogroup(replies.groupBy("batch")).applyInPandas(told, _SCORED)
    out = parts.groupBy("key").agg(F.first("doc_id").alias("doc_id"), F.first("held_out").alias("held_out"), *(F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(uni.total).cast("long").alias("train_tokens"), "base_score", "score")


def _slices_for(tokens: DataFrame) -> int:
    return max(1, -(-(tokens.agg(F.sum("n")).first()[0] or 0) // SLICE_KEYS))


def fit_katz(docs: DataFrame, order: int = ORDER) -> KatzModel:
    """A model of all ``docs``; its tables live in the shared folder until the session ends."""
    tokens = bucketed(token_table(docs, order, 1, None), "batch", "katz")
    slices = _slices_for(tokens)
    with shuffles_dropped(docs.sparkSession):
        _, _, counts, tables = _climbed(tokens, order, slices, None, keep=True)
    return KatzModel(order, tables, counts, slices)


def score_katz(model: KatzModel, docs: DataFrame) -> DataFrame:
    """``doc_id, n_tokens, n_known, train_tokens, base_score, score`` of any texts under a fitted model."""
    tokens = bucketed(token_table(docs, model.order, 1, 0), "batch", "katz")
    with shuffles_dropped(docs.sparkSession):
        tokens, replies, counts, _ = _climbed(tokens, model.order, model.slices, model)
    return _scores(tokens, replies, fit_of(counts, model.slices)).drop("held_out")


def katz_scores(docs: DataFrame, folds: int = 7, held_out_fold: int = 2, order: int = ORDER) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` per row.

    Learns from rows outside the held-out fold of the id's crc32 and scores all rows; the
    batches that fill the model's tables are answered from them at once. Null and empty
    texts have one token, the end. Unknown words share the unigram mass that discounting
    frees as one word. A null id counts as empty text for its fold. Repeated rows count and
    are scored as often as they are there. Without training rows every word is unknown and
    has probability one. Empty table, empty result; further columns are ignored.
    """
    tokens = bucketed(token_table(docs, order, folds, held_out_fold), "batch", "katz")
    slices = _slices_for(tokens)
    with shuffles_dropped(docs.sparkSession):
        tokens, replies, counts, _ = _climbed(tokens, order, slices, None)
    return _scores(tokens, replies, fit_of(counts, slices))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's query over all documents."""
    return katz_scores(load(spark, sf_dir, "documents"), order=QUERY_ORDER)
