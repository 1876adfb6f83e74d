"""Best-fit-decreasing packing of token sequences.

Documents are tokenised where they are read; only piece lengths travel on. Pieces are
dealt evenly to packing tasks of a bounded number of pieces, so the longest task does
not grow with the input; each task packs its pieces best fit decreasing. A segment
tree over remaining capacities names the tightest open bin in logarithmic time.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brightquay.llm.common import load, text_of, write_table
from brightquay.llm.tokens import CACHE, default_tokenizer, word_ids

#: Tokens of a sequence, the id that ends a document, and pieces of a packing task.
CAPACITY, END_ID, TASK_PIECES = 4096, 1, 65_536

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class OpenBins:
    """Open bins by remaining capacity; a segment tree over the capacities 0 to ``capacity``."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, remaining: int, bin_no: int) -> None:
        """Open ``bin_no`` with so much room."""
        self.bins[remaining].append(bin_no)
        self._change(remaining, 1)

    def _change(self, leaf: int, by: int) -> None:
        at = leaf + self.leaves
        while at:
            self.count[at] += by
            at >>= 1

    def take_tightest(self, size: int) -> tuple[int, int] | None:
        """Take out the bin with the least room of at least ``size``: its room and number."""
        count, at = self.count, size + self.leaves
        if not count[at]:
            while at > 1 and (at & 1 or not count[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.leaves:
                at *= 2
                if not count[at]:
                    at += 1
        room = at - self.leaves
        self._change(room, -1)
        return room, self.bins[room].pop()


def best_fit_decreasing(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each piece, and the number of bins. Lengths are 1 to ``capacity``."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    made, tree = 0, OpenBins(capacity)
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        found = tree.take_tightest(size)
        if found is None:
            room, at = capacity, made
            made += 1
        else:
            room, at = found
        bins[i], offsets[i] = at, capacity - room
        if room > size:
            tree.add(room - size, at)
    return bins, offsets, made


def piece_table(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, cache: int = CACHE) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of every document's tokens and its end id."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_ids(tokenizer_path, cache)
        end, step = np.array([end_id], "<u4").tobytes(), 4 * capacity
        for batch in batches:
            rows: list[tuple] = []
            texts = (x.as_py() for x in batch.column(1))
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoder.encode(texts), strict=True):
                ids += end
                for k, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    rows.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInArrow(cut, PIECES)


def pack(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, task_pieces: int = TASK_PIECES, cache: int = CACHE) -> DataFrame:
    """A row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    Null and empty texts are one piece of the end id alone. Documents longer than
    ``capacity`` are cut into full pieces and a last, shorter one. Repeated rows and
    null ids are packed as rows of their own. Empty table, empty result; further columns
    are ignored. Sequence ids are distinct, not consecutive. ``cache`` bounds the words
    that a worker keeps, which costs time and changes no result.
    """
    pieces = write_table(piece_table(docs, tokenizer_path or default_tokenizer(), capacity, end_id, cache), "pieces")
    tasks = max(1, -(-pieces.count() // task_pieces))

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = list(frames)
        if not own:
            return
        rows = pd.concat(own, ignore_index=True)
        bins, offsets, _ = best_fit_decreasing(rows["length"].to_numpy(), capacity)
        yield rows.assign(sequence_id=bins + (TaskContext.get().partitionId() << 40), offset=offsets)

    return pieces.repartition(tasks).mapInPandas(place, PIECES + ", sequence_id long, offset long")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's query over all documents."""
    return pack(load(spark, sf_dir, "documents"))
