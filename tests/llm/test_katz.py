"""What the language model holds of a batch at once."""

import tracemalloc

import numpy as np
import pytest

from brightquay.llm import katz

DATA = "/root/testdata/sf0.01"


@pytest.mark.parametrize("most", [1000, 1 << 62])
def test_distinct_keys(most):
    """Keys that fit beside their places, and keys that don't, are numbered alike."""
    rng = np.random.default_rng(1)
    key = rng.integers(0, most, 300)[rng.integers(0, 300, 5000)]
    want, first, number = np.unique(key, return_index=True, return_inverse=True)
    got = katz._distinct(key.copy())
    assert (got[0] == first).all() and (got[1] == number).all() and len(want) == len(first)
    assert [len(x) for x in katz._distinct(np.zeros(0, np.int64))] == [0, 0]


def test_a_batch_is_scored_in_little_memory(spark):
    """All orders of a batch take under 170 bytes a position (230 when positions held counts, names and sums)."""
    tokens = katz.bucketed(katz.token_table(spark.read.parquet(f"{DATA}/documents.parquet").coalesce(1), 3, 7, 2), "batch", "katz")
    tokens, replies, counts, _ = katz._climbed(tokens, 3, 2, None)
    row, replies, fit = next(tokens.toPandas().itertuples()), replies.toPandas(), katz.fit_of(counts, 2)
    replies = replies[replies["batch"] == row.batch]
    tracemalloc.start()
    try:
        batch = katz.Batch(row, fit, replies, scored=True)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(batch.toks) > 100_000
    assert most / len(batch.toks) < 170


def test_batches_send_no_totals():
    """An n-gram's row has what its slice can't tell from others: the lower context's tokens are the batch's own."""
    assert "total" not in katz._columns(katz._ASK)
