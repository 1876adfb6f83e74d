"""Scores, features and ranking measures on columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(x: Column) -> Column:
    """Rounding with halves towards plus infinity."""
    return F.floor(x + 0.5)


def clamp(x: Column, low: float = 0, high: float = 100) -> Column:
    """``x`` within bounds."""
    return F.least(F.lit(high), F.greatest(F.lit(low), x))


def candidate_scores(direct: Column, build: Column, compete: Column, negative: Column, local: Column, register: Column, prize: Column) -> Column:
    """(confidence, relevance) from evidence flags.

    62 with a direct term and 20 without, 16 each for building and competing, 30 less for
    a negative title unless both are there; relevance is 65% of it and 20, 8, 7 for place,
    registration and prize.
    """
    n = lambda flag: F.coalesce(flag, F.lit(False)).cast("int")
    both = F.coalesce(build & compete, F.lit(False))
    conf = clamp(F.when(direct, 62).otherwise(20) + n(build) * 16 + n(compete) * 16 - n(negative) * F.when(both, 0).otherwise(30))
    rel = clamp(half_up(conf * 0.65) + n(local) * 20 + n(register) * 8 + n(prize) * 7)
    return F.struct(conf.cast("int").alias("confidence"), rel.cast("int").alias("relevance"))


def freshness(start_ms: Column, now_ms: Column) -> Column:
    """Ladder on the days until the start: none 50, started 96, then 100, 92, 84, 70, 55 up to 2, 7, 14, 30, 60 days, else 40."""
    days = (start_ms - now_ms) / 86400000
    out = F.when(start_ms.isNull(), 50).when(days < 0, 96)
    for most, value in ((2, 100), (7, 92), (14, 84), (30, 70), (60, 55)):
        out = out.when(days <= most, value)
    return out.otherwise(40)


def looked_up(key: Column, table: Mapping[str, int], default: int, bonus: Column | None = None) -> Column:
    """A table's value for a key plus a bonus, within 0 to 100."""
    value = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key), F.lit(default))
    return clamp(value + (bonus if bonus is not None else F.lit(0)))


def final_score(confidence: Column, builder: Column, accessibility: Column, fresh: Column) -> Column:
    """40, 25, 20 and 15 percent, rounded half up."""
    return half_up(0.4 * confidence + 0.25 * builder + 0.2 * accessibility + 0.15 * fresh).cast("int")


def position_weight(position: Column, eta: float = 1.0, most: float = 10.0) -> Column:
    """Inverse examination weight of a list position, capped."""
    return F.least(F.lit(most), F.pow(F.greatest(F.lit(1.0), F.floor(position) + F.lit(1.0)), F.lit(eta)))


def linear_score(features: Column, weights: Sequence[float], bias: float) -> Column:
    """Bias and weighted sum; it orders, so no sigmoid."""
    return F.aggregate(F.zip_with(features, F.array(*[F.lit(float(w)) for w in weights]), lambda x, w: x * w), F.lit(float(bias)), lambda a, x: a + x)


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a over UTF-16 code units."""
    raw = F.hex(F.encode(text, "UTF-16BE"))
    units = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), (F.length(raw) / 4 - 1).cast("int"))), lambda i: F.conv(F.substr(raw, (i * 4 + 1).cast("int"), F.lit(4)), 16, 10).cast("bigint"))
    folded = F.aggregate(units, F.lit(0x811C9DC5).cast("bigint"), lambda h, u: (h.bitwiseXOR(u) * F.lit(0x01000193)).bitwiseAND(F.lit(4294967295)))
    return F.when(F.length(text) == 0, F.lit(0x811C9DC5).cast("bigint")).otherwise(folded)


def wilson(successes: Column, trials: Column, z: float = 1.96) -> Column:
    """(low, high) of a proportion, within 0 and 1; null without trials."""
    p, n = successes / F.nullif(trials, F.lit(0)), F.nullif(trials, F.lit(0))
    centre, denominator = p + z * z / (2 * n), 1 + z * z / n
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return F.struct(F.greatest(F.lit(0.0), (centre - half) / denominator).alias("low"), F.least(F.lit(1.0), (centre + half) / denominator).alias("high"))


def log_loss(label: Column, probability: Column, floor: float = 1e-12) -> Column:
    """Loss of one row, with the probability kept off 0 and 1."""
    p = F.least(F.lit(1 - floor), F.greatest(F.lit(floor), probability))
    return -F.when(label == 1, F.log(p)).otherwise(F.log(1 - p))


def discounted(rank: Column) -> Column:
    """Gain of a relevant item at a rank from 0."""
    return 1 / F.log2(rank + F.lit(2.0))


def ideal_gain(relevant: Column, k: int) -> Column:
    """Gain of ``relevant`` items at the top of a list cut at ``k``."""
    table = [0.0]
    from math import log2

    for i in range(k):
        table.append(table[-1] + 1 / log2(i + 2))
    return F.element_at(F.array(*[F.lit(x) for x in table]), F.least(relevant, F.lit(k)).cast("int") + 1)


def mulberry(seed: int, k: Column) -> Column:
    """The ``k``-th number, from 0, of the 32-bit generator that drafts and shuffles use: a state per number, so any of them is reckoned by itself."""
    mask = F.lit(0xFFFFFFFF)
    times = lambda a, b: (a * b.bitwiseAND(F.lit(0xFFFF)) + F.shiftleft((a * F.shiftright(b, 16)).bitwiseAND(F.lit(0xFFFF)), 16)).bitwiseAND(mask)
    mixed = lambda t, by: t.bitwiseXOR(F.shiftright(t, by))
    let = lambda x, f: F.get(F.transform(F.array(x), f), F.lit(0))
    state = (F.lit(seed & 0xFFFFFFFF).cast("long") + ((k + 1) % F.lit(1 << 32)) * F.lit(0x6D2B79F5)).bitwiseAND(mask)
    one = let(state, lambda t: times(mixed(t, 15), t.bitwiseOR(F.lit(1).cast("long"))))
    two = let(one, lambda t: t.bitwiseXOR((t + times(mixed(t, 7), t.bitwiseOR(F.lit(61).cast("long")))).bitwiseAND(mask)))
    return let(two, lambda t: mixed(t, 14).bitwiseAND(mask)) / F.lit(4294967296.0)


def fixed_places(x: Column, places: int = 4) -> Column:
    """Rounding of the exact binary value to decimal places, exact halves away from zero; null, NaN and infinities are null.

    The product with the power of ten is taken with its rounding error (halves of 26 bits,
    whose products are exact), so that 1.005, which is a little less, stays below its half.
    Products of 2^52 and more have no places left in them and are rounded as Spark does.
    """
    from brightquay.functions.dates import bound

    ten = float(10**places)
    split = lambda v: bound(v * F.lit(134217729.0), lambda c: c - (c - v))
    high_ten = 134217729.0 * ten - (134217729.0 * ten - ten)

    def of(a: Column) -> Column:
        p = a * F.lit(ten)
        low = lambda h: a - h
        error = lambda h: ((h * high_ten - p) + h * (ten - high_ten) + low(h) * high_ten) + low(h) * (ten - high_ten)
        parts = bound(split(a), lambda h: F.struct(p.alias("p"), error(h).alias("e"), F.rint(p).alias("n")))
        rest = lambda t: t["p"] - t["n"]
        whole = lambda t: t["n"] + F.when((rest(t) - 0.5) + t["e"] >= 0, 1).otherwise(0) - F.when((rest(t) + 0.5) + t["e"] < 0, 1).otherwise(0)
        return F.when(p < 4503599627370496.0, bound(parts, lambda t: whole(t) / F.lit(ten))).otherwise(F.round(a, places))

    finite = x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.when(finite, bound(F.abs(x), of) * F.when(x < 0, -1.0).otherwise(1.0))
