"""Spelling variants of a corpus's own words, found by the parity of their letters.

A word's mask has a bit per letter, set where the letter occurs an odd number of times. One
inserted or deleted letter flips one bit, one replaced letter two at most, so that of three
bands of the mask at least one stays as it is. Words with an equal band whose lengths differ
by one at most are candidates, and an edit distance of one is then verified.

Common bands hold many words. An edit also leaves the first or the last half of the shorter
word as it is, so the join asks for an equal half too: that splits a band's words without
losing a pair. Pairs that agree in several of the six ways are taken in the first one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brightquay.llm.common import drop_table, load, lower_ascii, text_of, write_table

#: Runs of letters that count as words, and the shortest and rarest of them.
LETTERS, LEAST_LENGTH, LEAST_COUNT = r"[A-Za-zÀ-ÿ]+", 6, 5
#: How much more common a form has to be.
TIMES = 5
#: Letters share this many bits of a mask by their code; a multiple of the three bands, which take every third bit.
BITS, BANDS = 63, 3


def damaged(run: Column, doc_id: Column, every: int = 199) -> Column:
    """The run without one code point where ``every`` divides the crc32 of ``<doc_id>:<run>``; a null id is empty text."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    return F.when(h % every == 0, F.concat(F.substr(run, F.lit(1), at), F.substr(run, at + 2))).otherwise(run)


def word_counts(docs: DataFrame, every: int | None = None) -> DataFrame:
    """``word, n``: words of enough letters that occur often enough; with ``every``, of runs :func:`damaged`."""
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all(text_of(), F.lit(LETTERS), F.lit(0))).alias("run")).filter(F.length("run") >= LEAST_LENGTH)
    low = runs.select("doc_id", lower_ascii(F.col("run")).alias("run"))
    words = low.select((F.col("run") if every is None else damaged(F.col("run"), F.col("doc_id"), every)).alias("word"))
    return words.filter(F.length("word") >= LEAST_LENGTH).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= LEAST_COUNT)


def parity_mask(word: Column) -> Column:
    """Bits of the letters that occur an odd number of times."""
    bit = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), (F.ascii(c) % BITS).cast("int"))
    return F.aggregate(F.split(word, ""), F.lit(0).cast("long"), lambda m, c: F.when(c == "", m).otherwise(m.bitwiseXOR(bit(c))))


def bands(mask: Column) -> list[Column]:
    """The mask in three parts, each of every third bit."""
    return [mask.bitwiseAND(F.lit(sum(1 << i for i in range(b, BITS, BANDS))).cast("long")) for b in range(BANDS)]


def _halves(word: str, shorter: Column) -> list[Column]:
    """First and last half of a word, by the length of the shorter one of a pair."""
    first = F.floor(shorter / 2).cast("int")
    return [F.substr(F.col(word), F.lit(1), first), F.right(F.col(word), (shorter - first).cast("int"))]


def near_pairs(words: DataFrame) -> DataFrame:
    """``word, n, other, other_n``: all pairs of ``word, n`` one edit apart, both ways round."""
    w = write_table(words.select("word", "n", F.length("word").alias("size"), parity_mask(F.col("word")).alias("mask")), "words")

    def keyed(side: str, grown: int) -> DataFrame:
        """Words under the keys of pairs whose shorter word has ``grown`` letters less."""
        shorter = F.col("size") - grown
        keys = [F.xxhash64(F.lit(b), band, F.lit(h), half, shorter) for b, band in enumerate(bands(F.col("mask"))) for h, half in enumerate(_halves("word", shorter))]
        return w.select(F.posexplode(F.array(*keys)).alias("way", "key"), *(F.col(c).alias(f"{side}_{c}") for c in ("word", "n", "size", "mask")))

    left, right = keyed("a", 0), keyed("b", 0).union(keyed("b", 1))
    shorter, flips = F.col("a_size"), F.bit_count(F.col("a_mask").bitwiseXOR(F.col("b_mask")))
    same_band = [x == y for x, y in zip(bands(F.col("a_mask")), bands(F.col("b_mask")), strict=True)]
    same_half = [x == y for x, y in zip(_halves("a_word", shorter), _halves("b_word", shorter), strict=True)]
    ways = [b & h for b in same_band for h in same_half]
    first = reduce(lambda out, k: F.when(ways[k], k).otherwise(out), reversed(range(len(ways))), F.lit(-1))
    close = ((F.col("b_size") == shorter) & (F.col("a_word") < F.col("b_word")) & (flips <= 2)) | ((F.col("b_size") == shorter + 1) & (flips == 1))
    met = left.join(right, ["key", "way"]).filter(close).filter(first == F.col("way")).filter(F.levenshtein("a_word", "b_word", 1) == 1)
    pair = lambda x, y: F.struct(*(F.col(f"{side}_{c}").alias(f"{tag}{c}") for side, tag in ((x, ""), (y, "other_")) for c in ("word", "n")))
    both = met.select(F.explode(F.array(pair("a", "b"), pair("b", "a"))).alias("p"))
    return both.select("p.word", "p.n", F.col("p.other_word").alias("other"), "p.other_n")


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` for ``word, form`` rows: where the forms lead in the end.

    Each round joins the table with itself and so doubles the steps taken. Forms are at
    least TIMES more common than their words, so chains are short and never turn back.
    """
    now = write_table(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "roots")
    while not now.filter("moved").isEmpty():
        on = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = write_table(now.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        drop_table(now)
        now = after
    return now.select("word", "root")


def spelling_variants(words: DataFrame, times: int = TIMES) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of ``word, n`` rows with distinct words.

    Near words are one inserted, deleted or replaced code point apart. The form is the most
    common near word (of equals the first in code-point order) if it is ``times`` as common
    at least, else null; the root follows forms to the end and is the word itself where it
    has none. Null words are left out.
    """
    w = write_table(words.filter(F.col("word").isNotNull()).select("word", "n"), "counts")
    best = near_pairs(w).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best"))
    with_best = w.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), (-F.col("best.less")).alias("near_n"), F.col("best.other").alias("near"))
    rises = F.col("near_n") >= times * F.col("n")
    out = write_table(with_best.select("word", F.when(rises, F.col("near")).alias("form"), "n", "n_near", F.when(rises, F.col("near_n")).alias("form_n")), "forms")
    ends = roots(out.filter("form IS NOT NULL"))
    return out.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents, damaged as the contract says, with their forms and roots."""
    return spelling_variants(word_counts(load(spark, sf_dir, "documents"), 199))


# The near words of each pattern: the word with one letter left out, at its place, and the word itself.
OP12_SQL = r"""
WITH RECURSIVE bits AS (
  SELECT i, CAST(list_reduce(list_prepend(CAST(i AS UBIGINT), [CAST(0 AS UBIGINT) FOR k IN range(8)]),
    lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, CAST(3988292384 AS UBIGINT)) ELSE c // 2 END) AS UBIGINT) AS v
  FROM range(256) t(i)
), tab AS (SELECT list(v ORDER BY i) AS t FROM bits),
runs AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
  FROM documents
), per AS (SELECT doc_id, run, count(*) AS times FROM runs WHERE length(run) >= 6 GROUP BY ALL),
hashed AS (
  SELECT run, times, xor(list_reduce(list_prepend(CAST(4294967295 AS UBIGINT),
      [CAST(('0x' || substr(hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)), 2 * k - 1, 2)) AS UBIGINT)
       FOR k IN range(1, 1 + octet_length(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)))]),
    lambda c, b: xor(c // 256, t[CAST(1 + xor(c % 256, b) AS BIGINT)])), CAST(4294967295 AS UBIGINT)) AS h
  FROM per, tab
), words AS (
  SELECT CASE WHEN h % 199 = 0 THEN left(run, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word,
         CAST(sum(times) AS BIGINT) AS n
  FROM hashed GROUP BY 1 HAVING length(word) >= 6 AND sum(times) >= 5
), cut AS (
  SELECT word, n, length(word) AS size, k, left(word, k - 1) || substr(word, k + 1) AS rest
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS k FROM words)
), near AS (
  SELECT DISTINCT a.word, b.word AS other, b.n AS other_n FROM cut a JOIN cut b ON a.rest = b.rest AND a.k = b.k AND a.word <> b.word
  UNION SELECT DISTINCT a.word, b.word, b.n FROM cut a JOIN words b ON a.rest = b.word
  UNION SELECT DISTINCT b.word, a.word, a.n FROM cut a JOIN words b ON a.rest = b.word
), best AS (
  SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, encode(other)) AS top, max(other_n) AS top_n FROM near GROUP BY word
), forms AS (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN top_n >= 5 * n THEN top END AS form, CASE WHEN top_n >= 5 * n THEN top_n END AS form_n
  FROM words LEFT JOIN best USING (word)
), walk AS (
  SELECT word, form, word AS at, form AS onward FROM forms
  UNION ALL
  SELECT w.word, w.form, f.word, f.form FROM walk w JOIN forms f ON w.onward = f.word
)
SELECT f.word, f.form, w.at AS root, f.n, f.n_near, f.form_n
FROM forms f JOIN walk w ON f.word = w.word AND w.onward IS NULL
"""
