"""URL filters: rules of hosts and paths, and a classifier of words for what no rule fits.

Host and path names are cut into words by a unigram model: of all ways to split a name the
likeliest is found by Viterbi's algorithm. Multinomial naive Bayes then scores the words of
a url's host and path. Pages are first gathered into kinds, which have equal names apart
from digits and separators; all model work is on kinds and distinct names, and pages meet
their kind in one join at the end.

Nothing labels urls, so classes are learned from seeds: a kind with a seed word among its
words counts as blocked, any other as allowed. Words that go with seeds are learned from
that, and a url without any seed is judged by them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brightquay.llm.common import load, lower_ascii, write_table

#: Rules of the contract: verdict, and host with path.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
#: Words of sites that are not to be trained on: the seeds of the block class.
SEEDS = tuple(
    "casino poker bet bets betting gambling jackpot roulette slots lottery adult porn xxx sex nude escort pills pharmacy viagra cialis "
    "spam ads adserver banner popup tracker track clickbait malware phishing warez torrent crack keygen payday".split()
)
#: Letters of a word at most, and of a name that is split; a longer name is a word of its own.
MOST_LETTERS, NAME_LETTERS = 24, 63
#: What a seed counts for in the unigrams, and the weight of the words of all urls in the estimate of a class.
SEED_COUNT, BACKGROUND = 100, 100.0


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host, lower-cased, and path of a url; both empty where it is null or has no ``://``."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    return lower_ascii(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def fitting_rules(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """``pages`` with ``rule`` and ``rule_verdict`` of the longest rule that fits ``host`` and ``path``, null without one.

    ``rules`` has ``verdict, rule``. A rule fits its host and all its subdomains, where the
    path starts with the rule's. Of fitting rules of one length that of the longer host is
    taken; a rule given both ways blocks. The rules of a host are one row of the joined
    table, one equi-join for each number of labels that rule hosts have.
    """
    r = rules.filter(F.col("rule").isNotNull()).groupBy("rule").agg(F.max("verdict").alias("verdict"))  # "block" is after "allow"
    at = F.instr("rule", "/")
    r = r.select("rule", "verdict", F.when(at > 0, F.substr(F.col("rule"), F.lit(1), at - 1)).otherwise(F.col("rule")).alias("on"), F.when(at > 0, F.substr(F.col("rule"), at)).otherwise(F.lit("")).alias("start"))
    r = r.groupBy("on").agg(F.sort_array(F.collect_list(F.struct(F.length("rule").alias("size"), F.length("on").alias("host_size"), "rule", "verdict", "start")), asc=False).alias("own")).withColumn("labels", F.size(F.split("on", r"\.", -1)))
    depths = sorted(x.labels for x in r.select("labels").distinct().collect())  # a host has few labels
    found, out = [], pages
    for d in depths:
        name = f"_fit_{d}"
        of = r.filter(F.col("labels") == d).select(F.col("on").alias(f"_on_{d}"), F.col("own").alias(name))
        out = out.join(of, F.substring_index("host", ".", -d) == F.col(f"_on_{d}"), "left")
        found.append(F.get(F.filter(name, lambda x: F.startswith(F.col("path"), x["start"])), F.lit(0)))
    best = F.array_max(F.array(*found)) if found else F.lit(None)
    kind = "struct<size:int,host_size:int,rule:string,verdict:string,start:string>"
    return out.withColumn("_best", best.cast(kind)).select(*pages.columns, F.col("_best.rule").alias("rule"), F.col("_best.verdict").alias("rule_verdict"))


def names_of(host: Column, path: Column) -> Column:
    """Names of letters in host and path, in order, with a # for each number, in one string."""
    low = F.lower(F.concat(host, F.lit(" "), path))
    return F.trim(F.regexp_replace(F.regexp_replace(low, r"\d+", " # "), r"[^\p{L}#]+", " "))


def text_words(texts: DataFrame, text: str = "html") -> DataFrame:
    """``word, n``: words of letters in all texts, markup left out, none longer than MOST_LETTERS."""
    plain = F.regexp_replace(F.lower(F.col(text)), r"<(script|style)\b[^>]*>[\s\S]*?</\1\s*>|<[^>]*>", " ")
    words = texts.select(F.explode(F.regexp_extract_all(plain, F.lit(r"\p{L}+"), F.lit(0))).alias("word"))
    return words.filter(F.length("word") <= MOST_LETTERS).groupBy("word").agg(F.count("*").alias("n"))


def likeliest_split(name: str, known: dict[tuple[int, int], int], total: float) -> list[str]:
    """Viterbi: the split of largest probability; of equals, the one whose last word is longest.

    ``known`` has the count of the word at a start with a length. Anything else counts a
    tenth of a word per letter, so that unknown names stay whole.
    """
    best: list[tuple[float, int]] = [(0.0, 0)]
    for end in range(1, len(name) + 1):
        options = []
        for start in range(end):
            n = known.get((start, end - start))
            options.append((best[start][0] + (math.log10(n / total) if n else -math.log10(total) - (end - start)), -start))
        score, start = max(options)
        best.append((score, -start))
    out, end = [], len(name)
    while end:
        out.append(name[best[end][1] : end])
        end = best[end][1]
    return out[::-1]


def split_names(names: DataFrame, unigrams: DataFrame) -> DataFrame:
    """``name, words`` of distinct ``name`` rows: each cut into words that ``unigrams`` (``word, n``) makes likeliest.

    A name's parts meet the unigrams in a join, whatever the vocabulary's size; only what
    is known of one name meets in one row.
    """
    total = float(unigrams.agg(F.sum("n")).first()[0] or 1)
    short = F.col("name").rlike(r"^\p{L}+\z") & (F.length("name") <= NAME_LETTERS)
    starts = names.filter(short).select("name", F.explode(F.sequence(F.lit(0), F.length("name") - 1)).alias("start"))
    most = F.least(F.length("name") - F.col("start"), F.lit(MOST_LETTERS))
    parts = starts.select("name", "start", F.explode(F.sequence(F.lit(1), most)).alias("size")).withColumn("word", F.substr(F.col("name"), F.col("start") + 1, F.col("size")))
    known = parts.join(unigrams, "word").groupBy("name").agg(F.collect_list(F.struct("start", "size", "n")).alias("known"))

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            words = [likeliest_split(name, {(k["start"], k["size"]): k["n"] for k in own}, total) for name, own in zip(f["name"], f["known"], strict=True)]
            yield pd.DataFrame({"name": f["name"], "words": words})

    split = known.mapInPandas(cut, "name string, words array<string>")
    return names.join(split, "name", "left").select("name", F.coalesce("words", F.array("name")).alias("words"))


def bayes_scores(kinds: DataFrame, seeds: Sequence[str] = SEEDS) -> DataFrame:
    """``key, score`` of ``key, n, words`` kinds: log-odds of the block class, learned from all kinds.

    A class's probability of a word is (count + B p) / (total + B), where p is the word's
    share in all urls and B is BACKGROUND: a word that a class has never seen speaks against
    it, and a rare word doesn't speak for the smaller class.
    """
    k = kinds.withColumn("seeded", F.arrays_overlap("words", F.array(*map(F.lit, seeds))) if seeds else F.lit(False))
    tokens = k.select("key", "n", "seeded", F.explode("words").alias("word"))
    counts = write_table(tokens.groupBy("word").agg(F.sum(F.when(F.col("seeded"), F.col("n")).otherwise(0)).alias("n_block"), F.sum("n").alias("n_all")), "words")
    t = counts.agg(F.sum("n_block").alias("block"), F.sum("n_all").alias("all"))
    total_block, total = (float(x or 0) for x in t.first())
    urls, urls_block = (float(x or 0) for x in k.agg(F.sum("n"), F.sum(F.when(F.col("seeded"), F.col("n")))).first())
    share = F.col("n_all") / F.lit(total or 1.0)
    in_block = (F.col("n_block") + BACKGROUND * share) / F.lit(total_block + BACKGROUND)
    in_rest = (F.col("n_all") - F.col("n_block") + BACKGROUND * share) / F.lit(total - total_block + BACKGROUND)
    weights = counts.select("word", F.log(in_block / in_rest).alias("weight"))
    prior = math.log((urls_block + 1) / (urls - urls_block + 1))
    summed = tokens.join(weights, "word").groupBy("key").agg(F.sum("weight").alias("odds"))
    return k.join(summed, "key", "left").select("key", (F.coalesce("odds", F.lit(0.0)) + prior).alias("score"))


def judge_urls(pages: DataFrame, rules: DataFrame, unigrams: DataFrame, seeds: Sequence[str] = SEEDS) -> DataFrame:
    """``page_id, host, path, rule, verdict, score`` for every row of ``page_id, url``.

    The verdict is the rule's where one fits, else block where the score, the log-odds of
    naive Bayes, is over 0. Urls without names (null, empty, digits alone) have the prior's
    score. Repeated rows and null ids are rows like others. Other columns aren't read.
    """
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("key", names_of(F.col("host"), F.col("path")))
    keys = write_table(rows.groupBy("key").agg(F.count("*").alias("n")), "keys")
    named = keys.select("key", "n", F.posexplode(F.split("key", " ")).alias("at", "name"))
    known = unigrams.filter(F.length("word") <= MOST_LETTERS).union(pages.sparkSession.createDataFrame([(w, SEED_COUNT) for w in seeds], "word string, n long")).groupBy("word").agg(F.sum("n").alias("n"))
    split = write_table(split_names(named.select("name").filter("name <> ''").distinct(), write_table(known, "unigrams")), "split")
    words = named.join(split, "name").groupBy("key").agg(F.first("n").alias("n"), F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("at", "words"))), lambda x: x["words"])).alias("words"))
    kinds = write_table(keys.join(words.select("key", "words"), "key", "left").select("key", "n", F.coalesce("words", F.array().cast("array<string>")).alias("words")), "kinds")
    scores = write_table(bayes_scores(kinds, seeds), "scores")
    judged = fitting_rules(rows.join(scores, "key", "left"), rules)
    method = F.when(F.col("score") > 0, "block").otherwise("allow")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", method).alias("verdict"), "score")


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page by the rules of the contract, and by words learned from all pages."""
    pages = load(spark, sf_dir, "pages")
    return judge_urls(pages, spark.createDataFrame(RULES, "verdict string, rule string"), text_words(pages))
