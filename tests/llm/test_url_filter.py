"""URL filters: rules and naive Bayes against plain Python, Viterbi against all splits."""

import itertools
import math
import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from brightquay.llm import url_filter as uf

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(url):
    """Host and path."""
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    path = rest[end:]
    stop = min((path.find(c) for c in "?#" if c in path), default=len(path))
    return rest[:end].translate(str.maketrans(UPPER, LOWER)), path[:stop]


def rule_of(host, path, rules=uf.RULES):
    """The longest fitting rule."""
    best = None
    for verdict, rule in rules:
        at = rule.find("/") if "/" in rule else len(rule)
        if (host == rule[:at] or host.endswith("." + rule[:at])) and path.startswith(rule[at:]) and (best is None or len(rule) > len(best[1])):
            best = (verdict, rule)
    return best


def all_splits(name):
    """Every way to cut a name."""
    for cuts in itertools.product((0, 1), repeat=len(name) - 1):
        out = [name[0]]
        for c, cut in zip(name[1:], cuts, strict=True):
            if cut:
                out.append(c)
            else:
                out[-1] += c
        yield out


def test_viterbi_is_the_best_of_all_splits():
    """Known words count by their share, others a tenth per letter."""
    counts, total = {"casino": 50, "win": 200, "cas": 3, "in": 900, "owin": 1, "a": 500}, 5000.0
    score = lambda words: sum(math.log10(counts[w] / total) if w in counts else -math.log10(total) - len(w) for w in words)
    for name in ("casinowin", "winner", "zzz", "acasinoa", "a", "inwinin"):
        known = {(i, j - i): counts[name[i:j]] for i in range(len(name)) for j in range(i + 1, len(name) + 1) if name[i:j] in counts}
        got = uf.likeliest_split(name, known, total)
        assert "".join(got) == name
        assert score(got) == pytest.approx(max(score(s) for s in all_splits(name)))
    assert uf.likeliest_split("casinowin", {(0, 6): 50, (6, 3): 200}, total) == ["casino", "win"]


URLS = [None, "", "no scheme", "http://", "HTTP://COM/", "http://com", "http://a.com?x", "https://Example.COM/en/x?y#z", "https://www.example.com/en/1", "https://m.www.example.com/en/", "https://xexample.com/en/", "https://blog.example.com/en", "http://b.net/es/1", "http://net/fr/", "http://bnet/fr/", "http://b.net/de/1", "http://u@b.net:80/es/", "a://b://c.com/", "http://x.com/" + "p/" * 5000, "http://" + "l" * 5000 + ".org/q", "http://b.org/\u00e9t\u00e9#f", "http://casinowin.org/1", "http://casinowin.org/1"]


def test_rules_on_edges(spark):
    """Subdomains, ports, schemes in any case, long and empty parts, repeated rows, clashing columns."""
    pages = spark.createDataFrame([(i if i % 5 else None, u, "h", "p", "r", "v") for i, u in enumerate(URLS)], "page_id long, url string, host string, path string, rule string, verdict string")
    rules = spark.createDataFrame(uf.RULES, "verdict string, rule string")
    words = spark.createDataFrame([("casino", 10), ("win", 30)], "word string, n long")
    got = uf.judge_urls(pages, rules, words).collect()
    want = Counter((*parts(u), (rule_of(*parts(u)) or (None, None))[1]) for u in URLS)
    assert Counter((r.host, r.path, r.rule) for r in got) == want
    assert all(r.verdict == (rule_of(r.host, r.path) or (r.verdict,))[0] for r in got) and {r.verdict for r in got} == {"allow", "block"}
    assert uf.judge_urls(pages.limit(0), rules, words).collect() == []
    assert uf.judge_urls(pages, rules.limit(0), words.limit(0)).filter("rule IS NOT NULL").count() == 0


def test_longest_rule_wins(spark):
    """Of random rules the longest that fits, the longer host of equals; a rule given both ways blocks."""
    rng = random.Random(2)
    name = lambda n: ".".join(rng.choice("ab") for _ in range(n))
    rules = sorted({(rng.choice(("allow", "block")), name(rng.randint(1, 3)) + "/" + "".join(rng.choice("xy/") for _ in range(rng.randint(0, 3)))) for _ in range(60)})
    pages = [(i, f"http://{name(rng.randint(1, 5))}/" + "".join(rng.choice("xy/") for _ in range(4))) for i in range(300)]
    df = spark.createDataFrame(pages, "page_id long, url string").withColumns(dict(zip(("host", "path"), uf.host_and_path(F.col("url")), strict=True)))
    for r in uf.fitting_rules(df, spark.createDataFrame(rules, "verdict string, rule string")).collect():
        fits = [(len(x), len(x[: x.find("/")]), x, v) for v, x in rules if (r.host == x[: x.find("/")] or r.host.endswith("." + x[: x.find("/")])) and r.path.startswith(x[x.find("/") :])]
        best = max(fits, default=(0, 0, None, None))
        assert (r.rule, r.rule_verdict) == (best[2], best[3])


def plain_scores(kinds, seeds):
    """Naive Bayes in plain Python."""
    block, every, urls, bad = Counter(), Counter(), 0, 0
    for _, n, words in kinds:
        seeded = bool(set(words) & set(seeds))
        urls, bad = urls + n, bad + n * seeded
        for w in words:
            every[w] += n
            block[w] += n * seeded
    total, total_block, b = sum(every.values()), sum(block.values()), uf.BACKGROUND
    weight = {w: math.log(((block[w] + b * every[w] / total) / (total_block + b)) / ((every[w] - block[w] + b * every[w] / total) / (total - total_block + b))) for w in every}
    return {k: sum(weight[w] for w in words) + math.log((bad + 1) / (urls - bad + 1)) for k, _, words in kinds}


def test_bayes_against_plain_python(spark):
    """Scores agree, and words that go with seeds are learned; kinds without words have the prior's score."""
    kinds = [("a", 5, ["casino", "win", "org"]), ("b", 3, ["win", "big", "org"]), ("c", 50, ["news", "org", "#"]), ("d", 40, ["garden", "org"]), ("e", 1, [])]
    got = {r.key: r.score for r in uf.bayes_scores(spark.createDataFrame(kinds, "key string, n long, words array<string>")).collect()}
    want = plain_scores(kinds, uf.SEEDS)
    assert got == pytest.approx(want)
    assert got["a"] > got["b"] > got["c"] and got["c"] < 0


def test_held_out_hosts(spark):
    """Joined names without a seed are told apart by the words they share with seeded ones."""
    rng = random.Random(4)
    bad, good = ["jackpotty", "megawin", "freespin", "bigbonus", "luckydeal"], ["garden", "recipe", "school", "museum", "weather", "travel"]
    words = {w: 200 for w in (*bad, *good, "club", "house", "online")}
    make = lambda own, extra: "".join(rng.sample(own, 2)) + extra
    rows = [(i, f"http://{make(bad, 'casino')}.org/{i}") for i in range(60)] + [(100 + i, f"http://{make(good, 'house')}.org/{i}") for i in range(400)]
    held = [(1000 + i, f"http://{make(bad, 'club')}.org/{i}") for i in range(40)] + [(2000 + i, f"http://{make(good, 'club')}.org/{i}") for i in range(40)]
    out = uf.judge_urls(spark.createDataFrame(rows + held, "page_id long, url string"), spark.createDataFrame([], "verdict string, rule string"), spark.createDataFrame(list(words.items()), "word string, n long")).collect()
    verdict = {r.page_id: r.verdict for r in out}
    right = sum(verdict[i] == ("block" if i < 2000 else "allow") for i, _ in held)
    assert right >= 76
    assert all(verdict[i] == "allow" for i, _ in rows if i >= 100)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_query(spark):
    """Every page once, with its rule."""
    pages = spark.read.parquet(f"{DATA}/pages.parquet").select("page_id", "url").collect()
    got = {r.page_id: r for r in uf.op13_url_filter(spark, DATA).collect()}
    assert len(got) == len(pages)
    for p in pages:
        host, path = parts(p.url)
        verdict, rule = rule_of(host, path) or (None, None)
        r = got[p.page_id]
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict in ("allow", "block") and (rule is None or r.verdict == verdict)
