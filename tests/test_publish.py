"""Publishing, gates and evaluation on hand-written cases."""

import json

import pytest
from pyspark.sql import functions as F

from brightquay.functions import facts, stated
from brightquay.operators import evaluate, gates, publish
from brightquay.operators.ranking import Mulberry, bootstrap_mean, shuffled
from brightquay.plans.notices import REGIONS


def one(spark, column, **values):
    """The value of a column over one row of literals."""
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()] or ["id"]).select(column.alias("x")).first()[0]


def test_prize_ladder(spark):
    """An amount on a prize line, an announcement, a mention, nothing; amounts elsewhere don't count."""
    p = lambda text: tuple(one(spark, facts.prize(F.lit("Night"), F.col("e")), e=text))
    assert p("fee $20\nCash $ 1,500 pool") == ("$1,500", "$1,500 cash")
    assert p("Prizes: coming soon")[1] == "Prizes TBA" and p("bounties")[1] == "Prizes listed" and p("fee $20") == (None, "Not listed")


def test_regions(spark):
    """Cities in any case, areas, bonuses, states and offsets."""
    assert one(spark, REGIONS.region_of(F.lit(" OAKLAND"), F.lit(False))) == "bay" and one(spark, REGIONS.region_of(F.lit("Rome"), F.lit(True))) == "online"
    assert one(spark, REGIONS.area_of(F.lit("sf"), F.lit("bay"))) == "SF" and one(spark, REGIONS.area_of(F.lit("Rome"), F.lit("south"))) == "San Diego"
    assert one(spark, REGIONS.bonus(F.lit("bay"), F.lit("East Bay"))) == 3 and one(spark, REGIONS.bonus(F.lit("bay"), F.lit("Peninsula"))) is None
    assert one(spark, REGIONS.resolve_city(F.lit("Hall 3, Palo Alto, CA"))) == "Palo Alto" and one(spark, REGIONS.resolve_city(F.lit("near san francisco"))) == "San Francisco"
    assert one(spark, REGIONS.unserved(F.lit("NV"))) and not one(spark, REGIONS.unserved(F.lit("ca"))) and not one(spark, REGIONS.unserved(F.lit(None).cast("string")))
    assert one(spark, REGIONS.serves_offset(F.lit(1_700_000_000_000), F.lit(-480))) and not one(spark, REGIONS.serves_offset(F.lit(1_700_000_000_000), F.lit(480)))


def test_publish_labels(spark):
    """Every way out of the gate."""
    rows = [(94, True, "event", False, True, True, True), (94, True, "event", True, True, False, False), (60, True, "event", False, False, False, False), (50, True, "event", False, True, True, False), (94, False, "event", False, True, True, False), (94, True, "profile", False, True, True, False)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, conf int, local boolean, kind string, neg boolean, comp boolean, named boolean, x boolean")
    c = F.col
    got = df.select("i", gates.publish_label(c("conf"), c("local"), c("kind"), F.lit(False), F.lit(False), c("neg"), c("comp"), c("named")).alias("l")).orderBy("i").collect()
    assert [(r.l.label, r.l.reason) for r in got] == [("hackathon", None), ("adjacent", "title names a non-hackathon format"), ("adjacent", "no competition or submission evidence"), ("near miss", None), ("none", None), ("none", None)]


def test_ranges_in_words(spark):
    """Dashes, cases, the turn of a year, and what runs backwards."""
    r = lambda t: one(spark, stated.range_instants("t", "UTC"), t=t)
    day = 86_400_000
    assert (r("Dec 30 – Jan 2, 2027").end - r("Dec 30 – Jan 2, 2027").start + 60_000) / day == 4
    assert (r("sep 26-27, 2026").end - r("sep 26-27, 2026").start + 60_000) / day == 2
    assert (r("Sep 26 - 20, 2026").end - r("Sep 26 - 20, 2026").start + 60_000) / day == 1
    assert r("Jul 28 - Jul 26, 2026") is None and r("soon") is None and r("Aug 04, 2026").start == 1785801600000


def test_tombstones_are_strict(spark, tmp_path):
    """No file is none; a file without a list, or a broken one, stops the publication."""
    at = tmp_path / "t.json"
    assert publish.read_tombstones(spark, str(at)).count() == 0
    at.write_text(json.dumps({"tombstones": [{"url": "u", "action": "delete"}]}))
    assert [r.url for r in publish.read_tombstones(spark, str(at)).collect()] == ["u"]
    for bad in ("{}", "{nope"):
        at.write_text(bad)
        with pytest.raises(ValueError, match="no list"):
            publish.read_tombstones(spark, str(at)).collect()


def test_fallbacks(spark):
    """A collapsed feed keeps what was there; failed queries keep what is not over."""
    row = lambda *rs: spark.createDataFrame(rs, "url string, end_ms long")
    old, new = row(("a", 5), ("b", 50)), row(("c", 60))
    assert {r.url for r in publish.merged_after_collapse(old, new, new, True).collect()} == {"a", "b", "c"} and publish.merged_after_collapse(old, new, new, False).count() == 1
    assert [r.url for r in publish.stay_alive(old, new, 3, 3, F.lit(10)).collect()] == ["b"] and [r.url for r in publish.stay_alive(old, new, 2, 3, F.lit(10)).collect()] == ["c"]
    assert {r.surface: r.n for r in publish.surfaces_of("a", board=old, feed=new).collect()} == {"board": 1, "feed": 0}


def test_random_orderings_and_bootstrap(spark):
    """Shuffles equal the plain one, and drawn means equal a loop over the generator."""
    lists = spark.createDataFrame([(1, 7, [3, 1, 2]), (2, 9, [5, 4])], "k int, s long, xs array<int>")
    got = evaluate.shuffled_ranks(lists, "k", "s", "xs").collect()
    assert {(r.k, r.rank): r.item for r in got} == {(k, i): x for k, s, xs in ((1, 7, [3, 1, 2]), (2, 9, [5, 4])) for i, x in enumerate(shuffled(xs, s))}
    values = [("a", 1.0), ("a", 3.0), ("b", 5.0), ("c", 0.0)]
    df = spark.createDataFrame(values, "c string, v double")
    from brightquay.operators.ranking import numbered_keys

    order = [r.c for r in numbered_keys(df.select("c").distinct(), "c").orderBy("k").collect()]
    rng, means = Mulberry(4242), []
    for _ in range(200):
        picks = [order[int(rng() * 3)] for _ in order]
        sample = [x for p in picks for k, x in values if k == p]
        means.append(sum(sample) / len(sample))
    means.sort()
    r = bootstrap_mean(df, "c", "v", draws=200).first()
    assert (r.mean, r.low, r.high) == pytest.approx((2.25, means[5], means[195]))


def test_model_versions_and_rounding():
    """The version says where its evidence is from; rounding takes the binary value."""
    args = (evaluate.FEATURES, {"l2": 0.01}, 1, 10, 5, "x")
    assert evaluate.model_version(*args, 0).startswith("syn-") and evaluate.model_version(*args, 1)[4:] == evaluate.model_version(*args, 0)[4:]
    assert evaluate.rounded(None) is None and evaluate.rounded(1.00005) == 1.0001 and evaluate.rounded(2.675, 2) == 2.67
