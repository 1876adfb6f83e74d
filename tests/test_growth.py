"""Steps whose work must grow no faster than the input."""

from pyspark.sql import functions as F

from brightquay.functions import dates, facts, page, text
from brightquay.operators import publish
from brightquay.plans import evaluation

DATA = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_drifted_titles_that_begin_alike_are_not_paired(spark):
    """The longest calendar title wins, one that goes on behind the board's before one that it begins with."""
    board = spark.createDataFrame([(1, "An evening of code by night", 0), (2, "An evening of", 0), (3, "An evening", 0)], "id long, title string, start_ms long")
    calendar = spark.createDataFrame([(1, "An evening of code", 60_000), (2, "An evening of c", 120_000), (3, "An evening of code by", 180_000)], "ordinal long, title string, start_ms long")
    out = publish.drifted(board, calendar)
    assert sorted(map(tuple, out.collect())) == [(1, 0, 180_000)]  # the others have fewer than 12 letters
    assert sorted(map(tuple, publish.drifted(board, calendar, prefix=4).collect())) == [(1, 0, 180_000), (2, 0, 180_000), (3, 0, 180_000)]
    assert "startswith" not in plan_of(out).lower()


def test_range_text_is_read_once(spark):
    assert str(dates.parse_range("h")).count("Jan|Feb") <= 4
    texts = ["Jul 26 - Aug 14, 2026", "dec 30 – Jan 2, 2027", "Sep 26-27, 2026", "Sep 27 - 26, 2026", "Aug 04, 2026", "Sep 26-27", None, "a|b|c|d|2026"]
    got = spark.createDataFrame([(t,) for t in texts], "h string").select(dates.parse_range("h").alias("r")).select(F.concat_ws("/", "r.start", "r.end")).collect()
    assert [r[0] for r in got] == ["2026-07-26/2026-08-14", "2026-12-30/2027-01-02", "2026-09-26/2026-09-27", "2026-09-27/2026-09-27", "2026-08-04/2026-08-04", "", "", ""]


def test_place_lines_are_read_once():
    assert str(facts.page_place(F.col("lines"), F.col("at"), "(?i)oakland")).count("Registration") == 1


def test_leak_controls_join_no_vectors(spark):
    assert plan_of(evaluation.leak_controls(spark, DATA)).count("Join") == 1


def test_coverage_counts_without_copies_for_each_distinct_count(spark):
    assert "Expand" not in plan_of(evaluation.ordering_coverage(spark, DATA))


def test_entities_are_found_once_a_text():
    assert str(text.decode_entities("h")).count("regexp_extract_all") == 1


def test_folding_makes_no_list_of_characters(spark):
    assert "lambda" not in str(text.ics_fold("h")).lower()
    for line in ("a" * 75, "a" * 76, "a" * 149, "a" * 150, "é" * 200, "日" * 99 + "b", "a\U0001f47e" * 60, "", "a" * 74 + "\n" + "b" * 80):
        got = spark.createDataFrame([(line,)], "h string").select(text.ics_fold("h")).first()[0]
        want, used, room = "", 0, 75
        for c in line:
            n = len(c.encode())
            want, used, room = (want + "\r\n " + c, n, 74) if used + n > room else (want + c, used + n, room)
        assert got == want


def test_what_holds_no_event_is_not_opened(spark, monkeypatch):
    body = '{"@type": "ItemList", "itemListElement": [{"position": 1, "item": {"@type": "Event", "name": "n", "location": {"name": "h", "address": {"a": {"b": 1}}}}}, {"x": [1, {"@type": "Event", "name": "m"}, "s"]}]}'
    pages = spark.createDataFrame([(1, f'<script type="application/ld+json">{body}</script>')], "id long, html string")
    levels, cut = [], page.cut
    monkeypatch.setattr(page, "cut", lambda df: levels.append(1) or cut(df))
    assert sorted(r["name"] for r in page.structured_events(pages, "id", "html").collect()) == ["m", "n"]
    assert len(levels) <= 5
