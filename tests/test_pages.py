"""Structured data, schedules and organizers of pages; Markdown tables."""

from pyspark.sql import functions as F

from brightquay.functions import page
from brightquay.sources.reports import markdown


def test_structured_events_at_any_depth(spark):
    """Lists in lists, types in lists, repeats, nameless ones, other types, and a malformed block beside a good one."""
    good = '{"@graph":[{"@type":"ItemList","itemListElement":[[{"item":{"@type":["Thing","Event"],"name":"A","startDate":"2026-01-01","location":{"name":"Hall","address":{"addressLocality":"Oakland"}},"organizer":[{"name":"O"},"P",{"x":1}]}}]]},{"@type":"Event","name":"A","startDate":"2026-01-01"},{"@type":"Event","url":"u"},{"@type":"SocialEvent","name":"S"}]}'
    more = '[{"@type":"Event","@id":"id","name":"B","location":"text","organizer":{"name":"Q"},"offers":[{},{"availability":"InStock"}]},5]'
    block = lambda x: f'<script type="application/ld+json">{x}</script>'
    rows = [(1, block("{bad") + block(good)), (2, "<p>none</p>"), (3, None), (4, block(more) + block("7") + block("")), (None, block(more))]
    got = page.structured_events(spark.createDataFrame(rows, "k int, h string"), "k", "h").collect()
    found = sorted((e.k or 0, e.name, e.url, e.place, e.city, e.organizers, e.offer) for e in got)
    b = ("B", "id", None, None, ["Q"], "InStock")
    assert found == [(0, *b), (1, "A", None, "Hall", "Oakland", ["O", "P"], None), (4, *b)]
    assert page.structured_events(spark.createDataFrame([], "k int, h string"), "k", "h").collect() == []


def test_page_schedule(spark):
    """The year by its weekday, an end past midnight, and pages without a schedule."""
    texts = ["x\nFriday, August 28\n9:00 AM - 7:00 PM PDT\ny", "Friday, August 28\n9:00 PM - 1:00 AM", "Friday, August 28\nsoon", "Monday, August 28\n9:00 AM - 10:00 AM", None]
    r = page.page_schedule("t", F.lit(2026), "America/Los_Angeles")
    got = [x.r for x in spark.createDataFrame([(t,) for t in texts], "t string").select(r.alias("r")).collect()]
    hours = [(x.end - x.start) / 3.6e6 if x else None for x in got]
    assert hours == [10, 4, None, None, None]
    assert got[0].start == 1787932800000


def test_organizer_ladder(spark):
    """Each step, down to Unknown."""
    rows = [(["A", "B"], "", "https://x.org"), ([], "Presented by\nP", "https://x.org"), ([], "Hosted By\nH", "u"), (None, "", "https://www.x.org/a"), (None, None, None)]
    df = spark.createDataFrame(rows, "o array<string>, t string, u string")
    assert [r[0] for r in df.select(page.organizer(F.col("o"), "t", "u")).collect()] == ["A, B", "P", "H", "x.org", "Unknown"]


def test_markdown(spark):
    """Numbers, nulls and bars."""
    df = spark.createDataFrame([("a|b", 0.12345, None)], "x string, y double, z int")
    assert markdown(df) == "| x | y | z |\n| --- | --- | --- |\n| a\\|b | 0.1235 | n/a |\n"
