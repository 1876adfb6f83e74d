"""Sources that push down, plan pages once, write and read back; streams that cut renders; text functions against plain Python."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from brightquay.functions import scoring, text
from brightquay.operators import evaluate, joins, sampling
from brightquay.operators import telemetry as batch
from brightquay.sources import paged, ranged
from brightquay.streaming import telemetry


def test_range_source_pushes_filters_and_columns(spark, tmp_path):
    """Bounds on time go to the source and nothing else; the rest is filtered by Spark; slices cover the range once."""
    ranged.register(spark)
    rows = spark.range(500).select(F.col("id"), F.timestamp_seconds(F.col("id") * 3600).cast("timestamp_ntz").alias("ts"), (F.col("id") % 5).alias("kind"), F.lit("wide").alias("more"))
    rows.write.parquet(str(tmp_path / "t"))
    load = lambda: spark.read.format("range").schema("id long, ts timestamp_ntz, kind long").load(str(tmp_path / "t"))
    at = lambda s: F.lit(s).cast("timestamp_ntz")
    df = load().filter((F.col("ts") >= at("1970-01-03 00:00:00")) & (F.col("ts") < at("1970-01-05 00:00:00")) & (F.col("kind") == 2)).select("id")
    assert sorted(r.id for r in df.collect()) == [i for i in range(48, 96) if i % 5 == 2]
    assert load().count() == 500
    assert sorted(r.id for r in load().filter(F.col("ts") == at("1970-01-02 01:00:00")).collect()) == [25]
    assert load().filter((F.col("ts") > at("1970-01-02")) & (F.col("ts") < at("1970-01-02"))).collect() == []
    reader = ranged.RangeReader({"path": str(tmp_path / "t")}, load().schema)
    from datetime import datetime

    from pyspark.sql.datasource import EqualTo, GreaterThan, LessThanOrEqual

    left = list(reader.pushFilters([GreaterThan(("ts",), datetime(1970, 1, 3)), EqualTo(("kind",), 2), LessThanOrEqual(("ts",), datetime(1970, 1, 4))]))
    assert left == [EqualTo(("kind",), 2)]
    cuts = reader.partitions()
    assert len(cuts) == 8 and all(a.last == b.first for a, b in zip(cuts, cuts[1:], strict=False))


def test_pages_are_read_once(spark, tmp_path, monkeypatch):
    """A stated total leaves all pages but the first to the tasks; cursors and quiet runs ship what planning has read."""
    reads = []
    plain = paged.read_page
    monkeypatch.setattr(paged, "read_page", lambda path, *a: reads.append(path) or plain(path, *a))
    for i in range(5):
        (tmp_path / f"{i}.json").write_text(json.dumps({"items": [{"n": i}] * 2, "total": 10}))
    reader = paged.PagedReader({"path": str(tmp_path)})
    parts = reader.partitions()
    assert len(parts) == 5 and len(reads) == 1
    assert sum(len(list(reader.read(p))) for p in parts) == 10 and len(reads) == len(set(reads)) == 5
    for i in range(5):
        (tmp_path / f"{i}.json").write_text(json.dumps({"items": [{"n": i, "open": i < 1}], "next": i + 1}))
    reads.clear()
    quiet = paged.PagedReader({"path": str(tmp_path), "quiet": "3"})
    parts = quiet.partitions()
    assert len(parts) == 4 and sum(len(list(quiet.read(p))) for p in parts) == 4 and len(reads) == 4
    assert paged.PagedReader({"path": str(tmp_path / "none")}).partitions() == []
    paged.register(spark)
    assert spark.read.format("paged").load(str(tmp_path / "none")).collect() == []


def test_failed_pages_are_tried_once_more(tmp_path, monkeypatch):
    """One error passes, two don't."""
    (tmp_path / "0.json").write_text("{}")
    calls = []

    def fails(times):
        def loads(_):
            calls.append(1)
            if len(calls) <= times:
                raise OSError("gone")
            return {"items": []}

        return loads

    monkeypatch.setattr(paged.json, "loads", fails(1))
    assert paged.read_page(str(tmp_path / "0.json")) == {"items": []}
    calls.clear()
    monkeypatch.setattr(paged.json, "loads", fails(2))
    with pytest.raises(OSError):
        paged.read_page(str(tmp_path / "0.json"))


def test_stream_cuts_renders_as_batches_do(spark, tmp_path):
    """Files out of order within the watermark, and a late row, give the batch's renders without it."""
    schema = "client_id string, session_id string, ts long, position int, event_id string"
    rng, t, rows = random.Random(7), 1_700_000_000_000, []
    for i in range(120):
        t += rng.choice((1, 50, 900, 7000))
        rows.append({"client_id": f"c{rng.randint(0, 2)}", "session_id": "s", "ts": t, "position": rng.randint(0, 5), "event_id": f"e{i}"})
    mixed = []
    for i in range(0, 120, 10):
        part = rows[i : i + 10]
        rng.shuffle(part)
        mixed += part
    folder = tmp_path / "in"
    folder.mkdir()
    end = {"client_id": "end", "session_id": "s", "ts": t + 10_000_000, "position": 0, "event_id": "end"}
    for i, part in enumerate([mixed[:60], mixed[60:], [end], [rows[3] | {"event_id": "late"}], [end | {"ts": t + 20_000_000}]]):
        at = folder / f"{i}.json"
        at.write_text("\n".join(map(json.dumps, part)))
        os.utime(at, (1e9 + i, 1e9 + i))
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, telemetry.ROCKS)
    try:
        stream = telemetry.with_event_time(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder)), late="1 minute")
        query = telemetry.cut_renders(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        query.awaitTermination(240)
    finally:
        spark.conf.unset(key)
    got = sorted((r.client_id, r.render, r.position, r.event_id) for r in spark.read.parquet(str(tmp_path / "out")).collect() if r.client_id != "end")
    want = batch.renders(spark.createDataFrame([tuple(r.values()) for r in rows], schema)).collect()
    assert got == sorted((r.client_id, r.render, i.position, i.event_id) for r in want for i in r["items"])


def test_fixed_places_round_the_binary_value(spark):
    """Ties, values just beside ties, signs, tiny and large ones, and what has no number."""
    rng = random.Random(1)
    xs = [1.005, 0.125, 2.5, 0.00005, -0.125, 1e-300, 0.0, -0.0, 1e15 + 0.3, 4.35, float("nan"), None, float("inf"), -float("inf")]
    xs += [rng.random() * 10 ** rng.randint(-6, 6) for _ in range(800)] + [rng.randint(-(10**6), 10**6) / 32768 for _ in range(800)] + [round(rng.random() * 100, 5) for _ in range(800)]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    for k in (0, 2, 4):
        for r in df.select("x", scoring.fixed_places(F.col("x"), k).alias("r")).collect():
            assert r.r == evaluate.rounded(r.x, k), (r.x, k)


def test_folded_lines(spark):
    """No line is over 75 bytes, no character is cut, and unfolding gives the text back."""

    def fold(line):
        parts, now, room = [], b"", 75
        for ch in line:
            b = ch.encode()
            if len(now) + len(b) > room:
                parts.append(now.decode())
                now, room = b"", 74
            now += b
        return "\r\n ".join([*parts, now.decode()])

    lines = ["", "a" * 75, "a" * 76, "\u00e9" * 200, "\u65e5\u672c" * 90, "a\U0001f47e" * 100, "x" * 5000, "ab\ncd" * 50, None]
    for r in spark.createDataFrame([(x,) for x in lines], "x string").select("x", text.ics_fold("x").alias("f")).collect():
        assert r.f == (None if r.x is None else fold(r.x))


def test_plurals_and_missing_texts(spark):
    """Forms by language; a form that no catalog has is other, a missing key is the base language's or itself."""
    catalog = F.create_map(*[F.lit(x) for kv in {"en/n.one": "{count} day", "en/n.other": "{count} days", "pl/n.few": "{count} dni", "ar/n.two": "two", "en/only": "{who}!"}.items() for x in kv])
    one = lambda language, n, key="n": text.plural_text(catalog, F.lit(language), F.lit(key), F.lit(n).cast("long"))
    got = spark.range(1).select(one("en", 1), one("en", 1234), one("pl", 22), one("pl", 5), one("pl", 1), one("ar", 2), one("xx", 1), one("en", 1, "none"), text.template(text.catalog_text(catalog, F.lit("pl"), F.lit("only")), {"who": F.lit("me")}), text.plural_form(F.lit("ru"), F.lit(-21)), text.plural_form(F.lit("ar"), F.lit(111)), text.plural_form(F.lit("ja"), F.lit(1))).first()
    assert list(got) == ["1 day", "1,234 days", "22 dni", "5 days", "1 day", "two", "1 days", "none.other", "me!", "one", "many", "other"]


def test_search_results(spark):
    """JSON paths first, then links; the engine's own hosts are left out; broken escapes too."""
    bodies = [
        '{"organic": [{"link": "https://a", "title": "T", "description": "D", "snippet": "S"}, {"title": "no link"}, {"url": "https://b"}]}',
        '{"results": {"organic": [{"url": "https://c", "snippet": "S"}]}}',
        '{"organic": []}',
        '<a href="/url?q=https%3A%2F%2Fd.org%2F&sa=U">x</a><a href="https://www.google.com/x">g</a><a href="https://d.org/">d</a><a href="/url?q=%zz&x">bad</a><a href="https://fonts.gstatic.com">f</a>',
        None,
    ]
    got = [r.r for r in spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "i int, b string").orderBy("i").select(text.search_results("b").alias("r")).collect()]
    show = lambda rows: None if rows is None else [(r.link, r.text) for r in rows]
    assert show(got[0]) == [("https://a", "T D"), ("https://b", "")] and show(got[1]) == [("https://c", "S")] and show(got[2]) == []
    assert show(got[3]) == [("https://d.org/", "")] and not got[4]


def test_calendar_matching_and_ledger(spark):
    """A slug decides alone; titles match equal or within one another from eighteen letters on; the ledger goes both ways."""
    board = spark.createDataFrame([(1, "a", "x"), (2, "b", "longtitleofeighteenletters"), (3, None, "short"), (4, None, "shorter"), (5, None, "averylongtitleindeedofanevent"), (6, None, "titleindeedofanevent")], "id int, slug string, key string")
    shown = spark.createDataFrame([("a", "zzz"), (None, "longtitleofeighteenletters"), (None, "short"), (None, "longtitleindeedofanev"), (None, "mytitleindeedofanevents")], "slug string, key string")
    present = joins.slug_or_key_join(board, shown).select("id")
    assert sorted(r.id for r in present.collect()) == [1, 3, 5, 6]
    recorded = spark.createDataFrame([(1,), (2,)], "id int")
    assert {r.id: r.action for r in joins.ledger_check(recorded, present).collect()} == {1: "keep", 2: "clear", 3: "adopt", 5: "adopt", 6: "adopt"}
    assert sorted(r.id for r in joins.pending(board, recorded, spark.createDataFrame([(3,)], "id int")).collect()) == [4, 5, 6]


def test_seed_order(spark):
    """Tiers, promising first, reserves, headings."""
    df = spark.createDataFrame([(1, False, 100, "x"), (2, True, None, "x"), (3, False, None, "y"), (4, True, 5, "x")], "id int, promising boolean, seen long, region string")
    day = 86_400_000
    tiers = sampling.triage(df, F.col("promising"), F.col("seen") * day, F.lit(102 * day))
    assert {r.id: r.tier for r in tiers.collect()} == {1: 1, 2: 0, 3: 2, 4: 0}
    assert [r.id for r in sampling.promising_first(df, "promising", "id", 3).collect()] == [2, 4, 1]
    assert {r.id: r.turn.late for r in sampling.reserve_order(df, "region", "id", 2).collect()} == {1: 0, 2: 0, 3: 0, 4: 1}
    months = spark.createDataFrame([("k", 1, "May"), ("k", 2, "May"), ("k", 3, None), ("k", 4, "May"), ("l", 1, "May")], "k string, i int, m string")
    assert sorted((r.k, r.i, r.header) for r in sampling.headed(months, "k", "i", "m").collect()) == [("k", 1, "May"), ("k", 2, None), ("k", 3, None), ("k", 4, "May"), ("l", 1, "May")]


def test_a_stated_total_has_no_cap(spark, tmp_path):
    """All pages of a total are read, several by a task where there are many; a cap holds where it is asked for."""
    pages = 2500
    for i in range(pages):
        (tmp_path / f"{i}.json").write_text(json.dumps({"items": [i, -i], "total": 2 * pages - 1}))
    reader = paged.PagedReader({"path": str(tmp_path)})
    parts = reader.partitions()
    assert len(parts) <= paged.MOST_TASKS + 1
    rows = [row for p in parts for row in reader.read(p)]
    assert len(rows) == 2 * pages and len({r[0] for r in rows}) == pages
    few = paged.PagedReader({"path": str(tmp_path), "pages": "7"})
    assert sum(len(list(few.read(p))) for p in few.partitions()) == 14
