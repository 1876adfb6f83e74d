"""Column functions on hand-written cases."""

from pyspark.sql import functions as F

from brightquay.functions import dates, scoring, text
from brightquay.operators.ranking import Mulberry, draft, fnv1a_text, shuffled


def one(spark, column, **values):
    """The value of a column over one row of literals."""
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return df.select(column.alias("x")).first()[0]


def test_canonical_url_drops_tracking_and_keeps_the_rest(spark):
    """Parameters go by name, the scheme is checked."""
    url = "HTTPS://Example.com/a/b/?utm_source=x&q=1&ref=y#frag"
    assert one(spark, text.canonical_url("u"), u=url) == "https://example.com/a/b?q=1"
    assert one(spark, text.canonical_url("u"), u="http://example.com/") is None


def test_visible_text_and_links(spark):
    """Scripts hide their content, even with tags in strings; labels stand in for empty texts."""
    html = '<html><title>A &amp; B</title><script>var t="</p>";</script><p>one</p><!-- x --><div>two &lt;3</div><a href="/x" aria-label="lab">i</a></html>'
    assert one(spark, text.visible_text("h"), h=html) == "A & B one\ntwo <3\ni"
    assert one(spark, text.page_links("h"), h=html) == [("/x", "lab")]
    assert one(spark, text.page_title("h"), h=html) == "A & B"


def test_pages_of_any_spelling(spark):
    """Numbers and all names are decoded, attributes come in any quotes, line ends are two at most."""
    html = "<title>Caf&#233; &#x2019;s &hellip;</title><p>a&ndash;b</p><p></p><p></p><p>&ldquo;c&rdquo;&nbsp;d</p><a href='/q?a=1&amp;b=2'>go on</a> <a class=x href=/plain title='say &#39;hi&#39;'>.</a><a name=n>none</a>"
    assert one(spark, text.page_title("h"), h=html) == "Café ’s …"
    assert one(spark, text.visible_text("h"), h=html) == "Café ’s … a–b\n\n“c” d\ngo on . none"
    assert one(spark, text.page_links("h"), h=html) == [("/q?a=1&b=2", "go on"), ("/plain", "say 'hi'")]


def test_entities_are_decoded_once(spark):
    """Numeric, hexadecimal, unknown and double-escaped entities."""
    assert one(spark, text.decode_entities("h"), h="&#65;&#x42;&amp;lt;&nope;") == "AB&lt;&nope;"


def test_ics_fold_counts_bytes(spark):
    """Lines end at 75 bytes, continuations at 74, and characters stay whole."""
    folded = one(spark, text.ics_fold("h"), h="é" * 100)
    assert [len(x.encode()) for x in folded.split("\r\n")] == [74, 75, 53]
    assert folded.replace("\r\n ", "") == "é" * 100


def test_bounded_is_ascii(spark):
    """An accented letter before a word is no word character here."""
    assert one(spark, F.col("h").rlike(text.bounded(["hack"])), h="éhack")
    assert not one(spark, F.col("h").rlike(text.bounded(["hack"])), h="xhack")


def test_money(spark):
    """First amount of a prize line, and all amounts."""
    assert one(spark, text.first_money("h"), h="entry $5\nPrize pool $10,000 cash") == "$10,000"
    assert one(spark, text.amounts("h"), h="$1.5k and $2M") == [1500.0, 2000000.0]


def test_content_hash_tells_null_from_empty(spark):
    """Null, empty and absent."""
    hashes = {one(spark, text.content_hash({"a": F.lit(v)})) for v in ("", "x")} | {one(spark, text.content_hash({"a": F.lit(None)}))}
    assert len(hashes) == 3


def test_ranges(spark):
    """Every shape, and what is refused."""
    cases = {
        "Aug 04, 2026": ("2026-08-04", "2026-08-04"),
        "Sep 26 - 27, 2026": ("2026-09-26", "2026-09-27"),
        "Jul 26 - Aug 14, 2026": ("2026-07-26", "2026-08-14"),
        "Dec 28 - Jan 03, 2027": ("2026-12-28", "2027-01-03"),
        "Jul 28 - 26, 2026": ("2026-07-28", "2026-07-28"),
    }
    for s, (a, b) in cases.items():
        r = one(spark, dates.parse_range("h"), h=s)
        assert (str(r[0]), str(r[1])) == (a, b), s
    for s in ("", "coming soon", "2026-08-04", "Augustus 4, 2026"):
        assert one(spark, dates.parse_range("h"), h=s) is None


def test_local_to_utc_in_gap_and_overlap(spark):
    """The two-pass rule around daylight saving."""
    ms = lambda s: one(spark, F.unix_millis(F.lit(s).cast("timestamp")))
    for local, utc in (("2026-03-08 02:30:00", "2026-03-08 09:30:00"), ("2026-11-01 01:30:00", "2026-11-01 08:30:00")):
        assert one(spark, dates.local_to_utc(F.lit(ms(local)), "America/Los_Angeles")) == ms(utc)


def test_fnv_matches_plain_python(spark):
    """Code units, surrogates included."""
    for s in ("", "abc", "é👾"):
        assert one(spark, scoring.fnv1a(F.col("h")), h=s) == fnv1a_text(s)


def test_rounding_is_half_up(spark):
    """Halves go up."""
    assert one(spark, scoring.half_up(F.lit(2.5))) == 3


def test_generator_and_draft():
    """Draws are in range and repeat by seed; teams alternate, no item comes twice, and the list is as long as production."""
    a, b = Mulberry(1), Mulberry(1)
    xs = [a() for _ in range(5)]
    assert xs == [b() for _ in range(5)] and all(0 <= x < 1 for x in xs)
    out = draft([1, 2, 3], [3, 1, 4], Mulberry(7))
    assert len(out) == 3 and len({i for i, _ in out}) == 3
    assert {t for _, t in out[:2]} == {"production", "candidate"}
    assert sorted(shuffled(range(9), 3)) == list(range(9))
