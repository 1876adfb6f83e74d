"""Surrogates: awkward texts, ends of the draws, coreference, and entities found by a plain scanner."""

import re

import pytest

from brightquay.llm import pii

SCHEMA = "doc_id long, text string"
MEGABYTE = 1 << 20


def replaced(spark, texts, key="key"):
    """Rows of the result by id."""
    return {r.doc_id: r for r in pii.replace_pii(spark.createDataFrame(list(enumerate(texts)), SCHEMA), key).collect()}


def test_long_texts_of_every_shape(spark):
    """A megabyte that nearly matches a pattern neither overflows a stack nor takes long."""
    n = MEGABYTE // 4
    shapes = ["x@" + "a." * (MEGABYTE // 2) + "com", "x@" + "a." * (MEGABYTE // 2), "a@" * n, "1 " * n, "+1" * n, "1." * n, "DE00 " * n, "0" * n, "f0" * n, "Anna " * n, "A" * n, "Anna" * n]
    out = replaced(spark, shapes)
    assert len(out) == len(shapes) and out[0].n_entities == 1 and out[1].n_entities == 0 and out[8].n_entities == 1
    assert len(out[0].text) >= MEGABYTE and out[0].text.endswith(".com") and out[9].n_entities > 0


def test_draws_end_where_every_surrogate_is_an_entity(spark):
    """Ten addresses that fill their format get wider ones, all different."""
    out = replaced(spark, [f"_@{i}.com" for i in range(10)])
    assert len({r.text for r in out.values()}) == 10 and all(re.fullmatch(r"_[a-z]*@\d\.com", r.text) for r in out.values())
    assert not {r.text for r in out.values()} & {f"_@{i}.com" for i in range(10)}


def test_parts_of_names_follow_the_full_name(spark):
    """Given names, surnames and surnames behind titles; words that the text also writes small stay."""
    out = replaced(spark, ["Patricia Smith wrote. Patricia said so; Smith agreed, and SMITH and Dr. Smith.", "Mark Stone threw a stone. Stone met Mark.", "Smith alone, Patricia alone"])
    given, last = out[0].text.split(" wrote")[0].split()
    assert out[0].text == f"{given} {last} wrote. {given} said so; {last} agreed, and {last.upper()} and Dr. {last}." and given != "Patricia" and last != "Smith"
    assert " threw a stone. Stone met " in out[1].text and "Mark" not in out[1].text
    assert out[2].text == "Smith alone, Patricia alone"


def test_addresses_follow_their_owner(spark):
    """A local part made of a person's name takes the person's surrogate."""
    out = replaced(spark, ["Patricia Smith and Robert Jones", "patricia.smith@example.org, robert_jones@example.org, jones@example.org"])
    first, second = out[0].text.lower().split(" and ")
    a, b, c = out[1].text.split(", ")
    assert a.split("@")[0] == first.replace(" ", ".") and b.split("@")[0] == second.replace(" ", "_") and a.split("@")[1] == b.split("@")[1]
    assert c.split("@")[0] != "jones"


def test_rows_without_ids_are_texts_of_their_own(spark):
    """Names of one row are no persons of another row of the same id."""
    docs = spark.createDataFrame([(None, "Patricia Smith"), (None, "Smith"), (5, "Robert Jones"), (5, "Jones")], SCHEMA)
    assert {"Smith", "Jones"} <= {r.text for r in pii.replace_pii(docs, "key").collect()}


def test_key_is_required_and_decides(spark):
    """No key, no surrogates; another key, other ones."""
    with pytest.raises(TypeError):
        pii.replace_pii(spark.createDataFrame([(1, "a")], SCHEMA))
    assert replaced(spark, ["Patricia Smith"], "a")[0].text != replaced(spark, ["Patricia Smith"], "b")[0].text


def scanned_addresses(text):
    """Mail addresses by walking over the characters."""
    out, local, host = [], set("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-"), set("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789.-")
    at = 0
    while (at := text.find("@", at)) >= 0:
        begin, end = at, at + 1
        while begin and text[begin - 1] in local:
            begin -= 1
        while end < len(text) and text[end] in host:
            end += 1
        run = text[at + 1 : end]
        cut = None
        for dot in (k for k in range(len(run) - 1, 0, -1) if run[k] == "."):
            letters = 0
            while dot + 1 + letters < len(run) and run[dot + 1 + letters].isalpha():
                letters += 1
            if letters >= 2:
                cut = dot + 1 + letters
                break
        if begin < at and cut and run[0].isalnum():
            out.append(text[begin : at + 1 + cut])
        at += 1
    return out


def test_addresses_against_a_scanner(spark):
    """All addresses of the documents and of awkward strings, found by two ways that share no pattern."""
    import pyarrow.parquet as pq
    from pyspark.sql import functions as F

    texts = pq.read_table("/root/testdata/sf0.001/documents.parquet").column("text").to_pylist()
    texts += ["a@b.co", "a@b", "a@b.c", "a@-b.com", "a@b..com", "x.y+z@sub.example.com, or q@w.ee.", "a@b.com-", "@b.com", "é@b.com", "a@b.c1.de9"]
    df = spark.createDataFrame(list(enumerate(texts)), SCHEMA).select("doc_id", F.regexp_extract_all("text", F.lit(pii.KINDS["email"]), F.lit(0)).alias("h"))
    assert {r.doc_id: r.h for r in df.collect()} == dict(enumerate(map(scanned_addresses, texts)))


PLAIN = [
    "from 2024-01-01 2024-02-02 to 2024-03-03 2024-04-04",
    "12 34 56 78 90 12 34",
    "at 1704067798778 ms",
    "3.1415926535897932 and 0,4111111111111111",
    "Austin Texas, Victoria Station, Christian Church, Grace Period, Frank Discussion, Mark Schemes, GRACE and Mark",
    "1 234 567 890 123 456",
    "Will May go to Paris in April?",
]


def test_plain_text_stays(spark):
    """Dates, tables, instants, decimals, things and places."""
    out = replaced(spark, PLAIN)
    assert [out[i].text for i in range(len(PLAIN))] == PLAIN


@pytest.mark.parametrize("card", ["4041894974608795", "4041 8949 7460 8795", "4041-8949-7460-8795", "378282246310005", "3782 822463 10005", "6304000000000000000", "4222222222222"])
def test_cards_in_any_writing(spark, card):
    """Unbroken, in fours, in four, six and five; the writing stays."""
    out = replaced(spark, [f"paid with {card}, 12 items"])[0]
    new = out.text.removeprefix("paid with ").removesuffix(", 12 items")
    assert out.n_entities == 1 and new != card and re.sub(r"\d", "0", new) == re.sub(r"\d", "0", card)


def test_people_beside_places(spark):
    """The same given names with surnames are persons."""
    texts = ["Austin Miller", "Victoria Stone", "Christian Churchill", "Grace Hopper", "Mark Schemer"]
    out = replaced(spark, texts)
    assert all(out[i].n_entities == 1 and out[i].text != t for i, t in enumerate(texts))
