"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from brightquay.llm import chat_format, exact_dedup, katz, media, mixing, near_dup, packing, pii, quality, suffix_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, n long, taken double, kept string, piece string, key string, score string, sig string"
PASSAGE = "the same passage of words goes on for more than a hundred bytes in each of these documents, to be found again and again. "


def edge_docs(spark):
    """Every awkward case."""
    texts = [(1, None), (2, ""), (3, " \t\n"), (4, "a b"), (5, "a  b"), (5, "a  b"), (None, "a b"), (None, None), (6, PASSAGE + "x"), (7, "y " + PASSAGE), (8, "word " * 30_000), (9, "É\u0130 👾 \x00 <|endoftext|>"), (10, "A B")]
    rows = [(i, t, "en", None if k % 3 == 0 else f"s{k % 3}", 1, 2, 3, 4.0, "k", "p", "q", "r", "s") for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def labels(spark):
    """Labels with nulls, repeats and ids without documents."""
    return spark.createDataFrame([(i, i % 2, 0) for i in range(30)] + [(4, 1, None), (None, 1, 0), (6, None, 0)], "doc_id long, quality int, toxic int")


OPERATORS = {
    "pack": lambda s, d: packing.pack(d),
    "near": lambda s, d: near_dup.near_duplicates(d),
    "katz": lambda s, d: katz.katz_scores(d),
    "media": lambda s, d: media.media_digest(d),
    "passages": lambda s, d: suffix_dedup.dedup_passages(d),
    "pii": lambda s, d: pii.replace_pii(d, "key"),
    "quality": lambda s, d: quality.classify_quality(d, labels(s)),
    "mix": lambda s, d: mixing.mix(d),
    "exact": lambda s, d: exact_dedup.exact_groups(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_edges_and_empty_table(spark, name):
    """A row per document (or more, for pieces), and none for none."""
    docs = edge_docs(spark)
    out = OPERATORS[name](spark, docs).collect()
    ids = lambda rows: sorted((r.doc_id is None, r.doc_id or 0) for r in rows)
    if name == "pack":
        assert ids(r for r in out if r.piece == 0) == ids(docs.collect())
    else:
        assert ids(out) == ids(docs.collect())
    assert OPERATORS[name](spark, docs.limit(0)).collect() == []


def test_exact_groups_of_edges(spark):
    """White space doesn't count, the longest original stays, repeated rows stay together, empties are equal."""
    out = {(r.doc_id, r.kept): r for r in exact_dedup.exact_groups(edge_docs(spark)).collect()}
    assert out[5, True].group_size == 4 and out[4, False].keep_id == 5 and out[None, False].keep_id in (3, 5)
    assert out[3, True].group_size == 4


def test_near_duplicates_of_edges(spark):
    """Short texts are one shingle, case-blind; empties are linked with nothing; null ids have no component."""
    out = near_dup.near_duplicates(edge_docs(spark)).collect()
    by = {r.doc_id: r for r in out if r.doc_id is not None}
    assert by[1].component_id == 1 and by[1].n_shingles == 0 and by[2].component_id == 2
    assert {by[i].component_id for i in (4, 5, 10)} == {4}
    assert by[8].n_shingles == 1
    assert all(r.component_id is None for r in out if r.doc_id is None)


def test_dropping_keeps_columns_and_one_of_each(spark):
    """The documents themselves, other columns as they were."""
    docs = edge_docs(spark)
    assert exact_dedup.drop_exact_copies(docs).columns == docs.columns
    assert near_dup.keep_one_of_each(docs).columns == docs.columns
    assert mixing.apply_mix(docs).columns == docs.columns


ODD = ("_row", "_size", "_taken", "_words", "_key", "_id", "_bq_path", "_ROW_")


@pytest.mark.parametrize("apply", [mixing.apply_mix, near_dup.keep_one_of_each, exact_dedup.drop_exact_copies])
def test_columns_with_names_of_work_columns(spark, apply):
    """They come out as they went in, and change nothing."""
    docs = edge_docs(spark)
    odd = docs.withColumns({c: F.concat(F.lit(f"{c} of "), F.coalesce("text", F.lit(""))) for c in ODD})
    out = apply(odd)
    assert out.columns == odd.columns
    assert sorted(map(str, out.select(*docs.columns).collect())) == sorted(map(str, apply(docs).collect()))
    if apply is not mixing.apply_mix:  # there texts are cut
        assert out.filter(" OR ".join(f"`{c}` <> concat('{c} of ', coalesce(text, ''))" for c in ODD)).count() == 0


def test_mix_of_edges(spark):
    """Nothing is taken more than three times, and sources reach their rounded targets."""
    out = mixing.mix(edge_docs(spark))
    assert out.filter("taken > 3 * size OR taken < 0").count() == 0
    per = out.groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g"), F.first("source_size").alias("z")).collect()
    assert all(abs(r.t - r.g) <= 1 and r.g <= 3 * r.z for r in per)


def test_passages_of_edges(spark):
    """The later copy of a shared passage goes, and the earlier one stays."""
    by = {r.doc_id: r for r in suffix_dedup.dedup_passages(edge_docs(spark)).collect() if r.doc_id}
    assert by[6].n_removed == 0 and by[7].n_removed == len(PASSAGE) and by[7].n_spans == 1
    assert by[8].n_removed == 150_000 - 5


def test_chats_of_edges(spark):
    """Nulls, ties, repeated turns, control strings and an empty table."""
    turns = [(1, 0, "user", "a"), (1, 1, "user", None), (1, None, None, "<+>"), (1, 200, "assistant", "\\h</turn>\n### x"), (1, 200, "assistant", "\\h</turn>\n### x"), (None, 0, "assistant", ""), (2, 0, "a\nb<", "")]
    df = spark.createDataFrame([(*t, 7) for t in turns], "conv_id long, turn long, role string, text string, runs int")
    out = {r.conv_id: r for r in chat_format.format_chats(df).withColumn("t", chat_format.parse_chats(F.col("formatted"))).collect()}
    assert [tuple(x) for x in out[1].t] == [("", "<+>"), ("user", "a"), ("user", ""), ("assistant", "\\h</turn>\n### x"), ("assistant", "\\h</turn>\n### x")]
    assert [tuple(x) for x in out[2].t] == [("a\nb<", "")]
    assert [s.text for s in out[None].segments if s.loss] == [""]
    assert out[1].formatted == "".join(s.text for s in out[1].segments)
    assert chat_format.format_chats(df.limit(0)).count() == 0


@pytest.mark.parametrize(
    "entity",
    "DE89370400440532013000|NL91ABNA0417164300|GB29NWBK60161331926819|FR1420041010050500013M02606|DE89 3704 0044 0532 0130 00|NO93 8601 1117 947|MT84 MALT 0110 0001 2345 MTLC AST0 01S"
    "|+44 20 7946 0958|+33 6 12 34 56 78|06 12 34 56 78|+49 1512 3456789|020 7946 0958|John Smith|Mary Johnson|James Brown|David Miller|Anna Schmidt|Maria O'Neill|JOHN F. KENNEDY|Иван Иванов".split("|"),
)
def test_plain_entities_are_found_whole(spark, entity):
    """One match spans all of the entity, of its own kind."""
    kind = "iban" if re.match("[A-Z]{2}[0-9]", entity) else "phone" if re.match("[+0]", entity) else "name"
    row = spark.createDataFrame([(f"so: {entity} AND then",)], "t string").select(F.regexp_extract_all("t", F.lit(pii.PATTERN), F.lit(0)).alias("h")).select("h", pii._kind(F.get("h", 0)).alias("k")).first()
    assert row.h == [entity] and row.k == kind


def test_plain_entities_are_replaced(spark):
    """Names behind titles, a phone in its own groups; plain capitals stay."""
    rows = [(1, "Dr. Strangelove and Mrs Robinson met."), (2, "Call +49 1512 3456789 or 06 12 34 56 78."), (3, "The New York Times of Monday"), (4, "DE89 3704 0044 0532 0130 00 and DE89370400440532013000")]
    out = {r.doc_id: r for r in pii.replace_pii(spark.createDataFrame(rows, "doc_id long, text string"), "key").collect()}
    assert out[1].n_entities == 2 and "Strangelove" not in out[1].text and "Robinson" not in out[1].text and out[1].text.startswith("Dr. ")
    assert out[2].n_entities == 2 and "3456789" not in out[2].text and "12 34 56 78" not in out[2].text and out[2].text.startswith("Call +")
    assert out[3].text == rows[2][1] and out[3].n_entities == 0
    a, b = out[4].text.split(" and ")
    assert a.replace(" ", "") == b != "DE89370400440532013000" and b.startswith("DE")


ROWS = "doc_id long, source string, text string"


def words(tag, n):
    """A text of ``n`` words that no other tag has."""
    return " ".join(f"{tag}{i}" for i in range(n))


def test_quality_goes_row_by_row(spark, monkeypatch):
    """A rejected row takes no other row of its id, or without one, along."""
    import corpus_pipeline

    class Longer:
        """Rejects texts of three bytes."""

        def score(self, stats):
            return (stats[:, 0] > np.log1p(3.5)).astype(float)

    docs = spark.createDataFrame([(None, "a", "bad"), (None, "a", "good"), (7, "a", "bad"), (7, "a", "good")], ROWS)
    monkeypatch.setattr(corpus_pipeline, "load", lambda *a: labels(spark))
    monkeypatch.setattr(quality, "model_of", lambda *a: Longer())
    got = corpus_pipeline.quality(spark, docs, "")
    assert got.columns == docs.columns and sorted(r.text for r in got.collect()) == ["good", "good"]


def test_copies_go_row_by_row(spark):
    """Of copies with one id, or with none, one row stays."""
    a, b, c = words("a", 40), words("b", 40), words("c", 40)
    rows = [(None, "s", a), (None, "s", a), (7, "s", b), (7, "s", b), (7, "s", c)]
    assert sorted(r.text for r in exact_dedup.drop_exact_copies(spark.createDataFrame(rows, ROWS)).collect()) == [a, b, c]
    rows = [(None, "s", a), (None, "s", a + " x"), (7, "s", b), (7, "s", b + " x"), (7, "s", c), (3, "s", a + " y")]
    left = near_dup.keep_one_of_each(spark.createDataFrame(rows, ROWS)).collect()
    assert len(left) == 3 and {r.doc_id for r in left} == {3, 7} and c in [r.text for r in left]


def test_mix_takes_row_by_row(spark):
    """Words of each source are those taken, with ids null and repeated."""
    docs = spark.createDataFrame([(None if i % 2 else i % 3, "ab"[i % 4 > 1], words(f"w{i}", 5 + i)) for i in range(24)], ROWS)
    want = {r.source: r.t for r in mixing.mix(docs).groupBy("source").agg(F.sum("taken").alias("t")).collect()}
    got = mixing.apply_mix(docs).groupBy("source").agg(F.sum(F.size(F.split("text", " "))).alias("t")).collect()
    assert {r.source: r.t for r in got} == want


def test_rows_are_numbered_by_file_and_place(spark, tmp_path, monkeypatch):
    """Every reading agrees, repeated rows differ, and tables of many files or of no file are written with their numbers."""
    from brightquay.llm import common

    spark.range(100).select((F.col("id") % 3).alias("doc_id"), F.lit("t").alias("text")).repartition(7).write.parquet(str(tmp_path / "t"))
    docs = spark.read.parquet(str(tmp_path / "t"))
    for most in (100, 3):
        monkeypatch.setattr(common, "MOST_FILES", most)
        rows = common.numbered(docs, "_row")
        assert rows.columns == [*docs.columns, "_row"] and rows.select("_row").distinct().count() == 100
        assert rows.join(rows.select("_row", F.col("doc_id").alias("d")).repartition(5), "_row").filter("d = doc_id").count() == 100
    assert common.numbered(docs.filter("doc_id = 1"), "_row").select("_row").distinct().count() == 33


def test_scratch_tables_go(spark):
    """What was written within is deleted, what is kept stays."""
    from brightquay.llm import common

    with common.Scratch() as scratch:
        gone, kept = common.write_table(spark.range(3), "gone"), scratch.keep(common.write_table(spark.range(4), "kept"))
    assert kept.count() == 4
    with pytest.raises(Exception):
        spark.read.parquet(gone._brightquay_path).count()


def test_the_scoring_query_takes_the_model_s_order(monkeypatch):
    """No smaller order than the operator's own."""
    from brightquay.llm import katz

    orders = []
    monkeypatch.setattr(katz, "load", lambda *a: None)
    monkeypatch.setattr(katz, "katz_scores", lambda docs, order=katz.ORDER: orders.append(order))
    katz.op3_lm_scoring(None, "")
    assert orders == [katz.ORDER] and katz.ORDER >= 3


def test_scoring_with_katz_leaves_no_model_and_no_names_of_words(spark):
    """Only what the answer is read from stays on disk: numbered batches and replies, not the model's tables."""
    from pathlib import Path

    from brightquay.llm import common, exchange, katz

    docs = spark.createDataFrame([(i, f"a b c{i % 5} d b c{i % 3} e{i}") for i in range(40)], "doc_id long, text string")
    before, tables = {p for _, p in common._made}, {name for _, name, _ in exchange._tables}
    scored = katz.katz_scores(docs)
    assert scored.count() == 40
    left = [Path(p.removeprefix("file:")) for _, p in common._made if p not in before]
    assert left and not [x for p in left for x in p.glob(f"kind={katz._OF_MODEL}")]
    assert [spark.table(name).columns for _, name, _ in exchange._tables if name not in tables] == [katz._columns(katz._NUMBERED)]
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
