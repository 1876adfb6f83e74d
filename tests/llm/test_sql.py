"""Queries with SQL against DuckDB, and the pipeline."""

import os

import duckdb
import pytest

import corpus_pipeline
from brightquay.llm import queries

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


@pytest.mark.parametrize("name", queries.oracle_sql())
def test_query(spark, name):
    """Equal rows."""
    con = duckdb.connect()
    for t in ("documents", "conversations", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = queries.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    r = con.sql(queries.oracle_sql()[name])
    at = [r.columns.index(c) for c in cols]
    text = lambda v: f"{v:.9g}" if isinstance(v, float) else repr(v)
    assert sorted(tuple(text(x[c]) for c in cols) for x in df.collect()) == sorted(tuple(text(x[i]) for i in at) for x in r.fetchall())


def test_pipeline_stages(spark):
    """Each stage works on what the one before kept, and its decisions hold."""
    from pyspark.sql import functions as F

    from brightquay.llm.common import write_table

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    made = {"start": docs}
    for name, stage in corpus_pipeline.STAGES:
        docs = write_table(stage(spark, docs, DATA), name)
        made[name] = docs
    ids = {k: {r.doc_id for r in v.select("doc_id").collect()} for k, v in made.items()}
    assert ids["start"] > ids["quality"] >= ids["exact"] >= ids["near"] >= ids["mixing"] == ids["packing"]
    assert all(made[k].columns == made["start"].columns for k in ("quality", "exact", "near", "mixing"))
    y = spark.read.parquet(f"{DATA}/labels.parquet").filter("quality = 1")
    clean = y.select("doc_id").distinct().count()
    assert y.join(made["quality"], "doc_id", "left_semi").select("doc_id").distinct().count() >= 0.97 * clean
    squeezed = F.translate("text", " \t\n\x0b\x0c\r", "")
    assert made["exact"].select(squeezed).distinct().count() == made["exact"].count()
    per = made["packing"].groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("m")).collect()
    assert all(r.n == r.m <= 4096 for r in per)
