"""Queries over model artifacts, versions, tombstone files, reports and the order of candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brightquay.operators import evaluate, publish, ranking
from brightquay.plans.board import day_ms, table
from brightquay.session import scratch
from brightquay.sources.reports import markdown

NAMES = ("size", "price", "age")
HYPER = {"rate": 0.05, "steps": 2000, "l2": 0.001}


def accepted_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model artifact per customer as JSON, some cut or wrong in one respect, and whether it may rank the board."""
    k, names = F.col("c_custkey"), F.when(F.col("c_custkey") % 5 == 0, '["price","size","age"]').otherwise('["size","price","age"]')
    third = F.when(k % 7 == 0, "").when(k % 19 == 0, ',"1.5"').when(k % 23 == 0, ",1e999").when(k % 29 == 0, ",null").otherwise(",-0.25")
    raw = F.concat(
        F.lit('{"feature_names":'), names, F.lit(',"weights":['), F.col("c_nationkey").cast("string"), F.lit(",0.5"), third, F.lit('],"bias":'), F.when(k % 11 == 0, "null").otherwise("0.125"),
        F.lit(',"model_version":"'), F.when(k % 13 == 0, "").otherwise("syn-1"), F.lit('"}'),
    )
    c = table(spark, sf_dir, "customer").select("c_custkey", ranking.model_of(F.when(k % 17 == 0, F.substring(raw, 1, 40)).otherwise(raw)).alias("m"))
    ok = ranking.accepted(F.col("m"), NAMES)
    return c.select("c_custkey", ok.alias("accepted"), F.when(ok, F.try_element_at("m.weights", F.lit(1))).alias("first"))


ACCEPTED_MODELS = """
WITH c AS (SELECT c_custkey, c_nationkey, NOT (c_custkey % 5 = 0 OR c_custkey % 7 = 0 OR c_custkey % 19 = 0 OR c_custkey % 23 = 0 OR c_custkey % 29 = 0 OR c_custkey % 11 = 0 OR c_custkey % 13 = 0 OR c_custkey % 17 = 0) AS accepted FROM customer)
SELECT c_custkey, accepted, CASE WHEN accepted THEN c_nationkey END::DOUBLE AS first FROM c
"""


def model_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The version that a model of each day of the log would carry."""
    e = table(spark, sf_dir, "events").withColumn("ms", day_ms("ts"))
    e = e.select(F.floor(F.col("ms") / 86_400_000).alias("day"), F.concat_ws("|", "event_id", "ms", "user_id", "event_type").alias("line"), (F.coalesce(F.col("event_type") == "error", F.lit(False)) & F.coalesce(F.col("value") > 99, F.lit(False))).alias("organic"))
    per = e.groupBy("day").agg(F.count("*").alias("n"), F.count_if("organic").alias("organic"), evaluate.rows_sha256(F.col("line")).alias("log"))
    return per.select("day", "n", evaluate.version_of(NAMES, HYPER, 1.0, 10.0, F.col("n"), F.col("log"), F.col("organic")).alias("version"))


MODEL_VERSIONS = """
WITH e AS (SELECT epoch_us(ts) // 1000 AS ms, event_type = 'error' AND value > 99 AS organic, sha256(concat_ws('|', event_id, epoch_us(ts) // 1000, user_id, event_type)) AS h FROM events),
p AS (SELECT ms // 86400000 AS day, count(*) AS n, count(*) FILTER (WHERE organic) AS organic, sha256(sum(CAST('0x' || substr(h, 1, 15) AS HUGEINT)) || '/' || sum(CAST('0x' || substr(h, 16, 15) AS HUGEINT))) AS log FROM e GROUP BY 1)
SELECT day, n, CASE WHEN organic > 0 THEN 'web-' ELSE 'syn-' END || left(sha256('{"features":["size","price","age"],"hyperparameters":{"rate":0.05,"steps":2000,"l2":0.001},"eta":1.0,"cap":10.0,"rows":' || n || ',"log":"' || log || '"}'), 10) AS version FROM p
"""


def tombstone_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tombstones of orders, written and read back; of a file that is absent, and of a folder where one file cannot be read."""
    at = scratch(spark, "tombstones")
    o = table(spark, sf_dir, "orders").filter("o_orderstatus <> 'O'")
    stones = o.select(F.concat(F.lit("https://o/"), "o_orderkey").alias("url"), F.when(F.col("o_orderstatus") == "F", "delete").otherwise("redact").alias("action"), F.when(F.col("o_orderstatus") == "P", F.array(F.lit("title"), F.lit("venue"))).alias("fields"), F.concat(F.lit("asked: \"o\" "), "o_orderpriority").alias("reason"))
    publish.write_tombstones(stones, f"{at}/whole")
    publish.write_tombstones(stones, f"{at}/torn")
    spark.range(1).select(F.lit('{"tombstones": [{"url": ').alias("value")).write.mode("append").text(f"{at}/torn")
    read = publish.read_tombstones(spark, f"{at}/whole")
    try:
        torn = publish.read_tombstones(spark, f"{at}/torn").withColumn("what", F.lit("torn"))
    except ValueError:
        torn = spark.range(1).select(F.lit("torn").alias("url"), F.lit("abort").alias("action"), F.lit(None).cast("array<string>").alias("fields"), F.lit("").alias("reason"), F.lit("torn").alias("what"))
    absent = publish.read_tombstones(spark, f"{at}/none").withColumn("what", F.lit("absent"))
    every = read.withColumn("what", F.lit("whole")).unionByName(absent).select("what", "url", "action", "fields", "reason").unionByName(torn.select("what", "url", "action", "fields", "reason"))
    return every.groupBy("what", "action").agg(F.count("*").alias("n"), F.countDistinct("url").alias("urls"), F.sum(F.coalesce(F.size("fields"), F.lit(0))).alias("fields"), F.max("reason").alias("reason"))


TOMBSTONE_FILES = """
SELECT 'whole' AS what, CASE o_orderstatus WHEN 'F' THEN 'delete' ELSE 'redact' END AS action, count(*) AS n, count(DISTINCT o_orderkey) AS urls, sum(CASE o_orderstatus WHEN 'P' THEN 2 ELSE 0 END)::BIGINT AS fields, max('asked: "o" ' || o_orderpriority) AS reason
FROM orders WHERE o_orderstatus <> 'O' GROUP BY 2 UNION ALL SELECT 'torn', 'abort', 1, 1, 0, ''
"""


def brand_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a Markdown report of brands; a measure without rows is n/a."""
    p = table(spark, sf_dir, "part")
    size = F.col("p_size").cast("long")
    rms = lambda when: F.sqrt(F.avg(F.when(when, size * size)))
    df = p.groupBy(F.col("p_brand").alias("brand")).agg(F.count("*").alias("parts"), rms(F.lit(True)).alias("rms"), rms(size > 49).alias("large")).orderBy("brand")
    return spark.createDataFrame(list(enumerate(markdown(df).splitlines())), "line int, text string")


BRAND_REPORT = """
WITH b AS (SELECT p_brand, count(*) AS n, sqrt(avg(p_size * p_size)) AS rms, sqrt(avg(p_size * p_size) FILTER (WHERE p_size > 49)) AS large FROM part GROUP BY 1)
SELECT 0 AS line, '| brand | parts | rms | large |' AS text UNION ALL SELECT 1, '| --- | --- | --- | --- |'
UNION ALL SELECT CAST(row_number() OVER (ORDER BY p_brand) + 1 AS INT), '| ' || p_brand || ' | ' || n || ' | ' || coalesce(printf('%.4f', rms), 'n/a') || ' | ' || coalesce(printf('%.4f', large), 'n/a') || ' |' FROM b
"""


def relevance_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents by relevance, the most relevant first, ties as they were found."""
    d = table(spark, sf_dir, "documents")
    found = d.select("doc_id", F.coalesce(F.regexp_count("text", F.lit("[Aa]n")), F.lit(0)).alias("relevance"))
    return ranking.placed(found, F.desc("relevance"), F.asc("doc_id"), name="place")


RELEVANCE_ORDER = """
WITH d AS (SELECT doc_id, coalesce(len(regexp_extract_all(text, '[Aa]n')), 0)::INT AS relevance FROM documents)
SELECT doc_id, relevance, row_number() OVER (ORDER BY relevance DESC, doc_id) AS place FROM d
"""

QUERIES = {
    "accepted_models": (accepted_models, ACCEPTED_MODELS),
    "model_versions": (model_versions, MODEL_VERSIONS),
    "tombstone_files": (tombstone_files, TOMBSTONE_FILES),
    "brand_report": (brand_report, BRAND_REPORT),
    "relevance_order": (relevance_order, RELEVANCE_ORDER),
}
