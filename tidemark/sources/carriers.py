"""Views of the test tables in the shapes the operators take: points, intervals, words, turns, vectors, states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HOUR, MINUTE, SECOND = 3_600_000_000, 60_000_000, 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt over all cores where the source gives fewer parts, as a small file does; what has parts enough is left as it
    is read, without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def micros(ts: str) -> Column:
    """Microseconds since 1970 of a timestamp without time zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {ts})")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, id, kind, t, cents): events of users at microseconds, with a value in hundredths."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), F.col("event_type").alias("kind"), micros("ts").alias("t"), F.round(F.col("value") * 100).cast("long").alias("cents"))


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, id, s, e): each event lasts as many minutes as its value says."""
    return points(spark, sf_dir).select("key", "id", F.col("t").alias("s"), (F.col("t") + F.col("cents") * (MINUTE // 100)).alias("e"))


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), "lang", "text"))


def spoken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, words): the words of whole texts in one row."""
    return texts(spark, sf_dir).select("key", F.array_remove(F.split(F.trim("text"), r"\s+"), "").alias("words"))


def word_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, lang, words): the words of whole texts in one row, each at its place; what stands for no word is empty."""
    return texts(spark, sf_dir).select("key", "lang", F.split(F.trim("text"), r"\s+").alias("words"))


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, lang, i, w): the words of whole texts, one every 300 ms on the words' clock."""
    d = texts(spark, sf_dir)
    split = d.select("key", "lang", F.posexplode(F.split(F.trim("text"), r"\s+")).alias("i", "w"))
    return split.where("w <> ''").select("key", "lang", F.col("i").cast("long").alias("i"), "w")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("key"), F.col("turn").alias("i"), F.col("role").alias("spk"), "text")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", "embedding")


def shipping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, id, s, e): per customer the span of days over which each order ships."""
    o, l = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    spans = l.groupBy("l_orderkey").agg(F.min(micros("l_shipdate")).alias("s"), F.max(micros("l_shipdate")).alias("e"))
    return o.join(spans, o["o_orderkey"] == spans["l_orderkey"]).select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("id"), "s", "e")


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, id, t, kind, k): settings that users' events carry as JSON."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), micros("ts").alias("t"), F.col("event_type").alias("kind"), F.get_json_object("props", "$.k").alias("k"))


#: The same views for DuckDB, to be put before a query.
SQL = {
    "points": "points AS (SELECT user_id AS key, event_id AS id, event_type AS kind, epoch_us(ts) AS t, CAST(round(value * 100) AS BIGINT) AS cents FROM events)",
    "intervals": "intervals AS (SELECT user_id AS key, event_id AS id, epoch_us(ts) AS s, epoch_us(ts) + CAST(round(value * 100) AS BIGINT) * 600000 AS e FROM events)",
    "words": r"words AS (SELECT key, lang, i, w FROM (SELECT doc_id AS key, lang, CAST(generate_subscripts(string_split_regex(trim(text), '\s+'), 1) - 1 AS BIGINT) AS i, unnest(string_split_regex(trim(text), '\s+')) AS w FROM documents) WHERE w <> '')",
    "turns": "turns AS (SELECT conv_id AS key, turn AS i, role AS spk, text FROM conversations)",
    "shipping": "shipping AS (SELECT o_custkey AS key, o_orderkey AS id, min(epoch_us(l_shipdate)) AS s, max(epoch_us(l_shipdate)) AS e FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2)",
    "states": "states AS (SELECT user_id AS key, event_id AS id, epoch_us(ts) AS t, event_type AS kind, json_extract_string(props, '$.k') AS k FROM events)",
}


def sql_with(*views: str) -> str:
    return "WITH " + ", ".join(SQL[v] for v in views)
