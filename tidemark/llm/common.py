"""Shared helpers of the training-data operators: inputs, work folders, ordered prefix sums, connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def renamed(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """The same rows with columns c0, c1, … and the names they had: clashing names do no harm then."""
    names = list(df.columns)
    return df.toDF(*[f"c{i}" for i in range(len(names))]), names


def restored(df: DataFrame, names: list[str]) -> DataFrame:
    """Undo renamed(); columns added meanwhile go."""
    return df.select(*[f"c{i}" for i in range(len(names))]).toDF(*names)


def place(names: list[str], name: str) -> str:
    """The c-name of a column: an exact match first, else the first that differs in case only."""
    for i, x in enumerate(names):
        if x == name:
            return f"c{i}"
    for i, x in enumerate(names):
        if x.lower() == name.lower():
            return f"c{i}"
    raise KeyError(f"no column {name!r} in {names}")


def only(df: DataFrame, *wanted: str) -> DataFrame:
    """Just these columns, whatever else there is."""
    plain, names = renamed(df)
    return plain.select(*[F.col(place(names, w)).alias(w) for w in wanted])


def work_path(spark: SparkSession, what: str) -> str:
    """A new folder that driver and executors share: below spark.checkpoint.dir. Where that is unset a local folder serves a
    local master, as in tests; on a cluster it is an error, as no other machine could read it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = f"file://{tempfile.mkdtemp(prefix='tidemark-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str, path: str | None = None) -> DataFrame:
    """Write and read back: cuts the lineage, and survives the loss of any executor."""
    spark = df.sparkSession
    path = path or work_path(spark, what)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ordered_store(df: DataFrame, order: list[str], what: str, parts: int | None = None, path: str | None = None) -> DataFrame:
    """Write rows in the given order, range-partitioned, with the number of their part in column `part`; read back.

    Nulls come first. Equal rows may change places, which nothing can tell."""
    spark = df.sparkSession
    parts = parts or shuffle_parts(spark)
    ranged = df.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id())
    return stored(ranged.sortWithinPartitions(*order), what, path)


def running_before(placed: DataFrame, order: list[str], sums: list[str]) -> DataFrame:
    """Adds <name>_before for every name in sums: its sum over all rows that come earlier.

    `placed` is what ordered_store() gives. Only one row for each part goes through the unpartitioned window."""
    totals = placed.groupBy("part").agg(*[F.sum(s).alias(f"{s}_t") for s in sums])
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select("part", *[F.coalesce(F.sum(f"{s}_t").over(earlier), F.lit(0)).alias(f"{s}_b") for s in sums])
    within = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = placed.select("*", *[F.coalesce(F.sum(s).over(within), F.lit(0)).alias(f"{s}_l") for s in sums])
    out = local.join(F.broadcast(base), "part")  # a row for each part: as many as shuffle partitions
    for s in sums:
        out = out.withColumn(f"{s}_before", F.col(f"{s}_l") + F.col(f"{s}_b"))
    return out.drop(*[f"{s}{x}" for s in sums for x in ("_l", "_b")])


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fold(doc_id: Column, mod: int) -> Column:
    """crc32 of the id as text, modulo mod; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % mod


def components(edges: DataFrame, what: str, max_rounds: int = 64) -> DataFrame:
    """Connected components of edges (a, b) of a type with an order: rows (node, root) with root the smallest node of the component.

    Alternating large-star and small-star rounds; each is written to the work folder, so that no lineage grows and no
    edge list reaches the driver. Nodes without an edge don't appear. Large-star joins a node's least neighbour back to
    its edges instead of gathering the neighbours, so a hub's edges need not meet in one task's memory. Both sides of a join
    are as large as the edges, so they are merged: of small ones Spark would make a broadcast each, whose table and thread
    stay with the driver for many rounds."""
    pairs = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    now = stored(pairs, what)
    before = None
    for _ in range(max_rounds):
        both = now.select("a", "b").unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least.hint("merge"), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low.hint("merge"), "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        now = stored(small, what)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components: not settled after {max_rounds} rounds")
    release(edges.sparkSession)
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(roots)


def empty_like(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], T._parse_datatype_string(schema))


def release(spark: SparkSession) -> None:
    """Let go of the shuffle files of finished phases: Spark deletes them when the driver's JVM has collected the plans
    that held them, which a quiet driver may not do for long."""
    spark.sparkContext._jvm.System.gc()
