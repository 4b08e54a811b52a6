"""A table of measurements that keeps the newest of each operation.

Recording a batch rewrites only the operations that the batch has, and gives the same table however often and in whatever
order batches are recorded: the newest of what was kept and what is new are the newest of all. Rows are told apart by id.

Defined cases. A null operation is one of its own; a row without a time is older than all others. One writer at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import docs

from . import work

#: Measurements kept of an operation.
KEEP = 10


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What the table holds; nothing where there is none yet."""
    none = spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path).select(*none.columns) if exists(spark, path) else none


def exists(spark: SparkSession, path: str) -> bool:
    from pyspark.errors import AnalysisException

    try:
        spark.read.format("binaryFile").load(path).limit(0).count()
        return True
    except AnalysisException:
        return False


def record(batch: DataFrame, path: str, keep: int = KEEP) -> None:
    """Add rows (op, t, id, …) to the table at `path`, which is partitioned by `op`. A write that fails is done again whole."""
    spark = batch.sparkSession
    schema = ", ".join(f"`{n}` {t}" for n, t in batch.dtypes)
    touched = batch.select("op").distinct()
    table = read(spark, path, schema)
    held = table.join(touched.select(F.col("op").alias("_op")), F.col("op").eqNullSafe(F.col("_op")), "left_semi")
    newest = docs.keep_newest(held.unionByName(batch).dropDuplicates(["op", "id"]), ["op"], keep)
    ready = work.folder(spark, "measures")  # what is written over can't be read at the same time
    newest.write.parquet(ready)
    out = spark.read.schema(schema).parquet(ready).select(*[n for n, _ in batch.dtypes])
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("op").parquet(path)
