"""A corpus pipeline of five stages, each by one of the operators: toxic documents go, repeated lines go, one document of
each group of near copies stays, documents with benchmark passages go, and what remains is packed.

Defined cases, as the operators define them: a null text is an empty one and is kept by the first two stages; all texts
without words are one group of copies, of which one stays; rows equal in id and text are one document until the copies go,
rows of one id with different texts are documents of their own; a null id comes first in packing and is kept last among
copies. Very long texts are taken whole. Extra columns, also with clashing names, are kept by all stages but the last. Without
labels toxicity goes by its seed list; an empty table, or an empty benchmark, gives the rows that this leaves, down to none."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import common, decontamination, line_dedup, packing, simhash_dedup, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lexicon and curve are learned from all documents of the folder that are labelled."""
    model = toxicity.fit(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
    return toxicity.accepted(docs, model)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.deduplicated(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash_dedup.one_of_each(docs)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.clean(docs, common.table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("SimHash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_benchmark_passages),
    ("packing", pack),
]

#: Aho-Corasick scores, SimHash groups and tokens are beyond SQL: tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage over the folder's documents; what each stage leaves is written and read again."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
