"""The corpus pipeline: each stage works on all that the one before it kept.

Every stage's result is written as Parquet under the folder the cluster shares (spark.checkpoint.dir) and reread
as the next stage's documents. Stages keep rows whole: texts are not rewritten.

A filtering stage numbers its rows and decides about each row by itself: rows without an id and rows that share an id
stay or go for their own texts. Only the numbers of the rows that go are joined back to the documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from stowline.llm.decontamination import contamination
from stowline.llm.near_dup import near_duplicates
from stowline.llm.packing import pack
from stowline.llm.quality import judge_documents
from stowline.llm.queries import END_ID, SEQUENCE, TOKENIZER
from stowline.llm.tables import stored, table
from stowline.session import joinable


# whole texts travel to Python workers in batches; every core holds one on both sides
BATCH_ROWS = 1_000


def _small_batches(spark: SparkSession) -> None:
    """At most BATCH_ROWS texts at a time in each task's Arrow buffers; a smaller setting stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """The documents with a row number in a column of its own, stored so that all readers see the same numbers."""
    _small_batches(docs.sparkSession)
    row, taken = "row", {name.lower() for name in docs.columns}
    while row in taken:
        row += "_"
    return stored(docs.withColumn(row, F.monotonically_increasing_id()), "numbered"), row


def _without(docs: DataFrame, row: str, rejected: DataFrame) -> DataFrame:
    """The documents whose numbers are not among the rejected; these are broadcast only when few."""
    gone = joinable(stored(rejected.select(row), "rejected"))
    return docs.join(gone, row, "left_anti").drop(row)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text the quality rules reject go, null and empty texts among them. An empty table stays empty."""
    numbered, row = _numbered(docs)
    return _without(numbered, row, judge_documents(numbered, row).filter(~F.col("kept")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates stays: the one with the smallest id, or a row without an id if none has one.

    Of several rows with that id the first numbered one stays. Rows without words are linked with nothing and stay.
    """
    numbered, row = _numbered(docs)
    found = stored(near_duplicates(numbered, row).select(row, "component_id"), "row-components")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", row)
    firsts = found.join(numbered.select(row, "doc_id"), row).groupBy("component_id").agg(F.min_by(row, order).alias(row))
    return _without(numbered, row, found.join(firsts.select(row), row, "left_anti"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text holds a benchmark passage go; null and empty texts hold none."""
    numbered, row = _numbered(docs)
    return _without(numbered, row, contamination(numbered, table(spark, sf_dir, "benchmark"), key=row).filter("contaminated"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The remaining documents, packed into sequences; rows without an id and repeated ids are packed a row each."""
    _small_batches(spark)
    return pack(docs, public_tokenizers.path(TOKENIZER), END_ID, SEQUENCE)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]
# Similarity of whole shingle sets and packing by dominance cannot be expressed in SQL within reason.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
