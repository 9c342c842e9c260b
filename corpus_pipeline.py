"""From raw documents to packed training sequences: five stages over one table of documents.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next one's documents; all but the last return the columns of documents, extra ones included,
whatever their names. An empty table stays empty through all stages; texts are judged whole, however long.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeflow.llm.common import scratch, table, written
from treeflow.llm.op1_decontaminate import decontaminated
from treeflow.llm.op2_secrets import redacted
from treeflow.llm.op4_near_dedup import near_duplicates
from treeflow.llm.op9_packing import packed
from treeflow.llm.op10_quality import accepted


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts.

    Every row is judged by its own text, a null one as empty; rows that repeat have the same fate, rows
    without an id are judged like others. Without labels of both kinds nothing is rejected.
    """
    return accepted(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest id.

    Rows that repeat an id are one document: of their rows that with the smallest text stays, once, and all
    go if one of their texts is a duplicate of a smaller id's. Rows without an id all stay, and so do
    documents with null texts and texts without words, which are like nothing.
    """
    again = docs.groupBy("doc_id").agg(F.count("*").alias("rows")).filter("rows > 1 AND doc_id IS NOT NULL").select("doc_id")
    # Only the ids that go are joined back: rows whose id isn't its component's smallest.
    gone = near_duplicates(docs).filter(F.col("doc_id").isNotNull() & ~F.col("kept")).select("doc_id").distinct()
    left = docs.join(written(gone, "duplicates"), "doc_id", "left_anti").select(*docs.columns)
    again = written(again, "repeated")
    if again.isEmpty():
        return left
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    first = F.min(F.struct("text", *rest)).alias("first")
    once = left.join(again, "doc_id").groupBy("doc_id").agg(first).select("doc_id", "first.*").select(*docs.columns)
    return left.join(again, "doc_id", "left_anti").select(*docs.columns).unionAll(once)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a substantial part of a benchmark item.

    Every row is judged by its own text: null and empty ones stay, rows that repeat stay or go together.
    """
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; secrets in their texts are replaced by the kind of secret.

    Null and empty texts and rows that repeat stay as they are many.
    """
    return redacted(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in full training sequences.

    A null text is an empty one, which is a single end; every row is a document, with or without an id.
    """
    return packed(docs)


STAGES = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("packing", packing),
]

#: The classifier is fitted and texts are tokenized, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
