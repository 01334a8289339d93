"""The corpus pipeline: classify, de-duplicate, decontaminate, mix, write token ids.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; all but the last
return the columns of ``documents``. Between stages the rows are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm.common import row_key, small, stored, table
from cohortlens.llm.decontaminate import decontaminate
from cohortlens.llm.mixing import mixed_documents
from cohortlens.llm.near_dedup import BROADCAST_IDS, near_duplicates
from cohortlens.llm.ordered import numbered
from cohortlens.llm.quality_crf import scored, train
from cohortlens.llm.token_output import read_digests, write_ids

NODE = "pipeline_node"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose lines the classifier holds for good (score of at least 0.5); NULL is the empty text."""
    model = train(docs, table(spark, sf_dir, "labels"))
    return scored(docs, model, "quality_score").filter("quality_score >= 0.5").drop("quality_score")


def _named(docs: DataFrame) -> DataFrame:
    """``docs`` with ``NODE``, a number per (doc_id, text): the doc_id itself where ids are there and unique, else the place in their order."""
    repeated = docs.groupBy("doc_id").count().filter("doc_id IS NULL OR count > 1")
    if not repeated.limit(1).count():
        return docs.withColumn(NODE, F.col("doc_id").cast("bigint"))
    keyed = docs.withColumn("node_key", row_key("doc_id", "text"))
    keys = keyed.select("node_key", "doc_id").distinct().withColumn("all", F.lit(0).cast("bigint"))
    names = numbered(keys, "all", ["doc_id", "node_key"]).select("node_key", F.col("at").alias(NODE))
    return stored(keyed.join(names, "node_key").select(*docs.columns, NODE), "named")


def _without(named: DataFrame, gone: DataFrame) -> DataFrame:
    return named.join(small(stored(gone.select(F.col("doc_id").alias(NODE)).distinct(), "gone"), BROADCAST_IDS), NODE, "left_anti")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group, five words, similarity 0.8: that with the smallest doc_id (NULL first), then the smallest key.

    Different texts that share a doc_id, or have none, are documents of their own. Of rows with the same id and text the
    smallest by its other columns stays.
    """
    named = _named(docs)
    groups = near_duplicates(named.select(F.col(NODE).alias("doc_id"), "text"), threshold=0.8, width=5)
    left = _without(named, groups.filter("NOT kept"))
    again = stored(left.groupBy(NODE).count().filter("count > 1").select(NODE), "repeats")
    if not again.limit(1).count():
        return left.drop(NODE)
    few = small(again, BROADCAST_IDS)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    one = left.join(few, NODE, "left_semi").groupBy(NODE).agg(F.min(row).alias("row")).select("row.*")
    return left.join(few, NODE, "left_anti").drop(NODE).unionByName(one)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text the benchmark query does not report as contaminated, whatever other rows share their doc_id."""
    named = _named(docs)
    found = decontaminate(named.select(F.col(NODE).alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    return _without(named, found.filter("contaminated")).drop(NODE)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's weight asks: 0.95 of the largest entropy, or the nearest to it that 4 passes at most allow."""
    return mixed_documents(docs, budget_share=1.0, target_entropy=0.95, max_epochs=4.0)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of all documents, written, read back and digested."""
    return read_digests(spark, write_ids(docs))


STAGES = [
    ("quality_classifier", quality),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("token_output", token_output),
]

#: SQL cannot express the line classifier; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
