"""The numbered corpus queries: each takes (spark, sf_dir) and covers its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cohortlens.llm import sql
from cohortlens.llm.common import table
from cohortlens.llm.decontaminate import decontaminate
from cohortlens.llm.divergence import quality_rules
from cohortlens.llm.language_fusion import identify
from cohortlens.llm.mixing import mix
from cohortlens.llm.near_dedup import near_duplicates
from cohortlens.llm.packing import pack, read_pieces
from cohortlens.llm.pii import find_personal_data
from cohortlens.llm.prefix_trie import conversation_trie
from cohortlens.llm.quality_crf import classify
from cohortlens.llm.runs import digested, periodic_runs
from cohortlens.llm.secrets import scan_secrets
from cohortlens.llm.token_output import read_digests, write_ids
from cohortlens.llm.warc_fixity import audit, worn_replica


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), threshold=0.8, width=4)


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return audit(pages, worn_replica(pages))


def op7_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_digests(spark, write_ids(table(spark, sf_dir, "documents")))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), budget_share=1.0, target_entropy=0.95, max_epochs=4.0)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(table(spark, sf_dir, "documents"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digested(periodic_runs(table(spark, sf_dir, "documents"), plant=True))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(table(spark, sf_dir, "conversations"), plant=True)


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_pieces(spark, pack(table(spark, sf_dir, "documents")))


_ALL = (
    op1_near_dedup, op2_secrets, op3_quality_rules, op4_quality_classifier, op5_decontamination,
    op6_warc_fixity, op7_token_output, op8_language, op9_mixing, op10_pii, op11_periodic_runs, op12_prefix_trie, op13_packing,
)
QUERIES = {f.__name__: f for f in _ALL}
SQL = {"op1_near_dedup": sql.OP1, "op5_decontamination": sql.OP5, "op6_warc_fixity": sql.OP6, "op9_mixing": sql.OP9, "op12_prefix_trie": sql.OP12}
