"""The registered queries of the corpus operators over the given tables, and SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark.llm import alignment, collocations, decontam, licences, lm, mixing, packing, secret_scan, simhash, substring, topk, toxicity, url_rules
from cohortspark.llm.common import table


def op1_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    return toxicity.score(documents, toxicity.fit(documents, table(spark, folder, "labels")))


def op2_cover_tree_search(spark: SparkSession, folder: str) -> DataFrame:
    return topk.search(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0)


def op3_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    findings, _ = secret_scan.scan(table(spark, folder, "documents"), "doc_id", "text")
    return secret_scan.digest(findings, "doc_id")


def op4_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontam.digest(decontam.phrase_matches(table(spark, folder, "documents"), table(spark, folder, "benchmark")))


def op5_token_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"))


def op6_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents")).drop("source", "copies")


def op7_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substring.deduplicate(table(spark, folder, "documents"))


def op8_pitman_yor_scores(spark: SparkSession, folder: str) -> DataFrame:
    return lm.scored(table(spark, folder, "documents"))


def op9_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licences.scan(table(spark, folder, "documents"))


def op10_simhash_groups(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.printed(simhash.groups(table(spark, folder, "documents")))


def op11_tokenizer_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return alignment.aligned(table(spark, folder, "documents"))


def op12_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.mine(table(spark, folder, "documents"))


def op13_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return url_rules.judge(table(spark, folder, "pages"))


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_cover_tree_search, op3_secret_scan, op4_decontamination, op5_token_packing, op6_source_mixing, op7_substring_dedup, op8_pitman_yor_scores, op9_license_scan, op10_simhash_groups, op11_tokenizer_alignment, op12_collocations, op13_url_filter)}
ORACLE: dict[str, str] = {"op2_cover_tree_search": topk.ORACLE_SQL, "op4_decontamination": decontam.ORACLE_SQL, "op6_source_mixing": mixing.ORACLE_SQL, "op7_substring_dedup": substring.ORACLE_SQL, "op12_collocations": collocations.ORACLE_SQL, "op13_url_filter": url_rules.ORACLE_SQL}
