"""The queries of this folder, each over a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from recordloom.llm import (
    dualtree, graphsearch, laesacodes, mixing, packing, parityjoin, pii, pivottable, preference, repeats, rules, tokenstore, twins, urls,
)
from recordloom.llm.shared import table


def op1_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    return pii.query(table(spark, folder, "documents"))


def op2_preference_quality(spark: SparkSession, folder: str) -> DataFrame:
    return preference.query(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op3_parity_join(spark: SparkSession, folder: str) -> DataFrame:
    return parityjoin.query(table(spark, folder, "documents"))


def op4_token_store(spark: SparkSession, folder: str) -> DataFrame:
    return tokenstore.query(table(spark, folder, "documents"))


def op5_bucket_refinement(spark: SparkSession, folder: str) -> DataFrame:
    return repeats.query(table(spark, folder, "documents"))


def op6_graph_search(spark: SparkSession, folder: str) -> DataFrame:
    return graphsearch.query(table(spark, folder, "embeddings"))


def op7_url_rules(spark: SparkSession, folder: str) -> DataFrame:
    return urls.query(table(spark, folder, "pages"), table(spark, folder, "labels"))


def op8_retrieval_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.query(table(spark, folder, "documents"))


def op9_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.query(table(spark, folder, "documents"))


def op10_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return rules.query(table(spark, folder, "documents"))


def op11_pivot_search(spark: SparkSession, folder: str) -> DataFrame:
    return pivottable.query(table(spark, folder, "embeddings"))


def op12_laesa_codes(spark: SparkSession, folder: str) -> DataFrame:
    return laesacodes.query(table(spark, folder, "embeddings"))


def op13_dual_tree_search(spark: SparkSession, folder: str) -> DataFrame:
    return dualtree.query(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    return corpus_pipeline.run(spark, folder)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_personal_data, op2_preference_quality, op3_parity_join, op4_token_store, op5_bucket_refinement, op6_graph_search,
        op7_url_rules, op8_retrieval_packing, op9_source_mix, op10_quality_rules, op11_pivot_search, op12_laesa_codes,
        op13_dual_tree_search, pipeline,
    )
}
ORACLE: dict[str, str] = {"op11_pivot_search": twins.OP11, "op12_laesa_codes": twins.op12(), "op13_dual_tree_search": twins.OP13}
