"""Queries on source text that need parsers, and the SQL of those that don't."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import code_ir as C
from ..operators import imports as I
from ..operators import repair as R
from ..runtime import table


def _sources(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "source_files", "analysis_id", "path", "content")


def import_edges(spark: SparkSession, d: str) -> DataFrame:
    return I.imports(_sources(spark, d))


def module_nodes(spark: SparkSession, d: str) -> DataFrame:
    return I.module_graph(_sources(spark, d))[0]


def ir_metrics(spark: SparkSession, d: str) -> DataFrame:
    return C.metrics(C.nodes(_sources(spark, d)))


def ir_findings(spark: SparkSession, d: str) -> DataFrame:
    return C.findings(C.nodes(_sources(spark, d)))


def ir_health(spark: SparkSession, d: str) -> DataFrame:
    return C.file_health(C.nodes(_sources(spark, d))).withColumn("health", F.round("health", 6))


def ir_live_definitions(spark: SparkSession, d: str) -> DataFrame:
    return C.live_definitions(C.nodes(_sources(spark, d)))


def resource_leaks(spark: SparkSession, d: str) -> DataFrame:
    return C.leaks(C.nodes(_sources(spark, d)))


def code_functions(spark: SparkSession, d: str) -> DataFrame:
    return R.functions(_sources(spark, d))


def function_spans(spark: SparkSession, d: str) -> DataFrame:
    return R.spans(_sources(spark, d))


def repair_findings(spark: SparkSession, d: str) -> DataFrame:
    return R.findings(_sources(spark, d))


def repair_by_rule(spark: SparkSession, d: str) -> DataFrame:
    return R.findings(_sources(spark, d), 0).groupBy("engine", "rule", "severity").agg(F.count(F.lit(1)).alias("n"))


def repair_recommendations(spark: SparkSession, d: str) -> DataFrame:
    return R.recommendations(R.findings(_sources(spark, d), 0))


QUERIES = {f.__name__: f for f in (import_edges, module_nodes, ir_metrics, ir_findings, ir_health, ir_live_definitions, resource_leaks, code_functions, function_spans, repair_findings, repair_by_rule, repair_recommendations)}
SQL: dict[str, str] = {}
