"""Repositories on disk as the tables that all queries read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import IMPORT_LANGUAGES, IR_LANGUAGES, language_of
from ..operators.imports import module_graph
from .files import PRUNED, code_files
from .gitlog import register

ENDINGS = tuple(sorted({e for ends in (*IR_LANGUAGES.values(), *IMPORT_LANGUAGES.values()) for e in ends}))


def _write(df: DataFrame, folder: str, name: str) -> None:
    df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")


def snapshot(spark: SparkSession, repositories: list[str], folder: str, max_commits: int | None = 10_000) -> None:
    """Write process_commits, process_file_changes, source_files, dep_nodes and dep_edges of git repositories below folder.

    An analysis is named after its repository. Rows are loaded at the time of their commit; a repository without commits gives
    its files only, one without files its history only.
    """
    register(spark)
    log = spark.read.format("gitlog").option("max_commits", max_commits or 0).load(",".join(repositories))
    _write(log, folder, "_log")  # each repository is walked once
    log = spark.read.parquet(f"{folder}/_log.parquet")
    at = F.timestamp_millis("timestamp_ms").cast("timestamp_ntz").alias("loaded_at")
    row = F.monotonically_increasing_id().alias("row_id")
    commits = log.select("hash", "author", "author_email", "timestamp_ms", "message", "is_merge", "analysis_id", at).distinct()
    _write(commits.select(row, "*"), folder, "process_commits")
    changes = log.where("file_path IS NOT NULL").select(F.col("hash").alias("commit_hash"), "file_path", "lines_added", "lines_deleted", "change_type", "analysis_id", at)
    _write(changes.select(row, "*"), folder, "process_file_changes")
    files = None
    for repository in repositories:
        name = repository.rstrip("/").rsplit("/", 1)[-1]
        part = code_files(spark, repository, ENDINGS, PRUNED).select(F.lit(name).alias("analysis_id"), "path", "content")
        files = part if files is None else files.unionByName(part)
    language = F.coalesce(language_of(F.col("path"), IMPORT_LANGUAGES, True), language_of(F.col("path"), IR_LANGUAGES, False))
    _write(files.select("analysis_id", "path", language.alias("language"), "content"), folder, "source_files")
    nodes, edges = module_graph(spark.read.parquet(f"{folder}/source_files.parquet"))
    never = F.lit(None).cast("timestamp_ntz").alias("loaded_at")
    _write(nodes.select(row, "id", F.when(F.col("internal"), F.col("id")).alias("file_path"), F.substring_index("id", ".", -1).alias("module_name"), F.lit(None).cast("string").alias("language"), "analysis_id", never), folder, "dep_nodes")
    _write(edges.select(row, "source_id", "target_id", "line", "kind", "analysis_id", never), folder, "dep_edges")
