"""Commit references: spellings of a hash to the commit they stand for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import join_measured

SHORT_MIN, SHORT_MAX = 8, 39


def short_refs(refs: DataFrame, commits: DataFrame) -> DataFrame:
    """What the shortened references stand for.

    refs (analysis_id, ref) and commits (analysis_id, hash) hold normalised hashes. A reference of 8 to 39 characters
    resolves to the commit of that very hash, or else to the only commit of its analysis that begins with it.
    Both sides are reduced to distinct keys and joined on the first eight characters, so no row count of a single
    reference or commit reaches the join.

    Result: analysis_id, ref, hash, one row for each reference that resolves.
    """
    short = refs.where(F.length("ref").between(SHORT_MIN, SHORT_MAX) & F.col("analysis_id").isNotNull()).select("analysis_id", "ref").distinct()
    known = commits.where(F.length("hash") >= SHORT_MIN).select("analysis_id", "hash").distinct()
    head = F.substring(F.col("ref"), 1, SHORT_MIN).alias("head")
    pairs = short.select("analysis_id", "ref", head).join(known.select("analysis_id", "hash", F.substring("hash", 1, SHORT_MIN).alias("head")), ["analysis_id", "head"])
    return (
        pairs.where(F.startswith("hash", "ref"))
        .groupBy("analysis_id", "ref")
        .agg(F.count(F.lit(1)).alias("n"), F.min("hash").alias("one"), F.max(F.col("hash") == F.col("ref")).alias("exact"))
        .where(F.col("exact") | (F.col("n") == 1))
        .select("analysis_id", "ref", F.when(F.col("exact"), F.col("ref")).otherwise(F.col("one")).alias("hash"))
    )


def resolve(rows: DataFrame, commits: DataFrame) -> DataFrame:
    """rows (analysis_id, ref, ...) with the column ``hash``: what ref resolves to, or ref itself if it is no known short form.

    Only rows whose reference is short meet the resolution table; all others pass through without a shuffle. The table is
    written once, so a plan that uses the result twice resolves once, and broadcast if it is counted to be small.
    Whether the commit exists is left to the join that follows. Null references stay null.
    """
    is_short = F.length("ref").between(SHORT_MIN, SHORT_MAX)
    plain = rows.where(F.col("ref").isNull() | ~is_short).withColumn("hash", F.col("ref"))
    some = rows.where(is_short)
    found = short_refs(some, commits).withColumnRenamed("hash", "__resolved")
    joined = join_measured(some, found, ["analysis_id", "ref"], "left")
    return plain.unionByName(joined.withColumn("hash", F.coalesce("__resolved", "ref")).drop("__resolved"))
