"""Change history: one row per change, per-file features, co-change, findings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import is_bug_fix
from ..runtime import cut, normal_hash, table
from .commit_refs import resolve
from .pairs import pair_counts

DAY_MS = 86_400_000.0
FILE = ["analysis_id", "file_path"]


def commits_of(spark: SparkSession, folder: str) -> DataFrame:
    """One row per commit (analysis_id, hash); of repeated rows the one loaded first. ``now`` is the newest time of the analysis."""
    rows = table(spark, folder, "process_commits").select("analysis_id", normal_hash("hash").alias("hash"), "author", "author_email", F.col("timestamp_ms").alias("ts"), "message", "is_merge", "loaded_at", "row_id")
    first = F.min_by(F.struct("author", "author_email", "ts", "message", "is_merge"), F.struct("loaded_at", "row_id")).alias("c")
    return rows.where(F.col("hash").isNotNull()).groupBy("analysis_id", "hash").agg(first).select("analysis_id", "hash", "c.*")


def changes_of(spark: SparkSession, folder: str) -> DataFrame:
    """One row per change (analysis_id, hash, file_path) of a known commit with a time, with the commit's columns.

    Of rows that repeat a change the larger counts stand, as everywhere. Rows are reduced to changes before they meet the commits; n_files (files of the commit) travels with the
    commit side, so the changes are shuffled once more for the join and not for the count.
    """
    commits = commits_of(spark, folder).where(F.col("ts").isNotNull())
    rows = table(spark, folder, "process_file_changes", "analysis_id", "commit_hash", "file_path", "lines_added", "lines_deleted", "change_type", "loaded_at", "row_id").where(
        F.col("file_path").isNotNull() & F.col("commit_hash").isNotNull()
    )
    rows = rows.select("analysis_id", normal_hash("commit_hash").alias("ref"), "file_path", "lines_added", "lines_deleted", "change_type", "loaded_at", "row_id")
    zero = F.lit(0)
    states = [F.max(F.coalesce("lines_added", zero)).alias("added"), F.max(F.coalesce("lines_deleted", zero)).alias("deleted"), F.min_by("change_type", F.struct("loaded_at", "row_id")).alias("change_type")]
    known = table(spark, folder, "process_commits", "analysis_id", "hash").select("analysis_id", normal_hash("hash").alias("hash")).where(F.col("hash").isNotNull())
    changes = resolve(rows, known).groupBy("analysis_id", "hash", "file_path").agg(*states)
    sizes = changes.groupBy("analysis_id", "hash").agg(F.count(F.lit(1)).alias("n_files"))
    newest = commits.groupBy("analysis_id").agg(F.max("ts").alias("now"))
    return changes.join(commits.join(sizes, ["analysis_id", "hash"]).join(newest, "analysis_id"), ["analysis_id", "hash"])


def average_lines(changes: DataFrame) -> DataFrame:
    """Lines of each change as its commit's totals divided by its number of files (integer division), for parity with sources that know only totals."""
    totals = changes.groupBy("analysis_id", "hash").agg(F.sum("added").alias("a"), F.sum("deleted").alias("d"))
    return changes.drop("added", "deleted").join(totals, ["analysis_id", "hash"]).withColumn("added", F.expr("a div n_files")).withColumn("deleted", F.expr("d div n_files")).drop("a", "d")


def _entropy(lines: Column) -> tuple[Column, Column, Column]:
    """Sums from which the entropy of shares follows: T = sum l, S = sum l log2 l, n, over positive l."""
    real = F.when(lines > 0, lines)
    return F.sum(real).alias("T"), F.sum(real * F.log2(real)).alias("S"), F.count(real).alias("k")


def entropy_of(t: Column, s: Column, k: Column) -> Column:
    """-sum p log2 p with p = l / T equals log2 T - S / T: partial sums suffice, no share-of-total window."""
    return F.when(k <= 1, F.lit(0.0)).otherwise(F.greatest(F.log2(t) - s / t, F.lit(0.0)))


def change_entropy(changes: DataFrame, days: int | None = None) -> DataFrame:
    """Entropy of the lines of each file's changes, within the last ``days`` days of its analysis if given. Files with only empty changes are absent."""
    if days is not None:
        changes = changes.where(F.col("ts") >= F.col("now") - days * DAY_MS)
    sums = changes.groupBy(*FILE).agg(*_entropy(F.col("added") + F.col("deleted"))).where(F.col("k") > 0)
    return sums.select(*FILE, entropy_of(F.col("T"), F.col("S"), F.col("k")).alias("entropy"))


def jit_features(changes: DataFrame, age_mode: str = "first", recent_days: int = 30) -> DataFrame:
    """The 14 features of each file.

    Changes are first reduced to one state per (file, author), map-side; a file that holds a tenth of all rows meets the
    second step as one row per author. ``age_mode``: age since the first change, or since the last ('last').
    """
    lines = F.col("added") + F.col("deleted")
    days = F.greatest(F.lit(0.0), (F.col("now") - F.col("ts")) / DAY_MS)
    w = F.exp(-days / 30.0)
    states = changes.groupBy(*FILE, "author").agg(
        F.count(F.lit(1)).alias("n"), F.sum("added").alias("a"), F.sum("deleted").alias("d"), *_entropy(lines), F.sum("n_files").alias("files"), F.min("ts").alias("first"), F.max("ts").alias("last"), F.max("now").alias("now"),
        F.sum(w * days).alias("wd"), F.sum(w).alias("w"), F.count_if(F.col("ts") >= F.col("now") - recent_days * DAY_MS).alias("recent"), F.count_if(is_bug_fix(F.col("message"))).alias("bugs"),
    )
    own = F.col("a") + F.col("d")
    states = states.withColumn("churn", own).withColumn("total", F.sum(own).over(Window.partitionBy(*FILE)))
    per_file = states.groupBy(*FILE).agg(
        F.sum("n").alias("revisions"), F.count("author").alias("distinct_committers"), F.sum("a").alias("lines_added"), F.sum("d").alias("lines_deleted"), F.sum("churn").alias("total_lines_changed"),
        F.sum("T").alias("T"), F.sum("S").alias("S"), F.sum("k").alias("k"), F.sum("files").alias("files"), F.min("first").alias("first"), F.max("last").alias("last"), F.max("now").alias("now"), F.sum("wd").alias("wd"), F.sum("w").alias("w"),
        F.sum("recent").alias("recent_commits"), F.sum("bugs").alias("bug_fix_commits"), F.max("churn").alias("owner"), F.count_if(F.col("churn") < F.col("total") * 0.05).alias("minor_contributors"),
    )
    since = F.col("first") if age_mode == "first" else F.col("last")
    return per_file.select(
        *FILE, "revisions", "distinct_committers", "lines_added", "lines_deleted", "total_lines_changed",
        F.coalesce(entropy_of(F.col("T"), F.col("S"), F.col("k")), F.lit(0.0)).alias("entropy"), F.lit(1).cast("long").alias("num_directories"),
        (F.col("files") / F.col("revisions")).alias("avg_files_per_commit"), F.greatest(F.lit(0.0), (F.col("now") - since) / DAY_MS).alias("age_days"),
        F.when(F.col("w") > 0, F.col("wd") / F.col("w")).otherwise(0.0).alias("weighted_age_days"), "recent_commits", "bug_fix_commits",
        F.when(F.col("total_lines_changed") > 0, F.col("owner") / F.col("total_lines_changed")).otherwise(0.0).alias("owner_contribution"), "minor_contributors",
    )


FEATURES = ["revisions", "distinct_committers", "lines_added", "lines_deleted", "total_lines_changed", "entropy", "num_directories", "avg_files_per_commit", "age_days", "weighted_age_days", "recent_commits", "bug_fix_commits", "owner_contribution", "minor_contributors"]


def author_shares(changes: DataFrame) -> DataFrame:
    """Churn of each author of each file and its share."""
    churn = changes.groupBy(*FILE, "author").agg(F.sum(F.col("added") + F.col("deleted")).alias("churn"))
    total = F.sum("churn").over(Window.partitionBy(*FILE))
    return churn.withColumn("share", F.when(total > 0, F.col("churn") / total).otherwise(0.0))


def co_changes(changes: DataFrame) -> DataFrame:
    """Pairs of files changed in the same commit (smaller path first) and their number of commits; commits of many files are split (see pair_counts)."""
    rows = cut(changes.select("analysis_id", "hash", "file_path"))  # the pair engine reads them three times
    pairs = pair_counts(rows, "analysis_id", "hash", "file_path")
    return pairs.select(F.col("g").alias("analysis_id"), F.least("i1", "i2").alias("file_a"), F.greatest("i1", "i2").alias("file_b"), F.col("n_ab").alias("n"))


def co_changes_by_file(pairs: DataFrame, most: int | None = None) -> DataFrame:
    """For each file its companions, ranked by count and path: all of them, or the ``most`` most frequent."""
    both = pairs.select("analysis_id", F.col("file_a").alias("file_path"), F.col("file_b").alias("with_file"), "n").unionByName(
        pairs.select("analysis_id", F.col("file_b").alias("file_path"), F.col("file_a").alias("with_file"), "n")
    )
    order = Window.partitionBy(*FILE).orderBy(F.desc("n"), "with_file")
    ranked = both.withColumn("place", F.row_number().over(order))
    return ranked if most is None else ranked.where(F.col("place") <= most)


def findings(features: DataFrame, pairs: DataFrame, commits: DataFrame) -> DataFrame:
    """Threshold findings, numbered within each analysis in the order of rules, files and messages."""

    def rule(df: DataFrame, no: int, name: str, when: Column, severity: str, message: Column) -> DataFrame:
        return df.where(when).select("analysis_id", F.lit(no).alias("rule_no"), F.lit(name).alias("rule"), "file_path", F.lit(severity).alias("severity"), message.alias("message"))

    n = commits.groupBy("analysis_id").agg(F.count(F.lit(1)).alias("n_commits"))
    coupled = pairs.join(n, "analysis_id").withColumn("file_path", F.col("file_a"))
    rows = [
        rule(features, 1, "PROC-ENT", F.col("entropy") > 3.0, "warning", F.format_string("change entropy above %d", F.lit(3))),
        rule(features, 2, "PROC-REV", F.col("revisions") > 20, "warning", F.format_string("%d revisions", "revisions")),
        rule(features, 3, "PROC-BUG", F.col("bug_fix_commits") >= 3, "error", F.format_string("%d bug-fix commits", "bug_fix_commits")),
        rule(coupled, 4, "PROC-COUPLE", (F.col("n_commits") >= 10) & (F.col("n") >= 2) & (F.col("n") > F.expr("n_commits div 10")), "warning", F.format_string("changes with %s in %d commits", "file_b", "n")),
    ]
    out = reduce(DataFrame.unionByName, rows)
    place = F.row_number().over(Window.partitionBy("analysis_id").orderBy("rule_no", "file_path", "message"))
    return out.withColumn("finding_id", F.format_string("%s-%03d", "rule", place)).drop("rule_no")


def process_risk(found: DataFrame, features: DataFrame) -> DataFrame:
    """Risk of each analysis: min(1, 0.3 errors + 0.1 warnings + 0.1 largest entropy)."""
    counts = found.groupBy("analysis_id").agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))
    top = features.groupBy("analysis_id").agg(F.max("entropy").alias("max_entropy"))
    risk = F.least(F.lit(1.0), 0.3 * F.col("errors") + 0.1 * F.col("warnings") + 0.1 * F.col("max_entropy"))
    filled = top.join(counts, "analysis_id", "left").na.fill(0, ["errors", "warnings"])
    return filled.withColumn("risk", risk)
