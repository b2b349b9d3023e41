"""Queries on the change history and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import IMPORT_LANGUAGES, IR_LANGUAGES, is_bug_fix, is_test_path, language_of
from ..operators import process as P
from ..runtime import cut, table
from .problems import _NORMAL, _RESOLVED


def _r(df: DataFrame, *columns: str) -> DataFrame:
    """Doubles rounded to six digits, for comparison."""
    return df.withColumns({c: F.round(c, 6) for c in columns})


def jit_features(spark: SparkSession, d: str) -> DataFrame:
    return _r(P.jit_features(P.changes_of(spark, d)), "entropy", "avg_files_per_commit", "age_days", "weighted_age_days", "owner_contribution")


def changes(spark: SparkSession, d: str) -> DataFrame:
    return P.changes_of(spark, d).select("analysis_id", "hash", "file_path", "author", "ts", "added", "deleted", "change_type", "n_files")


def changes_averaged(spark: SparkSession, d: str) -> DataFrame:
    return P.average_lines(P.changes_of(spark, d)).select("analysis_id", "hash", "file_path", "added", "deleted")


def change_entropy(spark: SparkSession, d: str) -> DataFrame:
    return _r(P.change_entropy(P.changes_of(spark, d)), "entropy")


def entropy_window_90d(spark: SparkSession, d: str) -> DataFrame:
    return _r(P.change_entropy(P.changes_of(spark, d), 90), "entropy")


def author_ownership(spark: SparkSession, d: str) -> DataFrame:
    return _r(P.author_shares(P.changes_of(spark, d)), "share")


def minor_contributors(spark: SparkSession, d: str) -> DataFrame:
    return P.author_shares(P.changes_of(spark, d)).where("share < 0.05").groupBy(*P.FILE).agg(F.count(F.lit(1)).alias("n"))


def cochange_pairs(spark: SparkSession, d: str) -> DataFrame:
    return P.co_changes(P.changes_of(spark, d))


def cochange_top20(spark: SparkSession, d: str) -> DataFrame:
    return cochange_pairs(spark, d).orderBy(F.desc("n"), "analysis_id", "file_a", "file_b").limit(20)


def cochange_by_file(spark: SparkSession, d: str) -> DataFrame:
    """All companions of every file with their place."""
    return P.co_changes_by_file(cochange_pairs(spark, d))


def hotspots_top10(spark: SparkSession, d: str) -> DataFrame:
    return P.jit_features(P.changes_of(spark, d)).orderBy(F.desc("revisions"), "analysis_id", "file_path").select(*P.FILE, "revisions", "bug_fix_commits").limit(10)


def _findings(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = cut(P.changes_of(spark, d))  # features and pairs read the changes, findings and risk the features
    features = cut(P.jit_features(rows))
    return P.findings(features, P.co_changes(rows), P.commits_of(spark, d)), features


def process_findings(spark: SparkSession, d: str) -> DataFrame:
    return _findings(spark, d)[0]


def process_risk(spark: SparkSession, d: str) -> DataFrame:
    return _r(P.process_risk(*_findings(spark, d)), "max_entropy", "risk")


def severity_counts(spark: SparkSession, d: str) -> DataFrame:
    return process_findings(spark, d).groupBy("analysis_id", "severity").agg(F.count(F.lit(1)).alias("n"))


def bug_fix_commits(spark: SparkSession, d: str) -> DataFrame:
    return P.commits_of(spark, d).where(is_bug_fix(F.col("message"))).groupBy("analysis_id").agg(F.count(F.lit(1)).alias("n"))


def file_languages(spark: SparkSession, d: str) -> DataFrame:
    path = F.col("path")
    return table(spark, d, "source_files", "analysis_id", "path").select("analysis_id", "path", language_of(path, IR_LANGUAGES, False).alias("ir_language"), language_of(path, IMPORT_LANGUAGES, True).alias("import_language"), is_test_path(path).alias("is_test"))


def latest_analysis(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "process_commits", "analysis_id").agg(F.max("analysis_id").alias("analysis_id"))


def commit_walk(spark: SparkSession, d: str) -> DataFrame:
    """The 100 newest commits of all analyses (the walk's early stop is its feature)."""
    return P.commits_of(spark, d).where("ts IS NOT NULL").orderBy(F.desc("ts"), "analysis_id", "hash").select("analysis_id", "hash", "ts", "author").limit(100)


QUERIES = {
    f.__name__: f
    for f in (jit_features, changes, changes_averaged, change_entropy, entropy_window_90d, author_ownership, minor_contributors, cochange_pairs, cochange_top20, cochange_by_file, hotspots_top10, process_findings, process_risk, severity_counts, bug_fix_commits, file_languages, latest_analysis, commit_walk)
}

_BUG = "regexp_matches(lower(message), 'fix|bug|crash|defect|error|hotfix|patch|issue|#')"

CHANGES = f"""{_RESOLVED},
kc AS (SELECT analysis_id, {_NORMAL.format('hash')} AS hash, author, author_email, timestamp_ms AS ts, message, loaded_at, row_id FROM process_commits WHERE hash IS NOT NULL),
uc AS (SELECT * FROM kc QUALIFY row_number() OVER (PARTITION BY analysis_id, hash ORDER BY loaded_at, row_id) = 1),
rc AS (SELECT r.*, x.change_type FROM resolved r JOIN process_file_changes x ON x.row_id = r.row_id WHERE r.file_path IS NOT NULL),
ux AS (SELECT analysis_id, h AS hash, file_path, max(coalesce(lines_added, 0)) OVER w AS added, max(coalesce(lines_deleted, 0)) OVER w AS deleted, change_type FROM rc
       WINDOW w AS (PARTITION BY analysis_id, h, file_path) QUALIFY row_number() OVER (PARTITION BY analysis_id, h, file_path ORDER BY loaded_at, row_id) = 1),
ch AS (SELECT ux.*, author, ts, message, count(*) OVER (PARTITION BY ux.analysis_id, ux.hash) AS n_files, n.now, (n.now - ts) / 86400000.0 AS ago, added + deleted AS l
       FROM ux JOIN uc ON uc.analysis_id = ux.analysis_id AND uc.hash = ux.hash
       JOIN (SELECT analysis_id, max(ts) AS now FROM uc GROUP BY ALL) n ON n.analysis_id = ux.analysis_id WHERE ts IS NOT NULL)
"""

_ENT = """SELECT analysis_id, file_path, greatest(0.0, -sum(CASE WHEN k = 1 THEN 0 ELSE l / t * log2(l / t) END)) AS entropy FROM
(SELECT analysis_id, file_path, l, sum(l) OVER w AS t, count(*) OVER w AS k FROM ch WHERE l > 0 {} WINDOW w AS (PARTITION BY analysis_id, file_path)) GROUP BY ALL"""

JIT = f"""{CHANGES},
ent AS ({_ENT.format('')}),
au AS (SELECT analysis_id, file_path, author, sum(l) AS churn FROM ch GROUP BY ALL),
ow AS (SELECT analysis_id, file_path, max(churn) AS owner, sum(churn) AS total, CAST(count(*) FILTER (churn < 0.05 * t) AS BIGINT) AS minor FROM
       (SELECT *, sum(churn) OVER (PARTITION BY analysis_id, file_path) AS t FROM au) GROUP BY ALL),
f0 AS (SELECT analysis_id, file_path, count(*) AS revisions, count(DISTINCT author) AS distinct_committers, CAST(sum(added) AS BIGINT) AS lines_added, CAST(sum(deleted) AS BIGINT) AS lines_deleted,
       CAST(sum(l) AS BIGINT) AS total_lines_changed, avg(n_files) AS avg_files_per_commit, greatest(0.0, max(ago)) AS age_days, sum(exp(-ago / 30) * ago) / sum(exp(-ago / 30)) AS weighted_age_days,
       count(*) FILTER (ago <= 30) AS recent_commits, count(*) FILTER ({_BUG}) AS bug_fix_commits FROM ch GROUP BY ALL),
jit AS (SELECT f0.*, coalesce(entropy, 0.0) AS entropy, CAST(1 AS BIGINT) AS num_directories, CASE WHEN total > 0 THEN owner / total ELSE 0.0 END AS owner_contribution, minor AS minor_contributors
        FROM f0 LEFT JOIN ent USING (analysis_id, file_path) JOIN ow USING (analysis_id, file_path))
"""

_PAIRS = """pairs AS (SELECT a.analysis_id, a.file_path AS file_a, b.file_path AS file_b, count(*) AS n FROM ch a JOIN ch b ON a.analysis_id = b.analysis_id AND a.hash = b.hash AND a.file_path < b.file_path GROUP BY ALL)"""

FINDINGS = f"""{JIT}, {_PAIRS},
nc AS (SELECT analysis_id, count(*) AS n_commits FROM uc GROUP BY ALL),
raw AS (SELECT analysis_id, 1 AS rule_no, 'PROC-ENT' AS rule, file_path, 'warning' AS severity, 'change entropy above 3' AS message FROM jit WHERE entropy > 3
        UNION ALL SELECT analysis_id, 2, 'PROC-REV', file_path, 'warning', revisions || ' revisions' FROM jit WHERE revisions > 20
        UNION ALL SELECT analysis_id, 3, 'PROC-BUG', file_path, 'error', bug_fix_commits || ' bug-fix commits' FROM jit WHERE bug_fix_commits >= 3
        UNION ALL SELECT analysis_id, 4, 'PROC-COUPLE', file_a, 'warning', 'changes with ' || file_b || ' in ' || n || ' commits' FROM pairs JOIN nc USING (analysis_id) WHERE n_commits >= 10 AND n >= 2 AND n > n_commits // 10),
findings AS (SELECT analysis_id, rule, file_path, severity, message, rule || '-' || lpad(CAST(o AS VARCHAR), CAST(greatest(3, length(CAST(o AS VARCHAR))) AS INTEGER), '0') AS finding_id FROM
             (SELECT *, row_number() OVER (PARTITION BY analysis_id ORDER BY rule_no, file_path, message) AS o FROM raw)),
prisk AS (SELECT analysis_id, coalesce(errors, 0) AS errors, coalesce(warnings, 0) AS warnings, max_entropy, least(1.0, 0.3 * coalesce(errors, 0) + 0.1 * coalesce(warnings, 0) + 0.1 * max_entropy) AS risk
          FROM (SELECT analysis_id, max(entropy) AS max_entropy FROM jit GROUP BY ALL) LEFT JOIN
          (SELECT analysis_id, count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings FROM findings GROUP BY ALL) USING (analysis_id))
"""

_BY_FILE = "(SELECT analysis_id, file_a AS file_path, file_b AS with_file, n FROM pairs UNION ALL SELECT analysis_id, file_b, file_a, n FROM pairs)"
_LANGUAGE = "CASE {e} WHEN 'py' THEN 'python' WHEN 'js' THEN 'javascript' WHEN 'jsx' THEN 'javascript' WHEN 'mjs' THEN 'javascript' WHEN 'cjs' THEN 'javascript' WHEN 'ts' THEN 'javascript' WHEN 'tsx' THEN 'javascript' {more} END"

SQL = {
    "jit_features": f"""WITH {JIT} SELECT analysis_id, file_path, revisions, distinct_committers, lines_added, lines_deleted, total_lines_changed, round(entropy, 6) AS entropy, num_directories,
        round(avg_files_per_commit, 6) AS avg_files_per_commit, round(age_days, 6) AS age_days, round(weighted_age_days, 6) AS weighted_age_days, recent_commits, bug_fix_commits,
        round(owner_contribution, 6) AS owner_contribution, minor_contributors FROM jit""",
    "changes": f"WITH {CHANGES} SELECT analysis_id, hash, file_path, author, ts, added, deleted, change_type, n_files FROM ch",
    "changes_averaged": f"WITH {CHANGES} SELECT analysis_id, hash, file_path, CAST(sum(added) OVER w // n_files AS BIGINT) AS added, CAST(sum(deleted) OVER w // n_files AS BIGINT) AS deleted FROM ch WINDOW w AS (PARTITION BY analysis_id, hash)",
    "change_entropy": f"WITH {CHANGES}, e AS ({_ENT.format('')}) SELECT analysis_id, file_path, round(entropy, 6) AS entropy FROM e",
    "entropy_window_90d": f"WITH {CHANGES}, e AS ({_ENT.format('AND ago <= 90')}) SELECT analysis_id, file_path, round(entropy, 6) AS entropy FROM e",
    "author_ownership": f"WITH {JIT} SELECT analysis_id, file_path, author, CAST(churn AS BIGINT) AS churn, round(CASE WHEN t > 0 THEN churn / t ELSE 0 END, 6) AS share FROM (SELECT *, sum(churn) OVER (PARTITION BY analysis_id, file_path) AS t FROM au)",
    "minor_contributors": f"WITH {JIT} SELECT analysis_id, file_path, count(*) AS n FROM (SELECT *, sum(churn) OVER (PARTITION BY analysis_id, file_path) AS t FROM au) WHERE CASE WHEN t > 0 THEN churn / t ELSE 0 END < 0.05 GROUP BY ALL",
    "cochange_pairs": f"WITH {CHANGES}, {_PAIRS} SELECT * FROM pairs",
    "cochange_top20": f"WITH {CHANGES}, {_PAIRS} SELECT * FROM pairs ORDER BY n DESC, analysis_id, file_a, file_b LIMIT 20",
    "cochange_by_file": f"WITH {CHANGES}, {_PAIRS} SELECT *, row_number() OVER (PARTITION BY analysis_id, file_path ORDER BY n DESC, with_file) AS place FROM {_BY_FILE}",
    "hotspots_top10": f"WITH {JIT} SELECT analysis_id, file_path, revisions, bug_fix_commits FROM jit ORDER BY revisions DESC, analysis_id, file_path LIMIT 10",
    "process_findings": f"WITH {FINDINGS} SELECT * FROM findings",
    "process_risk": f"WITH {FINDINGS} SELECT analysis_id, errors, warnings, round(max_entropy, 6) AS max_entropy, round(risk, 6) AS risk FROM prisk",
    "severity_counts": f"WITH {FINDINGS} SELECT analysis_id, severity, count(*) AS n FROM findings GROUP BY ALL",
    "bug_fix_commits": f"WITH {CHANGES} SELECT analysis_id, count(*) AS n FROM uc WHERE {_BUG} GROUP BY ALL",
    "file_languages": f"""SELECT analysis_id, path, {_LANGUAGE.format(e="regexp_extract(path, '[.]([^./]+)$', 1)", more="WHEN 'rs' THEN 'rust'")} AS ir_language,
        {_LANGUAGE.format(e="lower(regexp_extract(path, '[.]([^./]+)$', 1))", more="WHEN 'java' THEN 'java' WHEN 'go' THEN 'go'")} AS import_language, regexp_matches(path, 'test|spec') AS is_test FROM source_files""",
    "latest_analysis": "SELECT max(analysis_id) AS analysis_id FROM process_commits",
    "commit_walk": f"WITH {CHANGES} SELECT analysis_id, hash, ts, author FROM uc WHERE ts IS NOT NULL ORDER BY ts DESC, analysis_id, hash LIMIT 100",
}
