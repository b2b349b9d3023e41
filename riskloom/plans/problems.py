"""The general training-data problems as queries over the repository tables, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.commit_refs import resolve
from ..operators.hot_keys import eager_join_aggregate, heavy_keys, key_shares
from ..operators.orphans import orphan_rows
from ..operators.rolling import trailing_totals
from ..operators.sessions import sessionize
from ..runtime import cut, join_measured, normal_hash, table

GAP_MS = 90 * 60_000


# 2: a few keys hold most records


def _joins(spark: SparkSession, d: str) -> dict:
    """Edges to the nodes they name, changes to the nodes of their file."""
    nodes = table(spark, d, "dep_nodes", "analysis_id", "id", "file_path")
    edges = table(spark, d, "dep_edges", "analysis_id", "target_id").withColumnRenamed("target_id", "id")
    changes = table(spark, d, "process_file_changes", "analysis_id", "file_path")
    return {
        "dep_edges": (edges, nodes.select("analysis_id", "id"), ["analysis_id", "id"], "id"),
        "process_file_changes": (changes, nodes.select("analysis_id", "file_path"), ["analysis_id", "file_path"], "file_path"),
    }


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Values with at least 3 % of all rows of their table."""
    return heavy_keys(_joins(spark, d), 3)


def p2_key_shares(spark: SparkSession, d: str) -> DataFrame:
    """Rows and share of every value, null among them, and its rows in the join with the nodes."""
    return key_shares(_joins(spark, d)).select("ref_table", "key_value", "n", "joined_rows", F.round("share", 9).alias("share"))


def p2_file_results(spark: SparkSession, d: str) -> DataFrame:
    """Per-file totals over the changes joined to their commits by hash, rows as they stand, without forming the join."""
    changes = table(spark, d, "process_file_changes", "analysis_id", "commit_hash", "file_path", "lines_added", "lines_deleted").withColumn("hash", normal_hash("commit_hash"))
    commits = table(spark, d, "process_commits", "analysis_id", "hash").withColumn("hash", normal_hash("hash"))
    return eager_join_aggregate(changes, commits, ["analysis_id", "hash"], ["file_path"], ["lines_added", "lines_deleted"], ["lines_added"])


def p2_fan_in(spark: SparkSession, d: str) -> DataFrame:
    """Fan-in of every target over the edges joined to their nodes, rows as they stand."""
    edges = table(spark, d, "dep_edges", "analysis_id", "target_id", "line").withColumnRenamed("target_id", "id")
    nodes = table(spark, d, "dep_nodes", "analysis_id", "id")
    return eager_join_aggregate(edges, nodes, ["analysis_id", "id"], ["id"], maxima=["line"]).select(F.col("id").alias("target_id"), F.col("joined_rows").alias("fan_in"), F.col("max_line"))


def p2_all_file_results(spark: SparkSession, d: str) -> DataFrame:
    """Totals of every file over all its change rows and over those of a known commit; short hashes are resolved, a commit loaded twice counts once."""
    commits = table(spark, d, "process_commits", "analysis_id", "hash").select("analysis_id", normal_hash("hash").alias("hash")).where(F.col("hash").isNotNull()).distinct()
    rows = table(spark, d, "process_file_changes", "analysis_id", "commit_hash", "file_path", "lines_added", "lines_deleted").select("analysis_id", normal_hash("commit_hash").alias("ref"), "file_path", "lines_added", "lines_deleted")
    out = eager_join_aggregate(resolve(rows, commits), commits, ["analysis_id", "hash"], ["file_path"], ["lines_added", "lines_deleted"], ["lines_added"], "left")
    return out.withColumnRenamed("rows", "n_changes")


def p2_all_fan_in(spark: SparkSession, d: str) -> DataFrame:
    """Edges of every target (fan_in), be it a node or not, and beside them the rows of the edges joined to the nodes as they stand."""
    edges = table(spark, d, "dep_edges", "analysis_id", "target_id", "line").withColumnRenamed("target_id", "id")
    nodes = table(spark, d, "dep_nodes", "analysis_id", "id")
    out = eager_join_aggregate(edges, nodes, ["analysis_id", "id"], ["id"], maxima=["line"], how="left")
    return out.select(F.col("id").alias("target_id"), F.col("rows").alias("fan_in"), "joined_rows", F.col("all_max_line").alias("max_line"))


# 4: sessions


def p4_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Bursts of work of each address: start, end, length, commits (a commit loaded twice counts once)."""
    commits = table(spark, d, "process_commits", "author_email", "timestamp_ms", "analysis_id", "hash").select(
        F.lower("author_email").alias("author_email"), "timestamp_ms", F.concat("analysis_id", F.lit(" "), normal_hash("hash")).alias("commit")
    )
    return sessionize(commits, "author_email", "timestamp_ms", "commit", GAP_MS)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_sessions(spark, d).select("author_email", "start_ms", "end_ms")


# 6: trailing totals


def _daily_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines added and deleted per analysis and UTC day of the commit, each change (analysis, commit, file) once.

    Of rows that repeat a change the larger counts stand. The rows are reduced to one per change, then to one per
    commit, before they meet the commits: a commit that holds a third of all rows arrives there as one row.
    """
    commits = table(spark, d, "process_commits", "analysis_id", "hash", "timestamp_ms").select("analysis_id", normal_hash("hash").alias("hash"), "timestamp_ms")
    commits = commits.where(F.col("hash").isNotNull())
    times = commits.groupBy("analysis_id", "hash").agg(F.min("timestamp_ms").alias("ts")).where(F.col("ts").isNotNull())
    rows = (
        table(spark, d, "process_file_changes", "analysis_id", "commit_hash", "file_path", "lines_added", "lines_deleted")
        .where(F.col("file_path").isNotNull() & F.col("commit_hash").isNotNull())
        .select("analysis_id", normal_hash("commit_hash").alias("ref"), "file_path", "lines_added", "lines_deleted")
    )
    per_change = resolve(rows, commits).groupBy("analysis_id", "hash", "file_path").agg(F.max("lines_added").alias("a"), F.max("lines_deleted").alias("d"))
    zero = F.lit(0)
    per_commit = per_change.groupBy("analysis_id", "hash").agg(F.sum(F.coalesce("a", zero)).alias("added"), F.sum(F.coalesce("d", zero)).alias("deleted"))
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col("ts") / 86_400_000).cast("int"))  # whatever the session's time zone
    return per_commit.join(times, ["analysis_id", "hash"]).groupBy("analysis_id", day.alias("day")).agg(F.sum("added").alias("added"), F.sum("deleted").alias("deleted"))


def p6_rolling(spark: SparkSession, d: str) -> DataFrame:
    """Trailing 7- and 30-day totals and averages of lines added plus deleted for every day of every analysis."""
    daily = _daily_lines(spark, d).withColumn("changed", F.col("added") + F.col("deleted"))
    out = trailing_totals(daily, "analysis_id", "day", "changed")
    return out.select("analysis_id", F.date_format("day", "yyyy-MM-dd").alias("day"), F.col("value").alias("changed"), "s7", F.round("avg7", 6).alias("avg7"), "s30", F.round("avg30", 6).alias("avg30"))


def p6_all_rolling(spark: SparkSession, d: str) -> DataFrame:
    """Trailing 7- and 30-day totals and averages of lines added, of lines deleted and of their sum for every day of every analysis."""
    daily = cut(_daily_lines(spark, d).withColumn("changed", F.col("added") + F.col("deleted")))  # a row per day: read once for each measure
    out = None
    for c in ("added", "deleted", "changed"):
        rolled = trailing_totals(daily, "analysis_id", "day", c)
        one = rolled.select("analysis_id", "day", F.col("value").alias(c), *[(F.round(k, 6) if "avg" in k else F.col(k)).alias(f"{c}_{k}") for k in ("s7", "avg7", "s30", "avg30")])
        out = one if out is None else out.join(one, ["analysis_id", "day"])
    return out.withColumn("day", F.date_format("day", "yyyy-MM-dd"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_rolling(spark, d).where(F.col("s7") * 2 > F.col("s30")).select("analysis_id", "day")


# 7: references to records that do not exist


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    commits = table(spark, d, "process_commits", "analysis_id", "hash", "loaded_at").select("analysis_id", normal_hash("hash").alias("hash"), "loaded_at").where(F.col("hash").isNotNull())
    changes = table(spark, d, "process_file_changes", "row_id", "analysis_id", "commit_hash", "loaded_at").select("row_id", "analysis_id", normal_hash("commit_hash").alias("ref"), "loaded_at").where(F.col("ref") != "")
    edges = table(spark, d, "dep_edges", "row_id", "analysis_id", "target_id", "loaded_at").where(F.col("target_id") != "")
    nodes = table(spark, d, "dep_nodes", "analysis_id", "id", "loaded_at").where(F.col("id").isNotNull())

    def tagged(df: DataFrame, name: str, key: str, *rest: str) -> DataFrame:
        return df.select(F.lit(name).alias("ref_table"), "analysis_id", F.col(key).alias("key"), "loaded_at", *rest)

    refs = tagged(edges, "dep_edges", "target_id", "row_id").unionByName(tagged(resolve(changes, commits), "process_file_changes", "hash", "row_id"))
    parents = tagged(nodes, "dep_edges", "id").unionByName(tagged(commits, "process_file_changes", "hash"))
    rows = sum(table(spark, d, t).count() for t in ("dep_edges", "dep_nodes", "process_file_changes", "process_commits"))  # from the files' footers
    return orphan_rows(refs, parents, ["ref_table", "analysis_id", "key"], "loaded_at", join_measured, rows)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).select("ref_table", "row_id", "state")


def p7_by_month(spark: SparkSession, d: str) -> DataFrame:
    """Orphan rows per table, month of loaded_at and state."""
    month = F.date_format("loaded_at", "yyyy-MM").alias("month")
    return _orphans(spark, d).groupBy("ref_table", month, "state").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (p2_found, p2_key_shares, p2_all_file_results, p2_all_fan_in, p2_file_results, p2_fan_in, p4_found, p4_sessions, p6_found, p6_all_rolling, p6_rolling, p7_found, p7_by_month)}

_NORMAL = r"lower(regexp_replace({}, '^\s+|\s+$', '', 'g'))"

_RESOLVED = f"""
commits AS (SELECT analysis_id, {_NORMAL.format('hash')} AS h, min(timestamp_ms) AS ts, min(loaded_at) AS first_at
            FROM process_commits WHERE hash IS NOT NULL GROUP BY ALL),
refs AS (SELECT row_id, analysis_id, file_path, lines_added, lines_deleted, loaded_at, {_NORMAL.format('commit_hash')} AS ref
         FROM process_file_changes WHERE commit_hash IS NOT NULL),
short AS (SELECT r.analysis_id, r.ref, CASE WHEN bool_or(c.h = r.ref) THEN r.ref WHEN count(*) = 1 THEN min(c.h) END AS h
          FROM (SELECT DISTINCT analysis_id, ref FROM refs WHERE length(ref) BETWEEN 8 AND 39) r
          JOIN commits c ON c.analysis_id = r.analysis_id AND c.h[1:8] = r.ref[1:8] AND starts_with(c.h, r.ref) GROUP BY r.analysis_id, r.ref),
resolved AS (SELECT r.*, coalesce(s.h, r.ref) AS h FROM refs r LEFT JOIN short s ON s.analysis_id = r.analysis_id AND s.ref = r.ref)
"""

_DAILY = f"""{_RESOLVED},
changes AS (SELECT analysis_id, h, file_path, max(coalesce(lines_added, 0)) AS a, max(coalesce(lines_deleted, 0)) AS d
            FROM resolved WHERE file_path IS NOT NULL GROUP BY ALL),
daily AS (SELECT x.analysis_id, CAST(epoch_ms(c.ts) AS DATE) AS day, CAST(sum(a + d) AS BIGINT) AS changed
          FROM changes x JOIN commits c ON c.analysis_id = x.analysis_id AND c.h = x.h WHERE c.ts IS NOT NULL GROUP BY ALL),
calendar AS (SELECT analysis_id, CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM daily GROUP BY analysis_id),
dense AS (SELECT k.analysis_id, k.day, coalesce(x.changed, 0) AS changed FROM calendar k LEFT JOIN daily x ON x.analysis_id = k.analysis_id AND x.day = k.day),
rolling AS (SELECT analysis_id, strftime(day, '%Y-%m-%d') AS day, changed,
            CAST(sum(changed) OVER (PARTITION BY analysis_id ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS BIGINT) AS s7,
            CAST(sum(changed) OVER (PARTITION BY analysis_id ORDER BY day ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS BIGINT) AS s30 FROM dense)
"""

_SPAN = "OVER (PARTITION BY analysis_id ORDER BY day ROWS BETWEEN {} PRECEDING AND CURRENT ROW)"
_EACH = ", ".join(
    f"{c}, CAST(sum({c}) {_SPAN.format(6)} AS BIGINT) AS {c}_s7, round(sum({c}) {_SPAN.format(6)} / 7, 6) AS {c}_avg7, "
    f"CAST(sum({c}) {_SPAN.format(29)} AS BIGINT) AS {c}_s30, round(sum({c}) {_SPAN.format(29)} / 30, 6) AS {c}_avg30"
    for c in ("added", "deleted", "changed")
)
_ALL_DAILY = f"""{_DAILY},
two AS (SELECT x.analysis_id, CAST(epoch_ms(c.ts) AS DATE) AS day, CAST(sum(a) AS BIGINT) AS added, CAST(sum(d) AS BIGINT) AS deleted
        FROM changes x JOIN commits c ON c.analysis_id = x.analysis_id AND c.h = x.h WHERE c.ts IS NOT NULL GROUP BY ALL),
full_days AS (SELECT k.analysis_id, k.day, coalesce(x.added, 0) AS added, coalesce(x.deleted, 0) AS deleted, coalesce(x.added, 0) + coalesce(x.deleted, 0) AS changed
              FROM calendar k LEFT JOIN two x ON x.analysis_id = k.analysis_id AND x.day = k.day)
"""

_SESSIONS = f"""
e AS (SELECT lower(author_email) AS author_email, timestamp_ms AS ts, analysis_id, {_NORMAL.format('hash')} AS h, row_id FROM process_commits
      WHERE author_email IS NOT NULL AND timestamp_ms IS NOT NULL),
m AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY author_email ORDER BY ts) <= {GAP_MS} THEN 0 ELSE 1 END AS new FROM e),
s AS (SELECT *, sum(new) OVER (PARTITION BY author_email ORDER BY ts ROWS UNBOUNDED PRECEDING) AS no FROM
      (SELECT author_email, ts, max(new) AS new, count(DISTINCT coalesce(analysis_id || ' ' || h, 'row ' || row_id)) AS n FROM m GROUP BY ALL)),
sessions AS (SELECT author_email, min(ts) AS start_ms, max(ts) AS end_ms, max(ts) - min(ts) AS duration_ms, CAST(sum(n) AS BIGINT) AS n_events FROM s GROUP BY author_email, no)
"""

_ORPHANS = f"""{_RESOLVED},
nodes AS (SELECT analysis_id, id, min(loaded_at) AS first_at FROM dep_nodes WHERE id IS NOT NULL GROUP BY ALL),
joined AS (SELECT 'process_file_changes' AS ref_table, r.row_id, r.loaded_at, c.first_at FROM resolved r
           LEFT JOIN commits c ON c.analysis_id = r.analysis_id AND c.h = r.h WHERE r.ref <> ''
           UNION ALL SELECT 'dep_edges', e.row_id, e.loaded_at, n.first_at FROM dep_edges e
           LEFT JOIN nodes n ON n.analysis_id = e.analysis_id AND n.id = e.target_id WHERE e.target_id <> ''),
orphans AS (SELECT ref_table, row_id, loaded_at, CASE WHEN first_at IS NULL THEN 'missing' ELSE 'late' END AS state FROM joined WHERE first_at IS NULL OR first_at > loaded_at)
"""

_SHARES = """
ni AS (SELECT analysis_id, id, count(*) AS m FROM dep_nodes GROUP BY ALL),
nf AS (SELECT analysis_id, file_path, count(*) AS m FROM dep_nodes GROUP BY ALL),
k AS (SELECT 'dep_edges' AS ref_table, e.target_id AS key_value, count(*) AS n, CAST(coalesce(sum(m), 0) AS BIGINT) AS joined_rows
      FROM dep_edges e LEFT JOIN ni ON ni.analysis_id = e.analysis_id AND ni.id = e.target_id GROUP BY ALL
      UNION ALL SELECT 'process_file_changes', x.file_path, count(*), CAST(coalesce(sum(m), 0) AS BIGINT)
      FROM process_file_changes x LEFT JOIN nf ON nf.analysis_id = x.analysis_id AND nf.file_path = x.file_path GROUP BY ALL),
shares AS (SELECT *, sum(n) OVER (PARTITION BY ref_table) AS total FROM k)
"""

SQL = {
    "p2_found": f"WITH {_SHARES} SELECT ref_table, key_value FROM shares WHERE key_value IS NOT NULL AND n * 100 >= total * 3",
    "p2_key_shares": f"WITH {_SHARES} SELECT ref_table, key_value, n, joined_rows, round(n / total, 9) AS share FROM shares",
    "p2_file_results": f"""SELECT x.file_path, count(*) AS joined_rows, CAST(sum(x.lines_added) AS BIGINT) AS sum_lines_added,
        CAST(sum(x.lines_deleted) AS BIGINT) AS sum_lines_deleted, max(x.lines_added) AS max_lines_added
        FROM process_file_changes x JOIN process_commits c ON c.analysis_id = x.analysis_id AND {_NORMAL.format('c.hash')} = {_NORMAL.format('x.commit_hash')} GROUP BY ALL""",
    "p2_fan_in": """SELECT e.target_id, count(*) AS fan_in, max(e.line) AS max_line FROM dep_edges e
        JOIN dep_nodes n ON n.analysis_id = e.analysis_id AND n.id = e.target_id GROUP BY ALL""",
    "p2_all_file_results": f"""WITH {_RESOLVED},
        x AS (SELECT r.file_path, r.lines_added AS a, r.lines_deleted AS d, c.h IS NOT NULL AS known FROM resolved r LEFT JOIN commits c ON c.analysis_id = r.analysis_id AND c.h = r.h
              UNION ALL SELECT file_path, lines_added, lines_deleted, false FROM process_file_changes WHERE commit_hash IS NULL)
        SELECT file_path, count(*) AS n_changes, count(*) FILTER (known) AS joined_rows, CAST(sum(a) AS BIGINT) AS all_sum_lines_added, CAST(sum(d) AS BIGINT) AS all_sum_lines_deleted, max(a) AS all_max_lines_added,
        CAST(sum(a) FILTER (known) AS BIGINT) AS sum_lines_added, CAST(sum(d) FILTER (known) AS BIGINT) AS sum_lines_deleted, max(a) FILTER (known) AS max_lines_added FROM x GROUP BY ALL""",
    "p2_all_fan_in": """WITH n AS (SELECT analysis_id, id, count(*) AS k FROM dep_nodes GROUP BY ALL)
        SELECT e.target_id, count(*) AS fan_in, CAST(coalesce(sum(n.k), 0) AS BIGINT) AS joined_rows, max(e.line) AS max_line FROM dep_edges e
        LEFT JOIN n ON n.analysis_id = e.analysis_id AND n.id = e.target_id GROUP BY ALL""",
    "p4_found": f"WITH {_SESSIONS} SELECT author_email, start_ms, end_ms FROM sessions",
    "p4_sessions": f"WITH {_SESSIONS} SELECT * FROM sessions",
    "p6_found": f"WITH {_DAILY} SELECT analysis_id, day FROM rolling WHERE 2 * s7 > s30",
    "p6_all_rolling": f"WITH {_ALL_DAILY} SELECT analysis_id, strftime(day, '%Y-%m-%d') AS day, {_EACH} FROM full_days",
    "p6_rolling": f"WITH {_DAILY} SELECT analysis_id, day, changed, s7, round(s7 / 7, 6) AS avg7, s30, round(s30 / 30, 6) AS avg30 FROM rolling",
    "p7_found": f"WITH {_ORPHANS} SELECT ref_table, row_id, state FROM orphans",
    "p7_by_month": f"WITH {_ORPHANS} SELECT ref_table, strftime(loaded_at, '%Y-%m') AS month, state, count(*) AS n FROM orphans GROUP BY ALL",
}
