"""Results as tables, JSON, CSV, SARIF, DOT and Markdown."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import SEVERITIES, severity_rank
from ..operators.process import FEATURES
from ..runtime import cut, join_measured
from ..sources.files import FEEDBACK

#: SARIF levels by severity (fixed values).
LEVELS = {"info": "note", "warning": "warning", "error": "error", "critical": "error"}
_EDGE = {"static": ("solid", "black"), "dynamic": ("dashed", "orange"), "reexport": ("dotted", "blue")}


def append_new(df: DataFrame, path: str, keys: list[str]) -> None:
    """Append rows whose keys the table at path does not hold yet; repeated keys count once."""
    rows = df.dropDuplicates(keys)
    try:
        old = df.sparkSession.read.parquet(path).select(*keys)
    except Exception as e:  # noqa: BLE001 - the table does not exist yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
    else:
        rows = rows.join(old, keys, "left_anti")
    rows.write.mode("append").partitionBy("analysis_id").parquet(path)


def upsert(df: DataFrame, path: str, keys: list[str] | None = None) -> None:
    """Put rows into the table at path: rows of the same keys are replaced, all others stay. Without keys whole partitions (analysis_id) are replaced.

    Only partitions that df holds are written again. Repeated keys of df count once.
    """
    if keys:
        df = df.dropDuplicates(keys)
        touched = df.select("analysis_id").distinct()
        try:
            old = df.sparkSession.read.schema(df.schema).parquet(path)
        except Exception as e:  # noqa: BLE001 - the table does not exist yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
        else:
            stay = join_measured(old, touched, ["analysis_id"]).join(df, keys, "left_anti")
            df = cut(stay.select(*df.columns).unionByName(df))  # what is read is about to be overwritten
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("analysis_id").parquet(path)


def append_feedback(entries: DataFrame, path: str) -> None:
    """Add feedback entries to a folder of JSON lines, those whose id it holds already left out; files.feedback reads them."""
    rows = entries.dropDuplicates(["id"])
    try:
        known = entries.sparkSession.read.schema(FEEDBACK).json(path).select("id")
    except Exception as e:  # noqa: BLE001 - the folder does not exist yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
    else:
        rows = rows.join(cut(known), "id", "left_anti")
    rows.select(*[c.split()[0] for c in FEEDBACK.split(", ")]).write.mode("append").json(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_features_csv(features: DataFrame, path: str) -> None:
    """Features as CSV with the fixed header of 15 columns, the header alone if there are no rows."""
    columns = ["file_path", *FEATURES]
    if features.limit(1).count():
        features.select(*columns).write.mode("overwrite").option("header", True).csv(path)
    else:
        header = features.sparkSession.createDataFrame([(",".join(columns),)], "value string")
        header.coalesce(1).write.mode("overwrite").text(path)


def write_text(lines: DataFrame, path: str) -> None:
    """One string column as text, in parallel."""
    lines.write.mode("overwrite").text(path)


def dot_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Body lines of a Graphviz graph: (analysis_id, section, line). Labels are last path segments."""

    def quoted(c):
        return F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))

    style, colour = F.lit("solid"), F.lit("black")
    for kind, (s, c) in _EDGE.items():
        style, colour = F.when(F.col("kind") == kind, s).otherwise(style), F.when(F.col("kind") == kind, c).otherwise(colour)
    a = nodes.select("analysis_id", F.lit(1).alias("section"), F.format_string("  %s [label=%s];", quoted(F.col("id")), quoted(F.substring_index("id", "/", -1))).alias("line"))
    b = edges.select("analysis_id", F.lit(2).alias("section"), F.format_string("  %s -> %s [style=%s, color=%s];", quoted(F.col("source_id")), quoted(F.col("target_id")), style, colour).alias("line"))
    return a.unionByName(b)


def dot(nodes: DataFrame, edges: DataFrame, cycles: DataFrame | None = None) -> str:
    """One graph as DOT text on the driver, for graphs that a person looks at."""
    lines = [r.line for r in dot_lines(nodes, edges).orderBy("section", "line").toLocalIterator()]
    notes = [f"  // cycle: {', '.join(r.ids)}" for r in cycles.groupBy("component").agg(F.array_sort(F.collect_list("id")).alias("ids")).orderBy("component").toLocalIterator()] if cycles is not None else []
    return "\n".join(["digraph modules {", *notes, *lines, "}"])


def sarif_results(findings: DataFrame) -> DataFrame:
    """One SARIF 2.1.0 result object (JSON text) per finding (rule, severity, message, file_path, line)."""
    level = F.lit("note")
    for severity, name in LEVELS.items():
        level = F.when(F.lower("severity") == severity, name).otherwise(level)
    region = F.struct(F.greatest(F.col("line").cast("long"), F.lit(1)).alias("startLine"))
    location = F.struct(F.struct(F.struct(F.col("file_path").alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
    return findings.select(F.to_json(F.struct(F.col("rule").alias("ruleId"), level.alias("level"), F.struct(F.col("message").alias("text")).alias("message"), F.array(location).alias("locations"))).alias("result"))


def sarif(findings: DataFrame, tool: str = "riskloom") -> str:
    """A SARIF 2.1.0 log on the driver."""
    results = [json.loads(r.result) for r in sarif_results(findings).toLocalIterator()]
    rules = [{"id": x} for x in dict.fromkeys(r["ruleId"] for r in results)]
    return json.dumps({"$schema": "https://json.schemastore.org/sarif-2.1.0.json", "version": "2.1.0", "runs": [{"tool": {"driver": {"name": tool, "rules": rules}}, "results": results}]})


def badge(risk: float) -> str:
    return "HIGH" if risk >= 0.8 else "MEDIUM" if risk >= 0.5 else "LOW"


def markdown(findings: DataFrame, risk: float, most: int = 50) -> str:
    """A review comment: badge, counts by severity, the ``most`` worst findings (a top-k report)."""
    counts = {r[0]: r[1] for r in findings.groupBy(F.lower("severity")).count().collect()}
    rows = findings.orderBy(F.desc(severity_rank(F.col("severity"))), "file_path", "line", "rule").select("severity", "rule", "file_path", "line", "message").limit(most).collect()
    total = ", ".join(f"{counts[s]} {s}" for s in reversed(SEVERITIES) if s in counts) or "no findings"
    clean = lambda x: str(x).replace("|", "\\|").replace("\n", " ")
    body = [f"| {r.severity} | {r.rule} | {clean(r.file_path)}:{r.line} | {clean(r.message)} |" for r in rows]
    return "\n".join([f"## Risk {risk:.2f} ({badge(risk)})", "", total, "", *(["| Severity | Rule | Where | Message |", "|---|---|---|---|", *body] if body else [])]).rstrip()


def graph_report(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One JSON text per analysis with the graph's counts by kind."""
    n = nodes.groupBy("analysis_id").agg(F.count(F.lit(1)).alias("nodes"))
    e = edges.groupBy("analysis_id").agg(F.count(F.lit(1)).alias("edges"), *[F.count_if(F.col("kind") == k).alias(k) for k in _EDGE])
    return n.join(e, "analysis_id", "left").na.fill(0).select("analysis_id", F.to_json(F.struct("nodes", "edges", *_EDGE)).alias("report"))


def graph_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The whole graph as JSON lines: (analysis_id, kind, line), a line for each node and each edge."""
    a = nodes.select("analysis_id", F.lit("node").alias("kind"), F.to_json(F.struct("id", "file_path", "module_name", "language")).alias("line"))
    b = edges.select("analysis_id", F.lit("edge").alias("kind"), F.to_json(F.struct("source_id", "target_id", "line", F.col("kind").alias("kind"))).alias("line"))
    return a.unionByName(b)
