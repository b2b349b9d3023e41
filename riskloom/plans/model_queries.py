"""Queries on the risk model, human feedback and fused results, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import is_bug_fix
from ..operators import feedback as H
from ..operators import fusion as U
from ..operators import ml as M
from ..operators import process as P
from ..runtime import table
from .graph_queries import dependency_risk
from .process_queries import FINDINGS, JIT, process_risk

#: A file counts as defective from this number of bug-fix commits on.
DEFECTIVE = 4


def _scored(spark: SparkSession, d: str) -> DataFrame:
    features = P.jit_features(P.changes_of(spark, d))
    return M.predict(features, M.DEMO, floor=1.0).withColumn("label", F.col("bug_fix_commits") >= DEFECTIVE)


def ml_score(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).select("analysis_id", "file_path", F.round("p", 6).alias("p"))


def ml_presets(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.createDataFrame([(k, *map(float, v)) for k, v in M.PRESETS.items()], "preset string, " + ", ".join(f"{c} double" for c in M.FEATURES))
    return M.predict(rows, M.DEMO, floor=1.0).select("preset", F.round("p", 6).alias("p"), "risky")


def ml_scaling(spark: SparkSession, d: str) -> DataFrame:
    return M.scaling(P.jit_features(P.changes_of(spark, d))).select("feature", F.round("mean", 6).alias("mean"), F.round("std", 5).alias("std"))


def ml_confusion(spark: SparkSession, d: str) -> DataFrame:
    out = M.confusion(_scored(spark, d).withColumn("p", F.round("p", 9)), ["analysis_id"])
    return out.withColumns({c: F.round(c, 6) for c, t in out.dtypes if t == "double"})


def ml_auc(spark: SparkSession, d: str) -> DataFrame:
    return M.auc(_scored(spark, d), ["analysis_id"], digits=5).withColumn("auc", F.round("auc", 6))


def ml_train_sgd(spark: SparkSession, d: str) -> DataFrame:
    """A model of each analysis, trained in the order of paths on all features but the one that makes the label."""
    rows = P.jit_features(P.changes_of(spark, d)).withColumn("label", F.col("bug_fix_commits") >= DEFECTIVE)
    return M.train(rows, "analysis_id", ["file_path"], [c for c in M.FEATURES if c != "bug_fix_commits"])


def _feedback(spark: SparkSession, d: str) -> DataFrame:
    """Events as verdicts: the value decides, the property names the finding."""
    value = F.col("value")
    return table(spark, d, "events").select(
        F.concat(F.lit("e"), F.col("event_id")).alias("id"), F.concat(F.lit("f"), F.get_json_object("props", "$.k")).alias("finding_id"), F.col("event_type").alias("engine"),
        F.when(value < 60, "Correct").when(value < 120, "Incorrect").otherwise("Uncertain").alias("verdict"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("timestamp"),
    )


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c, t in df.dtypes if t == "double"})


def feedback_metrics(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(H.metrics(_feedback(spark, d), ["engine"]))


def feedback_total(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(H.metrics(_feedback(spark, d), []))


def finding_ratios(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(H.finding_ratios(_feedback(spark, d)))


def precision_at_50(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(H.precision_at(_feedback(spark, d), "engine", 50))


def engine_reliability(spark: SparkSession, d: str) -> DataFrame:
    best = F.max_by("engine", F.struct("precision", "engine"))
    return _rounded(H.metrics(_feedback(spark, d), ["engine"])).agg(best.alias("most_reliable"), F.max("precision").alias("precision"))


def _judged(spark: SparkSession, d: str) -> DataFrame:
    k = F.explode(F.sequence(F.lit(0), F.lit(129))).alias("k")
    severity = F.element_at(F.array(*map(F.lit, ("info", "warning", "error", "critical"))), (F.col("k") % 4 + 1).cast("int"))
    return spark.range(1).select(k).select(F.concat(F.lit("f"), F.col("k")).alias("finding_id"), severity.alias("severity"))


def adjust_findings(spark: SparkSession, d: str) -> DataFrame:
    return H.adjust(_judged(spark, d), _feedback(spark, d))


def findings_with_feedback(spark: SparkSession, d: str) -> DataFrame:
    return _judged(spark, d).join(_feedback(spark, d).select("finding_id").distinct(), "finding_id", "left_semi")


def _engines(spark: SparkSession, d: str) -> DataFrame:
    process = process_risk(spark, d).select("analysis_id", F.lit("process").alias("engine"), F.col("risk").alias("overall_risk"))
    graph = dependency_risk(spark, d).select("analysis_id", F.lit("dependency").alias("engine"), F.col("risk").alias("overall_risk"))
    score = F.round(F.avg(F.round("p", 6)), 6)
    model = _scored(spark, d).groupBy("analysis_id").agg(score.alias("overall_risk")).select("analysis_id", F.lit("ml").alias("engine"), "overall_risk")
    return process.unionByName(graph).unionByName(model).withColumns({"status": F.lit("ok"), "blocked_merge": F.col("overall_risk") >= 0.99, "processing_time_ms": F.lit(1.0)})


def risk_fusion(spark: SparkSession, d: str) -> DataFrame:
    """Fused risk of each analysis over its process, dependency and model engines."""
    return _rounded(U.label(U.fuse(_engines(spark, d), ["analysis_id"])))


def bug_density(spark: SparkSession, d: str) -> DataFrame:
    """Share of bug-fix changes per folder of the first level."""
    rows = P.changes_of(spark, d)
    out = rows.groupBy("analysis_id", F.substring_index("file_path", "/", 1).alias("folder")).agg(F.count(F.lit(1)).alias("n"), F.count_if(is_bug_fix(F.col("message"))).alias("bugs"))
    return out.withColumn("share", F.round(F.col("bugs") / F.col("n"), 6))


QUERIES = {
    f.__name__: f
    for f in (ml_score, ml_presets, ml_scaling, ml_confusion, ml_auc, ml_train_sgd, feedback_metrics, feedback_total, finding_ratios, precision_at_50, engine_reliability, adjust_findings, findings_with_feedback, risk_fusion, bug_density)
}

_Z = f"{M.DEMO.bias} + " + " + ".join(f"{w} * ({c} - {m}) / {max(s, 1.0)}" for w, m, s, c in zip(M.DEMO.weights, M.DEMO.means, M.DEMO.stds, M.FEATURES))
_SCORED = f"{JIT}, scored AS (SELECT *, 1 / (1 + exp(-({_Z}))) AS p, bug_fix_commits >= {DEFECTIVE} AS label FROM jit)"
_FEEDBACK = """fb AS (SELECT 'e' || event_id AS id, 'f' || (props->>'$.k') AS finding_id, event_type AS engine, CASE WHEN value < 60 THEN 'Correct' WHEN value < 120 THEN 'Incorrect' ELSE 'Uncertain' END AS verdict,
       CAST(floor(epoch(ts)) AS BIGINT) AS timestamp FROM events)"""
_METRICS = """count(*) AS total, count(*) FILTER (verdict = 'Correct') AS correct, count(*) FILTER (verdict = 'Incorrect') AS incorrect, count(*) FILTER (verdict = 'Uncertain') AS uncertain, count(DISTINCT finding_id) AS findings,
       round(coalesce(count(*) FILTER (verdict = 'Correct') / nullif(count(*) FILTER (verdict <> 'Uncertain'), 0), 0), 6) AS precision, round(count(*) FILTER (verdict = 'Incorrect') / count(*), 6) AS incorrect_rate"""
_JUDGED = "judged AS (SELECT 'f' || k AS finding_id, ['info', 'warning', 'error', 'critical'][k % 4 + 1] AS severity FROM range(130) t(k))"
_RATIOS = "ratios AS (SELECT finding_id, count(*) AS n, count(*) FILTER (verdict = 'Correct') / count(*) AS confirm, count(*) FILTER (verdict = 'Incorrect') / count(*) AS reject FROM fb GROUP BY ALL)"
_PRESET_ROWS = " UNION ALL ".join(f"SELECT '{k}' AS preset, " + ", ".join(f"CAST({x} AS DOUBLE) AS {c}" for x, c in zip(v, M.FEATURES)) for k, v in M.PRESETS.items())


def _fusion_sql() -> str:
    from .graph_queries import _SCC, _VIOLATIONS

    return f"""WITH {_SCC}, {_VIOLATIONS}, {FINDINGS}, scored AS (SELECT *, 1 / (1 + exp(-({_Z}))) AS p FROM jit),
        f AS (SELECT analysis_id, component AS x FROM scc GROUP BY ALL UNION ALL SELECT analysis_id, source_id FROM violations),
        e AS (SELECT analysis_id, round(risk, 6) AS r FROM prisk UNION ALL SELECT analysis_id, round(least(1.0, 0.2 * count(*)), 6) FROM f GROUP BY ALL UNION ALL SELECT analysis_id, round(avg(round(p, 6)), 6) FROM scored GROUP BY ALL),
        u AS (SELECT analysis_id, least(1.0, avg(r)) AS risk, bool_or(r >= 0.99) AS blocked, CAST(count(*) AS DOUBLE) AS time_ms, count(*) AS engines FROM e GROUP BY ALL)
        SELECT analysis_id, round(risk, 6) AS risk, blocked, time_ms, engines, CASE WHEN risk < 0.3 THEN 'LOW' WHEN risk < 0.6 THEN 'MODERATE' WHEN risk < 0.8 THEN 'HIGH' ELSE 'CRITICAL' END AS label,
        CASE WHEN blocked OR risk >= 0.8 THEN 'FAIL' WHEN risk >= 0.5 THEN 'WARN' ELSE 'PASS' END AS ci, blocked OR risk >= 0.8 AS failing FROM u"""


SQL = {
    "ml_score": f"WITH {_SCORED} SELECT analysis_id, file_path, round(p, 6) AS p FROM scored",
    "ml_presets": f"WITH presets AS ({_PRESET_ROWS}) SELECT preset, round(1 / (1 + exp(-({_Z}))), 6) AS p, 1 / (1 + exp(-({_Z}))) >= 0.5 AS risky FROM presets",
    "ml_scaling": f"WITH {JIT} " + " UNION ALL ".join(f"SELECT '{c}' AS feature, round(avg({c}), 6) AS mean, round(CASE WHEN var_pop({c}) <= 1e-12 THEN 1 ELSE sqrt(var_pop({c})) END, 5) AS std FROM jit" for c in M.FEATURES),
    "ml_confusion": f"""WITH {_SCORED}, c AS (SELECT analysis_id, count(*) FILTER (round(p, 9) >= 0.5 AND label) AS tp, count(*) FILTER (round(p, 9) >= 0.5 AND NOT label) AS fp, count(*) FILTER (round(p, 9) < 0.5 AND NOT label) AS tn, count(*) FILTER (round(p, 9) < 0.5 AND label) AS fn FROM scored GROUP BY ALL),
        r AS (SELECT *, (tp + tn) / (tp + fp + tn + fn) AS a, coalesce(tp / nullif(tp + fp, 0), 0) AS pr, coalesce(tp / nullif(tp + fn, 0), 0) AS re FROM c)
        SELECT analysis_id, tp, fp, tn, fn, round(a, 6) AS accuracy, round(pr, 6) AS precision, round(re, 6) AS recall, round(coalesce(2 * pr * re / nullif(pr + re, 0), 0), 6) AS f1 FROM r""",
    "ml_auc": f"""WITH {_SCORED}, x AS (SELECT analysis_id, round(p, 5) AS s, label FROM scored),
        a AS (SELECT p.analysis_id, avg(CASE WHEN p.s > n.s THEN 1.0 WHEN p.s = n.s THEN 0.5 ELSE 0.0 END) AS auc FROM x p JOIN x n ON p.analysis_id = n.analysis_id AND p.label AND NOT n.label GROUP BY ALL)
        SELECT g.analysis_id, round(coalesce(auc, 0.5), 6) AS auc FROM (SELECT DISTINCT analysis_id FROM x) g LEFT JOIN a USING (analysis_id)""",
    "feedback_metrics": f"WITH {_FEEDBACK} SELECT engine, {_METRICS} FROM fb GROUP BY ALL",
    "feedback_total": f"WITH {_FEEDBACK} SELECT {_METRICS} FROM fb",
    "finding_ratios": f"WITH {_FEEDBACK}, {_RATIOS} SELECT finding_id, n, round(confirm, 6) AS confirm, round(reject, 6) AS reject FROM ratios",
    "precision_at_50": f"""WITH {_FEEDBACK}, r AS (SELECT * FROM fb WHERE verdict <> 'Uncertain' QUALIFY row_number() OVER (PARTITION BY engine ORDER BY timestamp DESC, id DESC) <= 50)
        SELECT engine, round(count(*) FILTER (verdict = 'Correct') / count(*), 6) AS precision, count(*) AS n FROM r GROUP BY ALL""",
    "engine_reliability": f"WITH {_FEEDBACK}, m AS (SELECT engine, {_METRICS} FROM fb GROUP BY ALL) SELECT engine AS most_reliable, precision FROM m ORDER BY precision DESC, engine DESC LIMIT 1",
    "adjust_findings": f"""WITH {_FEEDBACK}, {_RATIOS}, {_JUDGED} SELECT j.finding_id, CASE WHEN coalesce(reject >= 0.6, false) AND NOT coalesce(confirm >= 0.8, false) THEN CASE WHEN severity = 'critical' THEN 'warning' ELSE 'info' END ELSE severity END AS severity,
        coalesce(confirm >= 0.8, false) AS validated FROM judged j LEFT JOIN (SELECT * FROM ratios WHERE n >= 3) r ON r.finding_id = j.finding_id""",
    "findings_with_feedback": f"WITH {_FEEDBACK}, {_JUDGED} SELECT * FROM judged WHERE finding_id IN (SELECT finding_id FROM fb)",
    "risk_fusion": _fusion_sql(),
    "bug_density": f"""WITH {JIT} SELECT analysis_id, string_split(file_path, '/')[1] AS folder, count(*) AS n, count(*) FILTER (coalesce(regexp_matches(lower(message), 'fix|bug|crash|defect|error|hotfix|patch|issue|#'), false)) AS bugs,
        round(count(*) FILTER (coalesce(regexp_matches(lower(message), 'fix|bug|crash|defect|error|hotfix|patch|issue|#'), false)) / count(*), 6) AS share FROM ch GROUP BY ALL""",
}
