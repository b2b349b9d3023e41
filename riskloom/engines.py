"""The engines over a folder of tables, as the orchestrator runs them."""

from __future__ import annotations

import json
from threading import Lock

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import severity_rank
from .operators import code_ir, repair, survivability
from .operators import graph as G
from .operators import process as P
from .operators.fusion import EngineResult, Orchestrator, union_findings
from .plans import graph_queries, model_queries, process_queries
from .runtime import cut, table

#: Findings of one engine that the pretty text shows, beside the number of all; JSON and SARIF have all.
SHOWN = 200

FOUND = "rule string, severity string, file_path string, line int, message string, engine string"


def _worst_first(found: DataFrame) -> DataFrame:
    return found.orderBy("engine", F.desc(severity_rank(F.col("severity"))), "rule", "file_path", "line", "message")


def _result(engine: str, found: DataFrame, risk: float, blocked: bool = False) -> EngineResult:
    """The engine's result with all its findings as a table, their number, and the worst of them to show."""
    have = set(found.columns)
    path = "file_path" if "file_path" in have else "path" if "path" in have else None
    rows = found.select(
        F.col("rule"), "severity", (F.col(path) if path else F.lit("")).alias("file_path"), (F.col("line") if "line" in have else F.lit(1)).cast("int").alias("line"), (F.col("message") if "message" in have else F.col("rule")).alias("message"), F.lit(engine).alias("engine")
    )
    rows = cut(rows)
    shown = [r.asDict() for r in _worst_first(rows).limit(SHOWN).collect()]
    return EngineResult(engine, risk=float(min(1.0, max(0.0, risk or 0.0))), blocked=blocked, findings=shown, found=rows, total=rows.count())


def _worst(found: DataFrame, high: float, low: float) -> float:
    rank = found.agg(F.max(severity_rank(F.col("severity")))).first()[0]
    return 0.0 if rank is None else high if rank >= 2 else low if rank >= 1 else 0.0


def process(spark: SparkSession, folder: str) -> EngineResult:
    found, features = process_queries._findings(spark, folder)
    found = cut(found)
    return _result("process", found, P.process_risk(found, features).agg(F.max("risk")).first()[0])


def dependency(spark: SparkSession, folder: str) -> EngineResult:
    """Cycles, and edges that the layer rules do not allow; each is an error."""
    found = cut(graph_queries.dependency_findings(spark, folder).withColumnRenamed("subject", "message"))
    return _result("dependency", found, G.dependency_risk(found).agg(F.max("risk")).first()[0])


def mgtg(spark: SparkSession, folder: str) -> EngineResult:
    tree = cut(code_ir.nodes(table(spark, folder, "source_files", "analysis_id", "path", "content")))
    found = cut(code_ir.findings(tree))
    mean = code_ir.file_health(tree, found).agg(F.coalesce(F.avg("health"), F.lit(1.0))).first()[0]
    return _result("mgtg", found, 1.0 - mean)


def rse(spark: SparkSession, folder: str) -> EngineResult:
    """Findings of the endpoints' files; where no file declares an endpoint, of every file. Blocked below 0.3."""
    files = table(spark, folder, "source_files", "analysis_id", "path", "language", "content")
    scored = cut(survivability.scores(survivability.profiles(files)))
    routed = cut(survivability.endpoint_scores(scored))
    scored = routed if routed.limit(1).count() else scored
    worst = scored.agg(F.min("survivability")).first()[0]
    found = survivability.findings(scored).select("file_path", "rule", "severity").unionByName(survivability.no_source(files).drop("analysis_id"))
    return _result("rse", found, 0.0 if worst is None else 1.0 - worst, worst is not None and worst < 0.3)


def ml(spark: SparkSession, folder: str) -> EngineResult:
    scored = cut(model_queries.ml_score(spark, folder))
    found = scored.where("p >= 0.5").select("file_path", F.lit("ML-RISK").alias("rule"), F.lit("warning").alias("severity"), F.format_string("predicted risk %.2f", "p").alias("message"))
    return _result("ml", found, scored.agg(F.avg("p")).first()[0])


class _Repairs:
    """The repair engines over one scan of the files of a folder."""

    def __init__(self):
        self.found: dict[str, DataFrame] = {}
        self.lock = Lock()

    def engine(self, name: str, high: float, low: float):
        def run(spark: SparkSession, folder: str) -> EngineResult:
            with self.lock:
                if folder not in self.found:
                    self.found[folder] = cut(repair.findings(table(spark, folder, "source_files", "analysis_id", "path", "content")))
            found = self.found[folder].where(F.col("engine") == name)
            return _result(name, found, _worst(found, high, low))

        return run


def orchestrator() -> Orchestrator:
    """All engines that need nothing but the tables."""
    shared = _Repairs()
    repairs = {"refactoring": (0.6, 0.3), "coupling": (0.6, 0.3), "performance": (0.7, 0.4), "testing_gap": (0.5, 0.3), "debt_roi": (0.6, 0.3)}
    return Orchestrator({"process": process, "dependency": dependency, "mgtg": mgtg, "rse": rse, "ml": ml} | {n: shared.engine(n, *r) for n, r in repairs.items()})


def all_findings(spark: SparkSession, results: list[EngineResult]) -> DataFrame:
    """All findings of all engines, failures among them."""
    failed = [(f.get("rule") or f.get("id"), f["severity"], f["file_path"], int(f["line"] or 0), f["message"], r.engine) for r in results if r.found is None for f in r.findings]
    return _worst_first(union_findings([spark.createDataFrame(failed, FOUND), *[r.found for r in results if r.found is not None]]))


def summary(results: list[EngineResult], shown: bool = False) -> dict:
    """Fused result: mean risk of the engines that succeeded, all findings, whether the merge is blocked. ``shown``: only the findings to show, with the number of all by engine."""
    good = [r for r in results if r.status == "ok"]
    risk = min(1.0, sum(r.risk for r in good) / len(good)) if good else 0.0
    findings = [f for r in results for f in (r.findings if shown or r.found is None else (x.asDict() for x in _worst_first(r.found).toLocalIterator()))]
    engines = {r.engine: {"status": r.status, "risk": r.risk, "findings": len(r.findings) if r.total is None else r.total} for r in results}
    return {"risk": round(risk, 6), "blocked": any(r.blocked for r in results), "engines": engines, "findings": findings}


def as_text(result: dict, form: str) -> str:
    """A fused result as pretty text or JSON."""
    if form == "json":
        return json.dumps(result, ensure_ascii=False)
    total = sum(e["findings"] for e in result["engines"].values())
    lines = [f"risk {result['risk']:.2f}" + (", blocked" if result["blocked"] else ""), *[f"  {n}: {e['status']}, {e['risk']:.2f}, {e['findings']} findings" for n, e in result["engines"].items()]]
    if len(result["findings"]) < total:
        lines.append(f"the {len(result['findings'])} worst of {total} findings, at most {SHOWN} of an engine; JSON and SARIF have all")
    return "\n".join([*lines, *[f"{f['severity']:8} {f.get('rule') or f.get('id')} {f['file_path']}:{f['line']} {f['message']}" for f in result["findings"]]])
