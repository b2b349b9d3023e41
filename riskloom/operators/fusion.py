"""Fusing the results of engines: risk, metrics, findings, status; engines run side by side with failures kept apart."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import ci_status, risk_label, severity_rank

FINDING = "id string, engine string, file_path string, line long, message string, severity string, validated boolean, suggested_fix string, spec_data string, confidence double, edge_cases array<string>"

#: Engines and other names for them (fixed values).
ENGINES = {"mgtg": (), "dependency": ("deps",), "process": (), "ml": (), "hitl": ("feedback",), "rse": ("survivability",), "refactoring": (), "coupling": (), "performance": (), "testing_gap": ("testing",), "debt_roi": ("debt",)}
DEFAULT_ENGINES = ("mgtg", "dependency", "process")


def parse_engines(names: str | None) -> list[str]:
    """Engine names of a comma-separated list; nothing gives the default three, an unknown name all."""
    if not names or not names.strip():
        return list(DEFAULT_ENGINES)
    alias = {a: e for e, others in ENGINES.items() for a in (e, e.replace("_", "-"), *others)}
    out = [alias.get(n.strip().lower()) for n in names.split(",") if n.strip()]
    return list(ENGINES) if None in out else list(dict.fromkeys(out))


def fuse(results: DataFrame, by: list[str] = (), strategy: str = "mean") -> DataFrame:
    """Risk over the engines that succeeded (NaN counts 0, at most 1; 0 if there is none), blocked if any blocks, total time."""
    risk = F.least(F.lit(1.0), F.when(F.isnan("overall_risk"), 0.0).otherwise(F.col("overall_risk")))
    good = F.when(F.lower("status") == "ok", risk)
    fused = F.avg(good) if strategy == "mean" else F.max(good)
    return results.groupBy(*by).agg(
        F.least(F.lit(1.0), F.coalesce(fused, F.lit(0.0))).alias("risk"), F.coalesce(F.bool_or("blocked_merge"), F.lit(False)).alias("blocked"), F.coalesce(F.sum("processing_time_ms"), F.lit(0.0)).alias("time_ms"), F.count_if(F.lower("status") == "ok").alias("engines")
    )


def label(fused: DataFrame) -> DataFrame:
    """Fused results with risk label, status line and whether they fail."""
    return fused.withColumn("label", risk_label(F.col("risk"))).withColumn("ci", ci_status(F.col("risk"), F.col("blocked"))).withColumn("failing", F.col("blocked") | (F.col("risk") >= 0.8))


def max_metrics(results: DataFrame, metrics: list[str], by: list[str] = ()) -> DataFrame:
    return results.groupBy(*by).agg(*[F.max(m).alias(m) for m in metrics])


def max_severity_risk(findings: DataFrame, by: list[str], high: float = 0.6, low: float = 0.3) -> DataFrame:
    """Risk by the worst finding: high from error on, low for a warning, else 0."""
    rank = F.max(severity_rank(F.col("severity")))
    return findings.groupBy(*by).agg(F.when(rank >= 2, high).when(rank >= 1, low).otherwise(0.0).alias("risk"))


def filter_severity(findings: DataFrame, level: str) -> DataFrame:
    """Findings of at least a level: error, warning or all."""
    least = {"error": 2, "warning": 1}.get(level, 0)
    return findings.where(severity_rank(F.col("severity")) >= least)


def union_findings(frames: list[DataFrame]) -> DataFrame:
    """Findings of all engines, none dropped."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def checked_risk(risk):
    """The risk, or an error if it lies outside [0, 1] or is NaN."""
    bad = risk.isNull() | F.isnan(risk) | (risk < 0) | (risk > 1)
    return F.when(bad, F.raise_error(F.lit("risk must lie in [0, 1]")).cast("double")).otherwise(risk)


@dataclass
class EngineResult:
    """``found`` has all findings of the engine and ``total`` their number; ``findings`` are those to show, or the failure."""

    engine: str
    status: str = "ok"
    risk: float = 0.0
    blocked: bool = False
    findings: list = field(default_factory=list)
    message: str = ""
    found: DataFrame | None = None
    total: int | None = None


class Orchestrator:
    """Named engines, each a function from a session and a folder to an EngineResult."""

    def __init__(self, engines: dict[str, Callable[[SparkSession, str], EngineResult]] | None = None):
        self.engines = dict(engines or {})

    def register(self, name: str, engine: Callable[[SparkSession, str], EngineResult]) -> None:
        self.engines[name] = engine

    def names(self) -> list[str]:
        return list(self.engines)

    def run_one(self, spark: SparkSession, folder: str, name: str) -> EngineResult:
        """The engine's result; a failure becomes an error finding."""
        try:
            return self.engines[name](spark, folder)
        except Exception as e:  # noqa: BLE001 - any engine failure is a finding
            found = {"id": f"ORCH-{name}-ERR", "engine": name, "severity": "error", "message": str(e)[:500], "file_path": "", "line": 0}
            return EngineResult(name, "failed", findings=[found], message=str(e)[:500])

    def run(self, spark: SparkSession, folder: str, names: list[str] | None = None) -> list[EngineResult]:
        """Results of the registered engines among the names. With process and ml both wanted, process runs first."""
        wanted = [n for n in (names or DEFAULT_ENGINES) if n in self.engines]
        first = ["process"] if {"process", "ml"} <= set(wanted) else []
        done = [self.run_one(spark, folder, n) for n in first]
        with ThreadPoolExecutor(max_workers=max(1, len(wanted))) as pool:
            done += pool.map(lambda n: self.run_one(spark, folder, n), [n for n in wanted if n not in first])
        return done
