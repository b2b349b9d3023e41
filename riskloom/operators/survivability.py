"""Runtime survivability of code under load."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import codetext as T
from ..functions import queueing as Q
from ..functions.text import runtime_of
from ..runtime import cut, spread

#: Runtimes: mean expansion of payloads, concurrent requests, memory in MB, requests per second (fixed values).
RUNTIMES = {"jvm": (6.5, 200.0, 512.0, 2000.0), "node": (4.0, 4.0, 256.0, 1000.0), "python": (8.0, 8.0, 128.0, 500.0), "rust": (2.75, 512.0, 128.0, 5000.0), "go": (3.5, 1000.0, 128.0, 4000.0)}
#: Endings of files that are analysed, and those that tell the runtime of a repository (fixed values).
SUPPORTED = ("java", "kt", "kts", "py", "js", "ts", "mjs", "mts", "rs", "go")
RUNTIME_OF_ENDING = {"jvm": ("java", "kt"), "node": ("js", "ts", "mjs"), "python": ("py",), "rust": ("rs",), "go": ("go",)}
#: Expected requests per second, memory limit in MB, endpoints of a repository (fixed values, defaults).
EXPECTED_RPS, MEMORY_MB, MAX_ENDPOINTS = 30.0, 512.0, 50


def _by_runtime(runtime: Column, place: int) -> Column:
    out = F.lit(None).cast("double")
    for name, values in RUNTIMES.items():
        out = F.when(runtime == name, values[place]).otherwise(out)
    return out


def repository_runtimes(files: DataFrame) -> DataFrame:
    """Runtime of each analysis: that of its first file, by path, with an ending that tells one; analyses without such a file are rust."""
    ending = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    runtime = F.lit(None).cast("string")
    for name, endings in RUNTIME_OF_ENDING.items():
        runtime = F.when(ending.isin(*endings), name).otherwise(runtime)
    first = F.min_by(runtime, F.when(runtime.isNotNull(), F.col("path")))
    return files.groupBy("analysis_id").agg(F.coalesce(first, F.lit("rust")).alias("repository_runtime"))


def profiles(files: DataFrame) -> DataFrame:
    """Complexity profile of source files (analysis_id, path, language, content).

    What is counted follows the file's language (unknown ones count as rust), ``runtime`` is that of the repository. Files
    without text are left out.
    """
    text = F.col("content")
    runtime = F.coalesce(runtime_of(F.col("language")), F.lit("rust"))
    loops = T.count_all(text, T.LOOPS)
    extra_alloc = F.when(F.col("runtime") == "node", T.occurrences(text, "await ")).when(F.col("runtime") == "python", T.occurrences(text, "yield")).when(F.col("runtime") == "go", T.occurrences(text, "make(")).otherwise(0)
    extra_branch = F.when(F.col("runtime") == "node", T.occurrences(text, ".then(")).when(F.col("runtime") == "rust", T.occurrences(text, "unwrap(") + T.occurrences(text, "expect(")).when(F.col("runtime") == "go", T.occurrences(text, "err != nil")).otherwise(0)
    of_repository = F.broadcast(repository_runtimes(files))  # a row for each analysis
    return (
        spread(files.where(text.isNotNull()))
        .withColumn("runtime", runtime)
        .withColumns({"loops": loops, "loop_depth": F.when(F.col("runtime") == "python", T.indent_nesting(text)).otherwise(T.brace_nesting(text)), "branches": T.count_all(text, T.BRANCHES) + extra_branch, "functions": T.count_all(text, T.FUNCTIONS), "allocations": T.count_allocations(text) + extra_alloc, "bytes": F.octet_length(text)})
        .withColumn("class", T.complexity_class(F.col("loops"), F.col("loop_depth")))
        .withColumn("endpoints", T.endpoints(text, F.col("runtime")))
        .drop("content", "runtime")
        .join(of_repository, "analysis_id")
        .withColumnRenamed("repository_runtime", "runtime")
    )


def scores(profiles: DataFrame, rps: float = EXPECTED_RPS, memory_mb: float = MEMORY_MB) -> DataFrame:
    """Survivability of profiled files under ``rps`` requests per second: 1 minus the largest of six risks.

    Profiles are written first: the risks use each of their columns several times, and the optimizer would merge the
    projections and count every pattern again for each use.
    """
    profiles = cut(profiles)
    runtime, risk = F.col("runtime"), T.class_risk(F.col("class"))
    zero, one = F.lit(0.0), F.lit(1.0)
    lam = F.lit(float(rps))
    mu = _by_runtime(runtime, 3) * (1 - 0.6 * risk) / (1 + 0.1 * F.col("loop_depth")) / (1 + 0.02 * F.col("branches"))
    alloc, funcs = F.col("allocations").cast("double"), F.col("functions").cast("double")
    total = F.col("bytes") * 3.0 + 256.0
    df = profiles.withColumns({"service_rate": mu, "total_bytes": total, "temp_bytes": F.lit(256.0)})
    mu = F.col("service_rate")
    use = F.when(mu > 0, F.least(lam / mu, one)).otherwise(one)
    ok = Q.stable(lam, mu)
    limit = F.lit(float(memory_mb))
    gc = (
        F.when(runtime == "jvm", (F.least(F.col("temp_bytes") / 1024, F.lit(100.0)) / 100 + F.least(alloc, F.lit(100.0)) / 100) / 2)
        .when(runtime == "node", F.least(alloc, F.lit(50.0)) / 50 * 0.6)
        .when(runtime == "python", F.least(alloc, F.lit(100.0)) / 100 * 0.5)
        .when(runtime == "rust", F.least(alloc, F.lit(50.0)) / 50 * 0.3)
        .otherwise(F.least(funcs, F.lit(100.0)) / 100 * 0.4)
    )
    df = df.withColumns(
        {
            "utilization": use,
            "active": F.when(ok, Q.mm1(lam, mu)["l"]).otherwise(F.when(mu > 0, lam / mu).otherwise(lam * 0.03)),
            "response_ms": F.when(ok, F.least(Q.mm1_percentile(lam, mu, 0.95) * 1000, F.lit(30000.0))).otherwise(30000.0),
            "safe_rps": F.when(ok, Q.safe_rps(mu)).otherwise(0.0),
            "cpu_risk": risk,
            "latency_risk": risk,
            "memory_risk": F.least(F.col("total_bytes") / 1048576.0 / limit * _by_runtime(runtime, 1), one),
            "gc_risk": F.least(gc, one),
            "thread_risk": F.least(lam / _by_runtime(runtime, 1) / 20.0, one),
        }
    ).withColumn("queueing_risk", Q.queueing_risk(F.col("utilization")))
    df = df.withColumns({"latency_ms": latency_ms(risk, F.col("loop_depth"), F.col("total_bytes")), "throughput": throughput(runtime, risk, F.col("loop_depth"))})
    worst = F.greatest("cpu_risk", "memory_risk", "gc_risk", "thread_risk", "latency_risk", "queueing_risk")
    value = F.least(F.greatest(1.0 - worst, zero), one)
    return df.withColumn("survivability", value).withColumn("max_safe_rps", F.col("safe_rps") * F.when(F.col("utilization") > 0, F.least(0.6 / F.col("utilization"), F.lit(10.0))).otherwise(10.0))


def latency_ms(risk: Column, loop_depth: Column, total_bytes: Column) -> Column:
    """Estimated milliseconds of one request, by the risk of its complexity class, its loops and its weight."""
    return 10.0 * (1.0 + risk * 5.0) * (1.0 + total_bytes / 1024.0 / 100.0) * (1.0 + loop_depth * 0.2)


def throughput(runtime: Column, risk: Column, loop_depth: Column) -> Column:
    """Estimated requests per second of a runtime, for requests of one KB."""
    return _by_runtime(runtime, 1) / (latency_ms(risk, loop_depth, 1024.0 * _by_runtime(runtime, 0) + 256.0) / 1000.0)


def request_weight(text: Column, runtime: Column) -> dict[str, Column]:
    """Weight of a JSON request: raw bytes, expansion by the runtime, temporary allocations, total."""
    raw, temp, factor = T.json_raw_bytes(text), T.json_temp_bytes(text), _by_runtime(runtime, 0)
    return {"raw_bytes": raw, "expansion_factor": factor, "runtime_bytes": raw * factor, "temp_bytes": temp, "total_bytes": raw * factor + temp}


def endpoint_scores(scored: DataFrame, max_endpoints: int = MAX_ENDPOINTS) -> DataFrame:
    """Scores of the endpoints that files declare, the first ``max_endpoints`` of each analysis by path and place (the reference's configured limit)."""
    each = scored.select("*", F.posexplode("endpoints").alias("no", "endpoint")).drop("endpoints")
    place = F.row_number().over(Window.partitionBy("analysis_id").orderBy("path", "no"))
    return each.withColumn("place", place).where(F.col("place") <= max_endpoints).drop("place")


def no_source(files: DataFrame) -> DataFrame:
    """RSE-NO-SRC for each analysis without a file of a supported ending, RSE-ERR for each file of one whose text can't be read."""
    ending = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*SUPPORTED)
    per = files.groupBy("analysis_id").agg(F.count_if(ending).alias("n"))
    none = per.where("n = 0").select("analysis_id", F.lit("N/A").alias("file_path"), F.lit("RSE-NO-SRC").alias("rule"), F.lit("info").alias("severity"))
    lost = files.where(ending & F.col("content").isNull()).select("analysis_id", F.col("path").alias("file_path"), F.lit("RSE-ERR").alias("rule"), F.lit("warning").alias("severity"))
    return none.unionByName(lost)


def band(value: Column) -> Column:
    """Severity by survivability."""
    return F.when(value < 0.3, "critical").when(value < 0.6, "error").when(value < 0.8, "warning").otherwise("info")


def findings(scored: DataFrame) -> DataFrame:
    """One RSE-SURV finding per file and one for each risk beyond its threshold."""
    rules = [
        ("RSE-SURV", F.lit(True), band(F.col("survivability"))),
        *[(f"RSE-{n.upper()}", F.col(f"{n}_risk") > 0.6, F.lit("error" if n == "thread" else "warning")) for n in ("cpu", "gc", "thread", "latency")],
        ("RSE-MEM", F.col("memory_risk") > 0.6, F.lit("warning")),
        ("RSE-QUEUE", F.col("utilization") >= 0.8, F.when(F.col("utilization") >= 1.0, "critical").otherwise("error")),
    ]
    each = F.explode(F.filter(F.array(*[F.when(when, F.struct(F.lit(name).alias("rule"), severity.alias("severity"))) for name, when, severity in rules]), lambda x: x.isNotNull())).alias("f")
    return scored.select("analysis_id", F.col("path").alias("file_path"), "survivability", each).select("analysis_id", "file_path", "f.rule", "f.severity", "survivability")


def summary(scored: DataFrame) -> DataFrame:
    """Worst file, averages and limits of each analysis; blocked below 0.3."""
    return scored.groupBy("analysis_id").agg(
        F.min_by("path", F.struct("survivability", "path")).alias("worst_file"), F.min("survivability").alias("worst"), F.avg("survivability").alias("average"), F.min("max_safe_rps").alias("min_safe_rps"),
        F.max("total_bytes").alias("max_bytes"), F.max("loop_depth").alias("max_loop_depth"), (F.min("survivability") < 0.3).alias("blocked"), (1 - F.min("survivability")).alias("risk"),
    )


def _digits(value: Column, n: int, unit: str = "") -> Column:
    """A number with n digits, halves to even."""
    return F.format_string(f"%.{n}f{unit}", F.bround(value, n))


def report_lines(scored: DataFrame) -> DataFrame:
    """The twelve formatted lines of each file's summary."""
    lines = [
        ("Survivability", _digits(F.col("survivability"), 2)), *[(f"{n} Risk", _digits(F.col(f"{n.lower()}_risk"), 2)) for n in ("CPU", "Memory", "GC", "Thread", "Latency")],
        ("Complexity", F.col("class")), ("Utilization", _digits(F.col("utilization") * 100, 1, "%%")), ("Safe RPS", _digits(F.col("safe_rps"), 0)),
        ("Response Time", _digits(F.col("response_ms"), 1, "ms")), ("Payload Expansion", F.lit("3.0x")), ("Predicted Memory", _digits(F.col("total_bytes") / 1024, 1, "KB/req")),
    ]
    each = F.posexplode(F.array(*[F.struct(F.lit(k).alias("label"), v.alias("value")) for k, v in lines]))
    return scored.select("analysis_id", "path", each).select("analysis_id", "path", "pos", "col.label", "col.value")
