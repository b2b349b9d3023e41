"""Queries on module graphs, queues and code text, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codetext as T
from ..functions import queueing as Q
from ..operators import graph as G
from ..operators import survivability as S
from ..runtime import table

#: Layers of the analysed repositories and what each may use.
LAYERS = {"ui": ["api", "common"], "api": ["core", "auth", "common"], "core": ["store", "common"], "store": ["common"], "auth": ["store", "common"], "common": []}
#: Service rates for which arrivals are examined, requests per second.
RATES = (0.0005, 0.001, 0.002, 0.01)


def _known(spark: SparkSession, d: str) -> DataFrame:
    return G.known_edges(G.edges_of(spark, d), G.nodes_of(spark, d))


def graph_nodes(spark: SparkSession, d: str) -> DataFrame:
    return G.nodes_of(spark, d)


def graph_edges(spark: SparkSession, d: str) -> DataFrame:
    return _known(spark, d).select("analysis_id", "source_id", "target_id", "line", "kind", "row_id")


def fan_in_out(spark: SparkSession, d: str) -> DataFrame:
    return G.fans(_known(spark, d))


def fan_summary(spark: SparkSession, d: str) -> DataFrame:
    return fan_in_out(spark, d).groupBy("analysis_id").agg(F.max("fan_in").alias("max_fan_in"), F.max("fan_out").alias("max_fan_out"), F.count(F.lit(1)).alias("n_nodes"))


def reachability(spark: SparkSession, d: str) -> DataFrame:
    """What each analysis reaches from the modules under src/api."""
    edges = _known(spark, d)
    return G.reach(edges, edges.where("source_id LIKE 'src/api/%'").select("analysis_id", F.col("source_id").alias("id")))


def scc_components(spark: SparkSession, d: str) -> DataFrame:
    return G.components(_known(spark, d))


def scc_findings(spark: SparkSession, d: str) -> DataFrame:
    per = scc_components(spark, d).groupBy("analysis_id", "component").agg(F.count(F.lit(1)).alias("n"))
    return per.select("analysis_id", F.lit("DEP-CYC").alias("rule"), F.lit("error").alias("severity"), "component", "n")


def layer_violations(spark: SparkSession, d: str) -> DataFrame:
    return G.layer_violations(_known(spark, d), LAYERS)


def dependency_findings(spark: SparkSession, d: str) -> DataFrame:
    """Cycles of modules and edges against the layer rules, as findings."""
    cycles = scc_findings(spark, d).select("analysis_id", "rule", "severity", F.format_string("cycle of %d modules at %s", "n", "component").alias("subject"))
    broken = layer_violations(spark, d).select("analysis_id", F.lit("DEP-ARCH").alias("rule"), F.lit("error").alias("severity"), F.format_string("%s uses %s: %s may not use %s", "source_id", "target_id", "from_layer", "to_layer").alias("subject"))
    return cycles.unionByName(broken)


def dependency_risk(spark: SparkSession, d: str) -> DataFrame:
    return G.dependency_risk(dependency_findings(spark, d)).withColumn("risk", F.round("risk", 6))


def _arrivals(spark: SparkSession, d: str) -> DataFrame:
    """Arrival rate of each event type in events per second, with each service rate."""
    per = table(spark, d, "events", "event_type", "ts").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.expr("timestampdiff(SECOND, min(ts), max(ts))").alias("s"))
    return per.select("event_type", (F.col("n") / F.col("s")).alias("lam"), F.explode(F.array(*map(F.lit, RATES))).alias("mu"))


def _round(df: DataFrame, **columns) -> DataFrame:
    return df.select("event_type", "mu", *[F.round(v, 6).alias(k) for k, v in columns.items()])


def mm1_metrics(spark: SparkSession, d: str) -> DataFrame:
    lam, mu = F.col("lam"), F.col("mu")
    return _round(_arrivals(spark, d), **Q.mm1(lam, mu), p50=Q.mm1_percentile(lam, mu, 0.5), p95=Q.mm1_percentile(lam, mu, 0.95), p99=Q.mm1_percentile(lam, mu, 0.99))


def mmc_metrics(spark: SparkSession, d: str) -> DataFrame:
    return _round(_arrivals(spark, d), b=Q.erlang_b(F.lit(3), F.col("lam") / F.col("mu")), **Q.mmc(F.lit(3), F.col("lam"), F.col("mu")))


def queue_risk(spark: SparkSession, d: str) -> DataFrame:
    use = F.least(F.col("lam") / F.col("mu"), F.lit(1.0))
    return _round(_arrivals(spark, d), safe_rps=Q.safe_rps(F.col("mu")), utilization=use, risk=Q.queueing_risk(use))


def _sources(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "source_files", "analysis_id", "path", "language", "content")


def text_counts(spark: SparkSession, d: str) -> DataFrame:
    text = F.col("content")
    return _sources(spark, d).where("content IS NOT NULL").select(
        "analysis_id", "path", T.count_all(text, T.LOOPS).alias("loops"), T.count_all(text, T.BRANCHES).alias("branches"), T.count_all(text, T.FUNCTIONS).alias("functions"), F.octet_length(text).cast("long").alias("bytes")
    )


def duplication(spark: SparkSession, d: str) -> DataFrame:
    return _sources(spark, d).where("content IS NOT NULL").select("analysis_id", "path", F.round(T.duplication_ratio(F.col("content")), 6).alias("ratio"))


def complexity_classes(spark: SparkSession, d: str) -> DataFrame:
    """Class of each file by its loops and their nesting."""
    return S.profiles(_sources(spark, d)).select("analysis_id", "path", "class", T.class_risk(F.col("class")).alias("risk"))


def endpoints(spark: SparkSession, d: str) -> DataFrame:
    from ..functions.text import runtime_of

    return _sources(spark, d).select("analysis_id", "path", F.explode(T.endpoints(F.col("content"), runtime_of(F.col("language")))).alias("route"))


def _scores(spark: SparkSession, d: str) -> DataFrame:
    return S.scores(S.profiles(_sources(spark, d)))


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c, t in df.dtypes if t == "double"})


def survivability_scores(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_scores(spark, d).drop("endpoints", "language"))


def endpoint_scores(spark: SparkSession, d: str) -> DataFrame:
    """Survivability of every declared endpoint, at most 50 of an analysis."""
    return _rounded(S.endpoint_scores(_scores(spark, d)).select("analysis_id", "path", "endpoint", "runtime", "survivability", "utilization", "safe_rps"))


def rse_no_source(spark: SparkSession, d: str) -> DataFrame:
    return S.no_source(_sources(spark, d))


def request_weights(spark: SparkSession, d: str) -> DataFrame:
    """Weight of JSON requests, here the review comments of documents with marks as they stand, on each runtime."""
    docs = table(spark, d, "documents", "doc_id", "text").where("text IS NOT NULL").withColumn("runtime", F.explode(F.array(*map(F.lit, S.RUNTIMES))))
    return docs.select("doc_id", "runtime", *[v.alias(k) for k, v in S.request_weight(F.col("text"), F.col("runtime")).items()])


def rse_findings(spark: SparkSession, d: str) -> DataFrame:
    return S.findings(_scores(spark, d)).withColumn("survivability", F.round("survivability", 6))


def rse_summary(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(S.summary(_scores(spark, d)))


def rse_report(spark: SparkSession, d: str) -> DataFrame:
    return S.report_lines(_scores(spark, d))


QUERIES = {
    f.__name__: f
    for f in (graph_nodes, graph_edges, fan_in_out, fan_summary, reachability, scc_components, scc_findings, layer_violations, dependency_findings, dependency_risk, mm1_metrics, mmc_metrics, queue_risk, text_counts, duplication, complexity_classes, endpoints, survivability_scores, endpoint_scores, rse_no_source, request_weights, rse_findings, rse_summary, rse_report)
}

EDGES = """
nodes AS (SELECT analysis_id, id, file_path, module_name, language FROM dep_nodes WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY analysis_id, id ORDER BY loaded_at, row_id) = 1),
edges AS (SELECT e.analysis_id, source_id, target_id, line, CASE WHEN kind IN ('static', 'dynamic', 'reexport') THEN kind ELSE 'static' END AS kind, row_id FROM dep_edges e
          JOIN nodes a ON a.analysis_id = e.analysis_id AND a.id = source_id JOIN nodes b ON b.analysis_id = e.analysis_id AND b.id = target_id)
"""
_FANS = """fans AS (SELECT analysis_id, id, CAST(sum(i) AS BIGINT) AS fan_in, CAST(sum(o) AS BIGINT) AS fan_out FROM (SELECT analysis_id, target_id AS id, 1 AS i, 0 AS o FROM edges UNION ALL SELECT analysis_id, source_id, 0, 1 FROM edges) GROUP BY ALL)"""
_LAYER = "CASE " + " ".join(f"WHEN {{0}} = '{x}' OR starts_with({{0}}, '{x}/') OR starts_with({{0}}, 'src/{x}/') OR starts_with({{0}}, '{x}.') THEN '{x}'" for x in LAYERS) + " END"
_ALLOWED = " OR ".join(f"(from_layer = '{k}' AND to_layer IN ({', '.join(repr(x) for x in v)}))" for k, v in LAYERS.items() if v)
_VIOLATIONS = f"""violations AS (SELECT * FROM (SELECT analysis_id, source_id, target_id, {_LAYER.format('source_id')} AS from_layer, {_LAYER.format('target_id')} AS to_layer FROM edges) WHERE from_layer <> to_layer AND NOT ({_ALLOWED}))"""
_SCC = f"""RECURSIVE {EDGES},
step AS (SELECT DISTINCT analysis_id, source_id AS a, target_id AS b FROM edges WHERE source_id <> target_id),
closure AS (SELECT analysis_id, a, b FROM step UNION SELECT c.analysis_id, c.a, s.b FROM closure c JOIN step s ON s.analysis_id = c.analysis_id AND s.a = c.b),
scc AS (SELECT x.analysis_id, x.a AS id, least(x.a, min(x.b)) AS component FROM closure x JOIN closure y ON x.analysis_id = y.analysis_id AND x.a = y.b AND x.b = y.a WHERE x.a <> x.b GROUP BY x.analysis_id, x.a)
"""
_ARRIVALS = f"""arrivals AS (SELECT event_type, n / s AS lam, mu FROM (SELECT event_type, count(*) AS n, (epoch_us(max(ts)) - epoch_us(min(ts))) // 1000000 AS s FROM events GROUP BY ALL), (SELECT unnest([{', '.join(f'CAST({r} AS DOUBLE)' for r in RATES)}]) AS mu))"""


def _counted(patterns: tuple[str, ...]) -> str:
    quoted = [p.replace("'", "''") for p in patterns]
    return "CAST(" + " + ".join(f"len(regexp_extract_all(content, '{p}'))" for p in quoted) + " AS BIGINT)"


_OK = "lam >= 0 AND lam < mu"
_TEXT = f"t AS (SELECT analysis_id, path, {_counted(T.LOOPS)} AS loops, {_counted(T.BRANCHES)} AS branches, {_counted(T.FUNCTIONS)} AS functions, strlen(content) AS bytes FROM source_files WHERE content IS NOT NULL)"

def _case(values: dict, on: str = "runtime") -> str:
    return f"CASE {on} " + " ".join(f"WHEN '{k}' THEN CAST({v} AS DOUBLE)" for k, v in values.items()) + " END"


def _value(place: int) -> str:
    return _case({k: v[place] for k, v in S.RUNTIMES.items()})


_KINDS = "CASE lower(language) WHEN 'java' THEN 'jvm' WHEN 'kotlin' THEN 'jvm' WHEN 'javascript' THEN 'node' WHEN 'typescript' THEN 'node' WHEN 'python' THEN 'python' WHEN 'go' THEN 'go' ELSE 'rust' END"
_ENDINGS = "CASE lower(regexp_extract(path, '[.]([^./]+)$', 1)) " + " ".join(f"WHEN '{e}' THEN '{k}'" for k, es in S.RUNTIME_OF_ENDING.items() for e in es) + " END"
_BARE_TEXT = r"""regexp_replace(content, '(["''](?:\\.|[^"''\\])*["'']?)|//[^\n]*|/\*(?:[^*]|\*+[^*/])*\*+/', ' ', 'gs')"""
_RSE = f"""
rt AS (SELECT analysis_id, coalesce(arg_min(r, path) FILTER (r IS NOT NULL), 'rust') AS runtime FROM (SELECT analysis_id, path, {_ENDINGS} AS r FROM source_files) GROUP BY ALL),
f AS (SELECT analysis_id, path, content, {_KINDS} AS kind, strlen(content) AS bytes FROM source_files WHERE content IS NOT NULL),
ln AS (SELECT analysis_id, path, generate_subscripts(string_split(content, chr(10)), 1) AS no, unnest(string_split(content, chr(10))) AS raw FROM f),
br AS (SELECT *, trim(raw) AS x, length(raw) - length(replace(raw, '{{', '')) AS o, length(raw) - length(replace(raw, '}}', '')) AS c FROM ln WHERE trim(raw) <> '' AND NOT regexp_matches(trim(raw), '^(//|#|/[*]|[*])')),
su AS (SELECT *, sum(o - c) OVER w AS s FROM br WINDOW w AS (PARTITION BY analysis_id, path ORDER BY no)),
de AS (SELECT *, s - least(0, min(s) OVER (PARTITION BY analysis_id, path ORDER BY no)) AS depth FROM su),
bn AS (SELECT analysis_id, path, max(greatest(CASE WHEN o > c THEN depth ELSE 0 END, CASE WHEN regexp_matches(x, 'if |for |while |catch |except') AND NOT contains(x, '{{') AND NOT ends_with(x, ':') THEN 1 ELSE 0 END)) AS nest FROM de GROUP BY ALL),
ind AS (SELECT analysis_id, path, greatest(max((length(raw) - length(ltrim(raw, ' '))) // 4) // 2, 1) AS nest FROM ln WHERE NOT regexp_matches(trim(raw), '^(#|$)') GROUP BY ALL),
occ AS (SELECT *, (length(content) - length(replace(content, 'await ', ''))) // 6 AS n_await, (length(content) - length(replace(content, 'yield', ''))) // 5 AS n_yield, (length(content) - length(replace(content, 'make(', ''))) // 5 AS n_make,
        (length(content) - length(replace(content, '.then(', ''))) // 6 AS n_then, (length(content) - length(replace(content, 'unwrap(', ''))) // 7 + (length(content) - length(replace(content, 'expect(', ''))) // 7 AS n_unwrap, (length(content) - length(replace(content, 'err != nil', ''))) // 10 AS n_err FROM f),
pr AS (SELECT o.analysis_id, o.path, rt.runtime, {_counted(T.LOOPS)} AS loops, CAST(CASE WHEN kind = 'python' THEN coalesce(ind.nest, 1) ELSE coalesce(bn.nest, 0) END AS BIGINT) AS loop_depth,
       {_counted(T.BRANCHES)} + CASE kind WHEN 'node' THEN n_then WHEN 'rust' THEN n_unwrap WHEN 'go' THEN n_err ELSE 0 END AS branches, {_counted(T.FUNCTIONS)} AS functions,
       least(1000, {_counted(T.ALLOCATIONS).replace("content", "bare")}) + CASE kind WHEN 'node' THEN n_await WHEN 'python' THEN n_yield WHEN 'go' THEN n_make ELSE 0 END AS allocations, bytes
       FROM (SELECT *, {_BARE_TEXT} AS bare FROM occ) o JOIN rt USING (analysis_id) LEFT JOIN bn ON bn.analysis_id = o.analysis_id AND bn.path = o.path LEFT JOIN ind ON ind.analysis_id = o.analysis_id AND ind.path = o.path),
cl AS (SELECT *, CASE WHEN loops = 0 THEN 'O(1)' WHEN loops = 1 THEN CASE WHEN loop_depth >= 4 THEN 'O(n³)' WHEN loop_depth >= 3 THEN 'O(n²)' ELSE 'O(n)' END WHEN loops = 2 THEN CASE WHEN loop_depth >= 3 THEN 'O(n³)' ELSE 'O(n²)' END
       WHEN loops <= 5 THEN 'O(n²)' WHEN loops <= 10 THEN 'O(n³)' WHEN loop_depth >= 5 THEN 'O(2ⁿ)' ELSE 'O(n³)' END AS class FROM pr),
ri AS (SELECT *, {_case(T.CLASS_RISK, "class")} AS risk, bytes * 3.0 + 256 AS total_bytes, 256.0 AS temp_bytes, {_value(0)} AS expansion, {_value(1)} AS conc, {_value(3)} AS base, CAST({S.EXPECTED_RPS} AS DOUBLE) AS lam FROM cl),
mu AS (SELECT *, base * (1 - 0.6 * risk) / (1 + 0.1 * loop_depth) / (1 + 0.02 * branches) AS service_rate FROM ri),
qu AS (SELECT *, least(lam / service_rate, 1.0) AS utilization, lam < service_rate AS ok FROM mu),
rk AS (SELECT *, CASE WHEN ok THEN lam / service_rate / (1 - lam / service_rate) ELSE lam / service_rate END AS active, CASE WHEN ok THEN least(-ln(1 - 0.95) / (service_rate - lam) * 1000, 30000.0) ELSE 30000.0 END AS response_ms,
       CASE WHEN ok THEN 0.5 * service_rate * service_rate / (1 + 0.5 * service_rate) ELSE 0.0 END AS safe_rps, risk AS cpu_risk, risk AS latency_risk, least(total_bytes / 1048576 / {S.MEMORY_MB} * conc, 1.0) AS memory_risk,
       least(CASE runtime WHEN 'jvm' THEN (least(temp_bytes / 1024, 100.0) / 100 + least(allocations, 100) / 100) / 2 WHEN 'node' THEN least(allocations, 50) / 50 * 0.6 WHEN 'python' THEN least(allocations, 100) / 100 * 0.5
         WHEN 'rust' THEN least(allocations, 50) / 50 * 0.3 ELSE least(functions, 100) / 100 * 0.4 END, 1.0) AS gc_risk, least(lam / conc / 20, 1.0) AS thread_risk,
       CASE WHEN utilization < 0.6 THEN utilization / 0.6 * 0.3 WHEN utilization < 0.8 THEN 0.3 + (utilization - 0.6) / 0.2 * 0.3 WHEN utilization < 1 THEN 0.6 + (utilization - 0.8) / 0.2 * 0.3 ELSE 1.0 END AS queueing_risk,
       10 * (1 + risk * 5) * (1 + total_bytes / 1024 / 100) * (1 + loop_depth * 0.2) AS latency_ms, conc / (10 * (1 + risk * 5) * (1 + (1024 * expansion + 256) / 1024 / 100) * (1 + loop_depth * 0.2) / 1000) AS throughput FROM qu),
sc AS (SELECT *, least(greatest(1 - greatest(cpu_risk, memory_risk, gc_risk, thread_risk, latency_risk, queueing_risk), 0.0), 1.0) AS survivability, safe_rps * least(0.6 / utilization, 10.0) AS max_safe_rps FROM rk)
"""
_RSE_COLUMNS = ["service_rate", "total_bytes", "temp_bytes", "utilization", "active", "response_ms", "safe_rps", "cpu_risk", "latency_risk", "memory_risk", "gc_risk", "thread_risk", "queueing_risk", "latency_ms", "throughput", "survivability", "max_safe_rps"]
_BAND = "CASE WHEN survivability < 0.3 THEN 'critical' WHEN survivability < 0.6 THEN 'error' WHEN survivability < 0.8 THEN 'warning' ELSE 'info' END"
_RULES = [("RSE-SURV", "true", _BAND), *[(f"RSE-{n.upper()}", f"{n}_risk > 0.6", "'error'" if n == "thread" else "'warning'") for n in ("cpu", "gc", "thread", "latency")], ("RSE-MEM", "memory_risk > 0.6", "'warning'"),
          ("RSE-QUEUE", "utilization >= 0.8", "CASE WHEN utilization >= 1 THEN 'critical' ELSE 'error' END")]
_LINES = [("Survivability", "printf('%.2f', survivability)"), *[(f"{n} Risk", f"printf('%.2f', {n.lower()}_risk)") for n in ("CPU", "Memory", "GC", "Thread", "Latency")], ("Complexity", "class"), ("Utilization", "printf('%.1f%%', utilization * 100)"),
          ("Safe RPS", "printf('%.0f', safe_rps)"), ("Response Time", "printf('%.1fms', response_ms)"), ("Payload Expansion", "'3.0x'"), ("Predicted Memory", "printf('%.1fKB/req', total_bytes / 1024)")]

SQL = {
    "graph_nodes": f"WITH {EDGES} SELECT * FROM nodes",
    "graph_edges": f"WITH {EDGES} SELECT * FROM edges",
    "fan_in_out": f"WITH {EDGES}, {_FANS} SELECT * FROM fans",
    "fan_summary": f"WITH {EDGES}, {_FANS} SELECT analysis_id, max(fan_in) AS max_fan_in, max(fan_out) AS max_fan_out, count(*) AS n_nodes FROM fans GROUP BY ALL",
    "reachability": f"""WITH RECURSIVE {EDGES}, r AS (SELECT DISTINCT analysis_id, target_id AS id FROM edges WHERE source_id LIKE 'src/api/%'
        UNION SELECT e.analysis_id, e.target_id FROM r JOIN edges e ON e.analysis_id = r.analysis_id AND e.source_id = r.id) SELECT * FROM r""",
    "scc_components": f"WITH {_SCC} SELECT analysis_id, component, id FROM scc",
    "scc_findings": f"WITH {_SCC} SELECT analysis_id, 'DEP-CYC' AS rule, 'error' AS severity, component, count(*) AS n FROM scc GROUP BY ALL",
    "layer_violations": f"WITH {EDGES}, {_VIOLATIONS} SELECT * FROM violations",
    "dependency_findings": f"""WITH {_SCC}, {_VIOLATIONS} SELECT analysis_id, 'DEP-CYC' AS rule, 'error' AS severity, 'cycle of ' || count(*) || ' modules at ' || component AS subject FROM scc GROUP BY analysis_id, component
        UNION ALL SELECT analysis_id, 'DEP-ARCH', 'error', source_id || ' uses ' || target_id || ': ' || from_layer || ' may not use ' || to_layer FROM violations""",
    "dependency_risk": f"""WITH {_SCC}, {_VIOLATIONS}, f AS (SELECT analysis_id, component AS x FROM scc GROUP BY ALL UNION ALL SELECT analysis_id, source_id FROM violations)
        SELECT analysis_id, round(least(1.0, 0.2 * count(*)), 6) AS risk FROM f GROUP BY ALL""",
    "mm1_metrics": f"""WITH {_ARRIVALS} SELECT event_type, mu, """
    + ", ".join(f"round(CASE WHEN {_OK} THEN {e} END, 6) AS {k}" for k, e in {"w": "1 / (mu - lam)", "wq": "lam / mu / (mu - lam)", "l": "lam / mu / (1 - lam / mu)", "lq": "(lam / mu) * (lam / mu) / (1 - lam / mu)", "p50": "-ln(0.5) / (mu - lam)", "p95": "-ln(1 - 0.95) / (mu - lam)", "p99": "-ln(1 - 0.99) / (mu - lam)"}.items())
    + " FROM arrivals",
    "mmc_metrics": f"""WITH {_ARRIVALS}, a AS (SELECT *, lam / mu AS a, lam / (3 * mu) AS rho FROM arrivals),
        b AS (SELECT *, (a*a*a/6) / (1 + a + a*a/2 + a*a*a/6) AS b FROM a), c AS (SELECT *, b / (1 - rho * (1 - b)) AS cw FROM b)
        SELECT event_type, mu, round(b, 6) AS b, round(CASE WHEN rho < 1 THEN cw END, 6) AS c_wait, round(CASE WHEN rho < 1 THEN cw / (3 * mu - lam) END, 6) AS wq, round(CASE WHEN rho < 1 THEN cw / (3 * mu - lam) + 1 / mu END, 6) AS w FROM c""",
    "queue_risk": f"""WITH {_ARRIVALS}, u AS (SELECT *, least(lam / mu, 1.0) AS u FROM arrivals) SELECT event_type, mu, round(0.5 * mu * mu / (1 + 0.5 * mu), 6) AS safe_rps, round(u, 6) AS utilization,
        round(CASE WHEN u < 0.6 THEN u / 0.6 * 0.3 WHEN u < 0.8 THEN 0.3 + (u - 0.6) / 0.2 * 0.3 WHEN u < 1 THEN 0.6 + (u - 0.8) / 0.2 * 0.3 ELSE 1 END, 6) AS risk FROM u""",
    "text_counts": f"WITH {_TEXT} SELECT * FROM t",
    "complexity_classes": f"WITH {_RSE} SELECT analysis_id, path, class, risk FROM ri",
    "survivability_scores": f"WITH {_RSE} SELECT analysis_id, path, runtime, loops, loop_depth, branches, functions, allocations, bytes, class, {', '.join(f'round({c}, 6) AS {c}' for c in _RSE_COLUMNS)} FROM sc",
    "rse_findings": f"WITH {_RSE} " + " UNION ALL ".join(f"SELECT analysis_id, path AS file_path, '{n}' AS rule, {sev} AS severity, round(survivability, 6) AS survivability FROM sc WHERE {when}" for n, when, sev in _RULES),
    "rse_summary": f"""WITH {_RSE} SELECT analysis_id, arg_min(path, (survivability, path)) AS worst_file, round(min(survivability), 6) AS worst, round(avg(survivability), 6) AS average, round(min(max_safe_rps), 6) AS min_safe_rps,
        round(max(total_bytes), 6) AS max_bytes, max(loop_depth) AS max_loop_depth, min(survivability) < 0.3 AS blocked, round(1 - min(survivability), 6) AS risk FROM sc GROUP BY ALL""",
    "rse_report": f"WITH {_RSE} " + " UNION ALL ".join(f"SELECT analysis_id, path, {i} AS pos, '{n}' AS label, {v} AS value FROM sc" for i, (n, v) in enumerate(_LINES)),
    "rse_no_source": f"""SELECT analysis_id, 'N/A' AS file_path, 'RSE-NO-SRC' AS rule, 'info' AS severity FROM source_files GROUP BY analysis_id HAVING count(*) FILTER (lower(regexp_extract(path, '[.]([^./]+)$', 1)) IN {S.SUPPORTED}) = 0
        UNION ALL SELECT analysis_id, path, 'RSE-ERR', 'warning' FROM source_files WHERE content IS NULL AND lower(regexp_extract(path, '[.]([^./]+)$', 1)) IN {S.SUPPORTED}""",
    "duplication": r"""WITH l AS (SELECT analysis_id, path, trim(translate(unnest(string_split(content, chr(10))), chr(13) || chr(9), '  ')) AS x FROM source_files WHERE content IS NOT NULL),
        c AS (SELECT analysis_id, path, x, count(*) AS k FROM l WHERE x <> '' GROUP BY ALL),
        r AS (SELECT analysis_id, path, sum(k) AS n, coalesce(sum(k - 1) FILTER (length(x) >= 5), 0) AS d FROM c GROUP BY ALL)
        SELECT s.analysis_id, s.path, round(CASE WHEN coalesce(n, 0) < 4 THEN 0 ELSE d / n END, 6) AS ratio FROM source_files s LEFT JOIN r ON r.analysis_id = s.analysis_id AND r.path = s.path WHERE content IS NOT NULL""",
}
