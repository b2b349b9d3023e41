import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.functions import codetext as T
from riskloom.functions import queueing as Q
from riskloom.functions import text as X
from riskloom.operators import feedback as H
from riskloom.operators import fusion as U
from riskloom.operators import ml as M
from riskloom.operators import survivability as S


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_queues(spark):
    m = Q.mm1(F.lit(0.8), F.lit(1.0))
    assert value(spark, m["w"]) == pytest.approx(5) and value(spark, Q.mm1_percentile(F.lit(0.8), F.lit(1.0), 0.95)) == pytest.approx(14.978661367769954)
    assert value(spark, Q.mm1_percentile(F.lit(0.5), F.lit(1.0), 0.5)) == pytest.approx(1.3862944, abs=1e-6)
    assert value(spark, Q.erlang_b(F.lit(2), F.lit(1.5))) == pytest.approx(0.31034482758620685) and value(spark, Q.erlang_b(F.lit(0), F.lit(1.5))) == 1
    c = Q.mmc(F.lit(2), F.lit(1.5), F.lit(1.0))
    assert value(spark, c["c_wait"]) == pytest.approx(0.6428571, abs=1e-6) and value(spark, c["wq"]) == pytest.approx(1.2857143, abs=1e-6)
    for lam, mu in ((1.2, 1.0), (1.0, 1.0), (-1.0, 1.0), (1.0, 0.0)):
        assert value(spark, Q.mm1(F.lit(lam), F.lit(mu))["w"]) is None and value(spark, Q.mmc(F.lit(1), F.lit(lam), F.lit(mu))["w"]) is None
    assert value(spark, Q.queueing_risk(F.lit(float("nan")))) == 1 and value(spark, Q.queueing_risk(F.lit(0.7))) == pytest.approx(0.45) and value(spark, Q.queueing_risk(F.lit(float("inf")))) == 1
    assert value(spark, Q.safe_rps(F.lit(0.0))) == 0


def test_bands_and_labels(spark):
    assert [value(spark, S.band(F.lit(x))) for x in (0.29, 0.3, 0.6, 0.8)] == ["critical", "error", "warning", "info"]
    assert [value(spark, X.risk_label(F.lit(x))) for x in (0.29, 0.3, 0.6, 0.8)] == ["LOW", "MODERATE", "HIGH", "CRITICAL"]
    assert value(spark, X.ci_status(F.lit(0.1), F.lit(True))) == "FAIL" and value(spark, X.ci_status(F.lit(0.5), F.lit(False))) == "WARN"
    assert [value(spark, X.severity_rank(F.lit(x))) for x in ("info", "Warning", "ERROR", "critical", "odd", None)] == [0, 1, 2, 3, 0, 0]
    assert value(spark, X.normal_path(F.lit("a/./b/../c//d"))) == "a/c/d" and value(spark, X.normal_path(F.lit("../x"))) == "x"
    assert value(spark, X.module_name(F.lit("src/pkg/sub/__init__.py"))) == "pkg.sub" and value(spark, X.runtime_of(F.lit("Kotlin"))) == "jvm"
    assert value(spark, X.is_bug_fix(F.lit("prefix"))) and not value(spark, X.is_bug_fix(F.lit(None).cast("string")))


def test_code_text(spark):
    src = "// for (x)\nfn main() {\n  for (a) {\n    while (b) { if x { } else if y { } }\n  }\n}\nlet s = \"new Foo\"; // new Bar\nlet v = vec![]; new Baz"
    assert value(spark, T.count_all(F.lit(src), T.LOOPS)) == 3 and value(spark, T.count_allocations(F.lit(src))) == 2
    assert value(spark, T.brace_nesting(F.lit(src))) == 2 and value(spark, T.indent_nesting(F.lit("a\n        b"))) == 1
    assert value(spark, T.duplication_ratio(F.lit("hello\nhello\nworld\nx"))) == 0.25 and value(spark, T.duplication_ratio(F.lit("hello\nhello"))) == 0
    assert value(spark, T.complexity_class(F.lit(1), F.lit(4))) == "O(n³)" and value(spark, T.complexity_class(F.lit(11), F.lit(5))) == "O(2ⁿ)"
    assert value(spark, T.endpoints(F.lit('@app.get("/users")\n# x'), F.lit("python"))) == ["/users", "/users"] and value(spark, T.endpoints(F.lit('// .get("/no")'), F.lit("node"))) == []
    assert value(spark, T.health(F.lit(1), F.lit(0), F.lit(0), F.lit(12), F.lit(0), F.lit(0))) == pytest.approx(0.81)


def test_survivability(spark):
    rows = [("an", "a.py", "python", "for x in y:\n    pass\n" * 12), ("an", "b.rs", "rust", "fn a() {}"), ("an", "c.go", None, ""), ("an", "d", "go", None)]
    scored = S.scores(S.profiles(spark.createDataFrame(rows, "analysis_id string, path string, language string, content string")))
    got = {r.path: r for r in scored.collect()}
    assert set(got) == {"a.py", "b.rs", "c.go"} and all(0 <= r.survivability <= 1 for r in got.values()) and got["a.py"].survivability < got["b.rs"].survivability
    assert S.report_lines(scored).count() == 36 and S.summary(scored).first().worst_file == "a.py"
    assert S.findings(scored).where("rule = 'RSE-SURV'").count() == 3


def test_confusion_auc_and_sgd(spark):
    rows = [(0.9, True)] * 8 + [(0.9, False)] * 2 + [(0.1, False)] * 7 + [(0.1, True)] * 3
    df = spark.createDataFrame([("g", *r) for r in rows], "g string, p double, label boolean")
    r = M.confusion(df, ["g"]).first()
    assert (r.accuracy, r.precision) == (0.75, 0.8) and r.recall == pytest.approx(8 / 11) and r.f1 == pytest.approx(16 / 21)
    a = lambda rows: M.auc(spark.createDataFrame([("g", *x) for x in rows], "g string, p double, label boolean"), ["g"]).first().auc
    assert a([(0.9, True), (0.1, False)]) == 1 and a([(0.1, True), (0.9, False)]) == 0 and a([(0.5, True)]) == 0.5 and a([(0.5, True), (0.5, False)]) == 0.5
    x = np.array([[0.0], [1.0], [2.0], [3.0]])
    w, b = M.sgd(x, np.array([0, 0, 1, 1.0]))
    assert w[0] > 0 and 1 / (1 + math.exp(-(w[0] * 3 + b))) > 0.5 > 1 / (1 + math.exp(-b))
    f = spark.createDataFrame([("g", i, float(i), i > 5) for i in range(12)], "g string, i int, x double, label boolean")
    models = M.train(f, "g", ["i"], ["x"], epochs=100)
    assert M.predict_with(f, models, "g", ["x"]).where("(p >= 0.5) = label").count() == 12


def test_feedback(spark):
    schema = "id string, finding_id string, engine string, verdict string, timestamp long"
    e = spark.createDataFrame([("1", "f", "mgtg", "Correct", 1), ("2", "f", "mgtg", "Incorrect", 2), ("3", "g", "process", "Correct", 3), ("3", "g", "process", "Incorrect", 9), ("", "x", "y", "Correct", 1)], schema)
    u = H.unique(e)
    assert {r.engine: r.precision for r in H.metrics(u, ["engine"]).collect()} == {"mgtg": 0.5, "process": 1.0} and u.count() == 3
    many = spark.createDataFrame([(str(i), "bad", "m", "Incorrect", i) for i in range(3)] + [(str(i), "good", "m", "Correct", i) for i in range(10, 14)] + [("9", "few", "m", "Incorrect", 1)], schema)
    f = spark.createDataFrame([("bad", "critical"), ("good", "error"), ("few", "error")], "finding_id string, severity string")
    assert {r.finding_id: (r.severity, r.validated) for r in H.adjust(f, many).collect()} == {"bad": ("warning", False), "good": ("error", True), "few": ("error", False)}
    assert H.report(many, f).count() == 1 and H.report(many.limit(0), f).count() == 0 and H.precision_at(many, "engine", 4).first().precision == 1


def test_fusion(spark):
    schema = "engine string, status string, overall_risk double, blocked_merge boolean, processing_time_ms double"
    r = spark.createDataFrame([("a", "ok", 0.5, False, 1.0), ("b", "ok", float("nan"), False, 2.0), ("c", "failed", 0.9, False, 1.0)], schema)
    assert U.fuse(r).first().risk == 0.25 and U.fuse(r, strategy="max").first().risk == 0.5 and U.fuse(r.limit(0)).first().risk == 0
    o = U.Orchestrator({"process": lambda s, d: U.EngineResult("process", risk=0.5), "mgtg": lambda s, d: 1 / 0})
    got = {x.engine: x for x in o.run(spark, "", ["mgtg", "process", "nosuch"])}
    assert got["mgtg"].status == "failed" and got["mgtg"].findings[0]["id"] == "ORCH-mgtg-ERR" and got["process"].risk == 0.5
    assert U.parse_engines("") == ["mgtg", "dependency", "process"] and len(U.parse_engines("what")) == 11 and U.parse_engines("deps,ml") == ["dependency", "ml"]
    with pytest.raises(Exception, match="risk must lie"):
        value(spark, U.checked_risk(F.lit(1.5)))
