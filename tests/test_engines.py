import json

from riskloom import engines, sinks
from riskloom.operators.fusion import EngineResult


def test_findings_beyond_the_shown_are_in_summary_json_and_sarif(spark):
    n = engines.SHOWN * 2 + 50
    found = spark.createDataFrame([("R", "error" if i == n - 1 else "info", f"f{i}.py", i) for i in range(n)], "rule string, severity string, path string, line long")
    lost = {"id": "ORCH-ml-ERR", "engine": "ml", "severity": "error", "message": "m", "file_path": "", "line": 0}
    results = [engines._result("mgtg", found, 0.5), EngineResult("ml", "failed", findings=[lost])]
    whole = engines.summary(results)
    assert len(whole["findings"]) == n + 1 and whole["engines"]["mgtg"]["findings"] == n and whole["findings"][0]["file_path"] == f"f{n - 1}.py"
    assert len(json.loads(engines.as_text(whole, "json"))["findings"]) == n + 1
    log = json.loads(sinks.sarif(engines.all_findings(spark, results)))
    assert {r["ruleId"] for r in log["runs"][0]["results"]} == {"R", "ORCH-ml-ERR"} and len(log["runs"][0]["results"]) == n + 1
    text = engines.as_text(engines.summary(results, shown=True), "pretty")
    assert f"{n} findings" in text and f"the {engines.SHOWN + 1} worst of {n + 1} findings" in text and text.count(" R f") == engines.SHOWN
    assert json.loads(sinks.sarif(engines.all_findings(spark, [])))["runs"][0]["results"] == []
