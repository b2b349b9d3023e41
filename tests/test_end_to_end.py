import json
import subprocess

from riskloom.__main__ import analyze
from riskloom.plans.catalogue import QUERIES


def test_repository_to_results(spark, tmp_path):
    repo = tmp_path / "demo"
    (repo / "pkg").mkdir(parents=True)
    run = lambda *a: subprocess.run(["git", "-C", str(repo), "-c", "user.name=A B", "-c", "user.email=a@b.example", *a], check=True, capture_output=True)
    run("init", "-q")
    for i in range(4):
        (repo / "pkg" / "a.py").write_text(f"from . import b\n\ndef f(x):\n    h = open('y')\n    if x is None:\n        pass\n    return {i}\n")
        (repo / "pkg" / "b.py").write_text(f"from . import a\nX = {i}\n")
        run("add", "."), run("commit", "-qm", f"fix {i}")
    tables = str(tmp_path / "tables")
    result = json.loads(analyze(spark, [str(repo)], "process,dependency,mgtg,rse,ml,debt", "json", None, tables))
    assert 0 <= result["risk"] <= 1 and {e["status"] for e in result["engines"].values()} == {"ok"} and len(result["engines"]) == 6
    assert {"PROC-BUG", "DEP-CYC", "MGTG-M000", "RSE-SURV"} <= {f["rule"] for f in result["findings"]}
    features = {r.file_path: r for r in QUERIES["jit_features"](spark, tables).collect()}
    assert features["pkg/a.py"].revisions == 4 and features["pkg/a.py"].bug_fix_commits == 4 and features["pkg/b.py"].lines_added == 5
    log = json.loads(analyze(spark, [str(repo)], "mgtg", "sarif", None, tables))
    assert log["runs"][0]["results"]
