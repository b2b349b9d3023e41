import json
import subprocess

import pytest
from pyspark.sql import functions as F

from riskloom import sinks
from riskloom.operators import validation as V
from riskloom.operators.process import FEATURES
from riskloom.sources import files as S
from riskloom.sources import gitlog
from riskloom.streaming import changes as W


def test_git_source(spark, tmp_path):
    repo = tmp_path / "demo"
    repo.mkdir()
    run = lambda *a: subprocess.run(["git", "-C", str(repo), "-c", "user.name=Zoë", "-c", "user.email=z@e.example", *a], check=True, capture_output=True)
    run("init", "-q")
    (repo / "lib.rs").write_text("a\nb\n")
    run("add", "."), run("commit", "-qm", "first\n\nbody")
    (repo / "lib.rs").write_text("a\nc\nd\n")
    (repo / "日本 x.py").write_text("1\n")
    run("add", "."), run("commit", "-qm", "second")
    gitlog.register(spark)
    rows = spark.read.format("gitlog").load(str(repo)).collect()
    got = {(r.message, r.file_path): (r.lines_added, r.lines_deleted, r.change_type) for r in rows}
    assert got == {("second", "lib.rs"): (2, 1, "Modified"), ("second", "日本 x.py"): (1, 0, "Added"), ("first\n\nbody", "lib.rs"): (2, 0, "Added")}
    assert {r.analysis_id for r in rows} == {"demo"} and {r.author for r in rows} == {"Zoë"}
    assert spark.read.format("gitlog").option("max_commits", 1).load(str(repo)).select("hash").distinct().count() == 1
    with pytest.raises(Exception, match="can't be read"):
        spark.read.format("gitlog").load(str(tmp_path)).count()


def test_git_source_has_merged_branches(spark, tmp_path):
    repo = tmp_path / "merged"
    repo.mkdir()
    run = lambda *a: subprocess.run(["git", "-C", str(repo), "-c", "user.name=Z", "-c", "user.email=z@e.example", *a], check=True, capture_output=True, text=True).stdout

    def commit(name, text, message):
        (repo / name).write_text(text)
        run("add", "."), run("commit", "-qm", message)

    run("init", "-q", "-b", "main")
    commit("a.py", "1\n2\n", "first")
    for k in (1, 2):  # two merges
        run("checkout", "-q", "-b", f"side{k}")
        commit(f"s{k}.py", "x\ny\nz\n", f"side {k}")
        run("checkout", "-q", "main")
        commit("a.py", f"{k}\n2\n3\n", f"main {k}")
        run("merge", "-q", "--no-ff", f"side{k}", "-m", f"merge {k}")
    run("mv", "s1.py", "t1.py"), run("commit", "-qm", "move")
    run("commit", "-q", "--allow-empty", "-m", "nothing\x1e\x1f\n\n:100644 odd")
    rows = list(gitlog.walk(str(repo)))
    assert len({r[0] for r in rows}) == int(run("rev-list", "--count", "HEAD")) == 9
    assert {r[4] for r in rows if r[5]} == {"merge 1", "merge 2"} and [r[6] for r in rows if r[4] == "merge 2"] == ["s2.py"]
    stat = run("log", "--diff-merges=first-parent", "--no-renames", "--numstat", "--format=").split("\n")
    assert sum(r[7] or 0 for r in rows) == sum(int(x.split("\t")[0]) for x in stat if x) and sum(r[8] or 0 for r in rows) == sum(int(x.split("\t")[1]) for x in stat if x)
    assert {(r[6], r[9]) for r in rows if r[4] == "move"} == {("s1.py", "Deleted"), ("t1.py", "Added")}
    assert {(r[6], r[9]) for r in gitlog.walk(str(repo), renames=True) if r[4] == "move"} == {("t1.py", "Renamed")}
    assert [r[6:] for r in rows if r[4].startswith("nothing")] == [(None,) * 4] and len(list(gitlog.walk(str(repo), 2))) >= 2


def test_code_files(spark, tmp_path):
    root = tmp_path / ".hidden" / "root"
    for name, data in {"a.py": b"x = 1", "node_modules/b.py": b"1", "c/.d/e.py": b"1", "f.py": b"a\0b", "g.PY": b"2", "h.py": b"\xff\xfe", "vendored.py": b"3"}.items():
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(data)
    assert {r.path for r in S.code_files(spark, str(root), ("py",)).collect()} == {"a.py", "g.PY", "vendored.py"}


def test_config(spark, tmp_path):
    (tmp_path / "c.toml").write_text('[a]\nb = "${X:1}"\nc = "${NOSUCH}"\n')
    c = S.load_config(str(tmp_path / "c.toml"), {"X": "2"})
    assert c == {"a": {"b": "2", "c": ""}} and S.get_config(c, "a.b") == "2" and S.get_config(c, "a.z", 5) == 5 and S.merge_config(c, {"a": {"b": 3}}) == {"a": {"b": 3, "c": ""}}
    assert S.layers_of('[[layers]]\nname = "web"\nallowed_deps = ["db"]\n') == {"web": ["db"]}
    with pytest.raises(ValueError, match="DEP-CFG001"):
        S.layers_of("[[layers")
    assert S.request('{"repo_path": "x"}')["commit_hash"] == "HEAD" and S.github_name("https://github.com/a/b.git") == "a/b" and S.github_name("http://x.y/a/b") is None
    (tmp_path / "f.json").write_text('[{"id": "1", "verdict": "Correct", "timestamp": 3}]')
    assert S.feedback(spark, str(tmp_path / "f.json")).first().timestamp == 3


def test_tables(spark, tmp_path):
    df = lambda rows: spark.createDataFrame(rows, "analysis_id string, hash string, n int")
    path = str(tmp_path / "t")
    sinks.append_new(df([("a", "1", 1), ("a", "1", 2)]), path, ["analysis_id", "hash"])
    sinks.append_new(df([("a", "1", 3), ("b", "2", 4)]), path, ["analysis_id", "hash"])
    assert spark.read.parquet(path).count() == 2
    sinks.upsert(df([("b", "9", 9)]), path)
    assert {(r.analysis_id, r.hash) for r in spark.read.parquet(path).collect()} == {("a", "1"), ("b", "9")}
    sinks.upsert(df([("b", "9", 10), ("b", "8", 8), ("b", "8", 8), ("c", "1", 1)]), path, ["analysis_id", "hash"])
    sinks.upsert(df([("a", "2", 2)]), path, ["analysis_id", "hash"])
    assert {(r.analysis_id, r.hash, r.n) for r in spark.read.parquet(path).collect()} >= {("a", "2", 2), ("b", "9", 10), ("b", "8", 8), ("c", "1", 1)} and spark.read.parquet(path).count() == 5
    sinks.upsert(df([("n", "1", 1)]), str(tmp_path / "new"), ["analysis_id", "hash"])
    assert spark.read.parquet(str(tmp_path / "new")).count() == 1
    entry = lambda i: spark.createDataFrame([(i, "f", "rse", "a", 1, "Correct", None, None, 5, None)], S.FEEDBACK)
    for i in ("1", "2", "1"):
        sinks.append_feedback(entry(i), str(tmp_path / "fb"))
    assert sorted(r.id for r in spark.read.schema(S.FEEDBACK).json(str(tmp_path / "fb")).collect()) == ["1", "2"]
    features = spark.createDataFrame([], "file_path string, " + ", ".join(f"{c} double" for c in FEATURES))
    sinks.write_features_csv(features, str(tmp_path / "csv"))
    assert spark.read.text(str(tmp_path / "csv")).first().value.count(",") == 14


def test_texts(spark):
    f = spark.createDataFrame([("R1", "critical", 'a|"b"', "x.py", 0), ("R2", "info", "m", "日本.py", 3)], "rule string, severity string, message string, file_path string, line int")
    log = json.loads(sinks.sarif(f))
    assert log["version"] == "2.1.0" and {r["level"] for r in log["runs"][0]["results"]} == {"error", "note"}
    assert log["runs"][0]["results"][0]["locations"][0]["physicalLocation"]["region"]["startLine"] >= 1
    text = sinks.markdown(f, 0.8)
    assert text.startswith("## Risk 0.80 (HIGH)") and text.index("R1") < text.index("R2") and "a\\|" in text and sinks.markdown(f.limit(0), 0.1).endswith("no findings")
    nodes = spark.createDataFrame([("an", 'src/a"b.py')], "analysis_id string, id string")
    edges = spark.createDataFrame([("an", "x", "y", "dynamic")], "analysis_id string, source_id string, target_id string, kind string")
    cycles = spark.createDataFrame([("an", "x", "x"), ("an", "x", "y")], "analysis_id string, component string, id string")
    dot = sinks.dot(nodes, edges, cycles)
    assert '[label="a\\"b.py"]' in dot and "style=dashed, color=orange" in dot and "// cycle: x, y" in dot
    assert json.loads(sinks.graph_report(nodes, edges).first().report)["dynamic"] == 1
    lines = sinks.graph_lines(nodes.withColumns({c: F.lit(None).cast("string") for c in ("file_path", "module_name", "language")}) if "file_path" not in nodes.columns else nodes, edges.withColumn("line", F.lit(1)))
    assert {r.kind for r in lines.collect()} == {"node", "edge"} and all(json.loads(r.line) for r in lines.collect())


def test_validation(spark):
    f = spark.createDataFrame([(str(i), "e", s, "f.py", 1, f"m{i}") for i, s in enumerate(["error", "warning", "warning", "error"])], "finding_id string, engine string, severity string, file_path string, line int, message string")
    answers = {"m0": '{"is_valid": true, "confidence": 2, "suggested_fix": "null"}', "m1": '```json\n{"confidence": -1, "explanation": "x", "suggested_fix": "do"}\n```', "m2": "garbage"}

    def client(prompt):
        return answers[prompt.rsplit("Message: ", 1)[1]]

    got = {r.finding_id: r for r in V.parse(V.ask(f, client)).collect()}
    assert (got["0"].is_valid, got["0"].confidence, got["0"].suggested_fix) == (True, 1.0, None) and (got["1"].confidence, got["1"].suggested_fix) == (0.0, "do")
    assert (got["2"].is_valid, got["2"].confidence) == (True, 0.5) and not got["3"].is_valid and "m3" in got["3"].suggested_fix
    cache = f.limit(1).withColumn("key", V.cache_key())
    assert V.to_validate(f, cache).count() == 3
    r = V.risk(f.join(V.parse(V.ask(f, client)).drop("x"), "finding_id")).first()
    assert r.blocked and 0 <= r.risk <= 1


def test_streams(spark, tmp_path):
    src = str(tmp_path / "in")
    rows = [("an", f"c{i % 40}", "f.py", i % 5 + 1, 1_700_000_000 + i * 3600) for i in range(80)]
    spark.createDataFrame(rows, "analysis_id string, hash string, file_path string, l long, s long").withColumn("at", F.timestamp_seconds("s")).drop("s").write.parquet(src)
    stream = spark.readStream.schema("analysis_id string, hash string, file_path string, l long, at timestamp").parquet(src)

    def run(df, name, mode):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(name)

    assert run(W.deduplicated(stream, "30 days"), "dedup", "append").count() == 40
    ent = run(W.windowed_entropy(stream, "1 day", "1 day", "1 hour"), "entropy", "update")
    assert ent.count() >= 3 and ent.where("entropy < 0 OR entropy > 7").count() == 0
    s = run(W.sessions(stream.select(F.col("file_path").alias("key"), "at"), "90 minutes", "1 hour"), "sess", "append")
    assert s.columns == ["key", "start", "end", "n"]


def test_validation_in_one_call(spark):
    rows = [("f1", "rse", "error", "a.py", 1, "m1"), ("f2", "ml", "error", "b.py", 2, "m2"), ("f3", "rse", "warning", "c.py", 3, "m3")]
    found = spark.createDataFrame(rows, "finding_id string, engine string, severity string, file_path string, line int, message string")
    answer = lambda prompt: json.dumps({"is_valid": "m1" in prompt, "confidence": 0.5})
    out = {r.finding_id: r for r in V.validate(found, answer).collect()}
    assert set(out) == {"f1", "f3"} and out["f1"].is_valid and not out["f3"].is_valid
    cache = spark.createDataFrame([("f3:c.py:3:m3", True, 0.9, "e", None)], "key string, is_valid boolean, confidence double, explanation string, suggested_fix string")
    out = {r.finding_id: r for r in V.validate(found, None, cache).collect()}
    assert out["f3"].confidence == 0.9 and out["f1"].confidence == 0.5 and out["f1"].is_valid
    assert V.risk(V.validate(found, answer)).first().risk == pytest.approx(0.15) and V.validate(found.limit(0), answer).count() == 0
