import time

from riskloom.operators import code_ir as C
from riskloom.operators import imports as I
from riskloom.operators import repair as R

PY = "import os, sys as s\nfrom . import a\nfrom ..b.c import d, e as f\n\ndef g(x):\n    h = open('f')\n    if x is None:\n        pass\n    for i in x:\n        while i:\n            for j in i:\n                g(j)\n    return h\n"
RS = "pub fn foo(x: i32) -> i32 {\n    if x > 1 { return 1; }\n    if x > 2 {\n        y();\n    } else if x > 3 {\n        z();\n    } else {\n        z();\n    }\n    for a in b {\n        match a {\n            _ => y(),\n        }\n    }\n    0\n}\n"


def files(spark, rows):
    return spark.createDataFrame([("an", p, t) for p, t in rows], "analysis_id string, path string, content string")


def test_imports(spark):
    rows = [("p/q/m.py", PY), ("a.ts", "import x from 'lib';\nconst y = require(\"z\");\nexport { q } from './r';\nimport('dyn')"), ("B.java", "import static a.b.C;\nimport d.e.*;"), ("c.go", "import \"fmt\"\nimport (\n  \"os\"\n  x \"net/http\"\n)"), ("d.py", None), ("e.txt", "import x")]
    got = {(r.source, r.target, r.kind) for r in I.imports(files(spark, rows)).collect()}
    assert {t for s, t, _ in got if s == "p/q/m.py"} == {"os", "sys", ".", ".a", "..b.c", "..b.c.d", "..b.c.e"}
    assert {(t, k) for s, t, k in got if s == "a.ts"} == {("lib", "static"), ("z", "static"), ("./r", "reexport"), ("dyn", "dynamic")}
    assert {t for s, t, _ in got if s == "B.java"} == {"a.b.C", "d.e.*"} and {t for s, t, _ in got if s == "c.go"} == {"fmt", "os", "net/http"}
    nodes, edges = I.module_graph(files(spark, rows))
    assert {"p.q.m", "p.q.a", "p.b.c", "p.b.c.d"} <= {r.id for r in nodes.collect()} and edges.count() == len(got)


def test_trees(spark):
    tree = C.nodes(files(spark, [("a.py", PY), ("b.rs", RS), ("bad.py", "def ("), ("nul.py", "a\0b"), ("none.py", None), ("deep.py", "x = " + "(" * 90 + "1" + ")" * 90)]))
    m = {r.path: r for r in C.metrics(tree).collect()}
    assert m["a.py"].cyclomatic == 5 and m["a.py"].loop_nesting == 3 and m["b.rs"].cyclomatic == 6 and "nul.py" not in m and m["bad.py"].cyclomatic == 1
    f = {(r.path, r.rule, r.line) for r in C.findings(tree).collect()}
    assert ("a.py", "MGTG-P000", 1) in f and ("a.py", "MGTG-P001", 1) in f and ("a.py", "MGTG-G001", 7) in f and ("a.py", "MGTG-M000", 6) in f and ("a.py", "MGTG-M100", 6) not in f
    assert ("b.rs", "MGTG-G000", 2) not in f and ("b.rs", "MGTG-G000", 3) not in f
    h = {r.path: r.health for r in C.file_health(tree).collect()}
    assert 0 <= h["a.py"] < h["b.rs"] <= 1
    closed = C.nodes(files(spark, [("c.py", "def f():\n    s = open('x')\n    s.close()\n")]))
    assert C.leaks(closed).count() == 0 and C.leaks(tree).count() == 1 and C.nodes(files(spark, [])).count() == 0


def of(rows, kind):
    return [(r[3], r[4]) for r in rows if r[2] == kind]


def test_uses_returns_and_captures():
    js = C.brace_nodes("function f(a) {\n  let k = 1;\n  let conn = open(a);\n  let g = (x) => x + k;\n  items.map(y => {\n    let t = y.size;\n    send(t, k, a);\n  });\n  return conn;\n}\n")
    assert ("a", 3) in of(js, "use") and ("k", 4) in of(js, "use") and ("conn", 9) in of(js, "use") and ("k", 2) not in of(js, "use")
    assert of(js, "returned") == [("conn", 9)] and of(js, "capture") == [("k", 4), ("a", 5), ("k", 5)]
    rs = C.brace_nodes("fn f(a: i32) -> i32 {\n    let conn_handle = connect(a);\n    let g = |x| x + a;\n    return (conn_handle, g);\n}\n")
    assert of(rs, "returned") == [("conn_handle", 4), ("g", 4)] and of(rs, "capture") == [("a", 3)] and of(rs, "define") == [("conn_handle", 2), ("g", 3)]
    py = C.python_nodes("def f(a):\n    k = 1\n    g = lambda x: x + k + len(a)\n    def h(b):\n        c = b\n        return c + k\n    return g, h\n")
    assert of(py, "capture") == [("a", 3), ("k", 3), ("k", 4)] and ("g", 7) in of(py, "returned") and ("h", 7) in of(py, "returned")
    assert C.brace_nodes("") == [] and C.python_nodes("") == []
    began = time.time()
    C.brace_nodes("if (a) {\n} else {\n}\n" * 20_000)
    assert time.time() - began < 20


def test_resources_that_leave(spark):
    tree = C.nodes(files(spark, [("a.py", "def f():\n    conn = connect()\n    return conn\n"), ("b.js", "function f() {\n  let conn = connect();\n  return conn;\n}\n"), ("c.js", "function f() {\n  let conn = connect();\n  conn.close();\n}\n")]))
    found = {(r.path, r.rule, r.line) for r in C.findings(tree).collect()}
    assert ("a.py", "MGTG-M100", 2) in found and ("b.js", "MGTG-M100", 2) in found and not any(p == "c.js" and r.startswith("MGTG-M") for p, r, _ in found)
    assert {(r.path, r.name) for r in C.live_definitions(tree).collect()} == {("a.py", "conn"), ("b.js", "conn"), ("c.js", "conn")}


def test_repair(spark):
    big = "def big(a):\n" + "    if a: pass\n" * 32 + "\ndef read_all(x) -> Result<x>:\n    db.read(x)\n    fetch(x)\n    db.query(x)\n    time.sleep(1)\n"
    f = files(spark, [("x.py", big), ("y.rs", "fn a(x: i32) {\n  1;\n  2;\n  3;\n  4;\n}\n"), ("n.py", None)])
    assert {(r.name, r.body_lines) for r in R.functions(f).collect()} == {("big", 32), ("read_all", 4), ("a", 5)}
    got = {(r.path, r.rule, r.severity) for r in R.findings(f, 0).collect()}
    assert {("x.py", "REF-EXTRACT-METHOD", "error"), ("x.py", "DEBT-COMPLEXITY", "error"), ("x.py", "REF-DUPLICATION", "warning"), ("x.py", "PERF-IO-HEAVY", "warning"), ("x.py", "PERF-SYNC-IO", "warning"), ("x.py", "TEST-ERROR-PATH", "info"), ("y.rs", "TEST-NO-BRANCH", "info")} <= got
    assert R.findings(f, 1).groupBy("path", "engine").count().where("count > 1").count() == 0
    assert R.findings(files(spark, []), 0).count() == 0 and {r.place for r in R.recommendations(R.findings(f, 0)).collect() if r.n == 1} >= {1}


def rules(text, path="a.rs"):
    return {(x["item"], x.get("name"), x["line"]): x for x in R.scan_file(text, path)}


def test_repair_scan():
    flat = "fn f() {\n  for a in b {\n  }\n  for a in b {\n  }\n  for a in b {\n  }\n}\n"
    assert not any(k[0] == "loop" for k in rules(flat))
    nested = "fn f() {\n  for a in b {\n    while c {\n      loop {\n      }\n    }\n  }\n}\n"
    assert {(k[2], v["nesting"]) for k, v in rules(nested).items() if k[0] == "loop"} == {(3, 2), (4, 3)} and rules(nested)["function", "f", 1]["nesting"] == 3
    assert not any(k[0] == "loop" for k in rules("for a in b:\n    x\nfor a in b:\n    y\n", "a.py"))
    assert {k[2] for k in rules("for a in b:\n    for c in d:\n        y\n", "a.py") if k[0] == "loop"} == {2}
    r = rules("fn foo() { bar(); }\nfn bar() { foo(); }\n")
    assert {k[1] for k in r if k[0] == "chain"} == {"foo", "bar"}
    r = rules("fn foo() {\n  bar(1);\n  bar(2);\n  x();\n}\nfn bar(a: i32) {\n}\n")
    assert {(k[1], v["other"], k[2]) for k, v in r.items() if k[0] == "coupling"} == {("foo", "bar", 2)}
    many = "".join(f"fn f{i}() {{}}\n" for i in range(7))
    assert all(v["fan_in"] == v["fan_out"] == 0 for k, v in rules(many).items())
    assert rules(many + "f3.x\n")["function", "f3", 4]["fan_in"] == 6 and rules(many + "f3.x\n")["function", "f1", 2]["fan_out"] == 1
    assert ("allocation", None, 1) in rules("let a = vec![new Array, Box::new, Rc::new, Arc::new, Vec::new, String::new, HashMap::new, clone()]; malloc format!( to_owned()\n")
    assert rules("fn q() {\n a.unwrap();\n db.read();\n}")["blocking", None, 2] and not any(k[0] == "blocking" for k in rules("fn q() {\n a.unwrap();\n}"))
    assert ("error", "load", 1) in rules("fn load() -> Result<A> {\n}") and not any(k[0] == "error" for k in rules("fn load() -> Result<A> {\n}\nfn test_load() {}"))
    assert rules("") == {} and rules("fn" * 9) == {} and rules("}}}}\nfn a() {\n")["function", "a", 2]["body_lines"] == 1
    deep = "fn g() {\n" + "if x {\n" * 7 + "}\n" * 8
    assert rules(deep)["function", "g", 1]["nesting"] == 7 and rules(deep)["function", "g", 1]["cyclomatic"] == 8
    began = time.time()
    R.scan_file("fn a() {\n" * 20_000, "a.rs")
    assert time.time() - began < 20
