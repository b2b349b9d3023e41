"""Queries on fixed sources for rules that the generated files never break, and the rows they must give, worked out by hand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import code_ir as C
from ..operators import imports as I
from ..operators import repair as R
from ..operators import survivability as S

REPAIR = {
    "src/nested.rs": "fn scan(rows: Vec<Row>) {\n    for a in rows {\n        while a.next() {\n            for b in a {\n                db.query(b);\n                db.read(b);\n                fetch(b);\n                lock.unwrap();\n            }\n        }\n    }\n}\n",
    "src/hub.js": "".join(f"function f{i}() {{}}\n" for i in range(7)) + "f0.call();\n",
    "src/circle.rs": "fn foo() { bar(); }\nfn bar() { foo(); }\n",
    "src/deep.rs": "fn g(x: bool) -> Result<i32> {\n" + "if x {\n" * 6 + "}\n" * 7,
    "src/pair.rs": "fn outer() {\n    helper(1);\n    other();\n}\nfn helper(a: i32) {\n}\n",
}
CODE = {
    "a.py": "def load(path):\n    conn = connect(path)\n    if conn is None:\n        pass\n    return conn\n",
    "b.js": "function walk(items) {\n  let total = 0;\n  items.forEach(item => {\n    total = total + item;\n  });\n  for (let a of items) {\n    for (let b of a) {\n      for (let c of b) {\n        walk(c);\n      }\n    }\n  }\n  return total;\n}\n",
}
IMPORTS = {
    "web/main.ts": "import x from 'lib';\nexport { q } from './part';\nimport('late');\n",
    "web/part.ts": "const y = require(\"z\");\n",
}
ROUTES = {
    "app.py": '@app.get("/users")\ndef users():\n    return 1\n',
    "main.rs": 'fn main() { let r = x.route("/items", y); }\n// x.route("/gone", y)\n',
}


def _files(spark: SparkSession, sources: dict[str, str]) -> DataFrame:
    return spark.createDataFrame([("x", p, None, t) for p, t in sources.items()], "analysis_id string, path string, language string, content string")


def repair_examples(spark: SparkSession, d: str) -> DataFrame:
    return R.findings(_files(spark, REPAIR), 0)


def ir_examples(spark: SparkSession, d: str) -> DataFrame:
    return C.findings(C.nodes(_files(spark, CODE)))


def ir_live_examples(spark: SparkSession, d: str) -> DataFrame:
    return C.live_definitions(C.nodes(_files(spark, CODE)))


def import_examples(spark: SparkSession, d: str) -> DataFrame:
    return I.imports(_files(spark, IMPORTS)).select("source", "target", "kind")


def endpoint_examples(spark: SparkSession, d: str) -> DataFrame:
    """Endpoints with the runtime of their repository, which is that of its first file."""
    files = _files(spark, ROUTES)
    languages = files.selectExpr("analysis_id", "path", "CASE WHEN path LIKE '%.py' THEN 'python' ELSE 'rust' END AS language", "content")
    return S.endpoint_scores(S.scores(S.profiles(languages))).select("path", "endpoint", "runtime").distinct()


QUERIES = {f.__name__: f for f in (repair_examples, ir_examples, ir_live_examples, import_examples, endpoint_examples)}


def _rows(columns: str, rows: list[tuple]) -> str:
    return f"SELECT * FROM (VALUES {', '.join(map(str, rows))}) AS t({columns})"


SQL = {
    "repair_examples": _rows(
        "analysis_id, path, engine, rule, severity, line",
        [
            ("x", "src/deep.rs", "refactoring", "REF-NESTING", "warning", 1), ("x", "src/pair.rs", "refactoring", "REF-COUPLING", "warning", 2),
            ("x", "src/hub.js", "coupling", "COUP-HUB", "warning", 1), ("x", "src/circle.rs", "coupling", "COUP-CIRCULAR", "error", 1),
            ("x", "src/nested.rs", "performance", "PERF-IO-HEAVY", "warning", 1), ("x", "src/nested.rs", "performance", "PERF-NESTED-LOOP", "warning", 3),
            ("x", "src/nested.rs", "performance", "PERF-NESTED-LOOP", "error", 4), ("x", "src/nested.rs", "performance", "PERF-SYNC-IO", "warning", 8),
            ("x", "src/nested.rs", "testing_gap", "TEST-NO-BRANCH", "info", 1), ("x", "src/deep.rs", "testing_gap", "TEST-GAP", "warning", 1), ("x", "src/deep.rs", "testing_gap", "TEST-ERROR-PATH", "info", 1),
            ("x", "src/deep.rs", "refactoring", "REF-DUPLICATION", "warning", 1),
        ],
    ),
    "ir_examples": _rows(
        "analysis_id, path, rule, severity, line",
        [
            ("x", "a.py", "MGTG-G000", "warning", 3), ("x", "a.py", "MGTG-G001", "warning", 3), ("x", "a.py", "MGTG-M000", "error", 2), ("x", "a.py", "MGTG-M100", "warning", 2),
            ("x", "b.js", "MGTG-P000", "info", 1), ("x", "b.js", "MGTG-P001", "info", 1), ("x", "b.js", "MGTG-M200", "info", 3),
        ],
    ),
    "ir_live_examples": _rows("analysis_id, path, func, name", [("x", "a.py", "load", "conn"), ("x", "b.js", "walk", "total")]),
    "import_examples": _rows("source, target, kind", [("web/main.ts", "lib", "static"), ("web/main.ts", "./part", "reexport"), ("web/main.ts", "late", "dynamic"), ("web/part.ts", "z", "static")]),
    "endpoint_examples": _rows("path, endpoint, runtime", [("app.py", "/users", "python"), ("main.rs", "/items", "python")]),
}
