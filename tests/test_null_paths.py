from riskloom.operators import code_ir as C

LONG = " && ".join(f"condition_{i}" for i in range(40))
JS = f"""function f(x) {{
    if (x === null) {{
        g(x);
    }}
    if (typeof x === 'undefined') {{
        g(x);
    }} else {{
        h(x);
    }}
    if (x != null) {{}} else {{
        h(x);
    }}
    if (x > 1) {{ return null; }}
    if ({LONG} && x === undefined) {{
        g(x);
    }}
    if (x &&
        y === null) {{
        g(x);
    }}
    if ((x) == null) {{
        g(x);
    }} else {{
    }}
}}
"""
RS = "fn f(x: Option<i32>) {\n    if x == None {\n        g();\n    }\n    if x == None {\n        g();\n    } else {\n        h();\n    }\n}\n"
PY = f"def f(x):\n    if x is None:\n        g(x)\n    if x is None:\n        g(x)\n    else:\n        h(x)\n    if {LONG.replace('&&', 'and')} and x is None:\n        g(x)\n    if x is None:\n        g(x)\n    else:\n        pass\n    y = 1 if x is None else 2\n"


def test_null_paths_of_every_language_and_length(spark):
    files = spark.createDataFrame([("an", "a.js", JS), ("an", "b.rs", RS), ("an", "c.py", PY)], "analysis_id string, path string, content string")
    got = {(r.path, r.line) for r in C.findings(C.nodes(files)).where("rule = 'MGTG-G001'").collect()}
    assert {line for p, line in got if p == "a.js"} == {2, 10, 14, 17, 21}
    assert {line for p, line in got if p == "b.rs"} == {2}
    assert {line for p, line in got if p == "c.py"} == {2, 8, 10}
