import random

from riskloom.llm.handwritten import describe, not_handwritten, path_tokens, tool_path


def test_paths():
    for p in ("vendor/x/a.go", "web/node_modules/y/lib/b.js", "a/b.min.js", "a/b-min.js", "p/x_pb2.py", "q/zz_generated.a.go", "dist/w.f4fdfb05.js", "external/lib-1.2.3/A.java"):
        assert tool_path(p), p
    for p in ("src/vendor_portal/a.go", "src/report/generated_view.ts", "tools/minify_x.js", "src/external_accounts/a.py", "src/build/a.py", "", "minimum.js"):
        assert not tool_path(p), p
    assert "folder:external" in path_tokens("external-1.2.3/a.js") and path_tokens("") and path_tokens("/")


def test_notice_counts_in_header_comments_only():
    assert describe("// Code generated by x. DO NOT EDIT.\nvar a = 1")[-2] == "generated"
    assert describe("# lib v1.2.3 - (c) The lib contributors, MIT License\nx = 1")[-2] == "vendored"
    assert describe('HEADER = "# Code generated by x. DO NOT EDIT."\nx = 1')[-2] is None
    assert describe("/*! b 1 */function(){}")[-2] == "build" and describe(None)[-2] is None and describe("")[-2] is None
    shown = describe("// Code generated by x. DO NOT EDIT.\nvar a = 1")[:-2]
    assert shown == describe("var a = 1")[:-2]  # the notice is hidden from the features


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice("ticket lease budget shard report metric cursor offset".split())
    hand = lambda: "\n\n".join(f"# Checks the {word()}.\ndef {word()}_{word()}(x, limit={rng.randint(1, 99)}):\n    if x > limit:\n        return {word()}\n    return x + {rng.randint(1, 99)}" for _ in range(rng.randint(3, 9)))
    mini = lambda: "!function(){" + "".join(f"var {rng.choice('abcxyz')}={rng.choice('pqr')}[{rng.randint(0, 300)}];if({rng.choice('abc')}&&{rng.choice('xyz')}<{rng.randint(0, 99)})k=v;" for _ in range(30)) + "}()"
    stub = lambda: "\n".join(f"var F{i:03} = {rng.randint(1, 9999)};" for i in range(rng.randint(20, 50)))
    data = lambda: "X = [" + ", ".join(f"0x{rng.randint(0, 255):02x}" for _ in range(200)) + "]"
    files, truth = [], set()
    for i in range(600):
        kind = rng.random()
        path, text = f"src/{word()}/f{i}.py", hand()
        if kind < 0.12:
            text, bad = ("/*! b 7 */" if rng.random() < 0.5 else "") + mini(), True
        elif kind < 0.24:
            text, bad = ("// @generated from x\n" if rng.random() < 0.7 else "") + stub(), True
        elif kind < 0.3:
            text, bad = data(), True
        elif kind < 0.36:
            path, bad = f"third_party/z/f{i}.py", True
        else:
            bad = False
        files.append(("an", path, text))
        if bad:
            truth.add(path)
    return files, truth


def test_held_out_accuracy_without_notices(spark):
    files, truth = corpus(2)
    src = spark.createDataFrame([(*f, "x") for f in files], "analysis_id string, path string, content string, evidence string")
    paths = spark.createDataFrame([(a, p, "x") for a, p, _ in files] * 2 + [("an", None, "x"), (None, "vendor/a.js", "x"), ("an", "vendor/only_path.js", "x"), ("an", "src/only_path.py", "x")], "analysis_id string, file_path string, tool string")
    got = [r.file_path for r in not_handwritten(paths, src).collect()]
    assert len(got) == len(set(got)) and "vendor/only_path.js" in got and "src/only_path.py" not in got
    got = set(got) - {"vendor/only_path.js"}
    right = len(got & truth)
    assert right >= 0.95 * len(truth) and right >= 0.95 * len(got)


def test_without_labels_nulls_and_empty(spark):
    paths = spark.createDataFrame([("an", "a.py"), ("an", "vendor/b.py"), ("an", "")], "analysis_id string, file_path string")
    src = spark.createDataFrame([("an", "a.py", None), (None, None, None), ("an", "zz.py", ""), ("an", "long.py", "x = 1\n" * 50000)], "analysis_id string, path string, content string")
    assert [r.file_path for r in not_handwritten(paths, src).collect()] == ["vendor/b.py"]
    assert not_handwritten(paths.limit(0), src.limit(0)).count() == 0
